"""Property-graph operators over node and edge tables.

Iterative operators write a reliable checkpoint per round and stop when nothing changes.
The frontier and label tables hold one row per node; a hub's edges are split by adaptive
skew handling because they sit on the larger side of an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import CODE_SUFFIXES, CONFIDENCE_RANGES
from feedloom.session import cut_lineage

NODE_ID = r"^[a-z0-9_]+\z"


# --- build -------------------------------------------------------------------------------


def _first_source(tables: list[DataFrame], key: str) -> DataFrame:
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in (key, "_src")]
    best = F.min_by(F.struct(*rest), F.struct("_src", *rest))
    return union.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def merge_nodes(*tables: DataFrame) -> DataFrame:
    """Nodes of all extractions; for a repeated id the first table wins."""
    return _first_source(list(tables), "id")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New attributes overwrite old ones; attributes the new row lacks are kept."""
    merged = old.alias("o").join(new.alias("n"), "id", "full_outer")
    columns = ["id"]
    for c in old.columns:
        if c != "id":
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}"))
    return merged.select(*columns, *[F.col(f"n.{c}") for c in new.columns if c not in old.columns])


def merge_edges(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def incidences(hyperedges: DataFrame) -> DataFrame:
    """(id, label, member) rows of hyperedges with a ``members`` array."""
    return hyperedges.select("id", "label", F.explode("members").alias("member")).distinct()


def member_sets(rows: DataFrame) -> DataFrame:
    """Incidences (id, member and more) reduced to (id, set_key): equal for hyperedges over the same members.

    The key is the number of distinct members with two sums of their hashes, so a hyperedge with very many members is
    summed where its rows lie and never gathered.
    """
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("member")).cast("decimal(38,0)"))
    sums = rows.select("id", "member").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
    return sums.select("id", F.concat_ws(":", "n", "a", "b").alias("set_key"))


def merge_hyperedges(*tables: DataFrame) -> DataFrame:
    """(id, label, member) of all extractions, given as incidences; of hyperedges over the same members the
    one of the first table stays, of one table the one with the lowest id.  An id that comes again with
    other members in a later table is dropped there."""
    tagged = [t.select(F.lit(i).alias("_src"), "id", "label", "member") for i, t in enumerate(tables)]
    union = cut_lineage(reduce(DataFrame.unionByName, tagged).distinct())
    first = union.groupBy("id").agg(F.min("_src").alias("_src"))
    own = union.join(first, ["id", "_src"])
    keyed = member_sets(own).join(first, "id")
    chosen = keyed.groupBy("set_key").agg(F.min_by("id", F.struct("_src", "id")).alias("id")).select("id")
    return own.join(chosen, "id", "left_semi").select("id", "label", "member")


def prune_hyperedges(rows: DataFrame, kept: DataFrame, least: int = 2) -> DataFrame:
    """Incidences of members that are still nodes (``kept``: id), of hyperedges that keep at least ``least`` of them."""
    held = rows.join(kept.select(F.col("id").alias("member")).distinct(), "member", "left_semi")
    enough = held.groupBy("id").agg(F.count_distinct("member").alias("n")).where(F.col("n") >= least).select("id")
    return held.join(enough, "id", "left_semi").select("id", "label", "member")


def edge_errors(edges: DataFrame) -> DataFrame:
    """Edges that break the confidence ranges or the id format, with the reason."""
    score = F.col("confidence_score")
    in_range = F.lit(False)
    for name, (low, high) in CONFIDENCE_RANGES.items():
        in_range = in_range | ((F.col("confidence") == name) & score.between(low, high))
    reason = (
        F.when(score.isNull(), "no score")
        .when(~F.col("source").rlike(NODE_ID) | ~F.col("target").rlike(NODE_ID), "bad id")
        .when(~F.coalesce(in_range, F.lit(False)), "score out of range")
    )
    return edges.withColumn("reason", reason).where(F.col("reason").isNotNull())


def prune(nodes: DataFrame, edges: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes of deleted files and every edge that touches one."""
    gone = nodes.join(deleted.select("source_file").distinct(), "source_file", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    return kept, left.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def new_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("id"), "id", "left_anti")


def new_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["source", "target", "relation"]
    return new.join(old.select(*keys), keys, "left_anti")


def graph_diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, id): nodes and edges of only the new or only the old (nodes, edges)."""

    def said(kind: str, found: DataFrame, name: Column) -> DataFrame:
        return found.select(F.lit(kind).alias("kind"), name.alias("id"))

    pair = F.concat("source", F.lit(">"), "target")
    return (
        said("node", new_nodes(old[0], new[0]), F.col("id"))
        .unionByName(said("edge", new_edges(old[1], new[1]), pair))
        .unionByName(said("removed node", new_nodes(new[0], old[0]), F.col("id")))
        .unionByName(said("removed edge", new_edges(new[1], old[1]), pair))
    )


def incremental_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files new, changed or deleted since the manifest, each flagged as code or not."""
    b = before.select("path", F.col("mtime").alias("_t"))
    status = (
        F.when(F.col("_t").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") != F.col("_t"), "changed")
    )
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    return (
        now.select("path", "mtime")
        .join(b, "path", "full_outer")
        .select("path", status.alias("status"), suffix.isin(*CODE_SUFFIXES).alias("is_code"))
        .where(F.col("status").isNotNull())
    )


def code_only(changes: DataFrame) -> DataFrame:
    """One row: did only code change?"""
    touched = changes.where(F.col("status").isin("new", "changed"))
    return touched.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.bool_and("is_code"), F.lit(True)).alias("code_only"))


# --- search -------------------------------------------------------------------------------


def _hits(label: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    n = F.lit(0)
    for t in terms:
        n = n + low.contains(t.lower()).cast("int")
    return n


def question_terms(question: str) -> list[str]:
    return [t.lower() for t in question.split() if len(t) > 3]


def match_nodes(nodes: DataFrame, terms: list[str], k: int = 3) -> DataFrame:
    """Nodes whose label contains most terms; the greater id first on a tie."""
    return (
        nodes.withColumn("score", _hits(F.col("label"), terms))
        .where(F.col("score") > 0)
        .orderBy(F.desc("score"), F.desc("id"))
        .limit(k)
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without repeats."""
    a = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, depth): every node within ``depth`` hops and its distance."""
    links = cut_lineage(undirected(edges))
    seen = cut_lineage(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        step = links.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def bfs_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, target): steps from each layer to nodes of the next one."""
    a = reached.select(F.col("id").alias("src"), F.col("depth").alias("_da"))
    b = reached.select(F.col("id").alias("dst"), F.col("depth").alias("_db"))
    steps = undirected(edges).join(a, "src").join(b, "dst").where(F.col("_db") == F.col("_da") + 1)
    return steps.select(F.col("src").alias("source"), F.col("dst").alias("target"))


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(hop, id) along a shortest path; among equals the one whose parents sort first.

    The search keeps one parent per node and goes on until the goal is found or nothing is
    left to visit.  The path is gathered from the goal in jumps of 1, 2, 4, ... parents.
    """
    spark = edges.sparkSession
    links = cut_lineage(undirected(edges))
    seen = spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int")
    frontier, found = seen, start == goal
    hop = 0
    while not found:
        hop += 1
        step = (
            links.join(frontier.select(F.col("id").alias("src")), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("src").alias("parent"))
        )
        frontier = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)))
        if not frontier.take(1):
            return spark.createDataFrame([], "hop int, id string")
        seen = seen.unionByName(frontier)
        if hop % 10 == 0:  # keep the plan short
            seen = cut_lineage(seen)
        found = bool(frontier.where(F.col("id") == goal).take(1))
    seen = cut_lineage(seen)
    path = seen.where(F.col("id") == goal).select("id")
    up = seen.where("parent IS NOT NULL").select("id", F.col("parent").alias("up"))
    span = 1
    while span <= hop:
        path = cut_lineage(path.unionByName(path.join(up, "id").select(F.col("up").alias("id"))))
        up = cut_lineage(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")))
        span *= 2
    return seen.join(path, "id", "left_semi").select(F.col("depth").alias("hop"), "id")


def path_relations(path: DataFrame, edges: DataFrame) -> DataFrame:
    """The path with the relation and confidence of each hop, lowest name on parallels."""
    nxt = path.select((F.col("hop") - 1).alias("hop"), F.col("id").alias("next_id"))
    hops = path.join(nxt, "hop", "left")
    both = edges.select("source", "target", "relation", "confidence").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "confidence")
    )
    joined = hops.join(both, (hops.id == both.source) & (hops.next_id == both.target), "left")
    return joined.groupBy("hop", "id").agg(
        F.min("relation").alias("relation"), F.min_by("confidence", "relation").alias("confidence")
    )


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def explain_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Neighbours of a node with relation, confidence and where they come from; ``degree`` counts the node's neighbours."""
    out = edges.where(F.col("source") == node_id).select(F.col("target").alias("id"), "relation", "confidence")
    back = edges.where(F.col("target") == node_id).select(F.col("source").alias("id"), "relation", "confidence")
    links = out.unionByName(back).distinct().withColumn("_node", F.lit(node_id))
    degree = links.where(F.col("id") != F.col("_node")).groupBy("_node").agg(F.count_distinct("id").alias("degree"))
    counted = links.join(degree, "_node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).drop("_node")
    return counted.join(nodes.select("id", "label", "source_file"), "id")


def budgeted_context(nodes: DataFrame, reached: DataFrame, terms: list[str], tokens: int = 2000) -> DataFrame:
    """Node lines by relevance that fit the budget of four characters per token.

    Every line is at least one character, so only the first ``budget`` lines can fit; the
    running sum sees no more rows than that.
    """
    budget = tokens * 4
    line = F.concat(
        F.lit("NODE "), F.col("label"), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit("]")
    )
    ranked = (
        nodes.join(reached.select("id"), "id", "left_semi")
        .select("id", line.alias("line"), _hits(F.col("label"), terms).alias("relevance"))
        .orderBy(F.desc("relevance"), "id")
        .limit(budget)
    )
    order = Window.orderBy(F.desc("relevance"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("used", F.sum(F.length("line") + 1).over(order)).where(F.col("used") <= budget)
    )


def context_lines(nodes: DataFrame, edges: DataFrame, reached: DataFrame, terms: list[str], tokens: int = 2000) -> DataFrame:
    """The subgraph as text within the budget: lines of nodes by relevance, then lines of the steps between layers.

    A node line names file and location (empty where the nodes have none), an edge line the relation, the lowest one of
    parallel edges, and its confidence.  (``place``, ``line``, ``used``).
    """
    budget = tokens * 4
    location = F.coalesce(F.col("source_location"), F.lit("")) if "source_location" in nodes.columns else F.lit("")
    label = F.coalesce("label", "id")
    inside = nodes.join(reached.select("id"), "id", "left_semi").withColumn("_label", label).withColumn("_loc", location)
    of_node = F.concat(F.lit("NODE "), "_label", F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit(" loc="), "_loc", F.lit("]"))
    lines = inside.select(F.lit(0).alias("kind"), (-_hits(F.col("label"), terms)).alias("rank"), F.col("id").alias("place"), of_node.alias("line"))
    # Only lines that can still fit matter: a line takes two characters at least.
    lines = lines.orderBy("rank", "place").limit(budget)
    there = edges.select("source", "target", "relation", "confidence")
    both = there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "confidence"))
    known = both.groupBy("source", "target").agg(F.min("relation").alias("relation"), F.min_by("confidence", F.struct("relation", "confidence")).alias("confidence"))
    named = inside.select("id", "_label")
    steps = bfs_edges(edges, reached).orderBy("source", "target").limit(budget).join(known, ["source", "target"])
    steps = steps.join(named.select(F.col("id").alias("source"), F.col("_label").alias("_from")), "source")
    steps = steps.join(named.select(F.col("id").alias("target"), F.col("_label").alias("_to")), "target")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    of_edge = F.concat(F.lit("EDGE "), "_from", F.lit(" --"), text("relation"), F.lit(" ["), text("confidence"), F.lit("]--> "), "_to")
    steps = steps.select(F.lit(1).alias("kind"), F.lit(0).alias("rank"), F.concat("source", F.lit(">"), "target").alias("place"), of_edge.alias("line"))
    first = lines.unionByName(steps).orderBy("kind", "rank", "place").limit(budget)
    order = Window.orderBy("kind", "rank", "place").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum(F.length("line") + 1).over(order)).where(F.col("used") <= budget).select("place", "line", "used")


# --- analysis ---------------------------------------------------------------------------------


def god_nodes(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Nodes with the most neighbours."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return top.join(nodes.select("id", "label"), "id")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): lowest id reachable from each node.

    Alternates two steps until the links no longer change: every larger neighbour of a node is
    linked to its lowest neighbour, then every node and its smaller neighbours to the lowest of them.
    What is left are stars around the lowest ids.
    """
    links = cut_lineage(undirected(edges).where("src > dst"))
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("src", "_m").alias("_m"))
        large = both.where("dst > src").join(lowest, "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
        large = cut_lineage(large.distinct())
        lowest = large.groupBy("src").agg(F.min("dst").alias("_m"))
        moved = large.join(lowest, "src").where("dst <> _m").select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
        links = cut_lineage(moved.unionByName(lowest.select("src", F.col("_m").alias("dst"))).distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    found = nodes.join(links.select(F.col("src").alias("id"), "dst"), "id", "left")
    return found.select("id", F.coalesce("dst", "id").alias("component"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community) by label propagation; a community is named by its lowest id.

    A node wants the label most frequent among its neighbours, the lowest on a tie, but is
    content with its own label while that is as frequent.  Each round a pseudo-random half of
    the nodes that want another label take it, so neighbours don't swap labels for ever, and the
    rounds end when every node is content.  A hash of id and round is the coin; the answer is
    the same in every run.
    """
    links = cut_lineage(undirected(edges))
    labels = cut_lineage(links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    turn = 0
    while True:
        votes = (
            links.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
            .groupBy(F.col("src").alias("id"), "label")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        own = votes.join(labels.withColumnRenamed("label", "_own"), "id")
        best = own.groupBy("id", "_own").agg(
            F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l"))).alias("_best"),
            F.max("n").alias("_most"),
            F.max(F.when(F.col("label") == F.col("_own"), F.col("n"))).alias("_n"),
        )
        wants = F.coalesce("_n", F.lit(0)) < F.col("_most")
        moves = F.col("_wants") & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        step = cut_lineage(
            best.withColumn("_wants", wants).select("id", "_wants", F.when(moves, F.col("_best")).otherwise(F.col("_own")).alias("label"))
        )
        if not step.where("_wants").take(1):
            break
        labels, turn = step.select("id", "label"), turn + 1
    names = labels.groupBy("label").agg(F.min("id").alias("community"))
    named = labels.join(names, "label").select("id", "community")
    return nodes.select("id").join(named, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def cohesion(members: DataFrame, edges: DataFrame, label: str = "community") -> DataFrame:
    """Internal edges over possible pairs per community; a single node counts as 1."""
    m = members.select("id", F.col(label).alias("_c"))
    sizes = m.groupBy("_c").agg(F.count(F.lit(1)).alias("size"))
    once = undirected(edges).where("src < dst")
    inside = (
        once.join(m.select(F.col("id").alias("src"), F.col("_c").alias("_ca")), "src")
        .join(m.select(F.col("id").alias("dst"), F.col("_c").alias("_cb")), "dst")
        .where("_ca = _cb")
        .groupBy(F.col("_ca").alias("_c"))
        .agg(F.count(F.lit(1)).alias("internal_edges"))
    )
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inside, "_c", "left").select(
        F.col("_c").alias(label),
        "size",
        F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"),
        F.when(F.col("size") > 1, F.round(F.coalesce("internal_edges", F.lit(0)) / pairs, 4)).otherwise(1.0).alias("cohesion"),
    )


def surprising_edges(members: DataFrame, edges: DataFrame, k: int = 10, label: str = "community") -> DataFrame:
    """Edges between communities, least certain first, then between the busiest nodes."""
    m = members.select("id", F.col(label).alias("_c"))
    d = degrees(edges)
    crossing = (
        edges.join(m.select(F.col("id").alias("source"), F.col("_c").alias("_ca")), "source")
        .join(m.select(F.col("id").alias("target"), F.col("_c").alias("_cb")), "target")
        .where("_ca <> _cb")
        .join(d.select(F.col("id").alias("source"), F.col("degree").alias("_da")), "source")
        .join(d.select(F.col("id").alias("target"), F.col("degree").alias("_db")), "target")
    )
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    return (
        crossing.withColumn("_r", rank)
        .orderBy("_r", F.desc(F.col("_da") + F.col("_db")), "source", "target")
        .limit(k)
        .select("source", "target", "relation", "confidence", (F.col("_da") + F.col("_db")).alias("degree_sum"))
    )
