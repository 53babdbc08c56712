"""Similarity, playbook, retrieval and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.fixed_values import STOPWORDS_LESSONS, STOPWORDS_REMINDER, TEMPLATE_RULE, VERDICT_WEIGHT
from feedloom.functions import lessons as lesson_text
from feedloom.operators import graph, ledger, playbook, similarity
from feedloom.plans import adapters as A
from feedloom.plans import checker as K
from feedloom.plans.queries_measure import EFFECTIVENESS, scores
from feedloom.plans.queries_reports import LESSON_ROWS
from feedloom.plans.registry import CHECKS, query


def _token_sql(source: str, key: str, text: str, stop: list[str]) -> str:
    drop = f" WHERE NOT {K.in_list('token', stop)}" if stop else ""
    return f"SELECT * FROM (SELECT DISTINCT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z]{{4,}}')) AS token FROM {source}){drop}"


def _pairs_sql(name: str, tokens: str, threshold: float) -> str:
    """CTEs ``{name}`` (a, b, score) by counting shared tokens; copies against their lowest id."""
    return f"""{name}_t AS ({tokens}), {name}_s AS (SELECT id, count(*) AS n, string_agg(token, ' ' ORDER BY token) AS sig FROM {name}_t GROUP BY id),
{name}_m AS (SELECT id, min(id) OVER (PARTITION BY sig) AS rep, n FROM {name}_s), {name}_r AS (SELECT id, n FROM {name}_m WHERE id = rep),
{name}_x AS (SELECT t.id, t.token FROM {name}_t t JOIN {name}_r USING (id)),
{name}_o AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM {name}_x p JOIN {name}_x q ON p.token = q.token AND p.id < q.id GROUP BY ALL),
{name} AS (SELECT a, b, c / (p.n + q.n - c) AS score FROM {name}_o JOIN {name}_r p ON p.id = a JOIN {name}_r q ON q.id = b WHERE c / (p.n + q.n - c) >= {threshold}
 UNION ALL SELECT rep, id, 1.0 FROM {name}_m WHERE id <> rep)"""


@query(
    "near_duplicates",
    f"""WITH {_pairs_sql('pr', _token_sql('documents', 'doc_id', 'text', STOPWORDS_LESSONS), 0.8)}
SELECT CASE WHEN x.n_chars >= y.n_chars THEN a ELSE b END AS survivor, CASE WHEN x.n_chars >= y.n_chars THEN b ELSE a END AS loser, round(score, 3) AS score,
 greatest(x.n_chars, y.n_chars) AS survivor_n, least(x.n_chars, y.n_chars) AS loser_n FROM pr JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b""",
)
def near_duplicates(spark, sf):
    docs = A.tables(spark, sf, "documents")["documents"]
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("occurrence_count"))
    return similarity.near_duplicates(rows, 0.8)


# Lessons made of the evaluation passages; every third rule is boilerplate.
_ITEMS = """
SELECT concat(CASE WHEN item_id % 4 < 2 THEN 'wrong_column_name_' ELSE 'stale_partition_' END, CASE WHEN item_id % 2 = 0 THEN 'error' ELSE 'drift' END, '_',
   CAST(item_id AS STRING)) AS pattern,
 CASE WHEN item_id % 3 = 0 THEN concat('Avoid ', substring(text, 1, 12), ' — verify before acting.') ELSE text END AS rule, item_id * 7 % 11 AS occurrence_count,
 CASE item_id % 6 WHEN 0 THEN 'regressed' WHEN 1 THEN 'flat' WHEN 2 THEN 'improving' WHEN 3 THEN 'working' WHEN 4 THEN 'resolved' ELSE 'pending' END AS verdict
FROM {benchmark}
"""


def _set_sql(name: str, text: str) -> str:
    stop = K.in_list("x", STOPWORDS_LESSONS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z]{{4,}}')), lambda x: NOT {stop}) AS {name}"


@query(
    "merge_candidates",
    f"""WITH l AS (SELECT pattern, occurrence_count AS n, {_set_sql('rt', 'rule')}, {_set_sql('nt', "replace(pattern, '_', ' ')")}, {K.re('trim(rule)', TEMPLATE_RULE)} AS tm FROM ({_ITEMS})),
p AS (SELECT a.pattern AS a, b.pattern AS b, a.n AS na, b.n AS nb, a.tm AND b.tm AS both_t,
 CASE WHEN len(a.rt) > 0 AND len(b.rt) > 0 THEN len(list_intersect(a.rt, b.rt)) / (len(a.rt) + len(b.rt) - len(list_intersect(a.rt, b.rt))) ELSE 0 END AS r,
 CASE WHEN len(a.nt) > 0 AND len(b.nt) > 0 THEN len(list_intersect(a.nt, b.nt)) / (len(a.nt) + len(b.nt) - len(list_intersect(a.nt, b.nt))) ELSE 0 END AS m
 FROM l a JOIN l b ON a.pattern < b.pattern),
s AS (SELECT *, CASE WHEN both_t THEN 0 ELSE r END AS ro, CASE WHEN both_t THEN CASE WHEN m >= 0.5 THEN m ELSE 0 END ELSE greatest(r, m) END AS score FROM p)
SELECT CASE WHEN na >= nb THEN a ELSE b END AS survivor, CASE WHEN na >= nb THEN b ELSE a END AS loser, round(ro, 3) AS rule_overlap, round(m, 3) AS name_overlap,
 round(score, 3) AS score, greatest(na, nb) AS survivor_n, least(na, nb) AS loser_n FROM s WHERE score >= 0.3""",
)
def merge_candidates(spark, sf):
    return similarity.merge_candidates(A.view(spark, sf, _ITEMS))


@query(
    "resolved_merges",
    f"""WITH RECURSIVE c AS ({CHECKS['merge_candidates']}),
b AS (SELECT loser, survivor FROM c QUALIFY row_number() OVER (PARTITION BY loser ORDER BY score DESC, survivor_n DESC, survivor) = 1),
r(loser, survivor) AS (SELECT loser, survivor FROM b UNION ALL SELECT r.loser, b.survivor FROM r JOIN b ON b.loser = r.survivor)
SELECT survivor, loser FROM r WHERE survivor NOT IN (SELECT loser FROM b)""",
)
def resolved_merges(spark, sf):
    return ledger.resolve_merges(similarity.merge_candidates(A.view(spark, sf, _ITEMS)))


@query(
    "queued_merges",
    f"""WITH q AS ({A.QUEUE}), c AS ({CHECKS['merge_candidates']}), k AS (SELECT *, concat(survivor, '<-', loser) AS pattern FROM c)
SELECT pattern, '{A.QUEUE_AS_OF}' AS detected_at, CAST(NULL AS DOUBLE) AS delta, CAST(survivor_n + loser_n AS INT) AS after_n, 'n/a' AS obj_verdict, 'n/a' AS judge_verdict,
 'pending' AS status, CAST(NULL AS VARCHAR) AS reviewed_at, CAST(NULL AS VARCHAR) AS reviewer, 'lesson_dedup' AS source,
 concat('survivor=', survivor, ', loser=', loser, ', rule_overlap=', CAST(rule_overlap AS DECIMAL(10, 3)), ', name_overlap=', CAST(name_overlap AS DECIMAL(10, 3))) AS note
FROM k WHERE pattern NOT IN (SELECT pattern FROM q WHERE status = 'pending' AND source = 'lesson_dedup')""",
)
def queued_merges(spark, sf):
    return ledger.queue_merges(similarity.merge_candidates(A.view(spark, sf, _ITEMS)), A.view(spark, sf, A.QUEUE), A.QUEUE_AS_OF)


_DIVERSE = "SELECT concat('doc_', lpad(CAST(doc_id AS STRING), 7, '0')) AS pattern, text AS rule FROM {documents}"


@query(
    "diversity_check",
    f"""WITH d AS ({_DIVERSE}), {_pairs_sql('pr', _token_sql('d', 'pattern', 'rule', []), 0.75)}
SELECT a, b, round(score, 3) AS jaccard FROM pr ORDER BY jaccard DESC, a, b LIMIT 20""",
)
def diversity_check(spark, sf):
    return similarity.diversity_check(A.view(spark, sf, _DIVERSE))


_NAMES_G = "SELECT DISTINCT concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)) AS pattern FROM {part}"
_NAMES_W = "SELECT DISTINCT concat('feedback_', replace(p_name, ' ', '_'), '_', lower(p_type)) AS name FROM {part}"


@query(
    "name_overlap",
    f"""WITH g AS ({_NAMES_G}), w AS ({_NAMES_W}), gt AS (SELECT DISTINCT pattern, unnest(regexp_extract_all(lower(pattern), '[a-z]{{4,}}')) AS token FROM g),
wt AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[a-z]{{4,}}')) AS token FROM w)
SELECT pattern, name, count(*) AS shared FROM gt JOIN wt USING (token) GROUP BY ALL HAVING count(*) >= 2""",
)
def name_overlap(spark, sf):
    return similarity.name_overlap(A.view(spark, sf, _NAMES_G), A.view(spark, sf, _NAMES_W))


# --- retrieval and playbook ----------------------------------------------------------------

_WEIGHT = "CASE verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VERDICT_WEIGHT.items()) + " ELSE 0 END"


@query(
    "lesson_retrieval",
    f"""WITH l AS ({_ITEMS}), p AS ({_token_sql('documents', 'doc_id', 'text', STOPWORDS_REMINDER)}),
lt AS ({_token_sql('l', 'pattern', "concat(replace(pattern, '_', ' '), ' ', rule)", STOPWORDS_REMINDER)}),
o AS (SELECT p.id AS prompt_id, lt.id AS pattern, verdict, count(*) AS overlap FROM p JOIN lt USING (token) JOIN l ON l.pattern = lt.id WHERE verdict <> 'resolved' GROUP BY ALL),
s AS (SELECT *, overlap + {_WEIGHT} AS score FROM o WHERE overlap + {_WEIGHT} > 0)
SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, pattern) AS rank FROM s QUALIFY rank <= 3""",
)
def lesson_retrieval(spark, sf):
    items = A.view(spark, sf, _ITEMS)
    prompts = A.tables(spark, sf, "documents")["documents"].select(F.col("doc_id").alias("prompt_id"), "text")
    texts = items.select("pattern", playbook.lesson_text(F.col("pattern"), F.col("rule")).alias("text"))
    return playbook.rank_lessons(prompts, texts, items)


@query(
    "worst_lessons",
    f"""WITH l AS ({_ITEMS}) SELECT pattern, verdict FROM l WHERE verdict IN ('regressed', 'flat', 'pending')
ORDER BY CASE verdict WHEN 'regressed' THEN 0 WHEN 'flat' THEN 1 ELSE 2 END, pattern LIMIT 3""",
)
def worst_lessons(spark, sf):
    items = A.view(spark, sf, _ITEMS)
    return playbook.worst_lessons(items.select("pattern"), items).select("pattern", "verdict")


_FLOOR = f"""WITH l AS ({_ITEMS}), w AS (SELECT pattern FROM l WHERE verdict IN ('regressed', 'flat', 'pending')
 ORDER BY CASE verdict WHEN 'regressed' THEN 0 WHEN 'flat' THEN 1 ELSE 2 END, pattern LIMIT 3),
g AS (SELECT o_custkey AS prompt_id, pattern FROM orders JOIN l ON CAST(regexp_extract(pattern, '(\\d+)$', 1) AS INT) = o_orderkey % 40)
SELECT DISTINCT g.prompt_id, w.pattern FROM g JOIN w ON true WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.prompt_id = g.prompt_id AND h.pattern = w.pattern)"""


@query("floor_lessons", _FLOOR)
def floor_lessons(spark, sf):
    items = A.view(spark, sf, _ITEMS)
    orders = A.tables(spark, sf, "orders")["orders"]
    number = F.regexp_extract("pattern", r"(\d+)$", 1).cast("long")
    ranked = orders.select(F.col("o_custkey").alias("prompt_id"), (F.col("o_orderkey") % 40).alias("_i")).join(
        items.select("pattern", number.alias("_i")), "_i"
    )
    return playbook.floor_lessons(ranked, playbook.worst_lessons(items.select("pattern"), items))


def _bullets(spark, sf):
    df = A.view(spark, sf, LESSON_ROWS)
    lessons = df.select(
        "pattern", "rule", "occurrence_count",
        lesson_text.guess_section(F.col("pattern"), F.col("rule")).alias("section"),
        lesson_text.rule_quality(F.col("rule")).alias("quality"),
    )
    verdicts = df.select("pattern", "verdict", F.lit("no-eval").alias("obj_verdict"), F.lit("no-judge").alias("judge_verdict"))
    return playbook.bullets(lessons, verdicts)


# The wording columns come from the rule_quality check; here the counters are restated.
def _bullet_sql() -> str:
    from feedloom.plans.queries_reports import _QUALITY

    return f"""b AS (SELECT pattern, verdict, CAST(quality AS INT) AS quality, CASE verdict WHEN 'resolved' THEN 3 WHEN 'improving' THEN 2 WHEN 'working' THEN 1 ELSE 0 END
 + CASE WHEN quality >= 3 THEN floor(occurrence_count / 3) WHEN quality >= 2 THEN floor(occurrence_count / 6) ELSE 0 END AS helpful,
 CASE verdict WHEN 'regressed' THEN 3 WHEN 'flat' THEN 1 ELSE 0 END AS harmful,
 CASE verdict WHEN 'regressed' THEN 50 WHEN 'flat' THEN 30 WHEN 'working' THEN 5 WHEN 'improving' THEN 3 WHEN 'resolved' THEN -100 ELSE 0 END + least(quality, 4) * 2 AS priority
 FROM (SELECT *, {_QUALITY} AS quality FROM (SELECT *, trim(rule) AS t FROM ({LESSON_ROWS}))))"""


@query("playbook_counters", f"WITH {_bullet_sql()} SELECT pattern, verdict, quality, CAST(helpful AS BIGINT) AS helpful, CAST(harmful AS BIGINT) AS harmful, CAST(priority AS INT) AS priority FROM b")
def playbook_counters(spark, sf):
    return _bullets(spark, sf).select("pattern", "verdict", "quality", "helpful", "harmful", "priority")


@query(
    "playbook_rank",
    f"WITH {_bullet_sql()} SELECT pattern, CAST(priority AS INT) AS priority, quality FROM b ORDER BY priority DESC, quality DESC, harmful DESC, helpful DESC, pattern LIMIT 40",
)
def playbook_rank(spark, sf):
    return playbook.playbook_rank(_bullets(spark, sf)).limit(40).select("pattern", "priority", "quality")


@query(
    "playbook_cap",
    f"""WITH {_bullet_sql()}, s AS (SELECT b.*, q.seed FROM b JOIN (SELECT pattern, lesson_id % 400 = 0 AS seed FROM ({LESSON_ROWS})) q USING (pattern)),
c AS (SELECT *, CASE WHEN seed THEN 0 WHEN verdict IN ('regressed', 'flat') AND quality >= 2 AND NOT slud THEN 1 ELSE 3 END AS class FROM
 (SELECT s.*, length(trim(rule)) < 24 OR regexp_matches(trim(rule), '(?i)^when .+ risk appears:\\s*stop,?\\s*gather tool evidence') OR regexp_matches(trim(rule), '(?i)^avoid .+ [—-] verify before acting\\.?$') AS slud
  FROM s JOIN (SELECT pattern, rule FROM ({LESSON_ROWS})) USING (pattern)))
SELECT pattern, CAST(class AS INT) AS class FROM c ORDER BY class, priority DESC, quality DESC, harmful DESC, helpful DESC, pattern LIMIT 60""",
)
def playbook_cap(spark, sf):
    seeds = A.view(spark, sf, LESSON_ROWS).select("pattern", (F.col("lesson_id") % 400 == 0).alias("seed"))
    return playbook.playbook_cap(_bullets(spark, sf).join(seeds, "pattern"), 60).select("pattern", "class")


# Bullets with near-copies: descriptions are documents, patterns carry a family prefix.
_DUP_BULLETS = """
SELECT concat(CASE WHEN doc_id % 2 = 0 THEN 'stateless_' ELSE 'tone_' END, lpad(CAST(doc_id AS STRING), 7, '0')) AS pattern, text AS description, CAST(doc_id % 5 AS INT) AS quality,
 doc_id % 7 AS helpful, doc_id % 3 AS harmful, CAST(doc_id % 11 AS INT) AS priority, CASE WHEN doc_id % 4 = 0 THEN 'flat' ELSE 'working' END AS verdict, doc_id % 101 = 0 AS seed FROM {documents}
"""


@query("deduped_bullets")
def deduped_bullets(spark, sf):
    """Greedy by rank, so not a plain SQL statement; tests compare it with a direct loop."""
    return playbook.dedupe_bullets(A.view(spark, sf, _DUP_BULLETS)).select("pattern", "helpful", "harmful", "merged")


@query(
    "sync_priority",
    f"""WITH {EFFECTIVENESS}, e AS (SELECT pattern, 0 AS k FROM esc WHERE escalation_verdict IN ('flat', 'regressed') UNION ALL
 SELECT pattern, 1 FROM esc WHERE verdict = 'regressed' AND after_n >= 5 UNION ALL SELECT pattern, 2 FROM esc WHERE verdict IN ('flat', 'regressed') AND after_n >= 5),
o AS (SELECT pattern, min(k) AS k FROM e GROUP BY pattern ORDER BY k, pattern LIMIT 8) SELECT pattern, verdict, delta FROM o JOIN esc USING (pattern) WHERE verdict NOT IN ('pending', 'no-baseline', 'undated')""",
)
def sync_priority(spark, sf):
    from feedloom.operators import measure

    s = scores(spark, sf)
    return playbook.sync_priority(s, measure.escalation(s)).select("pattern", "verdict", "delta")


@query(
    "verdict_triples",
    f"""WITH {EFFECTIVENESS} SELECT concat('lesson_', pattern) AS subject, 'HAS_VERDICT' AS predicate, verdict AS object,
 format('Behavioral pattern ''{{}}'' has verdict ''{{}}'' (delta: {{:+.4f}}) as of 2024-02-15', pattern, verdict, delta) AS fact, '2024-02-15' AS as_of
FROM esc WHERE verdict NOT IN ('pending', 'stale-pending', 'no-baseline', 'undated')""",
)
def verdict_triples(spark, sf):
    return playbook.verdict_triples(scores(spark, sf), "2024-02-15")


# --- graph ----------------------------------------------------------------------------------

N, E = f"n AS ({A.NODES})", f"e AS ({A.EDGES})"
_UND = f"{E}, u AS (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e)"


def nodes(spark, sf):
    return A.view(spark, sf, A.NODES)


def edges(spark, sf):
    return A.view(spark, sf, A.EDGES)


_NEW_NODES = """
SELECT concat('nation_', CAST(n_nationkey AS STRING)) AS id, lower(n_name) AS label, 'nation' AS file_type, 'second.tbl' AS source_file FROM {nation}
UNION ALL SELECT concat('part_', CAST(p_partkey AS STRING)), p_name, 'part', 'part.tbl' FROM {part}
"""


@query(
    "merged_graph",
    f"WITH {N}, m AS ({_NEW_NODES}) SELECT * FROM n UNION ALL SELECT * FROM m WHERE id NOT IN (SELECT id FROM n)",
)
def merged_graph(spark, sf):
    return graph.merge_nodes(nodes(spark, sf), A.view(spark, sf, _NEW_NODES))


@query("merged_edges", f"WITH {E} SELECT source, target, relation, confidence, confidence_score FROM e")
def merged_edges(spark, sf):
    e = edges(spark, sf)
    return graph.merge_edges(e.where("relation = 'buys_from'"), e.where("relation <> 'buys_from'"))


_HYPER_OLD = """
SELECT concat('nation_', CAST(s_nationkey AS STRING)) AS id, 'suppliers of a nation' AS label, concat('supplier_', CAST(s_suppkey AS STRING)) AS member FROM {supplier}
"""
_HYPER_NEW = """
SELECT concat('again_', CAST(s_nationkey AS STRING)) AS id, 'found again' AS label, concat('supplier_', CAST(s_suppkey AS STRING)) AS member FROM {supplier} WHERE s_nationkey % 2 = 0
UNION ALL SELECT concat('balance_', CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) AS STRING)), 'alike in balance', concat('supplier_', CAST(s_suppkey AS STRING)) FROM {supplier}
UNION ALL SELECT concat('nation_', CAST(s_nationkey AS STRING)), 'changed', 'supplier_1' FROM {supplier}
"""
_HYPER_MERGED = f"""h AS (SELECT 0 AS src, * FROM ({_HYPER_OLD}) UNION SELECT 1, * FROM ({_HYPER_NEW})),
o AS (SELECT * FROM h QUALIFY src = min(src) OVER (PARTITION BY id)),
k AS (SELECT id, min(src) AS src, string_agg(DISTINCT member, ',' ORDER BY member) AS members FROM o GROUP BY id),
c AS (SELECT id FROM k QUALIFY row_number() OVER (PARTITION BY members ORDER BY src, id) = 1),
m AS (SELECT id, label, member FROM o WHERE id IN (SELECT id FROM c))"""


def _hyperedges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.merge_hyperedges(A.view(spark, sf, _HYPER_OLD).distinct(), A.view(spark, sf, _HYPER_NEW).distinct())


@query("merged_hyperedges", f"WITH {_HYPER_MERGED} SELECT * FROM m")
def merged_hyperedges(spark, sf):
    return _hyperedges(spark, sf)


@query(
    "pruned_hyperedges",
    f"""WITH {_HYPER_MERGED}, p AS (SELECT m.* FROM m JOIN {{supplier}} s ON m.member = concat('supplier_', CAST(s_suppkey AS STRING)) WHERE s_acctbal >= 2000)
SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY id) >= 2""",
)
def pruned_hyperedges(spark, sf):
    kept = A.view(spark, sf, "SELECT concat('supplier_', CAST(s_suppkey AS STRING)) AS id FROM {supplier} WHERE s_acctbal >= 2000")
    return graph.prune_hyperedges(_hyperedges(spark, sf), kept)


@query(
    "upserted_graph",
    f"WITH {N}, m AS ({_NEW_NODES}) SELECT * FROM m UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM m)",
)
def upserted_graph(spark, sf):
    return graph.upsert_nodes(nodes(spark, sf), A.view(spark, sf, _NEW_NODES))


@query(
    "edge_errors",
    f"""WITH {E} SELECT source, target, relation, CASE WHEN NOT regexp_matches(source, '^[a-z0-9_]+$') THEN 'bad id' ELSE 'score out of range' END AS reason FROM e
WHERE NOT ((confidence = 'EXTRACTED' AND confidence_score = 1) OR (confidence = 'INFERRED' AND confidence_score BETWEEN 0.4 AND 0.9) OR (confidence = 'AMBIGUOUS' AND confidence_score BETWEEN 0.1 AND 0.3))""",
)
def edge_errors(spark, sf):
    return graph.edge_errors(edges(spark, sf)).select("source", "target", "relation", "reason")


@query("pruned_nodes", f"WITH {N} SELECT * FROM n WHERE source_file <> 'supplier_b.tbl'")
def pruned_nodes(spark, sf):
    gone = nodes(spark, sf).where("source_file = 'supplier_b.tbl'").select("source_file")
    return graph.prune(nodes(spark, sf), edges(spark, sf), gone)[0].select("id", "label", "file_type", "source_file")


@query(
    "pruned_edges",
    f"""WITH {N}, {E}, g AS (SELECT id FROM n WHERE source_file = 'supplier_b.tbl') SELECT source, target, relation FROM e WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)""",
)
def pruned_edges(spark, sf):
    gone = nodes(spark, sf).where("source_file = 'supplier_b.tbl'").select("source_file")
    return graph.prune(nodes(spark, sf), edges(spark, sf), gone)[1].select("source", "target", "relation")


@query(
    "graph_diff",
    f"""WITH {N}, m AS ({_NEW_NODES}), {E} SELECT 'node' AS kind, id FROM m WHERE id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'edge', concat(source, '>', target) FROM e WHERE relation = 'supplies_from'
UNION ALL SELECT 'removed node', id FROM n WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'removed edge', concat(source, '>', target) FROM e WHERE relation = 'in_region'""",
)
def graph_diff(spark, sf):
    e = edges(spark, sf)
    old, new = nodes(spark, sf), A.view(spark, sf, _NEW_NODES)
    before, now = e.where("relation <> 'supplies_from'"), e.where("relation <> 'in_region'")
    return graph.graph_diff((old, before), (new, now))


@query(
    "incremental_files",
    f"""WITH w AS ({A.FILES_NOW}), b AS ({A.FILES_BEFORE}) SELECT coalesce(w.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'deleted' ELSE 'changed' END AS status,
 regexp_matches(lower(coalesce(w.path, b.path)), '\\.(py|ts|js)$') AS is_code FROM w FULL JOIN b ON w.path = b.path WHERE b.path IS NULL OR w.path IS NULL OR b.mtime <> w.mtime""",
)
def incremental_files(spark, sf):
    return graph.incremental_files(A.view(spark, sf, A.FILES_BEFORE), A.view(spark, sf, A.FILES_NOW))


@query(
    "code_only",
    f"SELECT count(*) AS files, coalesce(bool_and(is_code), true) AS code_only FROM ({CHECKS['incremental_files']}) WHERE status IN ('new', 'changed')",
)
def code_only(spark, sf):
    return graph.code_only(incremental_files(spark, sf))


@query(
    "matched_nodes",
    f"""WITH {N} SELECT id, CAST(contains(lower(label), 'customer') AS INT) + CAST(contains(lower(label), '0042') AS INT) + CAST(contains(lower(label), '9') AS INT) AS score
FROM n WHERE contains(lower(label), 'customer') OR contains(lower(label), '0042') OR contains(lower(label), '9') ORDER BY score DESC, id DESC LIMIT 3""",
)
def matched_nodes(spark, sf):
    return graph.match_nodes(nodes(spark, sf), ["customer", "0042", "9"], 3).select("id", "score")


def _reach_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_UND}, r(id, depth) AS (SELECT 'supplier_1', 0 UNION SELECT dst, depth + 1 FROM r JOIN u ON u.src = r.id WHERE depth < {depth})
SELECT id, min(depth) AS depth FROM r GROUP BY id"""


def _start(spark, sf):
    return nodes(spark, sf).where("id = 'supplier_1'")


@query("bfs_depth3", _reach_sql(3))
def bfs_depth3(spark, sf):
    return graph.reach(edges(spark, sf), _start(spark, sf), 3)


@query("reach_depth6", _reach_sql(6))
def reach_depth6(spark, sf):
    return graph.reach(edges(spark, sf), _start(spark, sf), 6)


@query(
    "bfs_edges",
    f"""WITH RECURSIVE {_UND}, r(id, depth) AS (SELECT 'supplier_1', 0 UNION SELECT dst, depth + 1 FROM r JOIN u ON u.src = r.id WHERE depth < 3),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT u.src AS source, u.dst AS target FROM u JOIN m a ON a.id = u.src JOIN m b ON b.id = u.dst WHERE b.depth = a.depth + 1""",
)
def bfs_edges(spark, sf):
    e = edges(spark, sf)
    return graph.bfs_edges(e, graph.reach(e, _start(spark, sf), 3))


@query(
    "shortest_path",
    f"""WITH RECURSIVE {_UND}, p(id, depth, path) AS (SELECT 'nation_0', 0, ['nation_0'] UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM p JOIN u ON u.src = p.id
 WHERE depth < 6 AND NOT list_contains(path, dst) AND (dst LIKE 'nation%' OR dst LIKE 'region%')),
b AS (SELECT path FROM p WHERE id = 'nation_20' ORDER BY depth, path LIMIT 1) SELECT CAST(generate_subscripts(path, 1) - 1 AS INT) AS hop, unnest(path) AS id FROM b""",
)
def shortest_path(spark, sf):
    return graph.shortest_path(edges(spark, sf), "nation_0", "nation_20")


@query(
    "path_relations",
    f"""WITH sp AS ({CHECKS["shortest_path"]}), {E}, both_ways AS (SELECT source, target, relation, confidence FROM e UNION ALL SELECT target, source, relation, confidence FROM e),
hops AS (SELECT sp.hop, sp.id, nx.id AS next_id FROM sp LEFT JOIN sp nx ON nx.hop = sp.hop + 1)
SELECT hop, id, min(relation) AS relation, arg_min(confidence, relation) AS confidence FROM hops LEFT JOIN both_ways ON source = id AND target = next_id GROUP BY hop, id""",
)
def path_relations(spark, sf):
    """The path with the relation of each hop."""
    e = edges(spark, sf)
    return graph.path_relations(graph.shortest_path(e, "nation_0", "nation_20"), e)


@query(
    "explained_node",
    f"""WITH {N}, {E}, x AS (SELECT target AS id, relation, confidence FROM e WHERE source = 'nation_3' UNION SELECT source, relation, confidence FROM e WHERE target = 'nation_3')
SELECT x.*, (SELECT count(DISTINCT id) FROM x WHERE id <> 'nation_3') AS degree, label, source_file FROM x JOIN n USING (id)""",
)
def explained_node(spark, sf):
    return graph.explain_node(nodes(spark, sf), edges(spark, sf), "nation_3")


@query(
    "budgeted_context",
    f"""WITH RECURSIVE {N}, {_UND}, r(id, depth) AS (SELECT 'supplier_1', 0 UNION SELECT dst, depth + 1 FROM r JOIN u ON u.src = r.id WHERE depth < 3),
l AS (SELECT id, concat('NODE ', label, ' [src=', source_file, ']') AS line, CAST(contains(lower(label), 'supplier') AS INT) AS relevance FROM n WHERE id IN (SELECT id FROM r)),
c AS (SELECT *, CAST(sum(length(line) + 1) OVER (ORDER BY relevance DESC, id) AS BIGINT) AS used FROM l) SELECT * FROM c WHERE used <= 8000""",
)
def budgeted_context(spark, sf):
    reached = graph.reach(edges(spark, sf), _start(spark, sf), 3)
    return graph.budgeted_context(nodes(spark, sf), reached, ["supplier"])


@query(
    "context_lines",
    f"""WITH RECURSIVE {N}, {_UND}, rr(id, depth) AS (SELECT 'supplier_1', 0 UNION SELECT dst, depth + 1 FROM rr JOIN u ON u.src = rr.id WHERE depth < 3),
r AS (SELECT id, min(depth) AS depth FROM rr GROUP BY id),
bw AS (SELECT source, target, relation, confidence FROM e UNION ALL SELECT target, source, relation, confidence FROM e),
k AS (SELECT source, target, min(relation) AS relation, arg_min(confidence, (relation, confidence)) AS confidence FROM bw GROUP BY ALL),
l AS (SELECT 0 AS kind, -CAST(contains(lower(label), 'customer') AS INT) AS rank, id AS place, concat('NODE ', label, ' [src=', source_file, ' loc=]') AS line FROM n WHERE id IN (SELECT id FROM r)
 UNION ALL SELECT 1, 0, concat(a.id, '>', b.id), concat('EDGE ', x.label, ' --', k.relation, ' [', k.confidence, ']--> ', y.label)
 FROM r a JOIN k ON k.source = a.id JOIN r b ON b.id = k.target AND b.depth = a.depth + 1 JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id),
c AS (SELECT *, CAST(sum(length(line) + 1) OVER (ORDER BY kind, rank, place) AS BIGINT) AS used FROM l) SELECT place, line, used FROM c WHERE used <= 400000""",
)
def context_lines(spark, sf):
    e = edges(spark, sf)
    return graph.context_lines(nodes(spark, sf), e, graph.reach(e, _start(spark, sf), 3), ["customer"], 100_000)


_DEG = "d AS (SELECT src AS id, count(*) AS degree FROM u GROUP BY src)"


@query("god_nodes", f"WITH {N}, {_UND}, {_DEG} SELECT id, degree, label FROM d JOIN n USING (id) ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark, sf):
    return graph.god_nodes(nodes(spark, sf), edges(spark, sf), 10)


@query(
    "components",
    f"""WITH RECURSIVE {N}, {_UND}, hub AS (SELECT src AS id, min(dst) AS h FROM u WHERE src LIKE 'customer%' OR src LIKE 'supplier%' GROUP BY src),
core AS (SELECT src, dst FROM u WHERE (src LIKE 'nation%' OR src LIKE 'region%') AND (dst LIKE 'nation%' OR dst LIKE 'region%')),
c(id, other) AS (SELECT id, id FROM n WHERE id LIKE 'nation%' OR id LIKE 'region%' UNION SELECT c.id, core.dst FROM c JOIN core ON core.src = c.other),
cl AS (SELECT id, list(other) AS members FROM c GROUP BY id), m AS (SELECT n.id, CASE WHEN hub.h IS NOT NULL THEN hub.h WHEN n.id LIKE 'nation%' OR n.id LIKE 'region%' THEN n.id END AS core_id FROM n LEFT JOIN hub USING (id)),
g AS (SELECT m.id, coalesce(array_to_string(list_sort(members), ','), m.id) AS grp FROM m LEFT JOIN cl ON cl.id = m.core_id)
SELECT id, min(id) OVER (PARTITION BY grp) AS component FROM g""",
)
def components(spark, sf):
    return graph.components(nodes(spark, sf), edges(spark, sf))


_BLOCKS = "SELECT s_suppkey AS k, (s_suppkey - s_suppkey % 5) AS block FROM {supplier}"


@query(
    "clique_communities",
    f"""WITH b AS ({_BLOCKS}) SELECT concat('supplier_', CAST(k AS STRING)) AS id, min(concat('supplier_', CAST(k AS STRING))) OVER (PARTITION BY block) AS community FROM b""",
)
def clique_communities(spark, sf):
    """Suppliers in disjoint cliques of at most five, where label propagation has one answer."""
    keys = A.view(spark, sf, _BLOCKS)
    name = lambda c: F.concat(F.lit("supplier_"), F.col(c).cast("string"))
    links = keys.join(keys.select(F.col("k").alias("other"), "block"), "block").where("k < other")
    return graph.communities(keys.select(name("k").alias("id")), links.select(name("k").alias("source"), name("other").alias("target")))


@query("communities")
def communities(spark, sf):
    """Label propagation; tests check that every node is content with its label."""
    return graph.communities(nodes(spark, sf), edges(spark, sf))


_TYPE = "m AS (SELECT id, CASE WHEN file_type IN ('customer', 'supplier') THEN 'party' ELSE 'place' END AS community FROM n)"


def _typed(spark, sf):
    return nodes(spark, sf).select("id", F.when(F.col("file_type").isin("customer", "supplier"), "party").otherwise("place").alias("community"))


@query(
    "cohesion",
    f"""WITH {N}, {_UND}, {_TYPE}, s AS (SELECT community, count(*) AS size FROM m GROUP BY community),
i AS (SELECT a.community, count(*) AS internal_edges FROM u JOIN m a ON a.id = u.src JOIN m b ON b.id = u.dst WHERE src < dst AND a.community = b.community GROUP BY a.community)
SELECT community, size, coalesce(internal_edges, 0) AS internal_edges, round(coalesce(internal_edges, 0) / (size * (size - 1) / 2), 4) AS cohesion FROM s LEFT JOIN i USING (community)""",
)
def cohesion(spark, sf):
    return graph.cohesion(_typed(spark, sf), edges(spark, sf))


@query(
    "surprising_edges",
    f"""WITH {N}, {_UND}, {_DEG}, {_TYPE} SELECT source, target, relation, confidence, x.degree + y.degree AS degree_sum FROM e JOIN m a ON a.id = source JOIN m b ON b.id = target
JOIN d x ON x.id = source JOIN d y ON y.id = target WHERE a.community <> b.community
ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, x.degree + y.degree DESC, source, target LIMIT 10""",
)
def surprising_edges(spark, sf):
    return graph.surprising_edges(_typed(spark, sf), edges(spark, sf), 10)


