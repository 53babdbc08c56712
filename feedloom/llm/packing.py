"""Packing of token sequences into windows of near-equal length.

A task encodes its documents and gathers them in batches of about ``BATCH`` tokens.  Whole windows
are cut off each document first.  What is left of each document is an item for Karmarkar-Karp
multiway differencing: a partial partition is a list of window sums; the two partitions whose
largest and smallest sums differ most are merged with opposing order, the largest window of one with
the smallest of the other, until one partition is left.  The window count starts at the total over
the capacity and rises for as long as the total does not fit.  Documents may be cut, so what a
window holds beyond its capacity is then cut off and moved into the windows with the most room;
without cutting, the count rises until every window keeps to the capacity.

No shuffle and no state beyond a batch: padding is below one window per batch and task.  Null texts
count as empty texts and give a piece of the end id alone; repeated rows are packed as often as they
occur; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import longs, table, texts_of
from feedloom.llm.tokens import byte_level

WINDOW = 1024
BATCH = 1_000_000
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items of ``sizes`` (all positive) dealt to ``windows`` windows."""
    if not sizes:
        return [[] for _ in range(windows)]
    members: list = list(range(len(sizes)))  # of a node: an item, or two nodes
    heap = [(-s, i, np.array([s]), np.array([i]), 0) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, na, _ = heapq.heappop(heap)
        _, _, b, nb, _ = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - windows)  # windows that get sums of both, largest with smallest
        keep_a, keep_b = len(a) - shared, len(b) - shared
        both = a[keep_a:] + b[keep_b:][::-1]
        fresh = np.arange(len(members), len(members) + shared)
        members.extend(zip(na[keep_a:].tolist(), nb[keep_b:][::-1].tolist()))
        sums = np.concatenate([a[:keep_a], b[:keep_b], both])
        nodes = np.concatenate([na[:keep_a], nb[:keep_b], fresh])
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        smallest = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (-int(sums[0] - smallest), order, sums, nodes, 0))
        order += 1
    out = []
    for node in heap[0][3].tolist():
        items, todo = [], [node]
        while todo:
            m = members[todo.pop()]
            if isinstance(m, tuple):
                todo.extend(m)
            else:
                items.append(m)
        out.append(items)
    return out + [[] for _ in range(windows - len(out))]


def pack(lengths: list[int], window: int = WINDOW, cut: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items of the given lengths; sequences from 0."""
    pieces, sequence, rest = [], 0, []
    for i, n in enumerate(lengths):
        whole = n // window if cut or n > window else 0
        for k in range(whole):
            pieces.append((i, k * window, window, sequence, 0))
            sequence += 1
        if n > whole * window:
            rest.append((i, whole * window, n - whole * window))
    total = sum(r[2] for r in rest)
    windows = total // window
    while True:
        if windows * window < total:
            windows += 1
            continue
        dealt = differencing([r[2] for r in rest], windows)
        if cut or max((sum(rest[x][2] for x in w) for w in dealt), default=0) <= window:
            break
        windows += 1
    held = [[rest[x] for x in w] for w in dealt]
    room = [window - sum(p[2] for p in w) for w in held]
    moved = []
    for w, free in zip(held, room):
        over = -free
        while over > 0:  # cut the excess off the largest piece
            k = max(range(len(w)), key=lambda x: w[x][2])
            i, start, n = w[k]
            off = min(over, n - 1)
            w[k] = (i, start, n - off)
            moved.append((i, start + n - off, off))
            over -= off
    spare = [(-free, k) for k, free in enumerate(room) if free > 0]
    heapq.heapify(spare)
    for i, start, n in sorted(moved, key=lambda p: -p[2]):
        while n:
            free, k = heapq.heappop(spare)
            take = min(n, -free)
            held[k].append((i, start, take))
            start, n = start + take, n - take
            if -free > take:
                heapq.heappush(spare, (free + take, k))
    for w in held:
        offset = 0
        for i, start, n in w:
            pieces.append((i, start, n, sequence, offset))
            offset += n
        sequence += bool(w)
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, batch_tokens: int = BATCH, forget: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text).  ``forget``: workers give back the words they met, for the stages that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        base = TaskContext.get().partitionId() << 36
        held, tokens = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base, held, tokens
            pieces = pack([len(ids) for _, ids in held], window)
            rows = [
                (held[i][0], start, n, zlib.crc32(held[i][1][start : start + n].astype("<u4").tobytes()), len(held[i][1]), base + sequence, offset)
                for i, start, n, sequence, offset in pieces
            ]
            base += 1 + max(p[3] for p in pieces)
            held, tokens = [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.frombuffer(encoder.ids(text) + end, dtype=encoder.dtype)
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= batch_tokens:
                    yield packed()
        if held:
            yield packed()
        if forget:
            encoder.clear()  # workers outlive the stage

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
