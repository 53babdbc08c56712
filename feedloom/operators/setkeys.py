"""Keys under which similar sets meet, and signatures that tell unlike ones apart; numpy on the executors.

A set comes as the 64-bit hashes of its tokens.  All sets order tokens alike: rare ones first, by the count
of the token's bucket (``order_of``), then by the hash.  Each rare token is a key.  The others fall into classes of
neighbours in the order, and each pair of tokens of one class is a key: two common words side by side say much
more than one.  Sets give out keys from the front, as prefixes do:

Say A and B overlap in at least ``need`` tokens, so A lacks at most ``|A| - need`` of B's and the reverse.  Take the first
rare token they share, or else the first class in which they share two.  Before it, A has no shared rare token and at most one shared token in a
class of ``u``: at least 1, or ``u - 1``, of its tokens are not in B.  So what stands before it (``before``) is at most
``|A| - need``, and the same for B.  There are fewer than ``need`` classes, so without a shared rare token some class holds two shared ones.

The number of classes goes with the size, so sets are dealt into levels of ``[2^k, 2^(k+1))`` tokens.  Two sets meet at the
level of the larger: each gives out keys at its own level and, for larger partners, at the next.  Below a threshold of
a half all sets have one level and every token is a key of its own.  Equal hashes of unlike tokens only make more candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BUCKETS = 1 << 20  # token counts are kept by bucket, so their table has one size for any vocabulary
RARE = 16  # a bucket seen in up to so many sets: its tokens are keys of their own
CHUNK = 100_000  # tokens worked on at once
SLACK = 1e-9  # keeps ceil() from being pushed up by rounding

_QUANTILES = 1 << 16
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def order_of(counts: np.ndarray, rare: int) -> np.ndarray:
    """Place of each bucket in the order: 0 and less for rare ones, else 1 to 65,536 by share of all that is not rare."""
    by_count = np.argsort(counts, kind="stable")
    sorted_counts = counts[by_count].astype(np.int64)
    mass = np.where(sorted_counts > rare, sorted_counts, 0)
    share = (np.cumsum(mass) - mass).astype(float) / max(int(mass.sum()), 1)
    place = np.empty(len(counts), np.int32)
    place[by_count] = np.where(sorted_counts > rare, np.minimum((share * _QUANTILES).astype(np.int64) + 1, _QUANTILES), sorted_counts - rare)
    return place


def levels(threshold: float) -> bool:
    return threshold >= 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def keys(hashes: np.ndarray, sizes: np.ndarray, place: np.ndarray, threshold: float, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(set, key, prior, before, up) for the levels ``low`` to ``high``.

    ``prior`` is the key given out before at that level, or -1; ``up`` marks keys for larger partners, of no use between two such.
    """
    n = sizes.astype(np.int64)
    own = np.frexp(n.astype(float))[1] - 1 if levels(threshold) else np.zeros_like(n)
    which = np.repeat(np.arange(len(n)), n)
    r = place[hashes & (len(place) - 1)].astype(np.int64)
    order = np.lexsort((hashes, r, which))
    h, r = hashes[order], r[order]
    start = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(h))
    found = []
    for up in (0, 1) if levels(threshold) else (0,):
        level = own + up
        base = np.left_shift(1, level)
        need = n * threshold if up == 0 else (n + base) * (threshold / (1 + threshold))
        spare = n - np.ceil(need - SLACK).astype(np.int64)
        spare[(level < low) | (level > high)] = -1
        classes = np.floor(threshold * base - 1 + SLACK).astype(np.int64) if levels(threshold) else np.zeros_like(n)
        classes = np.where(classes < 2, 0, classes)[which]
        single = (r <= 0) | (classes == 0)
        group = np.where(single, -1, (r - 1) * classes // _QUANTILES)
        first = single.copy()
        first[0:1] = True
        first[1:] |= (which[1:] != which[:-1]) | (group[1:] != group[:-1])
        cost = (single | ~first).astype(np.int64)
        total = np.cumsum(cost) - cost
        head = np.maximum.accumulate(np.where(first, at, 0))
        before = total[head] - total[start]
        given = before <= spare[which]
        alone = np.flatnonzero(given & single)
        later = np.flatnonzero(given & ~single)
        many = later - head[later]
        two = np.repeat(later, many)
        one = np.arange(len(two)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(head[later], many)
        u = h.view(np.uint64)
        salt = level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = np.concatenate([_mixed(u[alone] + salt[which[alone]]), _mixed(_mixed(u[one] + salt[which[two]]) + u[two])])
        last = np.concatenate([alone, two])
        seq = np.argsort(last, kind="stable")  # a set's pairs stay in order: both sets give them out alike
        key, last = key[seq], last[seq]
        key >>= np.uint64(16)
        prior = np.empty(len(key), np.int64)
        prior[1:] = key[:-1].view(np.int64)
        opens = np.ones(len(key), bool)
        opens[1:] = which[last[1:]] != which[last[:-1]]
        prior[opens] = -1
        found.append((which[last], key.view(np.int64), prior, before[last], np.full(len(key), up == 1)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sets of about CHUNK tokens; ``ends``: running sum of their sizes."""
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets)


def key_rows(place: np.ndarray, threshold: float, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """no, hashes -> key, prior, no, n, before, up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no = np.asarray(batch.column("no"))
            hashes, sizes = _lists(batch.column("hashes"))
            ends = np.cumsum(sizes)
            for at, to in _chunks(ends):
                which, key, prior, before, up = keys(hashes[ends[at] - sizes[at] : ends[to - 1]], sizes[at:to], place, threshold, low, high)
                mine = no[at:to][which]
                prior = np.where(prior < 0, -1 - mine, prior)  # a set's first key has none before: its own number stands there
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (key, prior, mine, sizes[at:to][which].astype(np.int32), before.astype(np.int32), up))],
                    names=["key", "prior", "no", "n", "before", "up"],
                )

    return run


def signature(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per set, 2 to 4 bits for each token (64 at least): whether an odd number of its tokens falls on the bit.

    Two signatures differ in as many bits at most as the sets differ in tokens.  Half as long, it is the first half xor the second.
    """
    n = sizes.astype(np.int64)
    bits = np.left_shift(1, np.maximum(np.frexp(np.maximum(2 * n - 1, 1).astype(float))[1], 6))
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, n) + ((hashes >> 24) & (np.repeat(bits, n) - 1))
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.packbits(odd).tobytes())])


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hashes -> bits, the other columns as they are."""
    for batch in batches:
        hashes, sizes = _lists(batch.column("hashes"))
        ends = np.cumsum(sizes)
        for at, to in _chunks(ends):
            bits = signature(hashes[ends[at] - sizes[at] : ends[to - 1]], sizes[at:to])
            rows = batch.slice(at, to - at)
            kept = [c for c in rows.schema.names if c != "hashes"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), bits], names=[*kept, "bits"])


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows of two byte matrices differ, at the length of the shorter."""
    while a.shape[1] != b.shape[1]:
        if a.shape[1] < b.shape[1]:
            a, b = b, a
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def maybe_alike(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, na, nb, bits_a, bits_b -> a, b of the pairs whose signatures allow ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (np.asarray(batch.column(c)).astype(np.int64) for c in ("na", "nb"))
            most = na + nb - 2 * np.ceil((na + nb) * (threshold / (1 + threshold)) - SLACK).astype(np.int64)
            sides = []
            for c in ("bits_a", "bits_b"):
                column = batch.column(c)
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                sides.append((np.frombuffer(column.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)))
            (data_a, at_a, len_a), (data_b, at_b, len_b) = sides
            keep = np.zeros(batch.num_rows, bool)
            for la, lb in np.unique(np.stack([len_a, len_b]), axis=1).T:
                rows = np.flatnonzero((len_a == la) & (len_b == lb))
                for part in np.array_split(rows, max(1, len(rows) * int(la + lb) // 4_000_000)):
                    differ = _difference(data_a[at_a[part, None] + np.arange(la)], data_b[at_b[part, None] + np.arange(lb)])
                    keep[part] = differ <= most[part]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run
