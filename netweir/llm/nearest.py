"""MinHash near-dedup with SetSketch registers.

A document is the set of its distinct word shingles (A-Z lower-cased; words are runs of anything but space and tab..CR); with fewer words than a
shingle, the whole sequence is its only one. Null and empty texts have empty sets and link with nothing. A row with a null id takes no part and is kept.
Rows are judged one by one: those that repeat an id may fall into different components, and of equal sets rows with the smallest id all stay.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t
from .components import components, forest
from .work import stored

BAND = 6  # registers a band
MISS = 1e-7  # chance at most that two sets at the threshold share no band
BASE, RATE = 1.001, 20.0
SIGMAS = 5
BLOCK = 256


def bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** BAND)))


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, sorted in each row, and row offsets."""
    low = t.LOWER[buf]
    starts, ends, first = t.spans(low, off)
    row, rows = t.row_of(first), len(off) - 1
    h = t.span_hash(t.prefix(low), starts, ends)
    at = np.flatnonzero(t.whole(row, k))
    key, own = t.window_hash(h, k)[at], row[at]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        key = np.concatenate((key, t.span_hash(t.prefix(h, t.BASES[1]), first[short], first[short + 1], t.BASES[1]) + t.U64(1)))
        own = np.concatenate((own, short))
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, bool)
    return key[new], np.searchsorted(own[new], np.arange(rows + 1))


def digests(key: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free fingerprints of each row's set."""
    sums = [np.concatenate((np.zeros(1, t.U64), np.cumsum(t.mix(key * t.U64(b) + t.U64(7))))) for b in t.BASES]
    return tuple((s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums)


def registers(key: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """Row by register: floor(1 - log_b of the smallest of the elements' exponential hashes), truncated to 16 bits.

    The smallest uniform hash gives the smallest exponential one, so a register is one minimum; the maximum of two sketches is their union's.
    """
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, m), np.uint16)
    factor = t.mix(np.arange(1, m + 1, dtype=t.U64)) | t.U64(1)
    for i in range(m) if len(full) else ():
        least = np.minimum.reduceat(key * factor[i], off[full])
        value = -np.log1p(-((least >> t.U64(11)).astype(float) + 0.5) / 2**53) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, 65535)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of all pairs of two blocks, from how many registers are larger, equal and smaller, given the set sizes."""
    m = a.shape[1]
    equal, more = np.empty((len(a), len(b))), np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        equal[i], more[i] = (b == x).sum(axis=1), (b < x).sum(axis=1)
    less = m - equal - more
    u = na[:, None] / (na[:, None] + nb[None, :])
    v = 1 - u
    p, q = u * u * (equal + less), v * v * (equal + more)
    return (p + q - np.sqrt((p - q) ** 2 + 4 * less * more * u * u * v * v)) / (2 * m * u * v)


def _sketch(k: int, m: int):
    def run(batches):
        for batch in t.blocks(batches, "text"):
            key, off = shingles(*t.utf8(batch.column("text")), k)
            d1, d2 = digests(key, off)
            sketch = registers(key, off, m)
            flat = t.binary(sketch.view(np.uint8).ravel(), np.arange(len(off)) * 2 * m)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(d1), pa.array(d2), flat], names=["id", "n", "d1", "d2", "sketch"])

    return run


def groups(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        if held:
            change[0] = any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, values))
        cuts = [int(c) for c in np.flatnonzero(change)]
        begin = 0
        for c in [*cuts, batch.num_rows]:
            if c > begin:
                held.append(batch.slice(begin, c - begin))
            if c < batch.num_rows or c in cuts:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            begin = c
    if held:
        yield pa.Table.from_batches(held)


def _edges(nodes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(nodes[at].tolist(), nodes[label[at]].tolist()))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _blocks_of(table: pa.Table) -> tuple[np.ndarray, int]:
    """Rows of the first block before those of the second, and how many the first has (0: one block only)."""
    block = table.column("block").to_numpy()
    if block.min() == block.max():
        return np.arange(len(block)), 0
    order = np.argsort(block, kind="stable")
    return order, int((block == block.min()).sum())


def _compare(table: pa.Table, pairwise) -> list[tuple[int, int]]:
    """Forest over the pairs of one block, or between two blocks, that ``pairwise(rows, columns)`` links."""
    order, split = _blocks_of(table)
    nodes = table.column("set").to_numpy()[order]
    linked = np.zeros((len(order), len(order)), bool)
    if split:
        linked[:split, split:] = pairwise(order[:split], order[split:])
        linked |= linked.T
    else:
        linked[:] = pairwise(order, order)
    return _edges(nodes, forest(linked))


def _similar(percent: int, m: int):
    """Forest of the pairs whose sketches do not rule the threshold out."""
    share = percent / 100
    floor = share - SIGMAS * math.sqrt(share * (1 - share) / m)

    def run(batches):
        found: list[tuple[int, int]] = []
        for table in groups(batches, ["key", "p", "q"]):
            n = table.column("n").to_numpy().astype(float)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(n), m)

            def pairwise(x, y):
                fit = 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
                return fit & (likely(sketch[x], sketch[y], n[x], n[y]) >= floor)

            found += _compare(table, pairwise)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _sets(k: int):
    """Whole shingle sets of the texts whose fingerprints are those of the set asked for."""

    def run(batches):
        for batch in t.blocks(batches, "text"):
            key, off = shingles(*t.utf8(batch.column("text")), k)
            d1, d2 = digests(key, off)
            keep = np.flatnonzero((d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy()))
            rest = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rest.column("set"), rest.column("key"), rest.column("block"), rest.column("blocks"), pa.array([key[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())], names=["set", "key", "block", "blocks", "shingles"])

    return run


def shared(lists: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 4096) -> np.ndarray:
    """Intersection sizes of the sets x with the sets y, by products of membership matrices, ``width`` elements at a time."""
    who = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
    _, at, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    use = df[at] > 1
    who, at = who[use], (np.cumsum(df > 1) - 1)[at[use]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [begin, begin + width])
        member = np.zeros((len(lists), width), np.float32)
        member[who[a:b], at[a:b] - begin] = 1
        out += (member[x] @ member[y].T).astype(np.int64)
    return out


def _verified(percent: int):
    """Forest of the pairs that reach the threshold on their full sets."""

    def run(batches):
        found: list[tuple[int, int]] = []
        for table in groups(batches, ["key", "p", "q"]):
            lists = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]
            n = np.array([len(s) for s in lists])

            def pairwise(x, y):
                both = shared(lists, x, y)
                return 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)

            found += _compare(table, pairwise)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _blocked(members: DataFrame, size: int) -> DataFrame:
    """Each row of (key, set, ...) with its block and its key's number of blocks, so that a group of any size is compared block by block."""
    count = members.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")).filter(F.col("blocks") >= 1)
    return members.join(count, "key").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))


def _dealt(rows: DataFrame) -> DataFrame:
    """A copy of each row for every pair of blocks its own is in, grouped by pair. One block: one copy."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.withColumn("other", other).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", "blocks")
    return pairs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "set")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: set size, smallest id reachable over links, and whether that is its own.

    Two documents link where 100 * intersection >= ``percent`` * union of their full sets.

    Equal sets become one node first, by map-side combined digests. Bands of registers bring candidates together; a bucket's pairs pass if their joint
    likelihood estimate is within five standard errors of the threshold, and leave as a forest. Members of a candidate
    group fetch their full sets, are compared exactly and leave as a forest of true links. Groups of any size are compared in blocks of ``BLOCK`` by
    ``BLOCK`` documents spread over tasks, so neither pairs nor groups ever become rows or one task's memory. A link at the threshold shares no
    band with a chance of at most ``MISS``.
    """
    m = bands(percent) * BAND
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_sketch(shingle, m), "id long, n long, d1 long, d2 long, sketch binary"), "near-sketches")
    sets = rows.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    sets = stored(sets.withColumn("set", F.monotonically_increasing_id()), "near-sets")
    # buckets: equal registers in a band; buckets of the same members count once
    cut = F.expr(f"substring(sketch, 1 + {2 * BAND} * band, {2 * BAND})")
    banded = sets.select("set", "sketch", F.explode(F.sequence(F.lit(0), F.lit(m // BAND - 1))).alias("band")).select("set", F.xxhash64("band", cut).alias("key"))
    marks = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y"), F.min("set").alias("s")]
    buckets = banded.groupBy("key").agg(*marks).filter("c > 1").groupBy("c", "x", "y", "s").agg(F.min("key").alias("key")).select("key")
    members = _blocked(stored(banded.join(buckets, "key"), "near-buckets"), BLOCK)
    guessed = _dealt(members.join(sets.select("set", "n", "sketch"), "set")).mapInArrow(_similar(percent, m), "a long, b long")
    coarse = components(guessed).select(F.col("node").alias("set"), F.col("component").alias("key"))
    wanted = _blocked(coarse, BLOCK).join(sets.select("set", "id", "d1", "d2"), "set")
    full = texts.join(wanted, "id").select("text", "set", "key", "block", "blocks", "d1", "d2")
    full = full.mapInArrow(_sets(shingle), "set long, key long, block int, blocks int, shingles binary").dropDuplicates(["set"])
    links = _dealt(full).mapInArrow(_verified(percent), "a long, b long")
    linked = components(links)
    named = linked.join(sets.select(F.col("set").alias("node"), "id"), "node")
    head = named.groupBy("component").agg(F.min("id").alias("head"))
    heads = named.join(head, "component").select(F.col("node").alias("set"), "head")
    per_set = sets.join(heads, "set", "left").select("d1", "d2", "n", F.coalesce("head", "id").alias("head"))
    out = rows.drop("sketch").join(per_set, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("head", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
