"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document is the set of its distinct word shingles (A-Z lower-cased; words are runs of anything but space and tab..CR); with fewer words than a
shingle, the whole sequence is its only one. Null and empty texts have empty sets and link with nothing. A row with a null id takes no part: its component is null
and it has no links. Rows that repeat an id are judged one by one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t
from .components import components
from .nearest import digests, shingles
from .work import stored

BINS = 128  # of a set's histogram
GROUP = 1024  # sets a block when histograms are compared
BLOCK = 512  # sets a block when rows are multiplied
BLOCK_BYTES = 8 << 20
WIDTH = 4096  # columns multiplied at a time


def bands(most: int, percent: int) -> np.ndarray:
    """First sizes of bands such that sets which link are in the same or in neighbouring bands."""
    first = [1]
    while first[-1] <= most:
        first.append(100 * first[-1] // percent + 1)
    return np.array([*first, 100 * first[-1] // percent + 1])


def column_blocks(key: np.ndarray, row: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row's column blocks, and their rows. Rows that link have a key in common.

    Sets that link differ in at most (a + b) * (100 - percent) / (100 + percent) columns. Columns are dealt by their hash into two blocks more than that, so two
    such rows are equal in two whole blocks at least. A block that holds a column of the row is a key; of those that hold none, each pair is one. The number of
    blocks goes by the band of the sizes; a row is dealt for its own band and for the next.
    """
    first = bands(int(n.max(initial=0)), percent)
    keys, owners = [], []
    for label in (np.searchsorted(first, n, "right") - 1, np.searchsorted(first, n, "right")):
        count = np.where(n > 0, 2 * (first[np.minimum(label + 1, len(first) - 1)] - 1) * (100 - percent) // (100 + percent) + 2, 0)
        base = np.cumsum(count) - count
        at = base[row] + (t.mix(key + t.U64(0x51)) % count[row].astype(t.U64)).astype(np.int64)
        total, size = np.zeros(int(count.sum()), t.U64), np.zeros(int(count.sum()), np.int64)
        np.add.at(total, at, t.mix(key + t.U64(0x2F)))
        np.add.at(size, at, 1)
        owner = np.repeat(np.arange(len(n)), count)
        name = t.mix((label[owner].astype(t.U64) << t.U64(32)) + (np.arange(len(owner)) - base[owner]).astype(t.U64) + t.U64(1))
        full, empty = np.flatnonzero(size), np.flatnonzero(size == 0)
        keys.append(t.mix(total[full] + name[full]))
        owners.append(owner[full])
        heads = np.flatnonzero(np.concatenate(([True], np.diff(owner[empty]) != 0))) if len(empty) else np.zeros(0, np.int64)
        i, j = pairs_of(heads, np.append(heads[1:], len(empty))[: len(heads)])
        keys.append(t.mix(t.mix(name[empty[i]] + t.U64(3)) + name[empty[j]]))
        owners.append(owner[empty[i]])
    return np.concatenate(keys), np.concatenate(owners)


def _incident(k: int, percent: int):
    """Per document the set's size, its two digests, its histogram and the keys of its column blocks."""

    def run(batches):
        for batch in t.blocks(batches, "text"):
            key, off = shingles(*t.utf8(batch.column("text")), k)
            n = np.diff(off)
            d1, d2 = digests(key, off)
            row = np.repeat(np.arange(len(n)), n)
            bins = np.bincount(row * BINS + (key % t.U64(BINS)).astype(np.int64), minlength=len(n) * BINS).astype(np.uint32)
            hist = t.binary(bins.view(np.uint8), np.arange(len(n) + 1) * 4 * BINS)
            keys, owner = column_blocks(key, row, n, percent)
            order = np.argsort(owner, kind="stable")
            heads = np.searchsorted(owner[order], np.arange(len(n) + 1)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(heads), pa.array(keys[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(d1), pa.array(d2), hist, parts], names=["id", "n", "d1", "d2", "hist", "parts"])

    return run


def tables(batches, keys: list[str], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``keys``: as many as fit in so many rows and bytes, one group at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            held.append(batch.slice(begin, rows))
            if sum(b.num_rows for b in held) < rows and sum(b.get_total_buffer_size() for b in held) < size:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(table, keys)
            if len(starts) > 1:
                yield table.slice(0, int(starts[-1])).combine_chunks()
                held = table.slice(int(starts[-1])).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within each [start, end)."""
    size = ends - starts
    i = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(ends, size) - i - 1
    first = np.repeat(i, later)
    return first, first + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)


def leaders(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of 0..n-1 that each reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = leaders(len(nodes), i, j)
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]]), pa.nulls(len(at), pa.int64())], names=["a", "b", "links"])


def _enough(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many shared columns reach the threshold for sets of these sizes: 100 * shared >= percent * (a + b - shared)."""
    return 100 * shared >= percent * (a + b - shared)


def _possible(percent: int):
    """Forest of the pairs of each group that sizes and histograms do not rule out."""

    def run(batches):
        for table in tables(batches, ["key", "p", "q"], 8192, 8 << 20):
            starts = group_starts(table, ["key", "p", "q"])
            ends = np.append(starts[1:], table.num_rows)
            n, block, nodes = (table.column(c).to_numpy() for c in ("n", "block", "set"))
            across = table.column("p").to_numpy() != table.column("q").to_numpy()
            hist = np.frombuffer(b"".join(table.column("hist").to_pylist()), np.uint32).reshape(-1, BINS)
            found_i, found_j = [], []
            # some groups at a time, about a million pairs
            part = np.cumsum((ends - starts) ** 2) >> 20
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(starts)]):
                i, j = pairs_of(starts[lo:hi], ends[lo:hi])
                fit = (~across[i] | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[fit], j[fit]
                for x in range(0, len(i), 1 << 14):
                    a, b = i[x : x + (1 << 14)], j[x : x + (1 << 14)]
                    good = _enough(np.minimum(hist[a], hist[b]).sum(axis=1).astype(np.int64), n[a], n[b], percent)
                    found_i.append(a[good])
                    found_j.append(b[good])
            if found_i:
                yield _forest(nodes, np.concatenate(found_i), np.concatenate(found_j))

    return run


def _rows_of(k: int):
    """Whole rows of the incidence matrix, for the texts whose set is the one asked for."""

    def run(batches):
        for batch in t.blocks(batches, "text"):
            key, off = shingles(*t.utf8(batch.column("text")), k)
            d1, d2 = digests(key, off)
            keep = np.flatnonzero((d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy()))
            rest = batch.take(pa.array(keep))
            grams = pa.array([key[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("set", "copies", "key", "blocks")), grams], names=["set", "copies", "key", "blocks", "grams"])

    return run


def multiplied(rows: list[np.ndarray], split: int) -> np.ndarray:
    """Overlap counts of the first ``split`` rows with the others (0: of all rows with all), ``WIDTH`` shared columns at a time.

    Only columns that two rows hold are multiplied, and columns held by the same rows are one column of that weight.
    """
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    mark = t.mix(np.arange(1, len(rows) + 1, dtype=t.U64))
    _, at, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    use = df[at] > 1
    who, at = who[use], (np.cumsum(df > 1) - 1)[at[use]]
    order = np.lexsort((who, at))
    who, at = who[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    held = np.add.reduceat(mark[who], begin) if len(begin) else np.zeros(0, t.U64)
    other = np.add.reduceat(t.mix(mark[who] + t.U64(1)), begin) if len(begin) else held
    order = np.lexsort((other, held))
    held, other = held[order], other[order]
    new = np.concatenate(([True], (held[1:] != held[:-1]) | (other[1:] != other[:-1]))) if len(held) else np.zeros(0, bool)
    weight = np.diff(np.append(np.flatnonzero(new), len(held))).astype(float)
    lead, end = begin[order[new]], np.append(begin, len(who))[order[new] + 1]
    x, y = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    out = np.zeros((split or len(rows), len(rows) - split))
    for c in range(0, len(lead), WIDTH):
        size = (end - lead)[c : c + WIDTH]
        member = np.zeros((len(rows), len(size)), np.float32)
        where = np.repeat(lead[c : c + WIDTH] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        member[who[where], np.repeat(np.arange(len(size)), size)] = 1
        # float32 holds whole numbers up to 2**24: weights stay on one side, in double precision if they are large
        heavy = member[x] * weight[c : c + WIDTH].astype(np.float32 if weight.sum() < 1 << 24 else float)
        out += heavy @ member[y].T
    return out.astype(np.int64)


def _linked(percent: int):
    """Forest of the pairs that reach the threshold, and each set's number of linked documents, from the product of two blocks."""

    def run(batches):
        for table in tables(batches, ["key", "p", "q"], 1, 1):
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            split = int((block == block.min()).sum()) if table.column("p")[0] != table.column("q")[0] else 0
            if split == len(block):
                continue  # nobody in the other block
            rows = [np.frombuffer(table.column("grams")[int(i)].as_py(), np.uint64) for i in order]
            nodes, copies = (table.column(c).to_numpy()[order] for c in ("set", "copies"))
            n = np.array([len(r) for r in rows])
            a, b = (n[:split], n[split:]) if split else (n, n)
            good = _enough(multiplied(rows, split), a[:, None], b[None, :], percent)
            if not split:
                np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            yield _forest(nodes, i, j + split)
            links = np.zeros(len(rows), np.int64)
            if split:
                links[:split], links[split:] = good @ copies[split:], good.T @ copies[:split]
            else:
                links = good @ copies
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], names=["a", "b", "links"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """A copy of each row for every pair of blocks that its own is in, sorted by pair."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", other)
    pairs = pairs.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", "blocks")
    return pairs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "set")


EDGES = "a long, b long, links long"


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: set size, smallest id reachable over links, and the number of documents it links with.

    Two documents link where 100 * intersection >= ``percent`` * union of their full sets.

    Equal sets become one row of the matrix first. Columns are dealt into blocks, so many that rows which link are equal in a whole one (see ``column_blocks``);
    rows that are equal there hang onto the smallest of them, and what hangs together is a group. In a group, pairs whose sizes or histograms
    bound the overlap below the threshold are discarded, and what is left are the blocks of the matrix that can hold links. There the rows
    are multiplied in full, block by block (``BLOCK`` sets or ``BLOCK_BYTES``), and pairs with fewer shared columns than their sizes ask for are discarded. Links leave as a tree's edges
    and as counts, so neither pairs nor groups become rows or one task's memory. The keys are a ninth of the n-grams at 90 %, the more the lower the threshold.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_incident(shingle, percent), "id long, n long, d1 long, d2 long, hist binary, parts array<long>"), "product-rows")
    firsts = [F.min("id").alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("hist", "parts"))]
    sets = rows.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(*firsts)
    sets = stored(sets.withColumn("set", F.monotonically_increasing_id()), "product-sets")
    sketches = sets.select("set", "n", "hist")
    alike = sets.select("set", F.explode("parts").alias("part"))
    least = alike.groupBy("part").agg(F.min("set").alias("b"), F.max("set").alias("last")).filter("b < last").drop("last")
    stars = alike.join(least, "part").filter("set > b").select(F.col("set").alias("a"), "b")
    groups = components(stars).select(F.col("node").alias("set"), F.col("component").alias("key"))
    groups = groups.join(groups.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")), "key")
    guessed = _dealt(groups.join(sketches, "set")).mapInArrow(_possible(percent), EDGES)
    coarse = components(guessed.select("a", "b")).select(F.col("node").alias("set"), F.col("component").alias("key"))
    wanted = coarse.join(sets.select("set", "id", "n", "d1", "d2", "copies"), "set")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    wanted = wanted.join(wanted.groupBy("key").agg(blocks.alias("blocks")), "key")
    full = texts.join(wanted, "id").select("text", "set", "key", "blocks", "copies", "d1", "d2")
    full = full.mapInArrow(_rows_of(shingle), "set long, copies long, key long, blocks int, grams binary").dropDuplicates(["set"])
    links = stored(_dealt(full).mapInArrow(_linked(percent), EDGES), "product-links")
    linked = components(links.filter("b IS NOT NULL").select("a", "b"))
    named = linked.join(sets.select(F.col("set").alias("node"), "id"), "node")
    heads = named.join(named.groupBy("component").agg(F.min("id").alias("head")), "component").select(F.col("node").alias("set"), "head")
    degrees = links.filter("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    per_set = sets.join(heads, "set", "left").join(degrees, "set", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    per_set = per_set.select("d1", "d2", "n", F.coalesce("head", "id").alias("head"), n_links)
    out = rows.select("id", "n", "d1", "d2").join(per_set, ["d1", "d2", "n"], "left")
    there = F.col("id").isNotNull()
    component = F.when(there, F.coalesce("head", "id")).alias("component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component, F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
