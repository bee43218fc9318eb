"""Benchmark decontamination with spaced seeds.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased. Null and empty texts have no words and are clean. Items
of fewer than ``MIN_ITEM`` words are not searched for. Rows that repeat an id, and rows with a null id, are judged one by one. Items that repeat
count once each; an item with a null id is searched for and reported as null. Other columns are ignored. Empty tables are fine on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t
from .work import stored

#: Masks of the seeds (a word marked 0 may differ), by number of substitutions and least length. However so many substitutions lie in a stretch of that
#: length or more, one mask fits between them.
MASKS = {
    1: {5: ("1111", "11011", "10111", "11101"), 7: ("11011",), 8: ("1010111", "1111001")},
    2: {10: ("110111", "11001011", "101000111"), 13: ("111010111", "11010011011", "110011100101")},
}
MIN_ITEM = 5
SLOTS = 1 << 24


def words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints and the rows' first words."""
    buf, off = t.utf8(batch.column("text"))
    starts, ends, first = t.spans(buf, off, t.ALNUM_WORD)
    return t.span_hash(t.prefix(buf), starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the mask fits into a row, and the fingerprints of the words it keeps."""
    at = np.flatnonzero(t.whole(t.row_of(first), len(mask)))
    key = np.full(len(at), int(mask, 2) + (len(mask) << 32), t.U64)
    for j, keep in enumerate(mask):
        if keep == "1":
            key = t.mix(key * t.U64(t.BASES[0]) + h[at + j])
    return at, key


def masks_of(n: int, min_percent: int) -> tuple[str, ...]:
    """Masks that find a stretch of ``n`` words of which ``min_percent`` are equal, wherever the others lie."""
    free = n * (100 - min_percent) // 100
    if not free:
        return ("1" * n,)
    fit = [k for k in MASKS.get(free, ()) if k <= n]
    return MASKS[free][max(fit)] if fit else ("1" * max(1, n // (free + 1)),)  # of free + 1 parts one is whole


def _masks(lengths: list[int], min_percent: int) -> dict[str, list[int]]:
    """The masks that items of these lengths need, each with its lengths."""
    masks: dict[str, list[int]] = {}
    for n in sorted(lengths):
        for mask in masks_of(n, min_percent):
            masks.setdefault(mask, []).append(n)
    return masks


def _item_seeds(masks: dict[str, list[int]], window: int):
    def run(batches):
        for batch in t.blocks(batches, "text"):
            h, first = words(batch)
            row, size = t.row_of(first), np.minimum(np.diff(first), window)
            rows, places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for mask, lengths in masks.items():
                at, key = seeds(h, first, mask)
                own = np.isin(size[row[at]], lengths)
                at, key = at[own], key[own]
                rows.append(row[at])
                places.append(at - first[row[at]])
                keys.append(key.view(np.int64))
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(keys))], names=["item", "item_at", "key"])

    return run


def _item_words(batches):
    for batch in t.blocks(batches, "text"):
        h, first = words(batch)
        hashes = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(np.diff(first), pa.int64()), pa.array(hashes, pa.binary())], names=["item", "item_id", "n", "item_words"])


def _regions(masks: list[str], known: np.ndarray, reach: int):
    """A row for each text, and rows for the stretches around hits, long enough to lay any item over them. A word stands in one stretch only."""

    def run(batches):
        for batch in t.blocks(batches, "text"):
            h, first = words(batch)
            row = t.row_of(first)
            at, keys, length = [np.zeros(0, np.int64)], [np.zeros(0, t.U64)], [np.zeros(0, np.int64)]
            for mask in masks:
                a, k = seeds(h, first, mask)
                s = k & t.U64(SLOTS - 1)
                hit = (known[s >> t.U64(3)] >> (s & t.U64(7)).astype(np.uint8)) & 1 > 0
                at.append(a[hit])
                keys.append(k[hit])
                length.append(np.full(int(hit.sum()), len(mask)))
            at, keys, length = np.concatenate(at), np.concatenate(keys), np.concatenate(length)
            order = np.argsort(at, kind="stable")
            at, keys, length = at[order], keys[order], length[order]
            own = row[at] if len(at) else at
            lo, hi = np.maximum(first[own], at - reach), np.minimum(first[own + 1], at + length + reach)
            new = np.flatnonzero(np.concatenate(([True], lo[1:] >= np.maximum.accumulate(hi)[:-1]))) if len(at) else np.zeros(0, np.int64)
            stop = np.append(new[1:], len(at)).astype(np.int64)[: len(new)]
            rows = batch.num_rows
            who = np.concatenate((np.arange(rows), own[new])).astype(np.int64)
            begin = [None] * rows + [int(lo[a] - first[own[a]]) for a in new]
            text = [None] * rows + [h[lo[a] : hi[a:b].max()].tobytes() for a, b in zip(new, stop)]
            cut = np.concatenate((np.zeros(rows + 1, np.int32), stop.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(who)), batch.column("id").take(pa.array(who)), pa.array(begin, pa.int64()), pa.array(text, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(at - first[own], pa.int64())), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.view(np.int64))),
                ],
                names=["row", "id", "begin", "words", "places", "keys"],
            )

    return run


def overlap(text: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int]:
    """Equal words and length of the best stretch of ``window`` words (or of the whole item, if shorter) with the item laid at ``shift``."""
    size = min(window, len(item))
    a, b = max(0, shift), min(len(text), shift + len(item))
    if b - a < size:
        return 0, size
    same = np.concatenate(([0], np.cumsum(text[a:b] == item[a - shift : b - shift])))
    return int((same[size:] - same[:-size]).max()), size


def _verify(window: int):
    def run(batches):
        for batch in batches:
            found = [
                overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), d - b, window)
                for x, y, d, b in zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "diagonal", "begin")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), *(pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ())))], names=["row", "item_id", "same", "compared"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_percent: int = 80
) -> DataFrame:
    """One row per document: ``contaminated``, the number of benchmark items found, the smallest id among the best matches and its equal words.

    An item is found where ``window`` of its words in a row (all, if it has fewer) stand in the text with at least ``min_percent`` of them equal, the others substituted.
    Seeds of both sides join by fingerprint; each joined diagonal is laid out and counted. The masks follow from an item's length and leave no such place unfound.

    A bit set of fixed size (2 MB) lets texts keep back seeds that no item has; it only saves moving them, the join decides. Only stretches around
    hits leave the scan. Seeds that many texts share split as a skewed join.
    """
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.lower(F.col(item_text_col)).alias("text"))
    kind = dict(items.dtypes)["item_id"]
    item_rows = stored(items.mapInArrow(_item_words, f"item long, item_id {kind}, n long, item_words binary").filter(F.col("n") >= MIN_ITEM), "bench-items")
    lengths = [r.n for r in item_rows.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # at most ``window`` values
    reach = item_rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    masks = _masks(lengths, min_percent)
    item_seeds = stored(items.select("item", "text").mapInArrow(_item_seeds(masks, window), "item long, item_at long, key long"), "bench-seeds")
    slots = item_seeds.select(F.col("key").bitwiseAND(SLOTS - 1).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()  # at most SLOTS numbers
    known = np.zeros(SLOTS // 8, np.uint8)
    np.bitwise_or.at(known, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    id_kind = dict(texts.dtypes)["id"]
    rows = stored(texts.mapInArrow(_regions(list(masks), known, reach), f"row long, id {id_kind}, begin long, words binary, places array<long>, keys array<long>"), "bench-regions")
    regions = rows.filter(F.col("begin").isNotNull())
    hits = regions.select("row", "begin", F.explode(F.arrays_zip("places", "keys")).alias("x")).select("row", "begin", F.col("x.places").alias("at"), F.col("x.keys").alias("key"))
    laid = hits.join(item_seeds, "key").select("row", "begin", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    laid = laid.join(item_rows, "item").join(regions.select("row", "begin", "words"), ["row", "begin"])
    checked = laid.select("row", "begin", "diagonal", "words", "item_id", "item_words").mapInArrow(_verify(window), f"row long, item_id {kind}, same long, compared long")
    found = checked.filter(100 * F.col("same") >= min_percent * F.col("compared"))
    best = found.groupBy("row").agg(F.countDistinct("item_id").alias("n_items"), F.min(F.struct(-F.col("same"), "item_id")).alias("best"))
    out = rows.filter(F.col("begin").isNull()).select("row", "id").join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best.item_id").alias(item_col), F.coalesce(-F.col("best.col1"), F.lit(0)).alias("n_same"))
