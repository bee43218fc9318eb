"""Suffix-array dedup with a logarithmic family of index levels.

Texts are their UTF-8 bytes; null is empty. A row with a null id loses nothing and is no one's copy; rows that repeat an id are documents of their own.
Other columns are ignored. An empty table gives an empty result.

The arrays are sparse: they hold the suffixes at anchors, places of the smallest 8-byte gram of some stretch. Every string of ``length`` bytes has
one in the same place, with at least ``CONTEXT`` bytes of the string behind it, so equal strings show as equal leading bytes of neighbouring suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textnp as t
from .substring import CHUNK, PLACE, _found, crossing, mark_repeats, whole_keys
from .work import by_row, stored

CONTEXT = 32
SUFFIX = "suffix binary, id long, pos long"
BLOCK = 1 << 18
SCATTER = t.U64(t.BASES[0])


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes within rows: place, first and last string it stands for, row."""
    size = np.diff(off)
    inside = np.maximum(size - length + 1, 0)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    key = np.ndarray(len(buf) - 7, t.U64, np.ascontiguousarray(buf), strides=(1,)) * SCATTER
    key &= ~PLACE
    key |= np.arange(len(key), dtype=t.U64)
    place = (t.sliding_min(key, length - CONTEXT + 1) & PLACE)[: len(buf) - length + 1]
    fits = np.repeat(np.tile([True, False], len(size)), np.stack((inside, size - inside), 1).ravel())[: len(place)]
    change = place[1:] != place[:-1]
    first, last = fits.copy(), fits.copy()
    first[1:] &= change | ~fits[:-1]
    last[:-1] &= change | ~fits[1:]
    lo = np.flatnonzero(first)
    return place[lo].astype(np.int64), lo, np.flatnonzero(last), np.searchsorted(off, lo, "right") - 1


def _leading(buf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ``CONTEXT`` bytes from each place on, one after another."""
    return np.lib.stride_tricks.sliding_window_view(buf, CONTEXT)[place].ravel() if len(place) else buf[:0]


def _suffixes(length: int):
    def run(batches):
        for batch in t.blocks(batches, "text", BLOCK):
            buf, off = t.utf8(batch.column("text"))
            place, _, _, row = anchors(buf, off, length)
            suffix = t.binary(_leading(buf, place), np.arange(len(place) + 1) * CONTEXT)
            yield pa.RecordBatch.from_arrays([suffix, batch.column("id").take(pa.array(row)), pa.array(place - off[row])], names=["suffix", "id", "pos"])

    return run


def _scan(batches):
    """Marks the sorted suffixes that agree with a neighbour. The ends of a partition may have theirs in the next one and are marked too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = np.frombuffer(t.utf8(batch.column("suffix"))[0].tobytes(), t.U64).reshape(-1, CONTEXT // 8)
        same = (lead[1:] == lead[:-1]).all(axis=1)
        hit = np.zeros(len(lead), bool)
        hit[1:] |= same
        hit[:-1] |= same
        if held is None:
            hit[0] = True
        else:
            tie = bool((held[1] == lead[0]).all())
            hit[0] |= tie
            yield _marked(held[0], np.array([held[2] or tie]))
        yield _marked(batch.slice(0, len(lead) - 1), hit[:-1])
        held = batch.slice(len(lead) - 1), lead[-1].copy(), bool(hit[-1])
    if held is not None:
        yield _marked(held[0], np.array([True]))


def _marked(batch: pa.RecordBatch, hit: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("suffix", "id", "pos")), pa.array(hit)], names=["suffix", "id", "pos", "hit"])


class SuffixIndex:
    """Levels of sorted suffixes, each a power of two of batches; equal-sized levels merge as a new batch comes in."""

    def __init__(self, length: int = 200):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []

    def _sorted(self, parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.repartitionByRange("suffix", "id", "pos").sortWithinPartitions("suffix", "id", "pos")
        return rows.mapInArrow(_scan, SUFFIX + ", hit boolean")

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in texts (id, text); returns (id, pos) of the anchors, old and new, whose suffix has a neighbour with equal leading bytes.

        The batch's suffixes are written once, as ranging reads them twice. They are sorted together with the levels they merge into, which is array, scan and merge in one pass; they are scanned
        against every other level in a further one.
        """
        new = stored(batch.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_suffixes(self.length), SUFFIX), "suffix-batch")
        size, merging = 1, []
        while self.levels and self.levels[-1][0] == size:
            merging.append(self.levels.pop()[1])
            size *= 2
        level = stored(self._sorted([new, *merging]), "suffix-level")
        found = level.filter("hit").select("id", "pos")
        for _, other in self.levels:
            found = found.unionByName(stored(self._sorted([new, other]).filter("hit").select("id", "pos"), "suffix-scan"))
        self.levels.append((size, level.drop("hit")))
        return found


def batches_of(rows: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of ids in order, so that a scan can skip the files of other batches."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return [rows]
    cuts = sorted({low + (high - low + 1) * i // n for i in range(n)})
    parts = []
    for a, b in zip(cuts, [*cuts[1:], None]):
        part = rows.filter(F.col("id") >= a)
        parts.append(part if b is None else part.filter(F.col("id") < b))
    return parts


def _strings(length: int):
    """All strings an asked anchor stands for, packed as one stretch of bytes, keyed by the bytes behind the anchor."""

    def run(batches):
        for batch in t.blocks(batches, "text", BLOCK):
            buf, off = t.utf8(batch.column("text"))
            place, lo, hi, row = anchors(buf, off, length)
            asked = batch.column("places")
            wanted = np.zeros(len(buf), bool)
            wanted[off[np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))] + asked.flatten().to_numpy()] = True
            keep = wanted[place]
            place, lo, stop, row = place[keep], lo[keep], hi[keep] + length, row[keep]
            first = np.arange(len(place)) * (CONTEXT // 8)
            key = t.span_hash(t.prefix(_leading(buf, place).view(t.U64)), first, first + CONTEXT // 8).view(np.int64)
            data = buf.tobytes()
            packed = pa.array([data[a:b] for a, b in zip(lo.tolist(), stop.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(pa.array(row)), pa.array(lo - off[row]), packed], names=["key", "id", "start", "bytes"])

    return run


def _count(length: int, limit: int):
    """Runs of repeated strings of each key. Stretches equal byte for byte repeat whole; one of them meets the other stretches string by string."""

    def run(batches):
        for table, is_first, is_last in whole_keys(t.blocks(batches, "bytes", max(1, limit // 16)), "key", max(1, limit // 4), limit):
            key, doc, start = (table.column(c).to_numpy() for c in ("key", "id", "start"))
            code = table.column("bytes").combine_chunks().dictionary_encode()
            buf, off = t.utf8(code.dictionary)
            code = code.indices.to_numpy()
            n = np.diff(off) - length + 1
            one = np.zeros(len(n), np.int64)
            one[code[::-1]] = np.arange(len(code))[::-1]
            other = (doc != doc[one[code]]) | (start != start[one[code]])
            whole = np.bincount(code, weights=other, minlength=len(n)) > 0
            copy = whole[code]
            yield _found(doc[copy], start[copy], n[code[copy]], None, None)
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + off[own]
            w1, w2 = (t.flat_hash(t.prefix(buf, b), at, at + length, b) for b in t.BASES)
            place = (start[one] - off[:-1])[own] + at
            open_keys = [key[0]] * is_first + [key[-1]] * is_last
            yield from mark_repeats(key[one], own, doc[one][own], place, w1, w2, open_keys, later_only=False, known=whole)

    return run


def _strip(length: int):
    """Removed byte ranges of each text, from runs of repeated strings."""

    def run(batches):
        for batch in t.blocks(batches, "text", BLOCK):
            buf, off = t.utf8(batch.column("text"))
            runs = batch.column("runs")
            flat = runs.flatten()
            begin = np.repeat(off[:-1], np.diff(runs.offsets.to_numpy())) + flat.field("start").to_numpy()
            cover = np.zeros(len(buf) + 1, np.int32)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + flat.field("n").to_numpy() - 1 + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            lo = np.flatnonzero(gone & (edge[:-1] | np.concatenate(([True], ~gone[:-1]))))
            hi = np.flatnonzero(gone & (edge[1:] | np.concatenate((~gone[1:], [True])))) + 1
            row = np.searchsorted(off, lo, "right") - 1
            base = off[row]
            spans = pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], names=["start", "stop"])
            ranges = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)), spans)
            removed = np.concatenate(([0], np.cumsum(gone)))[off]
            kept, cut = buf[~gone].tobytes(), (off - removed).tolist()
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(removed)), pa.array(sha, pa.string()), ranges], names=["id", "cut", "sha", "ranges"])

    return run


RANGES = "array<struct<start:long,stop:long>>"


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batches: int = 3, task_bytes: int = CHUNK // 2) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, digest of the rest, and the removed ranges.

    Removed is each byte covered by a string of ``length`` bytes that also starts elsewhere, in any document, judged on the input.

    ``batches`` ranges of ids go through the index one after another. Anchors it reports fetch their texts; the strings they stand for
    are sorted and counted exactly, by two independent 64-bit fingerprints. Of equal texts all is removed and only one stands for them from then on.
    Range partitioning by (suffix or key, id, place) spreads hot strings over as many partitions as their rows need, with the
    cut groups brought together again by fingerprint.
    """
    rows = by_row(docs, id_col, text_col)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    info = stored(rows.select("own", "id", F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha")), "suffix-texts")
    groups = info.filter((F.col("n_bytes") >= length) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("one"), F.max("id").alias("last")).filter("one < last").drop("last")
    copies = stored(info.join(groups, "sha").select("id", "one").distinct(), "suffix-copies")
    index = SuffixIndex(length)
    found = None
    for part in batches_of(rows, batches):
        more = index.add(part)
        found = more if found is None else found.unionByName(more)
    places = found.join(copies.filter("id <> one").select("id"), "id", "left_anti").groupBy("id").agg(F.collect_list("pos").alias("places"))
    texts = stored(rows.drop("own").join(places, "id"), "suffix-candidates")
    strings = texts.mapInArrow(_strings(length), "key long, id long, start long, bytes binary")
    strings = strings.repartitionByRange("key", "id", "start").sortWithinPartitions("key", "id", "start")
    marked = stored(strings.mapInArrow(_count(length, task_bytes), "id long, start long, n long, w1 long, w2 long"), "suffix-found")
    runs = marked.filter("n > 0").select("id", "start", "n").unionByName(crossing(marked, later_only=False))
    runs = runs.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    cut = texts.select("id", "text").join(runs, "id").mapInArrow(_strip(length), f"id long, cut long, sha string, ranges {RANGES}")
    gone = copies.select("id", F.lit(True).alias("copy")).join(cut.withColumnRenamed("sha", "left_sha"), "id", "full")
    out = info.join(gone, "id", "left")
    full = F.coalesce("copy", F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    ranges = F.when(full, whole).otherwise(F.coalesce("ranges", F.array().cast(RANGES)))
    return out.select(
        F.col("own").alias(id_col), "n_bytes", F.when(full, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"), F.size(ranges).cast("long").alias("n_spans"),
        F.when(full, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"), ranges.alias("removed"),
    )
