"""Substring dedup by super-k-mer partitioning.

Words are runs of anything but space and tab..CR, unchanged. Null and empty texts have no words. A row with a null id keeps its text and is no one's
earlier copy. Rows that repeat an id are documents of their own: shorter texts come first, of equal ones all but one lose what repeats.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import textnp as t
from .work import by_row, stored

MINIMISER = 2
PLACE = t.U64((1 << 32) - 1)
CHUNK = 4 << 20
SEEN = 1 << 20
KMERS = "mini int, id long, start long, n int, words binary"
FOUND = "id long, start long, n long, w1 long, w2 long"


class _Seen:
    """Packed strings met so far: fingerprint, second fingerprint, id and start of the first, sorted by fingerprint. Forgets all beyond ``SEEN`` of them."""

    def __init__(self):
        self.rows = [np.zeros(0, t.U64), np.zeros(0, t.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def later(self, x: np.ndarray, y: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of these equal one met before that has a smaller id, or the same id and a smaller start; new ones are remembered."""
        if not len(x):
            return np.zeros(0, bool)
        if len(self.rows[0]) > SEEN:
            self.__init__()
        known = self.rows[0]
        value, head, group = np.unique(x, return_index=True, return_inverse=True)
        at = np.searchsorted(known, value)
        met = np.zeros(len(value), bool)
        if len(known):
            met = known[np.minimum(at, len(known) - 1)] == value
        lead = []
        for i, new in enumerate((y, doc, start), 1):
            first = new[head]
            first[met] = self.rows[i][at[met]]
            lead.append(first[group])
        fresh = ~met
        self.rows = [np.insert(old, at[fresh], new[head[fresh]]) for old, new in zip(self.rows, (x, y, doc, start))]
        return (lead[0] == y) & ((lead[1] < doc) | ((lead[1] == doc) & (lead[2] < start)))


def super_kmers(window: int, m: int = MINIMISER):
    """Runs of windows that share the place of their smallest m-gram, each packed as its words joined by one space.

    A run that equals an earlier one this task has met is a copy already: it goes on as its number of windows alone.
    """

    def run(batches):
        seen = _Seen()
        for batch in t.blocks(batches, "text"):
            buf, off = t.utf8(batch.column("text"))
            starts, ends, first = t.spans(buf, off)
            row = t.row_of(first)
            at = np.flatnonzero(t.whole(row, window))
            if not len(at):
                continue
            grams = t.window_hash(t.span_hash(t.prefix(buf), starts, ends), m)
            key = (grams & ~PLACE) | np.arange(len(grams), dtype=t.U64)
            place = (t.sliding_min(key, window - m + 1)[at] & PLACE).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 0))))
            a, b = at[new], at[np.append(new[1:], len(at)) - 1] + window
            text, where = t.joined(buf, starts, ends)
            lo, hi, own = where[a], where[b] - 1, row[a]
            mini = (grams[place[new]] >> t.U64(32)).astype(np.uint32).view(np.int32)
            doc, start = batch.column("id").to_numpy()[own], a - first[own]
            x, y = (t.span_hash(t.prefix(text, q), lo, hi, q) for q in t.BASES)
            copy = seen.later(x, y, doc, start)
            n = np.where(copy, b - a - window + 1, 0).astype(np.int32)
            for part, words in ((~copy, t.binary(*t.gather(text, lo[~copy], (hi - lo)[~copy]))), (copy, pa.nulls(int(copy.sum()), pa.binary()))):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in (mini, doc, start, n)), words], names=["mini", "id", "start", "n", "words"])

    return run


def whole_keys(batches, key: str, limit: int, most: int = 0):
    """Tables of about ``limit`` bytes of the sorted rows, cut where the key changes if it does; one key alone may take ``most`` bytes if that is more.

    With each, whether its first and its last key may have more rows elsewhere: at the partition's ends, and where one key alone fills a table.
    """
    held, size, open_first = [], 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(changes):
            cut = int(changes[-1])
            yield table.slice(0, cut), open_first, False
            rest = table.slice(cut).combine_chunks()
            held, size, open_first = rest.to_batches(), rest.nbytes, False
        elif size < most:
            held = table.to_batches()
        else:
            yield table, True, True
            held, size, open_first = [], 0, True
    if held:
        yield pa.Table.from_batches(held), open_first, True


def mark_repeats(key, own, doc, place, w1, w2, open_keys: list, later_only: bool, known: np.ndarray | None = None):
    """Runs of windows found more than once (all, or those behind the first), and first windows of the open keys, which a boundary may cut, with n = 0.

    ``own`` is each window's row of ``key``. Equal places are one occurrence. For ``later_only`` windows come by (key, doc, place), and equal ones stay in that order.
    Runs of rows that are ``known`` to repeat whole are left out.
    """
    order = np.argsort(w1, kind="stable" if later_only else None)
    x, y = w1[order], w2[order]
    head = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(order)]
    group = np.cumsum(head) - 1
    lead = order[head][group]
    again = (doc[order] != doc[lead]) | (place[order] != place[lead])
    marked = np.zeros(len(order), bool)
    marked[order] = again if later_only else np.bincount(group, weights=again, minlength=1)[group] > 0
    if known is not None:
        marked &= ~known[own]
    hit = np.flatnonzero(marked)
    if len(hit):
        new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(own[hit]) != 0))))
        yield _found(doc[hit[new]], place[hit[new]], np.diff(np.append(new, len(hit))), None, None)
    if open_keys:
        kept = order[head]
        kept = kept[np.isin(key[own[kept]], open_keys)]
        yield _found(doc[kept], place[kept], np.zeros(len(kept), np.int64), w1[kept].view(np.int64), w2[kept].view(np.int64))


def crossing(found: DataFrame, later_only: bool) -> DataFrame:
    """(id, start, n = 1) of the windows that another partition holds too, from the rows with n = 0: one a partition for each window."""
    here, same = F.struct("id", "start"), Window.partitionBy("w1", "w2")
    ends = found.filter("n = 0").withColumn("first", F.min(here).over(same)).withColumn("last", F.max(here).over(same))
    ends = ends.filter((F.col("first") != here) if later_only else (F.col("first") != F.col("last")))
    return ends.select("id", "start", F.lit(1).cast("long").alias("n"))


def count_windows(window: int, limit: int):
    """Sorts the windows of each bucket; those behind the first of their kind come out as runs.

    A minimiser that a boundary may cut has more occurrences in the neighbouring part: its first windows come out too, with n = 0.
    """

    def run(batches):
        for table, is_first, is_last in whole_keys(batches, "mini", limit):
            mini = table.column("mini").to_numpy()
            open_keys = [mini[0]] * is_first + [mini[-1]] * is_last
            known = pc.is_null(table.column("words"))
            copies, table = table.filter(known), table.filter(pc.invert(known)).combine_chunks()
            if copies.num_rows:
                yield _found(*(copies.column(c).to_numpy() for c in ("id", "start", "n")), None, None)
            if not table.num_rows:
                continue
            mini, ids, begin = (table.column(c).to_numpy() for c in ("mini", "id", "start"))
            buf, off = t.utf8(table.column("words").combine_chunks())
            starts, ends, first = t.spans(buf, off)
            row = t.row_of(first)
            at = np.flatnonzero(t.whole(row, window))
            own = row[at]
            w1, w2 = (t.window_hash(t.span_hash(t.prefix(buf, a), starts, ends, a), window, b)[at] for a, b in (t.BASES, t.BASES[::-1]))
            doc, place = ids[own], begin[own] + at - first[own]
            yield from mark_repeats(mini, own, doc, place, w1, w2, open_keys, later_only=True)

    return run


def _found(doc, place, n, w1, w2) -> pa.RecordBatch:
    empty = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(n, pa.int64()), empty if w1 is None else pa.array(w1), empty if w2 is None else pa.array(w2)], names=["id", "start", "n", "w1", "w2"])


def _strip(window: int):
    def run(batches):
        for batch in t.blocks(batches, "text"):
            buf, off = t.utf8(batch.column("text"))
            starts, ends, first = t.spans(buf, off)
            lists = batch.column("spans")
            base = np.repeat(first[:-1], np.diff(lists.offsets.to_numpy())) if batch.num_rows else np.zeros(0, np.int64)
            flat = lists.flatten()
            begin, n = (base + flat.field("start").to_numpy(), flat.field("n").to_numpy())
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + n - 1 + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            text, where = t.joined(buf, starts[keep], ends[keep])
            edge = where[np.concatenate(([0], np.cumsum(keep)))[first]]
            kept = [bytes(text[a : max(a, b - 1)]) for a, b in zip(edge[:-1], edge[1:])]
            left = np.diff(np.concatenate(([0], np.cumsum(keep)))[first])
            n_words = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n_words), pa.array(n_words - left), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=["own", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, task_bytes: int = CHUNK) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words, and the kept words joined by one space.

    Removed is each word covered by a window of ``window`` words whose sequence also starts earlier (smaller id, or same id and earlier start),
    judged on the input.

    Consecutive windows that share a minimiser travel as one packed string; copies that a task has met before travel as a number. Range partitioning by (minimiser, id, start) spreads a hot
    minimiser over as many partitions as its rows need, and a task holds ``task_bytes`` of packed windows at a time; what a boundary may have cut
    meets again by window fingerprint, one row a part. Windows compare by two independent 64-bit fingerprints.
    """
    rows = by_row(docs, id_col, text_col)
    kmers = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(super_kmers(window), KMERS)
    sorted_kmers = kmers.repartitionByRange("mini", "id", "start").sortWithinPartitions("mini", "id", "start")
    found = stored(sorted_kmers.mapInArrow(count_windows(window, task_bytes), FOUND), "substring-found")
    runs = found.filter("n > 0").select("id", "start", "n").unionByName(crossing(found, later_only=True))
    spans = runs.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    none = F.array().cast("array<struct<start:long,n:long>>")
    out = rows.join(spans, "id", "left").withColumn("spans", F.coalesce("spans", none))
    out = out.mapInArrow(_strip(window), "own long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select(F.col("own").alias(id_col), "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept_text"))
