"""Line dedup by a deletion-neighbourhood join.

Lines are the parts between newlines; their words are runs of anything but space and tab..CR, A-Z lower-cased. Near lines have ``MIN_WORDS`` words or
more, so one edit is at most a fifth of a line; exact copies have ``exact_words`` or more. Null and empty texts have no such lines and stay as they are. A row with a null id
keeps its text and is no one's earlier copy. Rows that repeat an id are documents of their own: shorter texts come first, of equal ones all but one lose their lines. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t
from .work import by_row, stored

MIN_WORDS = 5
FULL = -1  # the place of no deletion


def lines(batch: pa.RecordBatch, least: int = MIN_WORDS):
    """Words, and lines of at least so many words: owner row, number in the row, first word, word behind the last."""
    buf, off = t.utf8(batch.column("text"))
    low = t.LOWER[buf]
    starts, ends, first = t.spans(low, off)
    newline = np.flatnonzero(buf == 10)
    bounds = np.unique(np.concatenate((off, newline + 1)))
    cut = np.searchsorted(starts, bounds)
    full = np.flatnonzero(np.diff(cut) >= least)
    begin = bounds[full]
    owner = np.searchsorted(off, begin, "right") - 1
    number = np.searchsorted(newline, begin) - np.searchsorted(newline, off)[owner]
    return low, starts, ends, owner, number, cut[full], cut[full + 1]


def _halves(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys a line. Lines within one edit share one: a half on the side away from the edit, cut for the shorter line's length."""
    n, keys = b - a, []
    for size in (n, n - 1):
        half = size // 2
        salt = t.mix(size.astype(t.U64))
        keys += [t.span_hash(sums, a, a + half, t.BASES[1]) ^ salt, t.span_hash(sums, b - (size - half), b, t.BASES[1]) + salt]
    return np.stack(keys, axis=1)


def _occurrences(least: int):
    """Lines of ``least`` words or more; those too short for near lines have no halves."""

    def run(batches):
        for batch in t.blocks(batches, "text"):
            low, starts, ends, owner, number, a, b = lines(batch, least)
            words = t.span_hash(t.prefix(low), starts, ends)
            sums = t.prefix(words, t.BASES[1])
            # the same word hashes scrambled anew: no second power table as long as the text
            second = t.span_hash(t.prefix(t.mix(words * t.U64(t.BASES[1]) + t.U64(7))), a, b)
            near = b - a >= MIN_WORDS
            keys = _halves(sums, a[near], b[near]).view(np.int64)
            off = pa.array(np.concatenate(([0], np.cumsum(near * 4))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(number), pa.array(t.span_hash(sums, a, b, t.BASES[1]).view(np.int64)), pa.array(second.view(np.int64)), pa.ListArray.from_arrays(off, pa.array(keys.ravel()))], names=["id", "no", "line", "again", "halves"])

    return run


def _variants(batches):
    """Of the lines asked for: the line itself (with its words) and its words without each one, as fingerprints."""
    for batch in t.blocks(batches, "text"):
        low, starts, ends, owner, number, a, b = lines(batch)
        asked = batch.column("numbers")
        wanted = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy())) * (1 << 40) + asked.flatten().to_numpy()
        keep = np.flatnonzero(np.isin(owner * (1 << 40) + number, wanted))
        a, b, owner, number = a[keep], b[keep], owner[keep], number[keep]
        if not len(a):
            continue
        sums = t.prefix(t.span_hash(t.prefix(low), starts, ends), t.BASES[1])
        size = b - a
        which = np.repeat(np.arange(len(a)), size)
        gone = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        at, x, y = a[which] + gone, a[which], b[which]
        inverse = t.powers(pow(t.BASES[1], -1, 1 << 64), len(sums))
        cut = t.mix((sums[at] - sums[x]) * inverse[x] + (sums[y] - sums[at + 1]) * inverse[x + 1])
        text, where = t.joined(low, starts, ends)
        packed = [bytes(text[where[i] : where[j] - 1]).decode() for i, j in zip(a, b)]
        who = np.concatenate((np.arange(len(a)), which))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((t.flat_hash(sums, a, b, t.BASES[1]), cut)).view(np.int64)), pa.array(np.concatenate((np.full(len(a), FULL), gone)), pa.int32()),
                batch.column("id").take(pa.array(owner[who])), pa.array(number[who]), pa.array(packed + [None] * len(which), pa.string()),
            ],
            names=["variant", "gone", "id", "no", "words"],
        )


def within_one(a: str, b: str) -> bool:
    """Whether one word inserted, dropped or replaced at most makes one line the other."""
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def _checked(batches):
    for batch in batches:
        good = [within_one(x, y) for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist())]
        yield batch.select(["id", "no"]).filter(pa.array(good, pa.bool_()))


def repeated_lines(texts: DataFrame, exact_words: int = MIN_WORDS) -> DataFrame:
    """(id, no) of each line that an earlier one (smaller id, or same id and smaller number) equals or lies within one word edit of."""
    found = stored(texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(_occurrences(exact_words), "id long, no long, line long, again long, halves array<long>"), "lines")
    place = F.struct("id", "no").alias("place")
    first = stored(found.groupBy("line", "again").agg(F.min(place).alias("place"), F.first("halves").alias("halves")), "lines-first")
    copies = found.join(first.select("line", "again", "place"), ["line", "again"]).filter(F.struct("id", "no") != F.col("place")).select("id", "no")
    # only distinct lines that share a half with another can have a neighbour
    halves = first.select("place", F.explode(F.array_distinct("halves")).alias("half"))
    busy = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    asked = halves.join(busy, "half").select("place.*").distinct().groupBy("id").agg(F.collect_list("no").alias("numbers"))
    variants = texts.join(asked, "id").select("id", "text", "numbers").mapInArrow(_variants, "variant long, gone int, id long, no long, words string")
    variants = stored(variants, "lines-variants")
    rows = variants.select("variant", "gone", place)
    swap = rows.groupBy("variant", "gone").agg(F.min("place").alias("by"), F.count("*").alias("c")).filter("c > 1").drop("c")
    full, cut = F.when(F.col("gone") == FULL, F.col("place")), F.when(F.col("gone") != FULL, F.col("place"))
    slip = rows.groupBy("variant").agg(F.min(full).alias("whole"), F.min(cut).alias("part")).filter("whole IS NOT NULL AND part IS NOT NULL")
    near = rows.join(swap, ["variant", "gone"]).select("place", "by")
    near = near.unionByName(rows.filter(F.col("gone") != FULL).join(slip, "variant").select("place", F.col("whole").alias("by")))
    near = near.unionByName(slip.select(F.col("whole").alias("place"), F.col("part").alias("by"))).filter("by < place")
    near = stored(near.groupBy("place").agg(F.min("by").alias("by")), "lines-near")
    words = variants.filter(F.col("gone") == FULL).select(place, "words").dropDuplicates(["place"])
    pairs = near.join(words, "place").join(words.select(F.col("place").alias("by"), F.col("words").alias("other")), "by")
    return stored(copies.unionByName(pairs.select("place.*", "words", "other").mapInArrow(_checked, "id long, no long")).distinct(), "lines-gone")


def _strip(batches):
    for batch in batches:
        texts, n, gone = batch.column("text").to_pylist(), [], []
        for i, numbers in enumerate(batch.column("numbers").to_pylist()):
            parts = (texts[i] or "").split("\n")
            drop = set(numbers or ())
            if drop:
                texts[i] = "\n".join(x for j, x in enumerate(parts) if j not in drop)
            n.append(len(parts) if texts[i] is not None else 0)
            gone.append(len(drop))
        keep = [c for c in batch.schema.names if c not in ("text", "numbers")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*keep, "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_words: int = 1) -> DataFrame:
    """One row per document: its text without the lines of which an earlier line is a copy or within one word edit, lines, and lines removed. Judged on the input.

    Exact copies, equal in two 64-bit fingerprints of their words, collapse to their first place by a combined minimum. Each remaining line that shares half of its words with another emits the fingerprints
    of itself and of itself without each word. Equal fingerprints with the same word left out are one replaced word; a whole
    line equal to another's shortened form is one inserted word. The earliest of each such group is all the others' witness, so groups
    of any size cost a row each and no pairs; each witness is verified on the words. Hot lines and variants combine before the shuffle and join
    back as skewed joins.
    """
    rows = by_row(docs, id_col, text_col)
    gone = repeated_lines(rows.drop("own"), exact_words).groupBy("id").agg(F.collect_list("no").alias("numbers"))
    out = rows.join(gone, "id", "left").drop("id").mapInArrow(_strip, "own long, text string, n_lines long, n_removed long")
    return out.select(F.col("own").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_removed")


NUMBERS = "_removed_line_numbers"


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_words: int = 1) -> DataFrame:
    """The documents, all columns as they are but the text without its repeated lines; one that thereby loses its last word goes.

    ``id_col`` has to name each row: rows that share it lose the lines found for any of them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = repeated_lines(texts, exact_words).groupBy("id").agg(F.collect_list("no").alias(NUMBERS)).withColumnRenamed("id", NUMBERS + "_of")

    names = docs.columns

    def strip(batches):
        for batch in batches:
            texts, keep = batch.column(text_col).to_pylist(), []
            for i, numbers in enumerate(batch.column(NUMBERS).to_pylist()):
                if numbers:
                    drop = set(numbers)
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in drop)
                keep.append(not numbers or bool(texts[i].strip(" \t\n\v\f\r")))
            columns = [pa.array(texts, batch.schema.field(c).type) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return docs.join(gone, docs[id_col] == gone[NUMBERS + "_of"], "left").drop(NUMBERS + "_of").mapInArrow(strip, docs.schema)
