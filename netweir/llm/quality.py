"""Quality rules: repetition measures of one text, and lines that too many documents of one host share.

Null or empty text has no words and fails the base rule; a null host is a host of its own; rows count as documents even where ids repeat or
are null; columns other than the three named ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnp as t
from .work import stored

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MEASURES = "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
REPEAT_WORDS = 8


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[off])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def full_lines(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, row: np.ndarray):
    """Lines with a word: start, end, first word, word behind the last, owner row."""
    bounds = np.unique(np.concatenate((off, np.flatnonzero(buf == 10) + 1)))
    line, end = bounds[:-1], bounds[1:]
    end = end - (buf[end - 1] == 10)
    a, b = np.searchsorted(starts, line), np.searchsorted(starts, end)
    full = np.flatnonzero(b > a)
    line, end, a, b = line[full], end[full], a[full], b[full]
    return line, end, a, b, row[a] if len(a) else a


def normalised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of lines, whatever their case and spaces."""
    lower = t.span_hash(t.prefix(t.LOWER[buf]), starts, ends)
    return t.span_hash(t.prefix(lower, t.BASES[1]), a, b, t.BASES[1]).view(np.int64)


def _strip(batches):
    """(row, text) without the lines whose fingerprints the row names."""
    for batch in t.blocks(batches, "text"):
        buf, off = t.utf8(batch.column("text"))
        starts, ends, first = t.spans(buf, off)
        line, _, a, b, owner = full_lines(buf, off, starts, t.row_of(first))
        newline = np.flatnonzero(buf == 10)
        number = np.searchsorted(newline, line) - np.searchsorted(newline, off)[owner]
        norm, cut = normalised(buf, starts, ends, a, b), np.searchsorted(owner, np.arange(batch.num_rows + 1))
        texts = batch.column("text").to_pylist()
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            if gone:
                own = slice(cut[i], cut[i + 1])
                drop = set(number[own][np.isin(norm[own], gone)].tolist())
                texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in drop)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def measure(batches):
    """Measures of each text, and its distinct normalised lines (fingerprint, words that stand in them)."""
    for batch in t.blocks(batches, "text"):
        buf, off = t.utf8(batch.column("text"))
        starts, ends, first = t.spans(buf, off)
        row, rows = t.row_of(first), len(off) - 1
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0 if len(starts) and np.all(starts[1:] > ends[:-1]) else t.SPACE_WORD[buf]
        chars = _sums(inside & ((buf & 0xC0) != 0x80), off)
        sums = t.prefix(buf)
        words = t.span_hash(sums, starts, ends)
        # windows of eight words found twice in the text, their words covered
        valid = t.whole(row, REPEAT_WORDS)
        cover = np.zeros(len(words) + 1, np.int32)
        if valid.any():
            at = np.flatnonzero(valid)
            twice = at[_repeated(t.window_hash(words, REPEAT_WORDS)[at] ^ t.mix(row[at].astype(t.U64) + t.U64(1)))]
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + REPEAT_WORDS, -1)
        repeat = _sums(np.cumsum(cover[:-1]) > 0, first)
        line, end, a, b, owner = full_lines(buf, off, starts, row)
        raw = np.unique(t.span_hash(sums, line, end) ^ t.mix(owner.astype(t.U64) + t.U64(1)), return_index=True)[1]
        dup = np.bincount(owner, minlength=rows) - np.bincount(owner[raw], minlength=rows)
        norm = normalised(buf, starts, ends, a, b)
        order = np.lexsort((norm, owner))
        norm, own, size = norm[order], owner[order], (b - a)[order]
        new = np.flatnonzero(np.concatenate(([True], (norm[1:] != norm[:-1]) | (own[1:] != own[:-1])))) if len(norm) else np.zeros(0, np.int64)
        size = np.add.reduceat(size, new) if len(new) else size
        lists = np.searchsorted(own[new], np.arange(rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("host"), pa.array(np.diff(first), pa.int64()), pa.array(chars), pa.array(_sums(SYMBOLS[buf], off)), pa.array(dup, pa.int64()), pa.array(repeat),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(norm[new])), pa.ListArray.from_arrays(pa.array(lists), pa.array(size, pa.int32())),
                *([batch.column("row")] if "row" in batch.schema.names else []),
            ],
            names=["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", *(["row"] if "row" in batch.schema.names else [])],
        )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_documents: int = 20, max_removed_percent: int = 50, min_words: int = 20, max_repeat_percent: int = 30, with_text: bool = False,
) -> DataFrame:
    """One row per document with its measures and verdict, and ``with_text`` its text without the removed lines.

    A line (words of A-Z lower-cased, joined by one space) that stands in more than ``max_documents`` documents of a host is removed from all
    of that host's documents. ``n_common_words`` counts the words so removed; a document that loses over ``max_removed_percent`` of its words is
    rejected, as is one that fails the base rule.

    Counts per (host, line) combine before the shuffle, so a hot line costs one row a task; the marked lines join back by (host, line), an inner
    join whose hot keys AQE splits. Only fingerprints move; text does ``with_text``, whose rows are stored once with a key.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    kinds = f"{MEASURES}, lines array<long>, line_words array<int>"
    if with_text:
        texts = stored(texts.withColumn("text", F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id()), "quality-texts")
        rows = stored(texts.mapInArrow(measure, f"{kinds}, row long"), "quality")
    else:
        rows = stored(texts.mapInArrow(measure, kinds).withColumn("row", F.monotonically_increasing_id()), "quality")
    host = [F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host")]
    lines = rows.select("row", *host, F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "h", "no_host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    common = lines.groupBy("h", "no_host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > max_documents).drop("documents")
    marked = lines.join(common, ["h", "no_host", "line"])
    lost = marked.groupBy("row").agg(F.sum("n").alias("n_common_words"))
    out = rows.drop("lines", "line_words").join(lost, "row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_common_words") > max_removed_percent * F.col("n_words")
    rest = []
    if with_text:
        gone = marked.groupBy("row").agg(F.collect_list("line").alias("gone"))
        out = out.join(texts.select("row", "text").join(gone, "row", "left").mapInArrow(_strip, "row long, text string"), "row")
        rest = [F.col("text").alias(text_col)]
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_common_words", *rest
    )
