import hashlib
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netweir.llm import substring, suffixes

from .helpers import SCHEMA, corpus, frame


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_row(rows):
    """Rows that repeat an id are documents of their own, shorter texts first; the keys are (id, place among its rows)."""
    docs, own = {}, defaultdict(list)
    for i, x, *_ in rows:
        if i is not None:
            own[i].append(x)
    for i, texts in own.items():
        docs |= {(i, k): x for k, x in enumerate(sorted(texts, key=lambda x: (x is not None, len((x or "").encode()), x)))}
    return docs


def brute_words(rows, window):
    first = {}
    docs = by_row(rows)
    for i in sorted(docs):
        w = words(docs[i])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = {}
    for i, x in docs.items():
        w = words(x)
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (i, s) for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("partitions,task_bytes", [(1, 1 << 22), (23, 1 << 22), (3, 300)])
def test_windows_equal_brute_force(spark, partitions, task_bytes):
    rows = corpus()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = substring.dedup_substrings(frame(spark, rows), task_bytes=task_bytes).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = brute_words(rows, 20)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) == sorted((i, *x) for (i, _), x in want.items())
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert r.doc_id is not None or r.n_removed == 0
    assert sum(r.n_removed for r in got) > 1000


def brute_bytes(rows, length):
    seen, docs = defaultdict(set), {i: (x or "").encode() for i, x in by_row(rows).items()}
    for i, b in docs.items():
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].add((i, s))
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if len(seen[b[s : s + length]]) > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batches,partitions,task_bytes", [(1, 2, 300), (3, 19, 1 << 22)])
def test_bytes_equal_brute_force(spark, batches, partitions, task_bytes):
    rows = corpus(7)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = suffixes.dedup_bytes(frame(spark, rows), batches=batches, task_bytes=task_bytes).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = brute_bytes(rows, 200)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == sorted((i, *x) for (i, _), x in want.items())
    for r in got:
        assert r.doc_id is not None or r.n_removed == 0
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed


def test_levels_merge_geometrically(spark):
    index, docs = suffixes.SuffixIndex(200), frame(spark, corpus(3), clash=False).selectExpr("doc_id AS id", "text")
    sizes = []
    for k in range(5):
        index.add(docs.filter(f"id % 5 = {k}"))
        sizes.append([s for s, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]


def test_empty_tables(spark):
    none = frame(spark, [], SCHEMA)
    assert substring.dedup_substrings(none).count() == 0
    assert suffixes.dedup_bytes(none).count() == 0


def odd_rows():
    """Different texts under one id: short rows last and in the middle, copies under one id and across ids, and neighbours that repeat nothing."""
    sixty, thirty = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(30))
    unique = " ".join(f"u{i}" for i in range(900))
    rows = [(0, sixty), (1, f"{thirty} {sixty}"), (1, "a b c"), (2, unique), (5, sixty), (5, "x"), (5, f"{thirty} z"), (6, None), (6, sixty), (7, "short"), (7, f"{sixty} y"), (9, " ".join(f"v{i}" for i in range(50)))]
    return [(i, x, "s", 1) for i, x in rows]


def test_rows_of_one_id_are_judged_by_themselves(spark):
    rows = odd_rows()
    got = substring.dedup_substrings(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((i, *x) for (i, _), x in brute_words(rows, 20).items())
    assert {r.n_removed for r in got if r.doc_id in (2, 9)} == {0}
    got = suffixes.dedup_bytes(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *x) for (i, _), x in brute_bytes(rows, 200).items())
    assert {r.n_removed for r in got if r.doc_id in (2, 9)} == {0}
    assert len(got) == len(rows) and all(r.n_removed <= r.n_bytes for r in got)


def test_fingerprints_tell_regular_sequences_apart():
    """Sequences of two values that every polynomial modulo 2**64 with an odd base confuses."""
    from netweir.llm import textnp as t

    turn = np.array([bin(i).count("1") % 2 for i in range(4096)])
    for base in t.BASES:
        for n in (512, 1024, 4096):
            both = np.concatenate((turn[:n], 1 - turn[:n])).astype(t.U64) * t.U64(0x1234567)
            a, b = t.span_hash(t.prefix(both, base), np.array([0, n]), np.array([n, 2 * n]), base)
            assert a != b
    where = np.random.default_rng(0).integers(0, 9, 5000).astype(t.U64)
    twice = np.concatenate((where, np.zeros(77, t.U64), where))
    sums = t.prefix(twice)
    assert (t.span_hash(sums, np.array([3, 9]), np.array([4000, 9])) == t.span_hash(sums, np.array([5080, 40]), np.array([9077, 40]))).all()


def peak(function, batches):
    """Largest number of bytes that the function holds at a time, and the rows it gives."""
    tracemalloc.start()
    rows = sum(x.num_rows for x in function(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_byte_tasks_hold_little(spark):
    rng = np.random.default_rng(1)
    data = [rng.bytes(360) for _ in range(20_000)]
    key, start = pa.array(np.arange(20_000) // 5), pa.array(np.arange(20_000) % 5 * 400)
    strings = pa.RecordBatch.from_arrays([key, key, start, pa.array(data, pa.binary())], names=["key", "id", "start", "bytes"])
    assert peak(suffixes._count(200, suffixes.CHUNK), [strings])[0] < 100 << 20
    texts = pa.array([rng.integers(97, 123, 5000, np.uint8).tobytes().decode() for _ in range(4000)])
    runs = pa.array([[{"start": 100 * i, "n": 3} for i in range(40)]] * 4000)
    most, rows = peak(suffixes._strip(200), [pa.RecordBatch.from_arrays([pa.array(range(4000)), texts, runs], names=["id", "text", "runs"])])
    assert rows == 4000 and most < 20 << 20


def test_equal_stretches_meet_the_others_once():
    """Of stretches equal byte for byte one is cut into strings; a third that shares some of them is found through it."""
    rng = np.random.default_rng(2)
    a = rng.bytes(300)
    data = [a, a, a[:250] + rng.bytes(50), rng.bytes(300), a]
    cells = [[7] * 5, [1, 2, 3, 4, 5], [0, 10, 20, 30, 40]]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cells), pa.array(data, pa.binary())], names=["key", "id", "start", "bytes"])
    got = pa.Table.from_batches(suffixes._count(200, 1 << 20)(iter([batch]))).to_pylist()
    assert sorted((r["id"], r["start"], r["n"]) for r in got if r["n"]) == [(1, 0, 101), (2, 10, 101), (3, 20, 51), (5, 40, 101)]
    ends = [(r["id"], r["start"]) for r in got if not r["n"]]
    assert len(ends) == len(set(ends)) == 101 + 50 + 101


def test_a_batch_is_tokenised_once(spark, monkeypatch):
    plans, write = [], suffixes.stored
    monkeypatch.setattr(suffixes, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))) or write(df, name))
    index, docs = suffixes.SuffixIndex(200), frame(spark, corpus(3), clash=False).selectExpr("doc_id AS id", "text")
    for k in range(3):
        index.add(docs.filter(f"id % 3 = {k}"))
    assert [name for name, _ in plans] == ["suffix-batch", "suffix-level", "suffix-batch", "suffix-level", "suffix-batch", "suffix-level", "suffix-scan"]
    assert {n for _, n in plans} == {1}
