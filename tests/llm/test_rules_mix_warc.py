import random
import re
import struct
from collections import Counter

import pytest

from netweir.llm import decontaminate, license, mixing, quality, toxicity, warc, work

from .helpers import SCHEMA, corpus, frame, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_equals_brute_force(spark):
    rows = corpus(9, 240)
    got = quality.quality_rules(frame(spark, rows)).collect()
    norm = lambda x: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(x))
    documents = Counter((r[2], n) for r in rows for n in {norm(x) for x in (r[1] or "").split("\n")} - {""})
    want = []
    for i, text, host, _ in rows:
        text = text or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        count = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        twice = {p for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        common = sum(len(words(x)) for x in lines if documents[host, norm(x)] > 20)
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        want.append((-1 if i is None else i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), failed, not failed and 100 * common <= 50 * len(w), common))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert any(x[-1] for x in want) and any(not x[7] and not x[6] for x in want)


def test_license_places_and_labels(spark):
    notice = license.NOTICES["mit"].split()
    del notice[8], notice[15]
    texts = ["Released under the MIT License. Again: under the mit license", "under the, mit-license!", "Apache License, Version 2.0", "apache license version", "CC BY-NC 4.0 cc by nc", " ".join(notice), "a " * 50 + "GNU", None, "", "É under the mit license " + "x " * 5000]
    got = {r.doc_id: r for r in license.license_scan(frame(spark, [(i, x, "s", 1) for i, x in enumerate(texts)])).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in range(5)] == [(2, 1, 6, "mit"), (1, 0, 0, "mit"), (1, 0, 0, "apache-2"), (0, None, None, ""), (2, 0, 5, "cc-by-nc")]
    assert (got[5].n_base, got[5].base_labels, got[5].labels) == (0, "", "mit") and 0.7 <= got[5].score < 1
    assert (got[6].labels, got[6].score, got[7].n_words, got[8].n_words, got[9].first_word) == ("", 0.0, 0, 0, 1)
    assert license.license_scan(frame(spark, [], SCHEMA)).count() == 0
    plan = license.license_scan(frame(spark, [(1, "x", "s", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def targets(sizes):
    """Water filling in plain Python: the excess over twice a source's size goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left, w = budget - sum(2 * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        above = {s for s in order if s not in stopped and weight[s] * left / w > 2 * sizes[s] + 1e-9}
        if not above:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * left / w for s in order}
        stopped |= above


@pytest.mark.parametrize("chunk", [7, 2048])
def test_mix_meets_targets(spark, chunk):
    rng = random.Random(3)
    rows = corpus(2, 90) + [(9000 + i, prose(rng, rng.randint(0, 40)), rng.choice(("hot", "hot", "é", "Z")), 1) for i in range(900)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, chunk=chunk).collect()
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(words(text))
    want, taken = targets(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        if r.source_size:
            assert int(r.target / r.source_size) <= r.copies <= int(r.target / r.source_size) + 1
        taken[r.source] += r.taken
    longest = {s: max((r.size for r in got if r.source == s)) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mixing.mix(docs.repartition(5), chunk=chunk).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "", "s", 0), (2, None, None, 0)])).collect()] == [0, 0]


def test_mix_of_rows_without_or_with_one_id(spark):
    """A source whose rows share an id or have none is dealt to chunks like any other."""
    rows = [(None, "w " * (1 + i % 7), "hot", 0) for i in range(900)] + [(5, "w " * (1 + i % 3), "cold", 0) for i in range(500)]
    docs = frame(spark, rows)
    sized = mixing.sized(docs, "doc_id", "text", "source")
    names = mixing.numbered(sized, block=16).collect()
    assert len(names) == len(set(names)) == len(rows)
    chunks = mixing.numbered(sized).filter("source = 'hot'").selectExpr("pmod(xxhash64(id, no_id, size, nth, 17), 15) AS c").groupBy("c").count().collect()
    assert len(chunks) == 15 and max(r["count"] for r in chunks) < 120
    got = mixing.mix(docs, chunk=64).collect()
    assert len(got) == len(rows) and all((r.doc_id is None) == (r.source == "hot") for r in got)
    for source in ("hot", "cold"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 7
    key = lambda r: (str(r.doc_id), r.size, r.copies, r.source)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7), chunk=64).collect()))


def test_pivotal_keeps_expectations():
    import pandas as pd

    total = Counter()
    for seed in range(400):
        pdf = pd.DataFrame({"id": range(6), "size": [5, 9, 4, 7, 1, 10], "base": 0, "part": 0.3, "copies": pd.array([None] * 6, "Int64")})
        for r in mixing.pivotal(seed, 0)(pdf).itertuples():
            total[r.id] += r.part if pd.isna(r.copies) else r.copies
    assert all(abs(total[i] / 400 - 0.3) < 0.08 for i in range(6))


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nInjected: 1", rng.choice(["<p>é</p>", "", None, prose(rng, 50), "\r\n\r\nx"])) for i in range(200)] + [(7, None, "same"), (7, "u", "same"), (None, "u", "alone"), (None, "u", "<p>é</p>"), (900, "", prose(rng, 90000))]
    path = work.folder(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS body", "1 AS id", "'x' AS sha", "0 AS first").repartition(3), path)
    got = warc.read(spark, path).collect()
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    want = sorted((str(p), (h or ""), "response" if least.get(h or "", p) == p else "revisit") for p, _, h in rows)
    full = {warc.digest((h or "").encode()): (h or "") for _, _, h in rows}
    assert sorted((str(r.page_id), full[r.payload_digest], r.record_type) for r in got) == want
    for r in got:
        text = full[r.payload_digest]
        assert r.payload_bytes == len(text.encode())
        assert (r.payload is None and r.refers_to == least[text]) if r.record_type == "revisit" else (bytes(r.payload) == text.encode() and r.refers_to is None)


def test_warc_short_payloads_and_nothing(spark):
    path = work.folder(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES), path, min_bytes=3)
    assert sorted((r.page_id, r.record_type) for r in warc.read(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    path = work.folder(spark, "warc-test")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def test_warc_refuses_bad_archives():
    import zstandard

    good = warc.record(1, "http://x", b"hello", None, False)
    lead, frame_ = struct.pack("<II", warc.DICTIONARY, 0), zstandard.compress(good)
    assert list(warc.frames(lead + frame_ + warc.EMPTY_FRAME + frame_)) == [good, good]
    for bad in (b"", frame_, lead + frame_[:-3], lead + b"xxxxxxxx", lead + frame_ + b"\x50"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(bad))
    assert warc.parse(good)[2] == 5
    for bad in (good[:-1], good.replace(b"hello", b"hallo"), good.replace(b"WARC-Type", b"X-Type"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), b"HTTP/1.1 x\r\n\r\n"):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 25, 14, 8, 3, 60))] + [(6, None), (None, prose(rng, 30)), (0, prose(rng, 22))]
    rows, leaks = [], set()
    for i in range(120):
        text = prose(rng, 70).upper()
        if i % 2:
            item = rng.choice([x for j, x in items if x and len(x.split()) >= 5])
            w = item.split()
            if len(w) >= 14 and i % 4 == 1:
                w[len(w) // 2] = w[len(w) // 3] = "zz"
            text = f"{prose(rng, 30)}, {' '.join(w)}! {prose(rng, 30)}"
            leaks.add(i)
        rows.append((i, text, "s", 1))
    rows += [(500, None, "s", 1), (501, "", "s", 1), (502, items[0][1], "s", 1), (502, items[0][1], "s", 1), (None, items[1][1], "s", 1), (503, items[4][1], "s", 1)]
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in got if r.contaminated}
    assert found == leaks | {502, None} and len(got) == len(rows)
    assert {r.item_id for r in got if r.doc_id == 502} == {0}
    # brute force: every item at every place
    sets = {r[0]: tokens(r[1]) for r in rows}
    for i, w in sets.items():
        hit = any(
            len(v) >= 5 and any(sum(a == b for a, b in zip(w[s : s + min(13, len(v))], v[o : o + min(13, len(v))])) * 100 >= 80 * min(13, len(v)) for s in range(len(w) - min(13, len(v)) + 1) for o in range(len(v) - min(13, len(v)) + 1))
            for v in (tokens(x) for _, x in items)
        )
        assert hit == (i in found), i
    assert decontaminate.decontaminate(frame(spark, [], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert clean.filter("contaminated").count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["slurone", "slurtwo", "slurthree"]
    rows, labels = [], []
    for i in range(900):
        rude, junk = rng.random() < 0.3, rng.random() < 0.3
        w = prose(rng, 25).split() + (["#"] * 3 + ["junk"] * 4 if junk else []) + (rng.sample(bad, 2) + (["junk"] if junk else []) if rude else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s", 1))
        labels.append((i, int(junk), int(rude)))
    docs = frame(spark, rows + [(5000, None, "s", 1), (5001, "", "s", 1), (None, "slurone slurtwo", "s", 1)])
    known = spark.createDataFrame(labels[:600] + [(None, 1, 1), (1, None, 0)], "doc_id long, junk int, rude int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, known, ["junk", "rude"]).collect()}
    right = sum(out[i].rejected == bool(rude) for i, _, rude in labels[600:])
    assert right >= 290 and out[None].rejected and not out[5000].rejected and not out[5001].rejected
    kept = toxicity.drop_toxic(docs, known, ["junk", "rude"])
    assert kept.schema == docs.schema and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if not r.rejected}
    none = spark.createDataFrame([], known.schema)
    assert toxicity.toxicity(docs, none, ["junk", "rude"]).filter("rejected").count() == 0
    assert toxicity.toxicity(frame(spark, [], SCHEMA), known, ["junk", "rude"]).count() == 0
