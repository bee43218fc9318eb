"""Verified spans of the license scan."""

import re

from netweir.llm import license

from .helpers import SCHEMA, frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def scan(spark, texts):
    return {r.doc_id: r for r in license.license_scan(frame(spark, [(i, x, "s", 1) for i, x in enumerate(texts)])).collect()}


def test_scattered_grams_are_no_license(spark):
    bsd = license.NOTICES["bsd"].split()
    scattered = " ".join(" ".join(bsd[i : i + 3]) + f" junk{i}" for i in range(len(bsd) - 2))
    shuffled = " ".join(" ".join(bsd[i : i + 5]) for i in range(len(bsd) - 5, -1, -5))
    got = scan(spark, [scattered, shuffled, scattered + " " + " ".join(bsd)])
    assert [(got[i].labels, got[i].score, got[i].spans) for i in (0, 1)] == [("", 0.0, [])] * 2
    n = len(scattered.split())
    assert [(s.first, s.last, s.label, s.score) for s in got[2].spans] == [(n, n + len(bsd) - 1, "bsd", 1.0)]


def test_score_is_the_word_alignment(spark):
    """Edits far enough apart leave every other word in a common gram, so the score is the plain edit distance in words."""
    mit = license.NOTICES["mit-warranty"].split()
    dropped = [w for i, w in enumerate(mit) if i not in (20, 40)]
    added = mit[:15] + ["so"] + mit[15:50] + ["called"] + mit[50:]
    changed = [("other" if i in (10, 30, 50) else w) for i, w in enumerate(mit)]
    cases = [mit, dropped, added, changed]
    got = scan(spark, ["Intro words " + " ".join(x) + " the end" for x in cases])
    for i, x in enumerate(cases):
        (span,) = got[i].spans
        assert (span.first, span.last, span.label) == (2, len(x) + 1, "mit")
        assert abs(span.score - (1 - distance(x, mit) / max(len(x), len(mit)))) < 1e-12


def test_copies_and_passages_are_spans_of_their_own(spark):
    whole = [license.NOTICES[k] for k in ("mit", "mit-rights", "mit-notice", "mit-warranty")]
    twice = "x " * 3 + whole[0] + " y " + whole[0]
    got = scan(spark, [" ".join(whole), twice, "under the MIT license " * 3, "of the software " * 500, None, ""])
    n = len(whole[0].split())
    assert [s.first for s in got[0].spans] == [0, n, n + len(whole[1].split()), n + len((whole[1] + " " + whole[2]).split())]
    assert [s.score for s in got[0].spans] == [1.0] * 4 and got[0].labels == "mit"
    assert [(s.first, s.last) for s in got[1].spans] == [(3, n + 2), (n + 4, 2 * n + 3)]
    assert [(s.first, s.last, s.score) for s in got[2].spans] == [(0, 3, 1.0), (4, 7, 1.0), (8, 11, 1.0)] and got[2].n_base == 3
    assert all((got[i].labels, got[i].spans) == ("", []) for i in (3, 4, 5))


def test_every_passage_is_found_and_repeated_ids_stay_apart(spark):
    texts = list(license.NOTICES.items())
    got = license.license_scan(frame(spark, [(7, re.sub(r"\b(\w)", lambda m: m[0].upper(), t), "s", 1) for _, t in texts] + [(None, None, None, None)], SCHEMA)).collect()
    assert len(got) == len(texts) + 1
    assert sorted(license.LABELS.get(k, k) for k, _ in texts) == sorted(s.label for r in got for s in r.spans if s.score == 1.0 and s.last + 1 == r.n_words and s.first == 0)
