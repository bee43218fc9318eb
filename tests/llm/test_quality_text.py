"""Texts without the lines that too many documents of a host share."""

import re
from collections import Counter

from netweir.llm import quality

from .helpers import corpus, frame


def norm(line):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def test_removed_lines_leave_the_text(spark):
    rows = corpus(9, 240)
    documents = Counter((r[2], n) for r in rows for n in {norm(x) for x in (r[1] or "").split("\n")} - {""})
    want = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if documents[r[2], norm(x)] <= 20)) for r in rows]
    out = quality.quality_rules(frame(spark, rows), with_text=True)
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
    assert sum(x != r[1] for (_, x), r in zip(want, rows)) > 20
    plain = quality.quality_rules(frame(spark, rows)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, out.drop("text").collect()))
