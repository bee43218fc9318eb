"""Small tables for the tests: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

WORDS = [f"w{i}" for i in range(400)]
CLASHING = ("id", "row", "n", "h", "key", "set", "words", "part", "size", "target", "hits", "place", "rejected", "kept", "spans", "host", "block", "a", "b", "sha", "item")


def frame(spark, rows, columns="doc_id long, text string, source string, n_chars long", clash=True):
    df = spark.createDataFrame(rows, columns)
    return df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHING)) if clash else df


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, source, n_chars): unrelated texts, copies, near copies, shared passages, and the odd ones."""
    rng = random.Random(seed)
    passage, hub = prose(rng, 45), prose(rng, 120)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = prose(rng, rng.randint(1, 90))
        elif kind == 1:
            text = f"{prose(rng, 12)}\n{passage}\n{prose(rng, 9)}"
        elif kind == 2:
            words = hub.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 3:
            text = hub
        elif kind == 4:
            text = "\n".join(prose(rng, rng.randint(3, 9)) for _ in range(6)) + "\nthe same common line of words here\n"
        else:
            text = "  É la\tligne x " + prose(rng, 30).upper()
        rows.append((i * 3, text, f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(1000, None, "s0", None), (1001, "", "s1", 0), (1002, " \n\t ", None, 4), (1003, "one", "s2", 3), (1004, prose(rng, 6000), "s0", 9)]
    rows += [(3, rows[1][1], "s1", 5), (2000, "tie tie tie " * 30, "s0", 1), (2000, "tie tie tie " * 30, "s0", 1), (None, passage, None, None), (None, None, "s9", None)]
    return rows


SCHEMA = "doc_id long, text string, source string, n_chars long"
