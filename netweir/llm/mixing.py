"""Mixing sources to target weights by pivotal dependent rounding.

Null text has size 0. A null source is a source of its own, the last. Rows that repeat an id are documents of their own. Other columns are
ignored. Rows that agree in id, size and source are numbered; which of them gets which number shows in no result. An empty table gives an empty result; a source without words has target 0 and its documents are taken once or not at all (0 words).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .work import stored

WEIGHTS = (3, 1, 2)
NAME = ("id", "no_id", "size", "nth")
STATE = "id long, no_id boolean, size long, nth long, source string, source_size long, target double, chunk long, base long, part double, copies long"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    number = F.col(id_col).cast("long")
    return docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"), words.cast("long").alias("size"), F.col(source_col).cast("string").alias("source"))


def numbered(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Numbers the rows that agree in all columns (``nth``), wherever they lie: they are counted, and counts become rows again.

    A count is spread over tasks in blocks before it becomes rows, so a third of all rows may agree.
    """
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("c"))
    blocks = counts.withColumn("b", F.explode(F.expr(f"sequence(0L, (c - 1) div {block})"))).repartition("id", "size", "b")
    first = F.col("b") * block
    nth = F.explode(F.sequence(first, F.least(first + block, F.col("c")) - 1))
    return blocks.select(*rows.columns, nth.alias("nth"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """Per source: size, number of documents, weight, target. Whole numbers throughout, so that reruns agree to the last bit.

    A target is the smaller of ``most`` times the source's size and weight times a common level. The level starts as total over weights and is
    solved anew over the sources below their stop until none is above it; each round is one aggregate whose single row comes to the driver.
    """
    per = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    # rank by code point, null last: places inside range partitions plus the rows of the partitions before
    ranged = stored(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "mix-ranks")
    before = ranged.groupBy("p").count().withColumn("before", F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last()))
    rank = inside + F.coalesce("before", F.lit(0)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)
    per = stored(ranged.join(before, "p").select("source", "source_size", "n", weight.cast("long").alias("weight")), "mix-weights")
    def sums(part: DataFrame, column: str) -> tuple[int, int]:
        got = part.agg(F.coalesce(F.sum(exact(column)), F.lit(0)), F.count("*")).first()
        return int(got[0]), int(got[1])

    def exact(column: str):
        return F.col(column).cast("decimal(19,0)")

    budget = share_percent * sums(per, "source_size")[0]  # in hundredths of a word
    stopped = F.lit(False)
    while True:
        left = budget - 100 * most * sums(per.filter(stopped), "source_size")[0]
        weighs, others = sums(per.filter(~stopped), "weight")
        if not others:
            break
        # weight * left / weighs is above the stop of 100 * most * size
        above = exact("weight") * F.lit(left).cast("decimal(19,0)") > exact("source_size") * F.lit(100 * most * weighs).cast("decimal(19,0)")
        if per.filter(~stopped & above).isEmpty():
            break
        stopped = stopped | above
    level = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(100.0 * weighs) if weighs else F.lit(0.0)
    return per.select("source", "source_size", "n", F.when(stopped, (most * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def _draw(seed: int, *key) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest()) / 2**64


def pivotal(seed: int, level: int, name: tuple[str, ...] = ("id", "size")):
    """Rounds all but one fractional document of a chunk.

    Two fractions a, b with sizes s, t exchange words: either a gains what b can give, or b what a can, with chances that keep both
    expectations. One of the two becomes whole and the sum of a*s + b*t stays. The other meets the next document. Draws hash the columns in ``name``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_draw(seed, level, *row) for row in zip(*(pdf[c].tolist() for c in name))]
        pdf = pdf.assign(key=keys).sort_values(["key", *name], ignore_index=True)
        names = list(zip(*(pdf[c].tolist() for c in name)))
        part, copies, sizes = pdf.part.tolist(), pdf.copies.astype("float").tolist(), pdf["size"].tolist()
        held = None

        def whole(i: int, up: bool) -> None:
            copies[i] = float(pdf.base[i] + up)

        for i, b in enumerate(part):
            if copies[i] == copies[i]:
                continue
            if b <= 0.0 or b >= 1.0:
                whole(i, b >= 1.0)
                continue
            if held is None:
                held = i
                continue
            a, s, t = part[held], float(sizes[held]), float(sizes[i])
            if not s or not t:  # without words there is nothing to trade: round on its own
                j = held if not s else i
                whole(j, _draw(seed, "zero", level, *names[j]) < part[j])
                held = i if j == held else held
                continue
            gain, give = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
            if _draw(seed, level, *names[held], *names[i]) < give / (gain + give):
                if (1 - a) * s <= b * t:
                    whole(held, True)
                    part[i], held = b - gain / t, i
                else:
                    whole(i, False)
                    part[held] = a + gain / s
            elif a * s <= (1 - b) * t:
                whole(held, False)
                part[i], held = b + give / t, i
            else:
                whole(i, True)
                part[held] = a - give / s
            if not 1e-12 < part[held] < 1 - 1e-12:
                whole(held, part[held] > 0.5)
                held = None
        pdf["part"] = part
        pdf["copies"] = pd.array([None if c != c else int(c) for c in copies], dtype="Int64")
        return pdf.drop(columns="key")

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2, seed: int = 17, chunk: int = 2048) -> DataFrame:
    """One row per document: its size, its source's size and target, the copies the mix takes of it and their words.

    A document's expected copies are target over source size, the same for all of a source; whole parts are taken, fractions rounded. A source's documents are dealt to chunks
    of about ``chunk`` rows by a hash of id, size and number, however large the source and however often an id repeats or is missing, so no task holds a source. Each chunk leaves one fraction at most; these meet ``chunk`` at a time
    on the next level of the tree until a source has one left, which a coin decides. The taken words of a source miss its target by less than one
    document. All draws hash ids and the seed: reruns agree wherever rows lie.
    """
    rows = stored(numbered(sized(docs, id_col, text_col, source_col)), "mix-sizes")
    goals = targets(rows, weights, share_percent, most)
    most_rows = goals.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = F.pmod(F.xxhash64("id", "no_id", "size", "nth", F.lit(seed)), F.ceil(F.col("n") / chunk))
    state = rows.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    state = state.select("id", "no_id", "size", "nth", "source", "source_size", "target", dealt.alias("chunk"), F.floor(share).alias("base"), (share - F.floor(share)).alias("part"), F.lit(None).cast("long").alias("copies"))
    done, level, chunks = [], 0, -(-most_rows // chunk)
    while True:
        state = stored(state.groupBy("source", "chunk").applyInPandas(pivotal(seed, level, NAME), STATE), f"mix-level{level}")
        done.append(state.filter(F.col("copies").isNotNull()))
        state = state.filter(F.col("copies").isNull())
        level += 1
        if chunks <= 1:
            break
        chunks = -(-chunks // chunk)
        state = state.withColumn("chunk", F.expr(f"chunk div {chunk}"))
    # one fraction a source: a coin
    coin = F.pmod(F.xxhash64("id", "no_id", "size", "nth", "source", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(state.withColumn("copies", F.col("base") + (coin < F.col("part")).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.col("source").alias(source_col))
