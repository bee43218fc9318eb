"""License scan by diagonal voting, with DataFrame functions only.

Null text is empty. Every row is a document; rows that repeat an id stay apart. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of public licenses, words in order; a license of several passages has a key for each.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "gpl": "this work is licensed under the gnu general public license version",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike international license",
    "cc-by": "this work is licensed under a creative commons attribution international license",
}
#: The labels of keys that are no labels themselves.
LABELS = {
    "mit-rights": "mit", "mit-notice": "mit", "mit-warranty": "mit", "apache-2-copy": "apache-2", "apache-2-basis": "apache-2",
    "bsd-source": "bsd", "bsd-binary": "bsd", "bsd-warranty": "bsd", "gpl-notice": "gpl", "gpl-warranty": "gpl",
}
WORD_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3


#: First letter that stands for a word in an alignment; letters before it stand for words that no template gram covers.
LETTER, OTHER = "0", "/"
SLACK, MIN_VOTES, MIN_SCORE = 4, 0.3, 0.7


def letters(words: list[str]) -> str:
    """A letter for each word, the same for equal words."""
    known: dict[str, int] = {}
    return "".join(chr(ord(LETTER) + known.setdefault(w, len(known))) for w in words)


def template_rows(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, gram: int = GRAM) -> list[tuple]:
    """(template, label, exact, code, at, gram) of every gram of every template; ``code`` has a letter for each word."""
    rows = []
    for exact, texts in ((True, [(k, v) for k, v in phrases.items()]), (False, [(v, LABELS.get(k, k)) for k, v in notices.items()])):
        for text, label in texts:
            words = text.split()
            if len(words) < gram:
                raise ValueError(f"template shorter than {gram} words: {text}")
            rows += [(text, label, exact, letters(words), i, " ".join(words[i : i + gram])) for i in range(len(words) - gram + 1)]
    return rows


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
    gram: int = GRAM, slack: int = SLACK, min_votes: float = MIN_VOTES, min_score: float = MIN_SCORE,
) -> DataFrame:
    """One row per document: words, places of the base phrases, base labels, all labels, the best score and the verified spans.

    The rolling word ``gram``-gram hashes of a text join the template positions by hash (and, against collisions, by the words themselves). Hits are
    aggregated by diagonal (place in text less place in template). A diagonal merges with its neighbours at most ``slack`` to either side, never further,
    which tolerates inserted and dropped words; merged diagonals that hold at least ``min_votes`` of the template's grams name a span, from where the first hit
    puts the template's first word to where the last hit puts its last. A span is verified by aligning its words with the template's:
    the score is 1 less their edit distance in words over the longer of the two, and must reach ``min_score``. Words of the span that stand in no common gram
    count as different. Of overlapping spans of one label the best stays (highest score, then first, then longest).
    A base phrase needs all its grams on one diagonal, that is, its words consecutively; it is a span of score 1.

    ``spans`` holds (first, last, label, score), words counted from 0, in order. ``score`` is the largest, 0 without a span.

    Grams that hash to no template position leave before the explode; hits are dealt by row once, for all that follows.
    """
    spark = docs.sparkSession
    fixed = template_rows(phrases, notices, gram)
    place = spark.createDataFrame(fixed, "template string, label string, exact boolean, code string, at int, gram string").withColumn("h", F.xxhash64("gram"))
    known = sorted({r.h for r in place.select("h").distinct().collect()})  # fixed texts: a few hundred hashes
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), WORD_SPLIT), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), words.alias("words"))

    def gram_at(words, i):
        return F.concat_ws(" ", *[F.element_at(words, i + j + 1) for j in range(gram)])

    # a second projection over the words array: each gram once
    starts = F.when(F.size("words") >= gram, F.sequence(F.lit(0), F.size("words") - gram)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(F.transform(starts, lambda i: F.struct(i.alias("pos"), gram_at(F.col("words"), i).alias("gram"))), lambda g: F.xxhash64(g["gram"]).isin(known))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    found = rows.select("row", "id", "n_words", F.explode_outer("hits").alias("x")).select("row", "id", "n_words", "x.pos", "x.gram", F.xxhash64("x.gram").alias("h"))
    votes = found.join(F.broadcast(place), ["h", "gram"], "left").repartition("row")
    doc, template = ["row", "id", "n_words"], ["template", "label", "exact", "code"]
    diagonals = votes.groupBy(*doc, *template, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))

    n_grams, length = F.length("code") - gram + 1, F.length("code")
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    placed = F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), at.alias("at")))
    merged = diagonals.withColumn("hits", F.flatten(F.collect_list(placed).over(near)))
    base = F.col("exact") & (F.size("ats") == n_grams)
    voted = ~F.col("exact") & (F.size(F.array_distinct(F.col("hits.at"))) >= min_votes * n_grams)
    begin, end = F.array_min("hits"), F.array_max("hits")
    merged = merged.withColumns({"base": F.coalesce(base, F.lit(False)), "voted": F.coalesce(voted, F.lit(False))}).withColumns({
        "first": F.when(F.col("base"), F.col("diagonal")).when(F.col("voted"), F.greatest(begin["pos"] - begin["at"], F.lit(0))).cast("long"),
        "stop": F.when(F.col("base"), F.col("diagonal") + length).when(F.col("voted"), F.least(end["pos"] - end["at"] + length, F.col("n_words"))).cast("long"),
    })

    def cover(hit):
        return F.array(*[F.struct((hit["pos"] + j).cast("long"), F.substring(F.col("code"), hit["at"] + j + 1, F.lit(1))) for j in range(gram)])

    letter = F.map_from_entries(F.array_distinct(F.flatten(F.transform("hits", cover))))
    seen = merged.withColumn("letter", F.when(F.col("voted"), letter))
    text = F.array_join(F.transform(F.sequence(F.col("first"), F.col("stop") - 1), lambda p: F.coalesce(F.col("letter")[p], F.lit(OTHER))), "")
    aligned = 1 - F.levenshtein(text, F.col("code")) / F.greatest(length, F.col("stop") - F.col("first"))
    judged = seen.withColumn("score", F.when(F.col("base"), F.lit(1.0)).when(F.col("voted"), aligned))
    good = F.coalesce(F.col("score") >= min_score, F.lit(False))
    judged = judged.select(*doc, "base", "diagonal", *[F.when(good, F.col(c)).alias(c) for c in ("label", "first", "stop", "score")])

    earlier = Window.partitionBy("row", "label", "base").orderBy("first", "stop", "score", "diagonal")
    apart = F.col("base") | F.coalesce(F.col("first") >= F.max("stop").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = judged.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("score", (-F.col("first")).alias("negative"), "stop"))
    spans = islands.groupBy(*doc, "label", "base", "island").agg(best.alias("b")).select(
        *doc, "label", "base", "b.score", (-F.col("b.negative")).alias("first"), (F.col("b.stop") - 1).alias("last"),
    )
    at = F.when(F.col("base"), F.col("first"))
    return (
        spans.groupBy("row").agg(
            F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.count_if("base").alias("n_base"),
            F.min(at).alias("first_word"), F.max(at).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("first", "last", "label", "score")))).alias("spans"),
        ).drop("row")
    )
