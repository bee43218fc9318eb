"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, license, linedup, mixing, nearest, product, quality, simplex, substring, suffixes, toxicity, warc, whitening, work


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.license_scan(_table(spark, sf_dir, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["last"]))
    return out.withColumn("spans", F.array_join(places, ","))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that the given labels hold, in chain order: low quality, then toxic."""
    return _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir), ["low_quality", "toxic"])
    return out.withColumn("kept", ~F.col("rejected"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumn("kept", ~F.col("contaminated"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(_table(spark, sf_dir, "documents")).drop("removed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work.folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster_vectors(_table(spark, sf_dir, "embeddings"), dims=64, k=16, rounds=3, scale=64, seed=1)


_ALL = [op1_substring_dedup, op2_line_dedup, op3_license_scan, op4_mixing, op5_toxicity, op6_decontamination, op7_minhash, op8_suffix_dedup, op9_warc, op10_quality_rules]
QUERIES = {f.__name__: f for f in [*_ALL, op11_whitening, op12_jaccard_join, op13_centroid_clustering]}

_SPACE = r"[\x20\x09-\x0D]+"


def _license_sql() -> str:
    """The same method in SQL: grams against template positions, diagonals merged with their neighbours, spans aligned by letters."""
    rows = ", ".join("('{}', '{}', {}, '{}', {}, '{}')".format(*row) for row in license.template_rows())
    return rf"""
WITH place(template, label, exact, code, slot, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
g AS (SELECT doc_id, len(words) AS n, unnest(list_transform(range(greatest(len(words) - 2, 0)),
      lambda i: {{'pos': i, 'gram': words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]}})) AS x FROM d),
diagonals AS (SELECT doc_id, n, template, label, exact, code, x.pos - slot AS diagonal, list(DISTINCT slot) AS slots,
    list(DISTINCT x.pos * 1000 + slot) AS hits FROM g JOIN place ON x.gram = gram GROUP BY ALL),
merged AS (SELECT * EXCLUDE (hits), exact AND len(slots) = length(code) - 2 AS base, flatten(list(hits) OVER w) AS hits FROM diagonals
  WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {license.SLACK} PRECEDING AND {license.SLACK} FOLLOWING)),
candidates AS (SELECT *, CASE WHEN base THEN diagonal ELSE greatest(list_min(hits) // 1000 - list_min(hits) % 1000, 0) END AS first,
    CASE WHEN base THEN diagonal + length(code) ELSE least(list_max(hits) // 1000 - list_max(hits) % 1000 + length(code), n) END AS stop
  FROM merged WHERE base OR (NOT exact AND len(list_distinct(list_transform(hits, lambda h: h % 1000))) >= {license.MIN_VOTES} * (length(code) - 2))),
numbered AS (SELECT *, row_number() OVER () AS c FROM candidates),
covered AS (SELECT DISTINCT c, h // 1000 + j AS p, substr(code, (h % 1000 + j + 1)::INT, 1) AS letter
  FROM (SELECT c, code, unnest(hits) AS h FROM numbered), range(3) AS r(j)),
places AS (SELECT c, unnest(range(first, stop)) AS p FROM numbered),
texts AS (SELECT places.c, string_agg(coalesce(letter, '{license.OTHER}'), '' ORDER BY places.p) AS seen
  FROM places LEFT JOIN covered ON places.c = covered.c AND places.p = covered.p GROUP BY places.c),
judged AS (SELECT doc_id, label, base, first, stop, CASE WHEN base THEN 1.0::DOUBLE
    ELSE 1 - levenshtein(seen, code)::DOUBLE / greatest(length(code), stop - first) END AS score FROM numbered JOIN texts USING (c)),
good AS (SELECT * FROM judged WHERE score >= {license.MIN_SCORE}),
islands AS (SELECT *, sum(CASE WHEN base OR before IS NULL OR first >= before THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, label, base ORDER BY first, stop, score ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id, label, base ORDER BY first, stop, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good)),
spans AS (SELECT doc_id, label, base, score, first, stop - 1 AS last FROM islands
  QUALIFY row_number() OVER (PARTITION BY doc_id, label, base, island ORDER BY score DESC, first, stop DESC) = 1)
SELECT d.doc_id, len(any_value(d.words))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, (min(first) FILTER (base))::BIGINT AS first_word,
  (max(first) FILTER (base))::BIGINT AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(score), 0.0) AS score,
  coalesce(string_agg(label || ':' || first || ':' || last, ',' ORDER BY first, last, label) FILTER (label IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, html, array_to_string(list_transform(string_split(sha1(html), ''),
      lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY bits) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT + 4 * substr(bits, 5 * i::INT + 3, 1)::INT
    + 2 * substr(bits, 5 * i::INT + 4, 1)::INT + substr(bits, 5 * i::INT + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, line, list_filter(string_split_regex(translate(line, '{license.UPPER}', '{license.LOWER}'), '{_SPACE}'), lambda x: x <> '') AS words FROM l),
full_lines AS (SELECT doc_id, source, line, len(words) AS n, array_to_string(words, ' ') AS norm FROM n WHERE len(words) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
common AS (SELECT source, norm FROM full_lines GROUP BY ALL HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT doc_id, sum(n)::BIGINT AS n_common_words FROM full_lines f JOIN common c ON f.norm = c.norm AND f.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
win AS (SELECT doc_id, unnest(list_transform(range(greatest(len(words) - 7, 0)), lambda i: {{'i': i, 'x': array_to_string(words[i + 1 : i + 8], ' ')}})) AS y FROM w),
twice AS (SELECT doc_id, y.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, y.x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_common_words, 0) AS n_common_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_common_words <= 50 * n_words AS kept, n_common_words FROM b"""

_SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(greatest(len(words) - 19, 0)), lambda i: {{'i': i, 'x': sha256(array_to_string(words[i + 1 : i + 20], ' '))}})) AS y FROM d),
later AS (SELECT doc_id, y.i AS i FROM win QUALIFY row_number() OVER (PARTITION BY y.x ORDER BY doc_id, y.i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
lost AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_MINHASH_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id,
  d.doc_id <= coalesce(min(other), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id"""

_LINES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
w AS MATERIALIZED (SELECT doc_id, no, list_filter(string_split_regex(translate(line, '{license.UPPER}', '{license.LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM l),
f AS MATERIALIZED (SELECT doc_id, no, w, array_to_string(w, ' ') AS x FROM w WHERE len(w) >= 1),
u AS MATERIALIZED (SELECT x, any_value(w) AS w, min((doc_id, no)) AS place FROM f GROUP BY x),
v AS MATERIALIZED (SELECT place, unnest(list_transform(range(len(w)), lambda i: {{'i': i, 'v': array_to_string(list_concat(w[1 : i], w[i + 2 :]), ' ')}})) AS y FROM u WHERE len(w) >= 5),
near AS (SELECT b.place FROM v a JOIN v b ON a.y.v = b.y.v AND a.y.i = b.y.i AND a.place < b.place
  UNION SELECT v.place FROM u JOIN v ON u.x = v.y.v AND u.place < v.place AND len(u.w) >= 5
  UNION SELECT u.place FROM u JOIN v ON u.x = v.y.v AND v.place < u.place AND len(u.w) >= 5),
gone AS (SELECT doc_id, no FROM f JOIN u USING (x) WHERE (doc_id, no) <> u.place OR u.place IN (SELECT place FROM near)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (g IS NULL) AS kept, count(*) AS n, count(g) AS r
  FROM l LEFT JOIN (SELECT *, 1 AS g FROM gone) USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)"""

_SUFFIX_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(greatest(length(x) // 2 - 199, 0)))::INT AS i FROM d)),
twice AS MATERIALIZED (SELECT doc_id, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM twice)) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (coalesce(e, length(x) // 2) - s)), '' ORDER BY s) AS rest FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, length(x)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
degree AS (SELECT a AS doc_id, count(*) AS k FROM edge GROUP BY a),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id, coalesce(any_value(k), 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN degree USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id"""


def _clusters_sql(dims: int = 64, k: int = 16, rounds: int = 3) -> str:
    """The same rounds in SQL, by plain distances to all centroids."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})",
    ]
    near = "SELECT vec_id, any_value(x) AS x, min((d, cluster)) AS best FROM (SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{}) GROUP BY vec_id"
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"u{i} AS (SELECT best[2] AS cluster, unnest(x) AS e, unnest(range({dims})) AS pos FROM a{i})",
            f"m{i} AS (SELECT cluster, pos, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS e FROM u{i} GROUP BY ALL)",
            f"n{i} AS (SELECT cluster, list(e::BIGINT ORDER BY pos) AS c FROM m{i} GROUP BY cluster)",
            f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (cluster))",
        ]
    steps.append(f"a AS MATERIALIZED (SELECT vec_id, best[1] AS distance, best[2] AS cluster FROM ({near.format(rounds)}))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (cluster)"""


ORACLES = {"op12_jaccard_join": _JACCARD_SQL, "op13_centroid_clustering": _clusters_sql(), "op8_suffix_dedup": _SUFFIX_SQL, "op2_line_dedup": _LINES_SQL, "op7_minhash": _MINHASH_SQL, "op1_substring_dedup": _SUBSTRING_SQL, "op3_license_scan": _license_sql(), "op9_warc": _WARC_SQL, "op10_quality_rules": _QUALITY_SQL}
