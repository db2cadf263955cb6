"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lines, mixing, near, neighbours, pii, quality, repeats, tokens
from .frames import only, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.with_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return out.select(
        "doc_id", F.size(lines.split_lines(F.col("text"))).cast("long").alias("n_lines"), F.size("lines_removed").cast("long").alias("n_removed"),
        F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("n_kept_chars"), F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


OP1 = """
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE length(text) > 0),
long AS (SELECT *, trim(raw, ' ') AS line FROM lines),
spread AS (SELECT line, min((doc_id, pos)) AS first_place FROM long WHERE length(line) >= 12 GROUP BY line HAVING count(DISTINCT site) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.raw, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first_place AS gone
  FROM long l LEFT JOIN spread s ON l.line = s.line),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(kept, '')) AS n_kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.with_licenses(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    base = F.filter("licenses", lambda m: m["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"), F.coalesce(F.array_max(F.transform("licenses", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def _op4_sql() -> str:
    """The same from all places of every key phrase, without an index."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SEPARATORS}'), lambda x: x <> '')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {t.key_at}, {quoted(t.key)}, {quoted(t.words)})" for t in licenses.Settings().templates)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
t(label, base, key_at, key, words) AS (VALUES {rows}),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM t),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d) GROUP BY word),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(n, 0) + 1)) AS weight FROM vocabulary v LEFT JOIN df ON v.word = df.word),
places AS (
  SELECT doc_id, label, base, key_at, words, unnest(list_filter(range(0, len(w) - len(key) + 1), lambda i: w[i + 1:i + len(key)] = key)) AS start, w
  FROM d, t WHERE list_contains(w, key[1])),
hits AS (
  SELECT p.doc_id, p.label, p.base, p.start, sum(i.weight) AS whole, sum(CASE WHEN p.start - p.key_at + j >= 0 AND p.w[(p.start - p.key_at + j + 1)::BIGINT] = p.words[(j + 1)::BIGINT] THEN i.weight ELSE 0 END) AS found
  FROM (SELECT *, unnest(range(0, len(words))) AS j FROM places) p JOIN idf i ON i.word = p.words[(j + 1)::BIGINT] GROUP BY ALL),
scored AS (SELECT *, CASE WHEN base OR whole <= 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, found / whole), 6) END AS s FROM hits),
good AS (SELECT * FROM scored WHERE s >= 0.6),
summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score
  FROM good GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(only(table(spark, sf_dir, "documents"), *DOCUMENT))
    return out.select("doc_id", "source", "mix_copies", "mix_copy", "mix_key", "text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(only(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(only(table(spark, sf_dir, "documents"), "doc_id", "text"))


OP5 = """
WITH named AS (
  SELECT doc_id, source, text, coalesce('=' || source, '') AS source_key, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS id FROM documents),
n AS (SELECT source_key, count(*) AS docs FROM named GROUP BY 1),
w AS (SELECT source_key, docs, pow(docs::DOUBLE, 0.7) AS weight FROM n),
r AS (SELECT source_key, weight / sum(weight) OVER () * sum(docs) OVER () * 1.0 / docs AS rate FROM w),
p AS (
  SELECT source_key, rate, k, sum(term) OVER (PARTITION BY source_key ORDER BY k) AS cdf
  FROM (SELECT source_key, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM r, (SELECT unnest(range(0, 120)) AS k))),
u AS (
  SELECT doc_id, source, text, source_key, id, ('0x' || substr(md5('17|' || id || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM named),
c AS (SELECT u.doc_id, u.id, u.source, u.text, (SELECT count(*) FROM p WHERE p.source_key = u.source_key AND p.cdf <= u.u)::INTEGER AS mix_copies FROM u)
SELECT doc_id, source, mix_copies, mix_copy::INTEGER AS mix_copy,
  ('0x' || substr(md5('18|' || id || '|' || mix_copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_key, text
FROM (SELECT *, unnest(range(0, mix_copies)) AS mix_copy FROM c WHERE mix_copies > 0)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a secret of the caller; without one the results of this query are those of a known key
    settings = pii.Settings(key=spark.conf.get("spark.inkwell.pii.key", "query"))
    out = pii.with_surrogates(only(table(spark, sf_dir, "documents"), "doc_id", "text"), settings)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), "text", "entities")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    out = quality.with_score(documents, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return neighbours.search(vectors, vectors.where("id % 50 = 0"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.removed(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = decontaminate.with_overlaps(documents, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["same"])), F.lit(0)).cast("long").alias("most_same"),
        F.array_join(F.transform("overlaps", lambda x: x["item_id"].cast("string")), ",").alias("items"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_counts": op3_token_counts,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_repeats": op9_repeats,
    "op10_decontaminate": op10_decontaminate,
}
SQL: dict[str, str] = {"op1_line_dedup": OP1, "op4_licenses": _op4_sql(), "op5_mixing": OP5}
