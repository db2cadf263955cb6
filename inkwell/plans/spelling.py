"""Spelling against a dictionary table: known forms by derivation, prefix, compound; identifiers, accepted words and names; suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import DOUBLED, FUNCTION_WORDS, NORDIC_ENDINGS
from ..sources.names import BY_NAME
from .engine import query, table

#: Endings and what stands for them in the base word (fixed values).
ENDINGS = (
    ("['’]s$", ""), ("s['’]$", "s"), ("s$", ""), ("es$", ""), ("ies$", "y"), ("ed$", ""), ("ed$", "e"), ("ied$", "y"), ("ing$", ""), ("ing$", "e"), ("er$", ""), ("er$", "e"), ("ers$", ""), ("ers$", "e"), ("est$", ""), ("ly$", ""), ("ily$", "y"), ("ness$", ""),
    ("iness$", "y"), ("able$", ""), ("able$", "e"), ("less$", ""), ("ful$", ""), ("ment$", ""), ("ments$", ""),
)
PREFIXES = ("de", "dis", "mis", "non", "over", "pre", "re", "sub", "un")


def bases(word: Column) -> Column:
    """Words that ``word`` can be derived from: endings, doubled consonants, prefixes, and both together."""
    plain = F.lower(F.replace(word, F.lit("’"), F.lit("'")))
    ended = [F.when((F.length(plain) >= 4) & plain.rlike(e), F.regexp_replace(plain, e, new)) for e, new in ENDINGS]
    doubled = F.when(plain.rlike(r"([b-df-hj-np-tv-z])\1(?:ed|ing|er|ers)$"), F.regexp_replace(plain, r"([b-df-hj-np-tv-z])\1(?:ed|ing|er|ers)$", "$1"))
    first = F.array_compact(F.array(plain, *ended, doubled))
    cut = F.flatten(F.transform(first, lambda w: F.array_compact(F.array(*[F.when(w.startswith(p) & (F.length(w) >= len(p) + 4), F.substring(w, len(p) + 1, 99)) for p in PREFIXES]))))
    return F.array_distinct(F.concat(first, cut))


def derived(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct ``words(word)`` that are in ``dictionary(known)`` or derive from a word of it."""
    each = words.select("word", F.explode(bases(F.col("word"))).alias("known"))
    return each.join(dictionary, "known", "left_semi").select("word").distinct()


def compounds(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words of six letters or more made of two known ones; the second part has four to eight letters."""
    own = words.where("length(word) >= 6 AND word RLIKE '^[A-Za-z]+$'").select("word", F.lower("word").alias("w"))
    split = own.select("word", "w", F.explode(F.expr("sequence(3, length(w) - 4)")).alias("at")).where("length(w) - at BETWEEN 4 AND 8").select("word", F.expr("substring(w, 1, at)").alias("a"), F.expr("substring(w, at + 1)").alias("b"))
    first = split.join(dictionary.select(F.col("known").alias("a")), "a", "left_semi")
    return first.join(dictionary.select(F.col("known").alias("b")), "b", "left_semi").select("word").distinct()


def misspelled(tokens: DataFrame, dictionary: DataFrame, accepted: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Tokens ``(doc_id, place, word)`` that are unknown, neither accepted nor like an identifier.

    Every distinct word is judged once, however often it stands in the corpus.
    """
    plain = tokens.where(F.col("word").rlike(r"^[A-Za-z][a-z'’]+$") & ~F.lower("word").rlike(r"^(?:(?:ha|he|lo){2,}|[ivxlcdm]+)$"))
    for p in patterns:
        plain = plain.where(~F.col("word").rlike(f"^(?:{p})$"))
    distinct = plain.select("word").distinct().join(accepted.select(F.lower("known").alias("low")), F.lower("word") == F.col("low"), "left_anti")
    unknown = distinct.join(derived(distinct, dictionary), "word", "left_anti")
    unknown = unknown.join(compounds(unknown, dictionary), "word", "left_anti")
    return plain.join(unknown, "word", "left_semi")


def suggested(words: DataFrame, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` known words within two edits; candidates share a word with one letter deleted, so nothing is enumerated twice."""
    deleted = lambda c: F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))))
    a = words.select("word", F.explode(F.array_distinct(deleted(F.lower("word")))).alias("key"))
    b = dictionary.select("known", F.explode(F.array_distinct(deleted(F.col("known")))).alias("key"))
    near = a.join(b, "key").select("word", "known").distinct().withColumn("edits", F.levenshtein(F.lower("word"), "known", 2)).where("edits >= 0")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("edits", "known"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("word", F.col("known").alias("suggestion"), "rank")


WORDS = ("boat", "lock", "work", "sun", "flower", "run", "happy", "carry", "use", "house", "light", "name")
TYPED = ("boats", "unlocked", "reworking", "sunflower", "runner", "happiness", "boatz", "flowr", "Zebulon", "MKDIR", "carries", "houselight")
TEXTS = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(TYPED)) + " END"


def _dictionary(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORDS], "known string")


@query("spelling", "SELECT p_partkey AS doc_id, CASE p_partkey % 12 WHEN 6 THEN 'boatz' ELSE 'flowr' END AS word FROM part WHERE p_partkey % 12 IN (6, 7)")
def spelling(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("place"), F.expr(TEXTS).alias("word"))
    return misspelled(tokens, _dictionary(spark), spark.createDataFrame([("zebulon",)], "known string"), ("MK.*",)).select("doc_id", "word")


@query("spelling_corrections", "SELECT * FROM (VALUES ('boatz', 'boat', 1), ('flowr', 'flower', 1)) AS t(word, suggestion, rank)")
def spelling_corrections(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.expr(TEXTS).alias("word")).distinct().where("word IN ('boatz', 'flowr')")
    return suggested(words, _dictionary(spark))


# languages of documents


def front_language(text: Column) -> Column:
    """Declared language of a text's front matter, its primary part."""
    front = F.regexp_extract(text, r"\A---\n([\s\S]*?)\n---", 1)
    found = F.lower(F.regexp_extract(front, r"(?m)^lang(?:uage)?\s*[:=]\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


@query("document_language", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'sv' WHEN p_partkey % 3 = 1 THEN 'fi' ELSE 'und' END AS language FROM part")
def document_language(spark, sf_dir):
    """Front matter, else the configuration of the path, else detection, else undetermined."""
    text = F.expr("CASE WHEN p_partkey % 3 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || 'lang: sv-SE' || chr(10) || '---' || chr(10) || 'Hej' ELSE 'Hej' END")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), F.when(F.col("p_partkey") % 3 == 1, "fi").alias("configured"), F.lit(None).cast("string").alias("detected"))
    return d.select("doc_id", F.coalesce(front_language(F.col("text")), "configured", "detected", F.lit("und")).alias("language"))


ENGLISH_STOP = "a an and are as at be by for from has have in is it its not of on or that the this to was were will with".split()


@query("looks_not_english", f"""WITH w AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda x: lower(x)) AS w FROM documents)
SELECT doc_id FROM w WHERE len(w) >= 80 AND len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in ENGLISH_STOP)}))) * 100 < 8 * len(w) AND len(regexp_extract_all(text, '[^\\x00-\\x7F]')) * 100 >= 5 * length(text)""")
def looks_not_english(spark, sf_dir):
    """Eighty words or more, few English function words, many letters beyond ASCII."""
    w = table(spark, sf_dir, "documents").select("doc_id", "text", F.transform(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1)), F.lower).alias("w"))
    stop = F.size(F.filter("w", lambda x: x.isin(ENGLISH_STOP)))
    return w.where((F.size("w") >= 80) & (stop * 100 < 8 * F.size("w")) & (F.regexp_count("text", F.lit(r"[^\x00-\x7F]")) * 100 >= 5 * F.length("text"))).select("doc_id")


NORDIC = {lang: sorted(set(FUNCTION_WORDS[lang].split()) - set(FUNCTION_WORDS["en"].split())) for lang in ("fi", "sv")}
NORDIC_TEXT = "CASE c_custkey % 5 WHEN 0 THEN 'plain words only' WHEN 1 THEN 'Det var en bil och den gick på vägen' WHEN 2 THEN 'Se oli auto ja hän ajoi kaupungissa' WHEN 3 THEN 'det on ja och' ELSE c_mktsegment END || ' ' || c_name"


def nordic_points(documents: DataFrame) -> DataFrame:
    """(doc_id, fi, sv): two points for a function word and for the letter å, one for an ending of a word of six letters and for a doubled Finnish vowel."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)), F.lower)

    def points(w: Column) -> Column:
        count = lambda f: F.size(F.filter(w, f))

        def of(lang: str) -> Column:
            own, ends = NORDIC[lang], rf"(?:{'|'.join(NORDIC_ENDINGS[lang])})$"
            return 2 * count(lambda x: x.isin(own)) + count(lambda x: (F.length(x) >= 6) & x.rlike(ends))

        return F.struct((of("fi") + count(lambda x: x.rlike(DOUBLED.pattern))).cast("long").alias("fi"), (of("sv") + 2 * count(lambda x: F.contains(x, F.lit("å")))).cast("long").alias("sv"))

    return documents.select("doc_id", F.explode(F.transform(F.array(words), points)).alias("p")).select("doc_id", "p.fi", "p.sv")


def _nordic_sql() -> str:
    point = lambda lang: f"2 * (word IN ({', '.join(repr(x) for x in NORDIC[lang])}))::INT + (length(word) >= 6 AND regexp_matches(word, '({'|'.join(NORDIC_ENDINGS[lang])})$'))::INT"
    return f"""WITH w AS (SELECT c_custkey AS doc_id, lower(unnest(regexp_extract_all({NORDIC_TEXT}, '\\p{{L}}+'))) AS word FROM customer),
n AS (SELECT doc_id, sum({point('fi')} + regexp_matches(word, '{DOUBLED.pattern}')::INT) AS fi, sum({point('sv')} + 2 * contains(word, 'å')::INT) AS sv FROM w GROUP BY doc_id)
SELECT doc_id, CASE WHEN sv > fi THEN 'sv' ELSE 'fi' END AS language, greatest(fi, sv)::BIGINT AS score FROM n WHERE greatest(fi, sv) >= 4 AND greatest(fi, sv) >= 2 * least(fi, sv)"""


@query("nordic_scores", _nordic_sql())
def nordic_scores(spark, sf_dir):
    """Four points or more and twice the runner-up decide."""
    d = nordic_points(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(NORDIC_TEXT).alias("text")))
    best = F.greatest("sv", "fi")
    return d.where((best >= 4) & (best >= 2 * F.least("sv", "fi"))).select("doc_id", F.when(F.col("sv") > F.col("fi"), "sv").otherwise("fi").alias("language"), best.alias("score"))


@query("region_routing", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'grammar/sv/DomDem' ELSE 'grammar/AnA' END AS rule FROM part")
def region_routing(spark, sf_dir):
    """In a marked region the findings of its language replace those of the document's."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))
    english = p.select("doc_id", F.lit(5).alias("b_start"), F.lit("grammar/AnA").alias("rule")).alias("f")
    region = p.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("s"), F.lit(9).alias("e"), F.lit("sv").alias("lang")).alias("r")
    native = p.select("doc_id", F.lit(6).alias("b_start"), F.lit("grammar/sv/DomDem").alias("rule"), F.lit("sv").alias("lang")).alias("n")
    inside = lambda a: (F.col(f"{a}.doc_id") == F.col("r.doc_id")) & (F.col(f"{a}.b_start") >= F.col("r.s")) & (F.col(f"{a}.b_start") < F.col("r.e"))
    kept = english.join(region, inside("f"), "left_anti").select("doc_id", "rule")
    return kept.union(native.join(region, inside("n") & (F.col("n.lang") == F.col("r.lang")), "left_semi").select("doc_id", "rule"))


# inputs beside the documents

MANIFEST = {
    "requirements.txt": r"(?m)^\s*([A-Za-z][\w.-]*)\s*(?:[=<>~!;\[].*)?$", "go.mod": r"(?m)^\s*(?:require\s+)?([\w.-]+\.[a-z]+/[\w./-]+)\s+v", "Gemfile": r"(?m)^\s*gem\s+[\"']([\w-]+)",
    "Cargo.toml": r"(?m)^\s*([A-Za-z][\w-]*)\s*=\s*(?:\"[\d^~=*]|\{\s*(?:version|path|git|workspace))", "package.json": r"\"(@?[\w./-]+)\"\s*:\s*\"[\^~]?\d", "mix.exs": r"\{:(\w+),",
}


def dependencies(manifests: DataFrame) -> DataFrame:
    """(dir, name) of the dependencies in ``manifests(dir, file, text)``, and the parts of their names."""
    found = F.array().cast("array<string>")
    for file, pattern in MANIFEST.items():
        found = F.when(F.col("file") == file, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(found)
    names = manifests.select("dir", F.explode(found).alias("name")).select("dir", F.regexp_replace(F.lower("name"), r"^rust-|-rs$", "").alias("name"))
    return names.select("dir", F.explode(F.array_distinct(F.concat(F.array("name"), F.filter(F.split("name", r"[-_./@]"), lambda x: F.length(x) > 2)))).alias("name")).distinct()


@query("manifest_names", "SELECT n_nationkey::BIGINT AS dir, unnest(['serde-json', 'serde', 'json', 'tokio']) AS name FROM nation")
def manifest_names(spark, sf_dir):
    text = F.lit('[dependencies]\nserde-json = "1.0"\ntokio-rs = { version = "1" }\n')
    return dependencies(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dir"), F.lit("Cargo.toml").alias("file"), text.alias("text")))


@query("link_cache", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 168 END::BIGINT AS ttl_hours FROM events WHERE date_diff('hour', ts, (SELECT max(ts) FROM events)) < CASE WHEN event_type = 'click' THEN 1 ELSE 168 END")
def link_cache(spark, sf_dir):
    """Stored outcomes that still hold: failures for an hour, others for a week."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("now"))  # one row
    ttl = F.when(F.col("event_type") == "click", 1).otherwise(168).cast("long")
    hours = F.expr("CAST(floor(unix_timestamp(now) / 3600) - floor(unix_timestamp(ts) / 3600) AS BIGINT)")
    return e.crossJoin(F.broadcast(newest)).withColumn("ttl_hours", ttl).where(hours < F.col("ttl_hours")).select("event_id", "ttl_hours")


@query("human_report", "SELECT p_partkey || '.md:' || p_size || ':1 ' || ['info', 'warning', 'error'][(p_size % 3 + 1)::BIGINT] || ' md/x ' || p_name AS line FROM part")
def human_report(spark, sf_dir):
    """One line a finding, in the order of path, place and rule when it is written."""
    level = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("p_size") % 3 + 1)
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", F.concat("p_partkey", F.lit(".md:"), "p_size", F.lit(":1")), level, F.lit("md/x"), "p_name").alias("line"))


@query("flattened_wraps", "SELECT p_partkey AS doc_id, 'one two' || chr(10) || chr(10) || 'three' || chr(10) || '- four' AS text FROM part")
def flattened_wraps(spark, sf_dir):
    """Soft line ends become spaces, except before a blank line, a bullet or a number."""
    text = F.lit("one\ntwo\n\nthree\n- four")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.regexp_replace(text, r"(?<!\n)\n(?!\n|[ \t]*(?:[-*+]|\d+[.)])[ \t])", " ").alias("text"))


STRETCH = {"de": "der die das und ist nicht ein eine mit von zu den dem des auf".split(), "es": "el la los las de que y en un una por con para del se".split(), "fr": "le la les des et est dans un une pour que qui pas sur au".split()}


def _stretch_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS {lang}" for lang, ws in STRETCH.items())
    return f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?,;:\\n]+')) AS phrase, generate_subscripts(regexp_extract_all(text, '[^.!?,;:\\n]+'), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, list_transform(regexp_extract_all(phrase, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda x: lower(x)) AS w FROM p),
n AS (SELECT doc_id, pos, len(w) AS n, {hits}, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ENGLISH_STOP)}))) AS en FROM w WHERE len(w) >= 6),
b AS (SELECT *, greatest(de, es, fr) AS best, de + es + fr - greatest(de, es, fr) - least(de, es, fr) AS second FROM n)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN de = best THEN 'de' WHEN es = best THEN 'es' ELSE 'fr' END AS language, best::BIGINT AS hits FROM b WHERE best >= 2 AND best * 4 >= n AND best >= 2 * en AND best >= 2 * second"""


@query("foreign_stretches", _stretch_sql())
def foreign_stretches(spark, sf_dir):
    """Phrases of six words or more that read as another language: function words of one language outweigh all others twice."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([^.!?,;:\n]+)"), F.lit(1))).alias("pos", "phrase"))
    own = F.regexp_extract_all(F.lower("phrase"), F.lit("([a-zß-öø-ÿ]+)"), F.lit(1))

    def counted(w: Column) -> Column:
        hits = {k: F.size(F.filter(w, _among(ws))) for k, ws in STRETCH.items()}
        return F.struct(F.size(w).alias("n"), *[n.alias(k) for k, n in hits.items()], F.size(F.filter(w, _among(ENGLISH_STOP))).alias("en"))

    def told(x: Column) -> Column:
        best = F.greatest(*[x[k] for k in STRETCH])
        second = x["de"] + x["es"] + x["fr"] - best - F.least(*[x[k] for k in STRETCH])
        good = (x["n"] >= 6) & (best >= 2) & (best * 4 >= x["n"]) & (best >= 2 * x["en"]) & (best >= 2 * second)
        return F.when(good, F.struct(F.when(x["de"] == best, "de").when(x["es"] == best, "es").otherwise("fr").alias("language"), best.cast("long").alias("hits")))

    # each step is bound by an array of one element and evaluated once
    verdict = F.array_compact(F.transform(F.transform(F.array(own), counted), told))
    return p.select("doc_id", (F.col("pos") + 1).alias("pos"), F.explode(verdict).alias("v")).select("doc_id", "pos", "v.language", "v.hits")


def _among(words: list[str]):
    return lambda x: x.isin(words)


def proper_names(tokens: DataFrame) -> DataFrame:
    """(doc_id, name): names of persons by their neighbours: a capitalised word after a title, or both of two capitalised words of which the first is a given name."""
    by = Window.partitionBy("doc_id").orderBy("place")
    near = tokens.withColumn("before", F.lag("word").over(by)).withColumn("after", F.lead("word").over(by))
    capital = lambda c: F.coalesce(F.col(c).rlike(r"^\p{Lu}\p{Ll}+$"), F.lit(False))
    given = lambda c: F.coalesce(F.col(c).isin(*BY_NAME), F.lit(False))
    titled = F.coalesce(F.col("before").isin("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Señor", "Madame"), F.lit(False))
    return near.where(capital("word") & (titled | given("before") | (given("word") & capital("after")))).select("doc_id", F.col("word").alias("name"))


@query("person_names", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Berg' ELSE 'Lund' END AS name FROM part")
def person_names(spark, sf_dir):
    text = F.concat(F.lit("Yesterday "), F.when(F.col("p_partkey") % 2 == 0, "Mr Berg").otherwise("Frau Lund"), F.lit(" saw the Big Boat"))
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(text, " ")).alias("place", "word"))
    return proper_names(tokens)


#: An attribute with its value, and those whose values are names or targets.
ATTRIBUTE = r"[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
NAMING = r"(?i)^(?:id|name|class|for|href|src|srcset|action|poster|type|data-[\w-]+)\s*="


def identifiers(text: Column) -> Column:
    """Words that a text uses as names: in code spans, addresses, link targets and the values of HTML attributes that hold names."""
    spans = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1))
    urls = F.regexp_extract_all(text, F.lit(r"(?:https?://|\]\()([^\s)>]+)"), F.lit(1))
    tags = F.regexp_extract_all(text, F.lit(r"(<[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))
    attributes = F.flatten(F.transform(tags, lambda t: F.transform(F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(NAMING)), lambda x: F.regexp_replace(x, r"^[^=]*=", ""))))
    return F.array_distinct(F.flatten(F.transform(F.concat(spans, urls, attributes), lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"([a-z][a-z0-9]+)"), F.lit(1)))))


@query("file_identifiers", "SELECT p_partkey AS doc_id, unnest(['frobnicate', 'https', 'example', 'com', 'qux']) AS word FROM part")
def file_identifiers(spark, sf_dir):
    text = F.concat(F.lit("Use `frobnicate` as in [x](https://example.com/qux) "), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(identifiers(text)).alias("word"))
