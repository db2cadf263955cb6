"""Text statistics and document checks as plain DataFrame plans over the raw tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lexicons import FUNCTION_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words as both engines see them: letters of ASCII and the accented letters of the languages in the table.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = f"[{LETTERS}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


#: Documents of more lines get their offsets from a window: adding up inside the row copies the sums at every line.
LINES_IN_ROW = 2000


def numbered(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line)."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, b_start, b_end, line): every line with its byte range; ``doc_id`` must be unique."""
    split = documents.select("doc_id", F.split("text", "\n", -1).alias("all"))
    few, many = split.where(F.size("all") <= LINES_IN_ROW), split.where(F.size("all") > LINES_IN_ROW)
    ends = F.aggregate("all", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(x) + 1)))
    zipped = few.select("doc_id", F.posexplode(F.arrays_zip(F.col("all").alias("line"), F.slice(ends, 1, F.size("all")).alias("at"))).alias("pos", "x"))
    short = zipped.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("x.at").alias("b_start"), F.col("x.line").alias("line"))
    each = many.select("doc_id", F.posexplode("all").alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    long = each.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long").alias("b_start"), "line")
    return short.unionByName(long).select("doc_id", "line_no", "b_start", (F.col("b_start") + F.octet_length("line")).alias("b_end"), "line")


LINES_SQL = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""


@query("lines", f"""WITH {LINES_SQL},
s AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b_start FROM l)
SELECT doc_id, line_no::INTEGER AS line_no, b_start, b_start + strlen(line)::BIGINT AS b_end FROM s""")
def lines(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "b_start", "b_end")


@query("doubled_words", f"""WITH {LINES_SQL},
w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{WORD}|[^{LETTERS}\\s]+')) AS word, generate_subscripts(regexp_extract_all(line, '{WORD}|[^{LETTERS}\\s]+'), 1) AS pos FROM l),
n AS (SELECT *, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS after FROM w)
SELECT doc_id, line_no::INTEGER AS line_no, pos::INTEGER AS pos, word FROM n WHERE lower(word) = lower(after) AND regexp_matches(word, '{WORD}')""")
def doubled_words(spark, sf_dir):
    """Words repeated in a row: neighbours meet inside the row's array, so no window and no shuffle."""
    own = F.regexp_extract_all("line", F.lit(f"({WORD}|[^{LETTERS}\\s]+)"), F.lit(1))

    def doubled(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.when(F.lower(a) == F.lower(b), a))

    # the words are cut once: bound by an array of one element, they are not cut anew wherever they are used
    pairs = numbered(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.posexplode(F.transform(F.array(own), doubled)[0]).alias("pos", "word"))
    return pairs.where(F.col("word").rlike(WORD)).select("doc_id", "line_no", (F.col("pos") + 1).alias("pos"), "word")


@query("text_statistics", f"""SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words,
  len(regexp_extract_all(text, '[.!?]+(\\s|$)'))::BIGINT AS sentences, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits FROM documents""")
def text_statistics(spark, sf_dir):
    t = F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines"), count(WORD).alias("words"), count(r"[.!?]+(\s|$)").alias("sentences"), count("[0-9]").alias("digits"))


SYLLABLES = "[aeiouyAEIOUY]+"


@query("readability_grades", f"""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+(\\s|$)'))) AS n, len(regexp_extract_all(text, '{SYLLABLES}')) AS y FROM documents WHERE lang = 'en')
SELECT doc_id, w::BIGINT AS words, round(0.39::DOUBLE * w / n + 11.8::DOUBLE * y / w - 15.59::DOUBLE, 4) AS grade FROM s WHERE w >= 100""")
def readability_grades(spark, sf_dir):
    """Flesch-Kincaid grade of English documents of 100 words or more, syllables as vowel groups."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.regexp_count(t, F.lit(WORD)).alias("w"), F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"[.!?]+(\s|$)"))).alias("n"), F.regexp_count(t, F.lit(SYLLABLES)).alias("y"))
    grade = F.lit(0.39) * F.col("w") / F.col("n") + F.lit(11.8) * F.col("y") / F.col("w") - F.lit(15.59)
    return d.where("w >= 100").select("doc_id", F.col("w").cast("long").alias("words"), F.round(grade, 4).alias("grade"))


PROFILES = {k: FUNCTION_WORDS[k] for k in ("de", "es", "fr", "pt")}


def _hint_sql() -> str:
    values = ", ".join(f"('{lang}', '{w}')" for lang, ws in {**PROFILES, "en": FUNCTION_WORDS["en"]}.items() for w in ws)
    return f"""WITH p(lang, word) AS (VALUES {values}),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) AS word FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
h AS (SELECT doc_id, p.lang, count(*) AS hits, count(DISTINCT w.word) AS kinds FROM w JOIN p ON w.word = p.word GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS rank, lead(hits) OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS runner FROM h WHERE lang <> 'en')
SELECT r.doc_id, r.lang AS language, r.hits::BIGINT AS hits FROM r JOIN n ON r.doc_id = n.doc_id LEFT JOIN h e ON e.doc_id = r.doc_id AND e.lang = 'en'
WHERE rank = 1 AND n.n >= 4 AND coalesce(e.hits, 0) * 4 < n.n AND r.hits >= 2 AND r.kinds >= 2 AND r.hits * 8 >= n.n AND r.hits >= 2 * coalesce(runner, 0)"""


def any_of(given: list[str]) -> str:
    """A pattern of words by their common beginnings, so that a place is not compared with every word."""
    tree: dict = {}
    for word in given:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def made(node: dict) -> str:
        own = [re.escape(c) + made(x) for c, x in sorted(node.items()) if c]
        return "" if not own else f"(?:{'|'.join(own)})" + "?" * ("" in node)

    return made(tree)


@query("language_hint", _hint_sql())
def language_hint(spark, sf_dir):
    """Language by function words, or none: all counts stay inside the row."""
    every = sorted({w for ws in (*PROFILES.values(), FUNCTION_WORDS["en"]) for w in ws})
    # only function words leave the pattern: the profiles then see a third of the words
    whole = F.lit(f"(?<![{LETTERS}])({any_of(every)})(?![{LETTERS}])")
    own = F.struct(F.regexp_count(F.lower("text"), F.lit(WORD)).alias("n"), F.regexp_extract_all(F.lower("text"), whole, F.lit(1)).alias("w"))

    def profile(w: Column, lang: str) -> Column:
        hits = F.filter(w, lambda x: x.isin(FUNCTION_WORDS[lang]))
        return F.struct((-F.size(hits)).alias("minus"), F.lit(lang).alias("lang"), F.size(F.array_distinct(hits)).alias("kinds"))

    def ranked(s: Column) -> Column:
        return F.struct(s["n"].alias("n"), F.size(F.filter(s["w"], lambda x: x.isin(FUNCTION_WORDS["en"]))).alias("english"), F.array_sort(F.array(*[profile(s["w"], lang) for lang in sorted(PROFILES)])).alias("all"))

    def told(r: Column) -> Column:
        first, n = r["all"][0], r["n"]
        hits, runner = -first["minus"], -r["all"][1]["minus"]
        good = (n >= 4) & (r["english"] * 4 < n) & (hits >= 2) & (first["kinds"] >= 2) & (hits * 8 >= n) & (hits >= 2 * runner)
        return F.when(good, F.struct(first["lang"].alias("language"), hits.cast("long").alias("hits")))

    # each step is bound by an array of one element and evaluated once; a projection of its own would be merged into those that use it
    verdict = F.transform(F.transform(F.array(own), ranked), told)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(verdict)).alias("v")).select("doc_id", "v.language", "v.hits")


@query("single_trailing_newline_raw", "SELECT doc_id, length(text)::BIGINT AS end_at FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '[^\\s]\\n$') AND regexp_matches(text, '[^\\s]')")
def single_trailing_newline_raw(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where((F.length("text") > 0) & ~F.col("text").rlike(r"[^\s]\n\z") & F.col("text").rlike(r"[^\s]")).select("doc_id", F.length("text").cast("long").alias("end_at"))


@query("recurring_names", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM documents)
SELECT word, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM w GROUP BY word HAVING count(*) >= 3""")
def recurring_names(spark, sf_dir):
    """Capitalised words seen three times or more: counted per document first, so that frequent words shuffle once a task."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("word"))
    each = w.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("word").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).cast("long").alias("docs")).where("n >= 3")


@query("acronyms_first_use", """WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9À-ÿ-])([A-Z]{2,5})(?:[^A-Za-z0-9À-ÿ-]|$)', 1)) AS name, generate_subscripts(regexp_extract_all(text, '(?:^|[^A-Za-z0-9À-ÿ-])([A-Z]{2,5})(?:[^A-Za-z0-9À-ÿ-]|$)', 1), 1) AS k FROM documents)
SELECT doc_id, name, min(k)::INTEGER AS first_use, count(*)::BIGINT AS uses FROM a GROUP BY doc_id, name""")
def acronyms_first_use(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?:^|[^A-Za-z0-9À-ÿ-])([A-Z]{2,5})(?:[^A-Za-z0-9À-ÿ-]|$)"), F.lit(1))).alias("k", "name"))
    return found.groupBy("doc_id", "name").agg((F.min("k") + 1).cast("int").alias("first_use"), F.count(F.lit(1)).cast("long").alias("uses"))


#: An attribute with a target, its value in any quotes; and one with several targets.
TARGET, TARGETS = r"(?i)[\s\"'](?:href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", r"(?i)[\s\"']srcset\s*=\s*(\"[^\"]*\"|'[^']*')"


def html_targets(html: Column) -> Column:
    """Targets of ``href``, ``src`` and ``srcset`` attributes."""
    bare = lambda c: F.regexp_replace(c, r"^[\"']|[\"']$", "")
    one = F.transform(F.regexp_extract_all(html, F.lit(TARGET), F.lit(1)), bare)
    many = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(TARGETS), F.lit(1)), lambda x: F.transform(F.split(bare(x), ","), lambda y: F.split(F.trim(y), r"\s+")[0])))
    return F.concat(one, F.filter(many, lambda x: x != ""))


_BARE = """regexp_replace(x, '^["'']|["'']$', '', 'g')"""


@query("html_links", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{TARGET.replace("'", "''")}', 1)) AS x FROM pages), b AS (SELECT page_id, unnest(regexp_extract_all(html, '{TARGETS.replace("'", "''")}', 1)) AS x FROM pages),
c AS (SELECT page_id, trim(unnest(string_split({_BARE}, ','))) AS y FROM b), h AS (SELECT page_id, {_BARE} AS dest FROM a UNION ALL SELECT page_id, string_split(y, ' ')[1] FROM c WHERE y <> '')
SELECT page_id, dest, count(*)::BIGINT AS n, bool_or(dest LIKE 'http://%') AS insecure FROM h GROUP BY page_id, dest""")
def html_links(spark, sf_dir):
    """Targets of links, images and image sets in raw HTML, in double, single or no quotes."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(html_targets(F.col("html"))).alias("dest"))
    return found.groupBy("page_id", "dest").agg(F.count(F.lit(1)).cast("long").alias("n"), F.bool_or(F.col("dest").startswith("http://")).alias("insecure"))


@query("html_elements", """SELECT page_id, len(regexp_extract_all(html, '<h[1-6][ >]'))::BIGINT AS headings, len(regexp_extract_all(html, '<!--'))::BIGINT AS comments, regexp_extract(html, 'lang="([A-Za-z-]+)"', 1) AS language, len(regexp_extract_all(html, '<img[ >]'))::BIGINT AS images FROM pages""")
def html_elements(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", count("<h[1-6][ >]").alias("headings"), count("<!--").alias("comments"), F.regexp_extract("html", 'lang="([A-Za-z-]+)"', 1).alias("language"), count("<img[ >]").alias("images"))


@query("quotes_mixed", """SELECT doc_id, len(regexp_extract_all(text, '"'))::BIGINT AS straight, len(regexp_extract_all(text, '[“”]'))::BIGINT AS curly FROM documents WHERE contains(text, '"')""")
def quotes_mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit('"'))).select("doc_id", F.regexp_count("text", F.lit('"')).cast("long").alias("straight"), F.regexp_count("text", F.lit("[“”]")).cast("long").alias("curly"))


@query("sentence_lengths", f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+')) AS s FROM documents)
SELECT doc_id, count(*)::BIGINT AS sentences, max(len(regexp_extract_all(s, '{WORD}')))::BIGINT AS longest, count(*) FILTER (len(regexp_extract_all(s, '{WORD}')) > 30)::BIGINT AS over_30 FROM s GROUP BY doc_id""")
def sentence_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("([^.!?]+)"), F.lit(1)), lambda s: F.regexp_count(s, F.lit(WORD))).alias("n"))
    return d.where(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("sentences"), F.array_max("n").cast("long").alias("longest"), F.size(F.filter("n", lambda x: x > 30)).cast("long").alias("over_30"))


@query("dialogue_turns", f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words, text = before AS repeats FROM t""")
def dialogue_turns(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), (F.col("text") == before).alias("repeats"))


@query("anaphora_runs", f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]+'), 1) AS pos FROM documents),
f AS (SELECT doc_id, pos, lower(regexp_extract(s, '{WORD}')) AS word FROM s),
g AS (SELECT *, CASE WHEN word = lag(word) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g)
SELECT doc_id, word, min(pos)::INTEGER AS first_sentence, count(*)::BIGINT AS n FROM i WHERE word <> '' GROUP BY doc_id, island, word HAVING count(*) >= 3""")
def anaphora_runs(spark, sf_dir):
    """Three sentences or more in a row that start alike: runs are found inside the row, without a window or a shuffle."""
    first = F.transform(F.regexp_extract_all("text", F.lit("([^.!?]+)"), F.lit(1)), lambda s: F.lower(F.regexp_extract(s, f"({WORD})", 1)))
    own = table(spark, sf_dir, "documents").select("doc_id", first.alias("w")).where(F.size("w") >= 3)

    def runs(s: Column) -> Column:
        w = s["w"]
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i - 1) != F.get(w, i)))
        # bound by an array of one struct: the starts are made once, not anew for each of them
        return F.transform(F.array(F.struct(w.alias("w"), starts.alias("at"))), lambda t: F.transform(t["at"], lambda a, k: F.struct(F.get(t["w"], a).alias("word"), (a + 1).alias("first_sentence"), (F.coalesce(F.get(t["at"], k + 1), F.size(t["w"])) - a).cast("long").alias("n"))))[0]

    found = own.select("doc_id", F.explode(F.filter(F.transform(F.array(F.struct("w")), runs)[0], lambda r: (r["n"] >= 3) & (r["word"] != ""))).alias("r"))
    return found.select("doc_id", "r.word", "r.first_sentence", "r.n")


def deletion_keys(word: Column, most: int = 1) -> Column:
    """Hashes of what is left of a word with up to ``most`` letters deleted: words within so many edits share one."""
    one = lambda c: F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))))
    left = F.array(word)
    for _ in range(most - 1):
        left = F.array_distinct(F.flatten(F.transform(left, one)))
    return F.array_distinct(F.flatten(F.transform(left, lambda c: F.transform(one(c), lambda x: F.xxhash64(x)))))


def words_by_language(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(words(F.col("text"))).alias("word")).select("doc_id", "lang", F.lower("word").alias("word"))


@query("spelling_unknown", f"""WITH w AS (SELECT doc_id, coalesce(lang, 'und') AS lang, lower(unnest(regexp_extract_all(text, '{WORD}'))) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, w.lang, w.word, count(*)::BIGINT AS n FROM w JOIN n ON w.lang = n.lang AND w.word = n.word WHERE n.n < 5 GROUP BY ALL""")
def spelling_unknown(spark, sf_dir):
    """Words outside the dictionary of their language, here the words that its documents have five times or more."""
    w = words_by_language(spark, sf_dir).groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).cast("long").alias("n"))
    known = w.groupBy("lang", "word").agg(F.sum("n").alias("all")).where("all >= 5").select("lang", "word")
    return w.join(known, ["lang", "word"], "left_anti").select("doc_id", "lang", "word", "n")


@query("spelling_suggest")
def spelling_suggest(spark, sf_dir):
    """Best three known words for every word under the threshold of ``spelling_unknown``, of any language, length and beginning."""
    n = words_by_language(spark, sf_dir).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return best_known(n.where("n < 5").select("lang", "word"), n.where("n >= 5"))


def best_known(bad: DataFrame, known: DataFrame) -> DataFrame:
    """Best three of ``known(lang, word, n)`` one edit away from each of ``bad(lang, word)``; words meet on a word with one letter deleted, so that no common block of words is paired."""
    have = known.select("lang", F.col("word").alias("suggestion"), "n", F.explode(deletion_keys(F.col("word"))).alias("key"))
    met = bad.select("lang", "word", F.explode(deletion_keys(F.col("word"))).alias("key")).join(have, ["lang", "key"])
    near = met.where(F.levenshtein("word", "suggestion", 1) == 1).select("lang", "word", "suggestion", "n").distinct()
    rank = F.row_number().over(Window.partitionBy("lang", "word").orderBy(F.desc("n"), "suggestion"))
    return near.withColumn("rank", rank).where("rank <= 3").select("lang", "word", "suggestion", "rank")
