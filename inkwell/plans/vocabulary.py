"""What a corpus says about its own words: its dialect, and names that may belong into its vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.names import BY_NAME
from .engine import query, table

#: British spellings; the American one follows by ``american`` or stands behind a slash (fixed values).
BRITISH = (
    "colour favour flavour harbour honour humour labour neighbour behaviour rumour vapour colours colourful favourite honourable organise organised organising organisation realise realised recognise recognised apologise "
    "authorise categorise customise emphasise finalise maximise minimise normalise optimise prioritise specialise standardise summarise synchronise visualise centre/center centres/centers theatre/theater metre/meter litre/liter fibre/fiber "
    "licence/license defence/defense offence/offense analyse/analyze analysed/analyzed catalogue/catalog dialogue/dialog travelled/traveled travelling/traveling cancelled/canceled labelled/labeled modelling/modeling grey/gray cheque/check tyre/tire "
    "programme/program aluminium/aluminum jewellery/jewelry storey/story sceptical/skeptical plough/plow mould/mold"
).split()


def american(british: str) -> str:
    """The American spelling of a regular British one."""
    for old, new in (("isation", "ization"), ("ising", "izing"), ("ised", "ized"), ("ise", "ize"), ("our", "or")):
        if old in british:
            return british.replace(old, new, 1)
    raise ValueError(british)


#: (British, American); words that are both dialects' in another sense tell nothing and are left out.
PAIRS = tuple((b, a or american(b)) for b, _, a in (x.partition("/") for x in BRITISH) if b not in ("cheque", "storey", "programme", "tyre", "metre", "licence", "catalogue", "dialogue"))
LETTERS = r"([\p{L}]+)"


def dialects(documents: DataFrame) -> DataFrame:
    """(doc_id, british, american, dialect): British where at least three British spellings are four fifths of all that tell.

    The words of a text are counted inside its row; the pairs are a fixed list.
    """
    own = F.transform(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(1)), F.lower)

    def points(w: Column) -> Column:
        count = lambda words: F.size(F.filter(w, lambda x: x.isin(*words)))
        return F.struct(count([b for b, _ in PAIRS]).alias("british"), count([a for _, a in PAIRS]).alias("american"))

    # the words are cut once: bound by an array of one element
    counted = documents.select("doc_id", F.explode(F.transform(F.array(own), points)).alias("p")).select("doc_id", "p.british", "p.american")
    british = (F.col("british") >= 3) & (F.col("british") * 5 >= (F.col("british") + F.col("american")) * 4)
    return counted.withColumn("dialect", F.when(british, "british").otherwise("american"))


_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query("document_dialects", f"""WITH t AS (SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'The Colour of the centre, a favour; we organise and realise. color' WHEN 1 THEN 'colour center gray analyze' WHEN 2 THEN 'honour labour behaviour organization recognize' ELSE c_name END || ' ' || c_mktsegment AS text FROM customer),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) AS word FROM t),
n AS (SELECT doc_id, count(*) FILTER (word IN ({_IN([b for b, _ in PAIRS])})) AS british, count(*) FILTER (word IN ({_IN([a for _, a in PAIRS])})) AS american FROM w GROUP BY doc_id)
SELECT doc_id, british::INTEGER AS british, american::INTEGER AS american, CASE WHEN british >= 3 AND british * 5 >= (british + american) * 4 THEN 'british' ELSE 'american' END AS dialect FROM n""")
def document_dialects(spark, sf_dir):
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'The Colour of the centre, a favour; we organise and realise. color' WHEN 1 THEN 'colour center gray analyze' WHEN 2 THEN 'honour labour behaviour organization recognize' ELSE c_name END || ' ' || c_mktsegment")
    return dialects(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


#: Endings of company names (fixed values).
COMPANY = ("Inc", "Ltd", "LLC", "GmbH", "AG", "AB", "Oy", "Corp", "Company", "SA", "SE", "BV")
#: Up to four capitalised words in a row inside a sentence: behind a small letter, a comma or a closing mark.
RUN = r"[\p{Ll}\d,)'’] ((?:\p{Lu}[\p{L}\d]+)(?: (?:\p{Lu}[\p{L}\d]+)){0,3})(?:['’]s)?"


def kind_of(phrase: Column) -> Column:
    """Company by the last word, person by a known given name before another word, else product."""
    words = F.split(phrase, " ")
    return F.when(F.element_at(words, -1).isin(*COMPANY) & (F.size(words) > 1), "company").when((F.size(words) > 1) & words[0].isin(*sorted(BY_NAME)), "person").otherwise("product")


def candidates(documents: DataFrame, least: int = 3, files: int = 3) -> DataFrame:
    """(phrase, kind, uses, documents, top): capitalised runs that stand inside sentences ``least`` times or more, with the documents that use them most.

    A run in the possessive is the run. Uses are counted in each document first.
    """
    hit = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("phrase"))
    each = hit.groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("n"), "doc_id"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= files).groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top"))
    total = each.groupBy("phrase").agg(F.sum("n").cast("long").alias("uses"), F.count(F.lit(1)).cast("long").alias("documents")).where(F.col("uses") >= least)
    return total.join(top, "phrase").select("phrase", kind_of(F.col("phrase")).alias("kind"), "uses", "documents", "top")


@query("vocabulary_candidates", f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{Ll}}\\d,)''’] ((?:\\p{{Lu}}[\\p{{L}}\\d]+)(?: (?:\\p{{Lu}}[\\p{{L}}\\d]+)){{0,3}})(?:[''’]s)?', 1)) AS phrase FROM documents),
e AS (SELECT phrase, doc_id, count(*) AS n FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, doc_id) AS rank FROM e)
SELECT phrase, CASE WHEN len(string_split(phrase, ' ')) > 1 AND string_split(phrase, ' ')[-1] IN ({_IN(COMPANY)}) THEN 'company' WHEN len(string_split(phrase, ' ')) > 1 AND string_split(phrase, ' ')[1] IN ({_IN(sorted(BY_NAME))}) THEN 'person' ELSE 'product' END AS kind,
  sum(n)::BIGINT AS uses, count(*)::BIGINT AS documents, array_to_string(list(doc_id ORDER BY rank) FILTER (rank <= 3), ',') AS top FROM r GROUP BY phrase HAVING sum(n) >= 3""")
def vocabulary_candidates(spark, sf_dir):
    """Names inside the sentences of the documents, whole texts."""
    return candidates(table(spark, sf_dir, "documents")).select("phrase", "kind", "uses", "documents", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))
