"""Lexicons, rendering, inverted indexes, facets and markup on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.session import table

TERMS_A, TERMS_B, TERMS_C = ["the", "und"], ["éau", "les"], ["of", "de"]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def lexicon_bounded(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.bounded_lexicon(t, TERMS_A).alias("a"), T.bounded_lexicon(t, TERMS_B).alias("b"))


def lexicon_gate(spark, d):
    """A, or B, or a weak term C that counts only beside A."""
    t = F.col("text")
    f = _docs(spark, d).select("lang", *[T.bounded_lexicon(t, x).alias(n) for n, x in (("a", TERMS_A), ("b", TERMS_B), ("c", TERMS_C))])
    return f.withColumn("about", F.col("a") | F.col("b") | (F.col("c") & F.col("a"))).groupBy("lang").agg(F.count_if("about").alias("about"), F.count("*").alias("docs"))


def like_any(spark, d):
    return _docs(spark, d).where(T.any_contains(F.col("text"), ["ation", "keit", "ción"])).select("doc_id")


def ilike_parts(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%A%") & F.col("p_size").between(5, 20)).select("p_partkey", "p_name")


def facet_source(spark, d):
    return _docs(spark, d).where("source <> ''").groupBy("source").agg(F.count("*").cast("int").alias("works"))


def facet_topk(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").cast("int").alias("works")).orderBy(F.desc("works"), "p_type").limit(10)


def typeahead(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").cast("int").alias("works")).where(F.col("p_brand").ilike("%#1%"))


def invert_index(spark, d):
    """Positions of each token of every text, through the JSON index and back to rows."""
    m = F.from_json("index", "map<string,array<int>>")
    out = T.inverted(_docs(spark, d), "doc_id", F.col("text")).select("doc_id", F.explode(m).alias("token", "at"))
    return out.select("doc_id", "token", F.size("at").alias("n"), F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("positions"))


def deinvert_roundtrip(spark, d):
    return T.inverted(_docs(spark, d), "doc_id", F.col("text")).select("doc_id", T.deinvert(F.col("index")).alias("text"))


def render_tagged(spark, d):
    return _docs(spark, d).select("doc_id", T.tagged(title=F.substring("text", 1, 40), lang=F.nullif("lang", F.lit("es")), source=F.col("source")).alias("rendered"))


def encoder_text(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(F.substring("text", 1, 20), F.lit(" [SEP] "), F.substring("text", 21, 30), F.lit(" [SEP] "), F.concat_ws("; ", F.nullif("lang", F.lit("en")), "source")).alias("rendered"))


def norm_keys(spark, d):
    """Bare lower-case identifiers and suffixes of addresses."""
    return table(spark, d, "pages").select("page_id", F.lower(F.replace("url", F.lit("https://"), F.lit(""))).alias("bare"), F.regexp_replace("url", ".*/", "").alias("suffix"), F.coalesce(F.nullif(F.regexp_replace("url", ".*/", ""), F.lit("")), F.col("page_id").cast("string")).alias("fallback"))


def truncate_text(spark, d):
    return _docs(spark, d).select("doc_id", T.truncated(F.col("text"), 60).alias("short"))


def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.regexp_replace("html", "(?s)<!--.*?-->", "")).alias("plain"))


def fts_title(spark, d):
    """Full-text membership by a token table of whole texts: how many documents hold each token of a search."""
    t = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return t.where(F.col("token").isin("the", "der", "la", "los")).groupBy("token").agg(F.count("*").alias("docs"))


def top_values(spark, d):
    """Cleaned and exploded '; '-like lists, top 15 with a total order."""
    w = F.explode(F.split(F.regexp_replace("text", r"[\n.]", ";"), ";")).alias("w")
    e = _docs(spark, d).select(w).select(F.regexp_replace(F.trim("w"), r"^\+", "").alias("value")).where("value <> ''")
    return e.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(15)


def year_bins(spark, d):
    """Right-closed bins."""
    y = F.year("o_orderdate")
    b = F.when((y > 1991) & (y <= 1993), "1992-1993").when((y > 1993) & (y <= 1996), "1994-1996").when((y > 1996) & (y <= 1998), "1997-1998")
    return table(spark, d, "orders").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


_B = lambda terms: f"regexp_matches(text, '(^|[^[:alpha:]])({'|'.join(terms)})([^[:alpha:]]|$)', 'i')"
_SQ = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (lexicon_bounded, lexicon_gate, like_any, ilike_parts, facet_source, facet_topk, typeahead, invert_index, deinvert_roundtrip, render_tagged, encoder_text, norm_keys, truncate_text, strip_html, fts_title, top_values, year_bins)}
ORACLE = {
    "lexicon_bounded": f"SELECT doc_id, {_B(TERMS_A)} AS a, {_B(TERMS_B)} AS b FROM documents",
    "lexicon_gate": f"SELECT lang, count(*) FILTER (WHERE {_B(TERMS_A)} OR {_B(TERMS_B)} OR ({_B(TERMS_C)} AND {_B(TERMS_A)})) AS about, count(*) AS docs FROM documents GROUP BY 1",
    "like_any": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%ation%' OR lower(text) LIKE '%keit%' OR lower(text) LIKE '%ción%'",
    "ilike_parts": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_size BETWEEN 5 AND 20",
    "facet_source": "SELECT source, CAST(count(*) AS INTEGER) AS works FROM documents WHERE source <> '' GROUP BY 1",
    "facet_topk": "SELECT p_type, CAST(count(*) AS INTEGER) AS works FROM part GROUP BY 1 ORDER BY works DESC, p_type LIMIT 10",
    "typeahead": "SELECT * FROM (SELECT p_brand, CAST(count(*) AS INTEGER) AS works FROM part GROUP BY 1) WHERE p_brand ILIKE '%#1%'",
    "invert_index": f"WITH w AS (SELECT doc_id, string_split({_SQ.format('text')}, ' ') AS ws FROM documents), u AS (SELECT doc_id, p - 1 AS p, ws[p] AS token FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)) SELECT doc_id, token, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM u GROUP BY 1, 2",
    "deinvert_roundtrip": f"SELECT doc_id, nullif(array_to_string(string_split({_SQ.format('text')}, ' '), ' '), '') AS text FROM documents",
    "render_tagged": "SELECT doc_id, concat_ws(' ', CASE WHEN coalesce(substr(text, 1, 40), '') <> '' THEN 'TITLE ' || substr(text, 1, 40) END, CASE WHEN coalesce(nullif(lang, 'es'), '') <> '' THEN 'LANG ' || lang END, CASE WHEN coalesce(source, '') <> '' THEN 'SOURCE ' || source END) AS rendered FROM documents",
    "encoder_text": "SELECT doc_id, substr(text, 1, 20) || ' [SEP] ' || substr(text, 21, 30) || ' [SEP] ' || concat_ws('; ', nullif(lang, 'en'), source) AS rendered FROM documents",
    "norm_keys": "SELECT page_id, lower(replace(url, 'https://', '')) AS bare, regexp_replace(url, '.*/', '') AS suffix, coalesce(nullif(regexp_replace(url, '.*/', ''), ''), CAST(page_id AS VARCHAR)) AS fallback FROM pages",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short FROM documents",
    "strip_html": f"SELECT page_id, {_SQ.format(chr(39).join(['regexp_replace(regexp_replace(html, ', '<!--.*?-->', ', ', '', ', ', 'gs', '), ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))} AS plain FROM pages",
    "fts_title": "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) SELECT token, count(*) AS docs FROM t WHERE token IN ('the', 'der', 'la', 'los') GROUP BY 1",
    "top_values": "SELECT value, count(*) AS n FROM (SELECT regexp_replace(trim(unnest(string_split(regexp_replace(text, '[\\n.]', ';', 'g'), ';'))), '^\\+', '') AS value FROM documents) WHERE value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 15",
    "year_bins": "SELECT CASE WHEN y > 1991 AND y <= 1993 THEN '1992-1993' WHEN y > 1993 AND y <= 1996 THEN '1994-1996' WHEN y > 1996 AND y <= 1998 THEN '1997-1998' END AS bin, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1",
}
