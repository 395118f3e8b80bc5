"""Queries over TEI documents, made of the scanned records: one small document for each record.

Their SQL starts from the records' columns, never from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import dataset, suggest, tei, xmlpatch
from vellum.operators.sizes import spread
from vellum.plans import dataset as dataset_plans
from vellum.plans import pipelines
from vellum.plans import suggest as suggest_plans
from vellum.plans.tables import MACRON_TILDE, sql_markers, sql_period, sql_replace, sql_strip, sql_words, table
from vellum.storage import materialize


def _safe(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path`` (the record's number), ``xml``.

    The paragraph holds both contexts around an ``abbr``, a ``g``, or an ``am`` in an ``abbr``, by the record's kind; expanded ones stand in a ``choice``.
    A record without ``abbr_id`` has a document that breaks off.
    """
    r = spread(table(spark, folder, "abbr_records").select("abbr_no", "kind", "abbr_id", "abbr_text", "context_before", "context_after", "already_expanded", "metadata"))
    m = lambda f: _safe(F.col(f"metadata.{f}"))
    terms = F.array_join(F.transform(F.split(m("genre"), ", "), lambda t: F.concat(F.lit("<term>"), t, F.lit("</term>"))), "")
    header = F.concat(
        F.lit("<teiHeader><fileDesc><titleStmt><title>"), m("title"), F.lit("</title><title>Other</title><author>"), m("author"), F.lit("</author></titleStmt><publicationStmt><date when=\""), m("date"),
        F.lit("\">no date</date></publicationStmt><sourceDesc><bibl>"), m("source"), F.lit("</bibl></sourceDesc></fileDesc><profileDesc><langUsage><language ident=\""), m("language"),
        F.lit("\"/></langUsage><textClass><keywords>"), terms, F.lit("</keywords></textClass></profileDesc></teiHeader>"),
    )
    text, before, after = _safe(F.col("abbr_text")), _safe(F.col("context_before")), _safe(F.col("context_after"))
    mark = (
        F.when(F.col("kind") == "abbr", F.concat(F.lit('<abbr xml:id="a">'), text, F.lit("</abbr>")))
        .when(F.col("kind") == "g", F.lit('<g ref="char:cmbAbbrStroke">̄</g>'))
        .otherwise(F.concat(F.lit("<abbr>x<am>"), text, F.lit("</am></abbr>")))
    )
    inner = F.when(F.col("already_expanded"), F.concat(F.lit("<choice>"), mark, F.lit("<expan>e</expan></choice>"))).otherwise(mark)
    body = F.concat(F.lit("<text><body><p>first</p><p>"), before, F.lit(" "), inner, F.lit(" "), after, F.lit("</p></body></text>"))
    whole = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0">'), header, body, F.when(F.col("abbr_id").isNotNull(), "</TEI>").otherwise(""))
    return r.select(F.col("abbr_no").cast("string").alias("file_path"), whole.alias("xml"))


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("abbr_no", F.col("file_path").cast("long")).drop("file_path")


def tei_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder))))
    return found.select("abbr_no", "kind", "parent_tag", "abbr_id", "xpath", "abbr_text", "context_before", "context_after", "normalized_form")


def tei_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return _number(tei.scan_documents(sources(spark, folder)).where("error IS NULL")).select("abbr_no", "valid_tei", "metadata.*")


def tei_word_context(spark: SparkSession, folder: str) -> DataFrame:
    """Words around elements, of the paragraph or, where it has none, of the body."""
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder)), include_expanded=True)).where("kind = 'abbr' AND parent_tag = 'p'")
    return found.select("abbr_no", "words_before", "words_after")


def tei_enumerated(spark: SparkSession, folder: str) -> DataFrame:
    """Each abbreviation's place among those of its document."""
    found = _number(tei.abbreviations(tei.scan_documents(sources(spark, folder))))
    return found.select("abbr_no", "kind", F.col("number").cast("long").alias("number"), F.col("of").cast("long").alias("of"))


def older_g_form(spark: SparkSession, folder: str) -> DataFrame:
    """What the earlier rule makes of a stroke and of the que mark after each context."""
    r = table(spark, folder, "abbr_records")
    return r.select("abbr_no", tei.older_form(F.col("context_before"), F.lit(tei.STROKE)).alias("stroke"), tei.older_form(F.col("context_before"), F.lit(tei.QUE)).alias("que"))


def statistics_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of documents, the session, suggestions and entries as rows."""
    words = table(spark, folder, "solution_dictionary")
    found = suggest.suggestions(table(spark, folder, "abbr_records").select("normalized_form", "abbr_text", "context_before"), words)
    scanned = materialize(tei.scan_documents(sources(spark, folder)))
    session = pipelines.session_counts(suggest.suggestions(tei.abbreviations(scanned), words))
    parts = [("documents", tei.statistics(scanned)), ("session", session), ("suggestions", suggest.statistics(found)), ("entries", dataset.validation_counts(table(spark, folder, "dataset_entries")))]
    return pipelines.reports(parts)


def tei_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tei.statistics(tei.scan_documents(sources(spark, folder)))


def tei_malformed_isolated(spark: SparkSession, folder: str) -> DataFrame:
    scanned = tei.scan_documents(sources(spark, folder))
    return _number(scanned).select("abbr_no", F.col("error").isNotNull().alias("malformed"), "valid_tei", F.size("found").cast("long").alias("found"))


def _patched(spark: SparkSession, folder: str, **options: bool) -> DataFrame:
    documents = sources(spark, folder)
    found = tei.abbreviations(tei.scan_documents(documents)).where("kind <> 'abbr' OR abbr_id IS NOT NULL")
    wanted = found.select("file_path", "kind_ord", "node_ord", F.concat(F.lit("E&"), "kind").alias("expansion"))
    done = xmlpatch.patch_documents(documents, wanted, **options)
    # From the paragraph on, so that what is compared is what was patched.
    return _number(done).select("abbr_no", "expanded", F.regexp_extract("xml", r"(?s)<p>first</p>(.*)", 1).alias("body"))


def tei_expand(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder, add_ids=False)


def tei_expand_choice(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder, use_choice=True, add_ids=False)


QUERIES = {f.__name__: f for f in (tei_extract, tei_metadata, tei_word_context, tei_stats, tei_malformed_isolated, tei_expand, tei_expand_choice, tei_enumerated, older_g_form, statistics_report)}

_R = f"""r AS (SELECT abbr_no, kind, already_expanded AS done, abbr_id IS NOT NULL AS whole, coalesce(abbr_text, '') AS t, {sql_strip("coalesce(abbr_text, '')")} AS ts,
                      coalesce(context_before, '') AS b, coalesce(context_after, '') AS a, {sql_strip("coalesce(context_before, '')")} AS bs, {sql_strip("coalesce(context_after, '')")} AS "as",
                      metadata AS md FROM abbr_records)"""
_BASIC = sql_period(sql_replace("regexp_replace(ts, '([A-Za-z])̄', '\\1$', 'g')", MACRON_TILDE))
_P = "'/TEI[1]/text[1]/body[1]/p[2]/'"
_M = lambda f: f"coalesce(md.{f}, '')"
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FOUND = f"""
        e AS (SELECT abbr_no, done, 'abbr' AS kind, 'p' AS parent_tag, 'a' AS abbr_id, {_P} || 'abbr[1]' AS xpath, ts AS abbr_text, bs AS context_before, "as" AS context_after, {sql_markers('ts')} AS normalized_form FROM r WHERE whole AND kind = 'abbr'
              UNION ALL SELECT abbr_no, done, 'g', 'p', NULL, {_P} || 'g[1]', '̄', bs, "as", CASE WHEN bs <> '' THEN bs || '$' || "as" ELSE 'm$' || "as" END FROM r WHERE whole AND kind = 'g'
              UNION ALL SELECT abbr_no, done, 'abbr', 'p', NULL, {_P} || 'abbr[1]', {sql_strip("'x' || t")}, bs, "as", {sql_markers(sql_strip("'x' || t"))} FROM r WHERE whole AND kind = 'am'
              UNION ALL SELECT abbr_no, done, 'am', 'abbr', NULL, {_P} || 'abbr[1]/am[1]', ts, 'x', '', {_BASIC} FROM r WHERE whole AND kind = 'am')"""
_INNER = """CASE kind WHEN 'abbr' THEN '<abbr xml:id="a"' || CASE WHEN t = '' THEN '/>' ELSE '>' || {t} || '</abbr>' END WHEN 'g' THEN '<g ref="char:cmbAbbrStroke">̄</g>'
                 ELSE '<abbr>x<am' || CASE WHEN t = '' THEN '/>' ELSE '>' || {t} || '</am>' END || '</abbr>' END""".replace("{t}", _ESC("t"))
_AM = "'<am' || CASE WHEN t = '' THEN '/>' ELSE '>' || {t} || '</am>' END".replace("{t}", _ESC("t"))
# A patched document is written anew, without text of blanks only unless other text comes before it; one without expansions stays as it was.
_WHOLE = lambda inner: f"""'<p>' || CASE WHEN bs = '' THEN '' ELSE {_ESC('b')} || ' ' END || {inner} || CASE WHEN bs = '' AND "as" = '' THEN '' ELSE ' ' || {_ESC('a')} END || '</p></body></text></TEI>'"""
_OLD = lambda x: f"replace({_ESC(x)}, '\"', '&quot;')"
_AS_MADE = f"""'<p>' || {_OLD('b')} || ' ' || CASE WHEN done THEN '<choice>' ELSE '' END
            || CASE kind WHEN 'abbr' THEN '<abbr xml:id="a">' || {_OLD('t')} || '</abbr>' WHEN 'g' THEN '<g ref="char:cmbAbbrStroke">̄</g>' ELSE '<abbr>x<am>' || {_OLD('t')} || '</am></abbr>' END
            || CASE WHEN done THEN '<expan>e</expan></choice>' ELSE '' END || ' ' || {_OLD('a')} || '</p></body></text>' || CASE WHEN whole THEN '</TEI>' ELSE '' END"""
_AM_EXPANDED = f"'<choice>' || core || '<expan>' || {_AM} || '<ex>E&amp;am</ex></expan></choice>'"


def _expand_sql(choice: bool) -> str:
    plain = "core || '<expan corresp=\"#a\">E&amp;abbr</expan>'".replace(' corresp="#a"', "")
    abbr = f"'<choice>' || {plain} || '</choice>'" if choice else plain
    return f"""WITH {_R}, i AS (SELECT *, {_INNER} AS core FROM r)
        SELECT abbr_no, CASE WHEN done OR NOT whole THEN 0 ELSE 1 END AS expanded, CASE WHEN done OR NOT whole THEN {_AS_MADE}
               WHEN kind = 'abbr' THEN {_WHOLE(abbr)} WHEN kind = 'g' THEN {_WHOLE("core || '<expan>E&amp;g</expan>'")} ELSE {_WHOLE(_AM_EXPANDED)} END AS body FROM i"""


SQL = {
    # An am within a choice's abbr counts as expanded, as does its abbr.
    "tei_extract": f"WITH {_R}, {_FOUND} SELECT * EXCLUDE (done) FROM e WHERE NOT done",
    "tei_metadata": f"""
        WITH {_R} SELECT abbr_no, TRUE AS valid_tei, {sql_strip(_M('title'))} AS title, {sql_strip(_M('author'))} AS author, {_M('date')} AS date, {_M('language')} AS language, {sql_strip(_M('source'))} AS source,
                         array_to_string(list_filter(list_transform(string_split({_M('genre')}, ', ')[:3], lambda x: {sql_strip('x')}), lambda x: x <> ''), ', ') AS genre FROM r WHERE whole""",
    "tei_word_context": f"""
        WITH {_R} SELECT abbr_no, CASE WHEN bs = '' AND "as" = '' THEN 'first' ELSE array_to_string({sql_words('b')}[-5:], ' ') END AS words_before, array_to_string({sql_words('a')}[:5], ' ') AS words_after
        FROM r WHERE whole AND NOT done AND kind <> 'g'""",
    "tei_stats": f"""
        WITH {_R}, {_FOUND} SELECT (SELECT count(*) FROM r WHERE whole) AS documents_processed, CAST(count_if(NOT done) AS BIGINT) AS abbreviations_found, CAST(count_if(done) AS BIGINT) AS already_expanded,
               CAST(count_if(kind = 'abbr' AND NOT done AND normalized_form <> abbr_text) AS BIGINT) AS normalized_abbr, (SELECT count(*) FROM r WHERE NOT whole) AS malformed_abbr FROM e""",
    "tei_malformed_isolated": f"""
        WITH {_R} SELECT abbr_no, NOT whole AS malformed, whole AS valid_tei, CAST(CASE WHEN NOT whole THEN 0 WHEN kind = 'am' THEN 2 ELSE 1 END AS BIGINT) AS found FROM r""",
    "tei_expand": _expand_sql(False),
    "tei_expand_choice": _expand_sql(True),
    "tei_enumerated": f"""
        WITH {_R}, {_FOUND} SELECT abbr_no, kind, row_number() OVER (PARTITION BY abbr_no ORDER BY kind) AS number, count(*) OVER (PARTITION BY abbr_no) AS of FROM e WHERE NOT done""",
    "older_g_form": f"""
        WITH {_R} SELECT abbr_no, CASE WHEN rtrim(bs) = '' THEN 'm$' ELSE right(bs, 1) || '$' END AS stroke, 'q$' AS que FROM r""",
}


def _long_sql(part: str, sql: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, '{m}' AS metric, CAST({m} AS BIGINT) AS value FROM ({sql})" for m in metrics)


SQL["statistics_report"] = " UNION ALL ".join(
    [
        _long_sql("documents", SQL["tei_stats"], ["documents_processed", "abbreviations_found", "already_expanded", "normalized_abbr", "malformed_abbr"]),
        _long_sql("session", f"""WITH {_R}, {_FOUND} SELECT count(DISTINCT abbr_no) AS files_processed, count_if(normalized_form <> '' OR abbr_text <> '' OR len({sql_words('context_before')}) > 0) AS abbreviations_expanded FROM e WHERE NOT done""", ["files_processed", "abbreviations_expanded"]),
        _long_sql("suggestions", suggest_plans.SQL["suggestion_stats"], ["total_suggestions", "dictionary_matches", "pattern_matches", "wordnet_suggestions", "lm_suggestions", "failed_abbreviations"]),
        _long_sql("entries", dataset_plans.SQL["validation_counts"], ["total_entries", "skipped_entries", "duplicate_entries"]),
    ]
)
