"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.plans.tables import MACRON_TILDE, WORD, sql_answers, sql_markers, sql_period, sql_replace, sql_strip, sql_words, table


def normalize_markers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.normalize_abbreviation(F.col("abbr_text")).alias("normalized"))


def normalize_g_markup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.normalize_abbreviation(F.col("text")).alias("normalized"))


def normalize_full_chain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.normalize_abbreviation(F.col("text"), full_chain=True).alias("normalized"))


def normalize_basic(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.basic_normalize(F.col("abbr_text")).alias("normalized"))


def period_abbrev(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions' expansions with a stop put before the last two letters, normalized."""
    dotted = F.regexp_replace("expansion", r"^(.+)(..)$", "$1.$2")
    return table(spark, folder, "user_decisions").select("decision_no", t.normalize_abbreviation(dotted).alias("normalized"))


def latin_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """What the Latin patterns make of each normalized form, with each ending."""
    texts = table(spark, folder, "abbr_records").select("abbr_no", F.explode(F.array(*(F.concat("normalized_form", F.lit(e)) for e in ("", "b;", "q;", "p;")))).alias("text"))
    return texts.select("abbr_no", "text", F.explode(t.pattern_expansions(F.col("text"))).alias("expansion"))


def english_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """What the English patterns make of each author, after each title."""
    texts = table(spark, folder, "documents").select("doc_id", F.explode(F.array(*(F.concat(F.lit(a), "author", F.lit(" x Dr Drake, Mr")) for a in ("Dr ", "Mr ", "St ", "St", "x Dr ")))).alias("text"))
    return texts.select("doc_id", "text", F.explode(t.pattern_expansions(F.col("text"), "english")).alias("expansion"))


def lookup_key_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.lookup_key(F.col("normalized_form"), F.col("abbr_text"), F.col("context_before")).alias("lookup_key"))


def lm_offline_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", F.explode(t.offline_expansions(F.coalesce("abbr_text", "normalized_form"))).alias("expansion"))


def lm_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.prompt(F.col("normalized_form"), F.col("context_before"), F.col("context_after"), F.col("metadata")).alias("prompt"))


def lm_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Expansions in answers of commas, blanks and the words of each decision."""
    answer = F.concat(F.regexp_replace(F.coalesce("expansion", F.lit("")), " ", " , ,"), F.lit(" , "), F.coalesce("abbreviation", F.lit("")), F.lit("\n"))
    parsed = table(spark, folder, "user_decisions").select("decision_no", F.posexplode(t.parse_answer(answer)).alias("at", "expansion"))
    return parsed.withColumn("at", (F.col("at") + 1).cast("long"))


def context_window_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.last_words(F.col("context_before")).alias("words_before"), t.first_words(F.col("context_after")).alias("words_after"))


def display_token(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.display_token(F.col("context_before")).alias("shown"), t.display_token(F.col("context_after"), shorten=True).alias("shortened"))


def display_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.truncate(F.col("text")).alias("shown"))


def combined_context(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.combined_context(F.col("context_before"), F.col("abbr_text"), F.col("context_after")).alias("context"))


def entry_ids(spark: SparkSession, folder: str) -> DataFrame:
    record = table(spark, folder, "abbr_records")
    return record.select("abbr_no", t.entry_id(F.col("abbr_text"), F.col("file_path")).alias("entry_id"), t.expansion_id(F.col("file_path"), F.col("node_ord")).alias("expan_id"))


def assistant_placeholder(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", t.placeholder(F.col("normalized_form")).alias("answer"), t.denormalize_expansion(F.col("abbr_text"), F.col("normalized_form")).alias("as_is"))


QUERIES = {f.__name__: f for f in (normalize_markers, normalize_g_markup, normalize_full_chain, normalize_basic, period_abbrev, latin_patterns, english_patterns, lookup_key_fallback, lm_offline_fallback, lm_prompt, lm_parse, context_window_words, display_token, display_truncate, combined_context, entry_ids, assistant_placeholder)}

_G = '<g ref="char:cmbAbbrStroke">[^<]+</g>'
_QUE = '<g ref="char:abque"/>'
_STROKED = f"regexp_replace(regexp_replace(text, '^(?:{_G})+', ''), '(?s)(.)(?:{_G})+', '\\1$', 'g')"
_LAST_WORD = lambda x: f"{sql_words(x)}[-1]"
_MARKED = lambda x: f"list_filter({sql_words(x)}, lambda w: contains(w, '$') OR contains(w, 'õ') OR contains(w, 'ā'))[1]"
_TEXT = lambda x: f"coalesce({x}, '')"


def _title_sql(short: str, long: str) -> str:
    # RE2 has no look-around: each word boundary is taken along and put back, twice for neighbours that share one.
    once = lambda x: f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_]){short}($|[^\\p{{L}}\\p{{N}}_])', '\\1{long}\\2', 'g')"
    return f"CASE WHEN regexp_matches(text, '^{short}($|[^\\p{{L}}\\p{{N}}_])') THEN {once(once('text'))} END"


SQL = {
    "normalize_markers": f"SELECT abbr_no, {sql_markers('abbr_text')} AS normalized FROM abbr_records",
    "normalize_g_markup": f"""
        SELECT doc_id, CASE WHEN regexp_matches(text, '{_G}') THEN {_STROKED} WHEN contains(text, '{_QUE}') THEN replace(text, '{_QUE}', 'q$')
                            ELSE {sql_markers('text')} END AS normalized FROM documents""",
    "normalize_full_chain": f"SELECT doc_id, {sql_markers(f'''replace({_STROKED}, '{_QUE}', 'q$')''')} AS normalized FROM documents",
    "normalize_basic": f"SELECT abbr_no, {sql_period(sql_replace(chr(39).join(('regexp_replace(abbr_text, ', '([A-Za-z])̄', ', ', chr(92) + '1$', ', ', 'g', ')')), MACRON_TILDE))} AS normalized FROM abbr_records",
    "period_abbrev": f"SELECT decision_no, {sql_markers('''regexp_replace(expansion, '^(.+)(..)$', '%s.%s')''' % (chr(92) + '1', chr(92) + '2'))} AS normalized FROM user_decisions",
    "latin_patterns": f"""
        WITH texts AS (SELECT abbr_no, normalized_form || e AS text FROM abbr_records, unnest(['', 'b;', 'q;', 'p;']) AS x(e)),
        made AS (SELECT abbr_no, text, list_distinct(list_filter([
            CASE WHEN regexp_full_match(text, '{WORD}+b;') THEN text[:-3] || 'bus' END, CASE WHEN regexp_full_match(text, '{WORD}+q;') THEN text[:-3] || 'que' END,
            CASE WHEN regexp_full_match(text, '{WORD}+p;') THEN text[:-3] || 'pre' END, CASE WHEN starts_with(text, 'q$') THEN 'que' || text[3:] END], lambda x: x IS NOT NULL)) AS xs FROM texts)
        SELECT abbr_no, text, unnest(xs) AS expansion FROM made""",
    "english_patterns": f"""
        WITH texts AS (SELECT doc_id, a || author || ' x Dr Drake, Mr' AS text FROM documents, unnest(['Dr ', 'Mr ', 'St ', 'St', 'x Dr ']) AS x(a)),
        made AS (SELECT doc_id, text, unnest([{_title_sql('Dr', 'Doctor')}, {_title_sql('Mr', 'Mister')}, {_title_sql('St', 'Saint')}]) AS expansion FROM texts)
        SELECT DISTINCT ON (rid, expansion) doc_id, text, expansion FROM (SELECT *, row_number() OVER () AS rid FROM made) WHERE expansion IS NOT NULL""",
    "lookup_key_fallback": f"SELECT abbr_no, coalesce(nullif(normalized_form, ''), nullif(abbr_text, ''), {_LAST_WORD('context_before')}) AS lookup_key FROM abbr_records",
    "lm_prompt": f"""
        SELECT abbr_no, 'Expand the following abbreviation into exactly 3 distinct single-word expansions. Separate each expansion by a comma only, with no extra text.' || chr(10) || chr(10)
               || 'Abbreviation: ' || {_TEXT('normalized_form')} || chr(10) || 'Context before: ' || {_TEXT('context_before')} || chr(10) || 'Context after: ' || {_TEXT('context_after')} || chr(10)
               || 'Additional information:' || chr(10) || CASE WHEN metadata IS NULL THEN '' ELSE 'Language: ' || {_TEXT('metadata.language')} || chr(10) || 'Title: ' || {_TEXT('metadata.title')}
               || chr(10) || 'Date: ' || {_TEXT('metadata.date')} || chr(10) || 'Source: ' || {_TEXT('metadata.source')} || chr(10) END AS prompt FROM abbr_records""",
    "lm_parse": f"""
        WITH a AS (SELECT decision_no, replace({_TEXT('expansion')}, ' ', ' , ,') || ' ,' || chr(8201) || {_TEXT('abbreviation')} || chr(10) AS answer FROM user_decisions),
        p AS (SELECT decision_no, list_filter(list_transform(string_split(answer, ','), lambda x: {sql_strip('x')}), lambda x: x <> '') AS xs FROM a)
        SELECT decision_no, i AS at, xs[i] AS expansion FROM p, unnest(generate_series(1, len(xs))) AS s(i)""",
    "context_window_words": f"""
        SELECT abbr_no, array_to_string({sql_words('context_before')}[-5:], ' ') AS words_before, array_to_string({sql_words('context_after')}[:5], ' ') AS words_after FROM abbr_records""",
    "display_token": f"""
        SELECT abbr_no, CASE WHEN len({sql_words('context_before')}) > 2 THEN coalesce({_MARKED('context_before')}, context_before) ELSE context_before END AS shown,
               CASE WHEN len({sql_words('context_after')}) > 2 THEN coalesce({_MARKED('context_after')}, '...' || {_LAST_WORD('context_after')}) ELSE context_after END AS shortened FROM abbr_records""",
    "display_truncate": "SELECT doc_id, CASE WHEN length(text) > 50 THEN array_to_string(string_split(text, '')[1:47], '') || '...' ELSE text END AS shown FROM documents",
    "combined_context": f"SELECT abbr_no, {_TEXT('context_before')} || ' ' || {_TEXT('abbr_text')} || ' ' || {_TEXT('context_after')} AS context FROM abbr_records",
    "entry_ids": f"SELECT abbr_no, 'abbr_' || md5({_TEXT('abbr_text')} || {_TEXT('file_path')}) AS entry_id, 'expan_' || substr(md5(file_path || '#' || node_ord), 1, 8) AS expan_id FROM abbr_records",
    "assistant_placeholder": "SELECT abbr_no, replace(normalized_form, '$', 'n') AS answer, normalized_form AS as_is FROM abbr_records",
    "lm_offline_fallback": f"""
        WITH k AS (SELECT abbr_no, coalesce(abbr_text, normalized_form) AS key FROM abbr_records),
        {sql_answers()}
        SELECT abbr_no, unnest(coalesce(answers, [CASE WHEN contains(key, '$') THEN replace(key, '$', 'n') WHEN contains(key, 'õ') THEN replace(key, 'õ', 'on') ELSE key END])) AS expansion
        FROM k LEFT JOIN fixed ON word = key WHERE key <> ''""",
}
