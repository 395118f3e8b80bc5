"""Queries of training entries, decisions and replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import combined_context, stamp_name
from vellum.operators import dataset as d
from vellum.operators import decisions, replace
from vellum.plans.tables import MACRON_TILDE, REST, sql_replace, table

#: What the replacement queries delete and replace.
DELETE = ["❧", "[", "]"]
REPLACE = {"ſ": "s", "æ": "ae", "--": "-"}
SYSTEM = "You expand abbreviations in early printed texts."


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dataset_entries").select("entry_no", "id", "abbreviation", "expansion", "context_before", "context_after", F.col("metadata.language").alias("lang"))


def context_sufficient(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "abbr_records")
    return rows.where(d.sufficient_context(F.col("context_before"), F.col("context_after"))).select("abbr_no")


def entry_projection(spark: SparkSession, folder: str) -> DataFrame:
    made = d.entries(table(spark, folder, "abbr_records"), keep=("abbr_no",))
    return made.select("abbr_no", "abbreviation", "id", "context_before", "context_after", "source.file", "source.xpath", "source.line", "metadata.title")


def entry_combined_context(spark: SparkSession, folder: str) -> DataFrame:
    made = d.entries(table(spark, folder, "abbr_records"), "combined", include_metadata=False, validate=False, keep=("abbr_no",))
    return made.select("abbr_no", "id", "context")


def validate_required(spark: SparkSession, folder: str) -> DataFrame:
    return d.with_required(_stored(spark, folder)).select("entry_no", "abbreviation")


def dedup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return d.validate(_stored(spark, folder).select("entry_no", "id", "abbreviation"), "entry_no")


def validation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return d.validation_counts(_stored(spark, folder))


def _key() -> Column:
    return F.col("entry_no").cast("string")


def split_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return d.split(_stored(spark, folder), _key()).select("entry_no", "split")


def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    """Split within each length of the abbreviation."""
    return d.split(_stored(spark, folder), _key(), derived=F.length("abbreviation")).select("entry_no", "split")


def split_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Split within each language label."""
    return d.split(_stored(spark, folder), _key(), stratify_by="lang").select("entry_no", "split")


def split_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """Split in the order of the seeded shuffle."""
    return d.split_shuffled(_stored(spark, folder).select("entry_no"), "entry_no")


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return d.split_counts(d.split(d.validate(_stored(spark, folder).select("entry_no", "id", "abbreviation"), "entry_no"), _key()))


def chatml_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stored(spark, folder).where("abbreviation IS NOT NULL")
    said = rows.select("entry_no", F.posexplode(d.chat_messages(rows, SYSTEM)).alias("at", "m"))
    return said.select("entry_no", F.col("at").cast("long").alias("at"), "m.role", "m.content")


def decisions_latest(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "user_decisions").select("abbr_key", "decision_no", "expansion", "confidence", "file_path", "decided_at", "loaded_at")
    return decisions.latest_decisions(wanted).drop("decided_at", "loaded_at")


def decision_files(spark: SparkSession, folder: str) -> DataFrame:
    """The name of the file each decision would be saved in."""
    return table(spark, folder, "user_decisions").select("decision_no", stamp_name(F.col("decided_at"), "user_decisions").alias("file_name"))


def decision_entries(spark: SparkSession, folder: str) -> DataFrame:
    made = decisions.decision_entries(table(spark, folder, "user_decisions"))
    return made.select("abbr_key", "abbreviation", "expansion", combined_context(F.col("context_before"), F.col("abbreviation"), F.col("context_after")).alias("context"), "source.file", "source.confidence", "source.source_type", "metadata.title")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("file_name"), "text")


def _done(spark: SparkSession, folder: str) -> DataFrame:
    return replace.run(_files(spark, folder), replace.steps(DELETE, REPLACE))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    return replace.lines(_files(spark, folder), ["file_name"]).withColumn("line_number", F.col("line_number").cast("long"))


def unicode_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("file_name", replace.replaced(F.col("text"), replace.steps(DELETE, markers=False)).alias("text"))


def unicode_replace(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("file_name", replace.replaced(F.col("text"), replace.steps(replace=REPLACE, markers=False)).alias("text"))


def unicode_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return replace.replaced_lines(_files(spark, folder), replace.steps(DELETE, REPLACE)).withColumn("line_number", F.col("line_number").cast("long"))


def replacement_log(spark: SparkSession, folder: str) -> DataFrame:
    return replace.change_log(_done(spark, folder)).select("file_name", F.col("line_number").cast("long").alias("line_number"), "original", "replacement")


def replacement_summary(spark: SparkSession, folder: str) -> DataFrame:
    return replace.summary(replace.change_log(_done(spark, folder)))


def replaced_texts(spark: SparkSession, folder: str) -> DataFrame:
    return replace.replaced_texts(_files(spark, folder), replace.steps(DELETE, REPLACE))


QUERIES = {f.__name__: f for f in (context_sufficient, entry_projection, entry_combined_context, validate_required, dedup_first_wins, validation_counts, split_ratio, split_stratified, split_by_language, split_shuffled, split_counts, chatml_format, decisions_latest, decision_files, decision_entries, text_lines, unicode_delete, unicode_replace, unicode_pipeline, replacement_log, replacement_summary, replaced_texts)}

_T = lambda x: f"coalesce({x}, '')"
_ENOUGH = f"(length({_T('context_before')}) >= 20 OR length({_T('context_after')}) >= 20)"
_ID = f"coalesce(nullif(abbr_id, ''), 'abbr_' || md5({_T('abbr_text')} || {_T('file_path')}))"


def _split_sql(source: str, stratum: str) -> str:
    return f"""WITH s AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST({stratum} AS VARCHAR), 'default') ORDER BY md5(CAST(entry_no AS VARCHAR))) AS rn,
        count(*) OVER (PARTITION BY coalesce(CAST({stratum} AS VARCHAR), 'default')) AS n FROM s),
        c AS (SELECT *, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM r)"""


_ENTRY = "SELECT entry_no, id, abbreviation, metadata.language AS lang FROM dataset_entries"
_FIRST = "SELECT entry_no, id, abbreviation FROM dataset_entries WHERE abbreviation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(id, '') ORDER BY entry_no) = 1"
_LINES = r"""l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id AS file_name, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM l), lines AS (SELECT file_name, i AS line_number, ls[i] AS line FROM t, unnest(generate_series(1, len(ls))) AS s(i))"""
_PAIRS = [(c, "") for c in DELETE] + list(REPLACE.items())
_ALL = _PAIRS + MACRON_TILDE + REST + [(e, e) for e in (".mo", ".ma", ".mi")]
_SAID = ["deleted"] * len(DELETE) + [b for _, b in _ALL[len(DELETE) :]]


def _states_sql() -> str:
    """Each line before each step, step by step."""
    found = ["s0 AS (SELECT *, line AS x FROM lines)"]
    for k, (a, b) in enumerate(_ALL):
        found.append(f"s{k + 1} AS (SELECT file_name, line_number, line, replace(x, '{a}', '{b}') AS x FROM s{k})")
    return ", ".join(found)


_LOG = " UNION ALL ".join(f"SELECT file_name, line_number, '{a}' AS original, '{said}' AS replacement FROM s{k} WHERE contains(x, '{a}')" for k, ((a, _), said) in enumerate(zip(_ALL, _SAID, strict=True)))

# The seeded generator of Python, and its shuffle: 624 words mixed from the seed in two passes; each draw makes the next word from those before; a draw of as many bits as the number of
# places left is taken if it names one of them, and that place is exchanged with the last one left.
def _mix_sql(source: str, last: int, factor: int, more: str) -> str:
    return f"""
          SELECT k + 1, CASE WHEN i + 1 >= 624 THEN 1 ELSE i + 1 END, CASE WHEN i + 1 >= 624 THEN list_concat([v], mt[2:623], [v]) ELSE list_concat(mt[1:i], [v], mt[i + 2:]) END
          FROM (SELECT k, i, mt, ((xor(mt[i + 1]::HUGEINT, xor(mt[i], mt[i] >> 30)::HUGEINT * {factor}) {more}) & 4294967295)::BIGINT AS v FROM {source} WHERE k < {last})"""


_SHUFFLED = f"""
        seed AS (SELECT 1 AS i, [19650218::BIGINT] AS mt UNION ALL SELECT i + 1, list_append(mt, ((1812433253::HUGEINT * xor(mt[i], mt[i] >> 30) + i) & 4294967295)::BIGINT) FROM seed WHERE i < 624),
        one AS (SELECT 0 AS k, 1 AS i, mt FROM seed WHERE i = 624 UNION ALL {_mix_sql("one", 624, 1664525, "+ 42")}),
        two AS (SELECT 0 AS k, i, mt FROM one WHERE k = 624 UNION ALL {_mix_sql("two", 623, 1566083941, "- i")}),
        draws AS (SELECT list_concat([2147483648::BIGINT], mt[2:]) AS w, (SELECT count(*) FROM dataset_entries) - 1 AS i, (SELECT range(count(*)) FROM dataset_entries) AS o FROM two WHERE k = 623
                  UNION ALL
                  SELECT w, CASE WHEN r <= i THEN i - 1 ELSE i END, CASE WHEN r < i THEN list_concat(o[1:r], [o[i + 1]], o[r + 2:i], [o[r + 1]], o[i + 2:]) ELSE o END
                  FROM (SELECT w, i, o, xor(d, d >> 18) >> (31 - floor(log2(i + 1))::INT) AS r
                        FROM (SELECT w, i, o, xor(c, (c << 15) & 4022730752) AS d FROM (SELECT w, i, o, xor(b, (b << 7) & 2636928640) AS c FROM (SELECT w, i, o, xor(w[624], w[624] >> 11) AS b
                              FROM (SELECT list_append(w[2:], xor(w[398], xor(y >> 1, CASE WHEN y % 2 = 1 THEN 2567483615 ELSE 0 END))) AS w, i, o FROM (SELECT *, (w[1] & 2147483648) | (w[2] & 2147483647) AS y FROM draws WHERE i > 0))))))),
        shuffled AS (SELECT o[k] AS pos, k AS rn, len(o) AS n FROM (SELECT o FROM draws WHERE i <= 0), unnest(generate_series(1, len(o))) AS u(k)),
        r AS (SELECT entry_no, row_number() OVER (ORDER BY entry_no) - 1 AS pos FROM dataset_entries)"""

SQL = {
    "split_shuffled": f"""
        WITH RECURSIVE {_SHUFFLED}
        SELECT entry_no, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r JOIN shuffled USING (pos)""",
    "context_sufficient": f"SELECT abbr_no FROM abbr_records WHERE {_ENOUGH}",
    "entry_projection": f"""SELECT abbr_no, abbr_text AS abbreviation, {_ID} AS id, {_T('context_before')} AS context_before, {_T('context_after')} AS context_after, file_path AS file, xpath, line_number AS line,
                                   metadata.title AS title FROM abbr_records WHERE {_ENOUGH}""",
    "entry_combined_context": f"SELECT abbr_no, {_ID} AS id, {_T('context_before')} || ' ' || {_T('abbr_text')} || ' ' || {_T('context_after')} AS context FROM abbr_records",
    "validate_required": "SELECT entry_no, abbreviation FROM dataset_entries WHERE abbreviation IS NOT NULL",
    "dedup_first_wins": _FIRST,
    "validation_counts": """SELECT count(*) AS total_entries, CAST(count_if(abbreviation IS NULL) AS BIGINT) AS skipped_entries,
                                   (SELECT count(*) - count(DISTINCT coalesce(id, '')) FROM dataset_entries WHERE abbreviation IS NOT NULL) AS duplicate_entries FROM dataset_entries""",
    "split_ratio": _split_sql(_ENTRY, "1") + " SELECT entry_no, part AS split FROM c",
    "split_stratified": _split_sql(_ENTRY, "length(abbreviation)") + " SELECT entry_no, part AS split FROM c",
    "split_by_language": _split_sql(_ENTRY, "lang") + " SELECT entry_no, part AS split FROM c",
    "split_counts": _split_sql(_FIRST, "1") + " SELECT part AS split, count(*) AS n FROM c GROUP BY 1",
    "chatml_format": f"""
        SELECT entry_no, i AS at, ['system', 'user', 'assistant'][i + 1] AS role,
               CASE i WHEN 0 THEN 'You expand abbreviations in early printed texts.'
                      WHEN 1 THEN 'Expand the abbreviation: ' || abbreviation || ' in context: ' || {_T('context_before')} || ' ' || abbreviation || ' ' || {_T('context_after')}
                      ELSE replace(abbreviation, '$', 'n') END AS content
        FROM dataset_entries, unnest(generate_series(0, 2)) AS s(i) WHERE abbreviation IS NOT NULL""",
    "decisions_latest": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY abbr_key ORDER BY decided_at DESC, decision_no DESC, loaded_at DESC) AS rn, first_value(decision_no) OVER (PARTITION BY abbr_key ORDER BY decided_at, decision_no, loaded_at) AS first_no FROM user_decisions)
        SELECT abbr_key, decision_no, expansion, confidence, file_path, first_no FROM r WHERE rn = 1""",
    "decision_files": "SELECT decision_no, 'user_decisions_' || strftime(decided_at, '%Y%m%d_%H%M%S') AS file_name FROM user_decisions",
    "decision_entries": f"""
        WITH a AS (SELECT *, coalesce(nullif(abbreviation, ''), abbr_key) AS abbr FROM user_decisions)
        SELECT abbr_key, abbr AS abbreviation, expansion, {_T('context_before')} || ' ' || {_T('abbr')} || ' ' || {_T('context_after')} AS context, {_T('file_path')} AS file, confidence, source AS source_type,
               metadata.title AS title FROM a""",
    "text_lines": f"WITH {_LINES} SELECT file_name, line_number, line FROM lines",
    "unicode_delete": f"SELECT doc_id AS file_name, {sql_replace('text', _PAIRS[: len(DELETE)])} AS text FROM documents",
    "unicode_replace": f"SELECT doc_id AS file_name, {sql_replace('text', list(REPLACE.items()))} AS text FROM documents",
    "unicode_pipeline": f"WITH {_LINES} SELECT file_name, line_number, {sql_replace('line', _ALL)} AS line FROM lines",
    "replacement_log": f"WITH {_LINES}, {_states_sql()} {_LOG}",
    "replacement_summary": f"""WITH {_LINES}, {_states_sql()}, log AS ({_LOG})
        SELECT CAST(count_if(replacement = 'deleted') AS BIGINT) AS deleted, CAST(count_if(replacement <> 'deleted') AS BIGINT) AS replaced, count(DISTINCT file_name) AS files FROM log""",
    "replaced_texts": f"WITH {_LINES} SELECT file_name, string_agg({sql_replace('line', _ALL)}, chr(10) ORDER BY line_number) || chr(10) AS text FROM lines GROUP BY 1",
}
