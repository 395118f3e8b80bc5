"""Queries of dictionaries and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import dictionary as d
from vellum.operators import suggest as s
from vellum.operators.decisions import best_decisions
from vellum.plans.tables import WORD, sql_answers, sql_strip, sql_words, table

#: Keys left out of conflicts as ambiguous.
AMBIGUOUS = ["yt$", "ye$", "wt$"]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abbr_records").select("abbr_no", "abbr_text", "normalized_form", "context_before", "context_after")


def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    return s.suggestions(_records(spark, folder), table(spark, folder, "solution_dictionary"))


def dict_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary values of each normalized form, exact keys before those equal but for case."""
    found = d.lookup(_records(spark, folder), "normalized_form", table(spark, folder, "solution_dictionary"))
    return found.select("abbr_no", F.posexplode("expansions").alias("at", "expansion")).withColumn("at", (F.col("at") + 1).cast("long"))


def dict_ci_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The same for upper-case keys, which mostly are in no dictionary as they stand."""
    upper = _records(spark, folder).withColumn("key", F.translate("normalized_form", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    found = d.lookup(upper, "key", table(spark, folder, "solution_dictionary"))
    return found.select("abbr_no", F.posexplode("expansions").alias("at", "expansion")).withColumn("at", (F.col("at") + 1).cast("long"))


def suggest_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return s.ranked(_cascade(spark, folder), "abbr_no").withColumn("rank", F.col("rank").cast("long"))


def suggest_top1(spark: SparkSession, folder: str) -> DataFrame:
    return s.top(_cascade(spark, folder), "abbr_no")


def suggestion_stats(spark: SparkSession, folder: str) -> DataFrame:
    return s.statistics(_cascade(spark, folder))


def stored_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The stored suggestions in their order of rank."""
    stored = table(spark, folder, "suggestions").groupBy("abbr_no").agg(F.array_sort(F.collect_list(F.struct("gen_ord", "expansion", "confidence", "source"))).alias("x"))
    found = stored.withColumn("suggestions", F.transform("x", lambda x: F.struct(x["expansion"].alias("expansion"), x["confidence"].alias("confidence"), x["source"].alias("source"))))
    return s.ranked(found, "abbr_no").withColumn("rank", F.col("rank").cast("long"))


def lemma_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Lemmas for the first letters of all normalized forms, from the words of the accepted forms' expansions."""
    lemmas = table(spark, folder, "abbr_forms").select(F.explode(F.split("expansion", " ")).alias("lemma"))
    keys = table(spark, folder, "abbr_records").select("abbr_no", F.substring("normalized_form", 1, 1).alias("normalized_form"), F.lit(None).cast("string").alias("abbr_text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"))
    found = s.suggestions(keys, table(spark, folder, "solution_dictionary"), lemmas=lemmas, use_model=False)
    return s.ranked(found, "abbr_no").where("source = 'wordnet'").select("abbr_no", F.col("rank").cast("long").alias("rank"), "expansion")


def long_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions without those of one character, where there are others."""
    return s.ranked(s.without_single_letters(_cascade(spark, folder)), "abbr_no").withColumn("rank", F.col("rank").cast("long"))


def suggest_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Choices among the suggestions: the rank stored as ``gen_ord`` + 1 of the best stored one, or a stored custom text."""
    stored = table(spark, folder, "suggestions").groupBy("abbr_no").agg(F.max("gen_ord").alias("g"), F.min("expansion").alias("e"))
    choices = stored.select("abbr_no", (F.col("g") + 1).alias("choice"), F.when(F.col("g") == 0, F.concat(F.lit(" "), "e")).alias("custom"))
    return s.choose(_cascade(spark, folder), choices, "abbr_no")


def _pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    both = table(spark, folder, "solution_dictionary")
    return d.single_values(both, "machine"), d.single_values(both, "user")


def conflict_detect(spark: SparkSession, folder: str) -> DataFrame:
    return d.conflicts(*_pair(spark, folder), AMBIGUOUS)


def conflict_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Both dictionaries after choices by the first letter of the key."""
    machine, user = _pair(spark, folder)
    first = F.substring("abbr", 1, 1)
    choices = machine.select("abbr", F.when(first < "d", "M").when(first < "p", "u").otherwise("S").alias("choice"))
    new_machine, new_user = d.resolve(machine, user, choices, AMBIGUOUS)
    return new_machine.withColumn("dict", F.lit("machine")).unionByName(new_user.withColumn("dict", F.lit("user")))


def dict_merge(spark: SparkSession, folder: str) -> DataFrame:
    return d.merge(*_pair(spark, folder))


def dict_merge_ascii(spark: SparkSession, folder: str) -> DataFrame:
    return d.ascii_only(d.merge(*_pair(spark, folder)))


def dict_add_custom(spark: SparkSession, folder: str) -> DataFrame:
    """The user's dictionary with the custom expansions of all decisions added."""
    user = table(spark, folder, "solution_dictionary").where("dict = 'user'").groupBy("abbr").agg(F.max_by("expansions", "key_ord").alias("expansions"))
    additions = table(spark, folder, "user_decisions").where("source = 'custom'").select(F.col("abbr_key").alias("abbr"), "expansion")
    return d.add_custom(user, additions).select("abbr", F.array_join("expansions", "|").alias("expansions"))


def automatic_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The last best suggestion of each abbreviation, with its first place."""
    records = table(spark, folder, "abbr_records").where("NOT already_expanded")
    found = s.top(s.suggestions(records, table(spark, folder, "solution_dictionary")), "abbr_no", "abbr_text", "normalized_form", "context_before", "context_after", "file_path")
    return best_decisions(found, "abbr_no").select("abbr_key", "first_at", "expansion", "confidence", "source", "file_path")


def abbr_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often each normalized form occurs, and the expansion its decisions give most."""
    counts = table(spark, folder, "abbr_records").where("normalized_form IS NOT NULL").groupBy("normalized_form").agg(F.count("*").alias("n"))
    uses = table(spark, folder, "user_decisions").where("expansion IS NOT NULL").groupBy("abbr_key", "expansion").agg(F.countDistinct("decision_no").alias("uses"))
    most = uses.groupBy(F.col("abbr_key").alias("normalized_form")).agg(F.min_by("expansion", F.struct(-F.col("uses"), F.col("expansion"))).alias("most_used"))
    return counts.join(most, "normalized_form", "left")


QUERIES = {f.__name__: f for f in (dict_lookup, dict_ci_fallback, suggest_ranked, suggest_top1, suggestion_stats, stored_ranked, lemma_suggestions, long_suggestions, suggest_chosen, conflict_detect, conflict_resolve, dict_merge, dict_merge_ascii, dict_add_custom, automatic_decisions, abbr_frequency)}

_DICT = """
        x AS (SELECT dict, key_ord, abbr, list_filter(coalesce(expansions, []), lambda e: length(e) > 1) AS xs FROM solution_dictionary),
        exact AS (SELECT dict, abbr, arg_max(xs, key_ord) AS xs FROM x GROUP BY ALL),
        folded AS (SELECT dict, lower(abbr) AS low, arg_min(xs, key_ord) AS xs FROM x GROUP BY ALL),
        hit AS (SELECT k.*, coalesce((SELECT xs FROM exact WHERE dict = 'user' AND abbr = key), []) AS u, coalesce((SELECT xs FROM exact WHERE dict = 'machine' AND abbr = key), []) AS m,
                       coalesce((SELECT xs FROM folded WHERE dict = 'user' AND low = lower(key)), []) AS ul, coalesce((SELECT xs FROM folded WHERE dict = 'machine' AND low = lower(key)), []) AS ml FROM k),
        -- list_distinct keeps no order, so positions are compared instead
        joined AS (SELECT *, list_concat(u, list_filter(m, lambda e, i: NOT list_contains(u, e) AND list_position(m, e) = i)) AS e FROM hit),
        known AS (SELECT *, CASE WHEN len(e) > 0 THEN e WHEN len(ul) > 0 THEN ul ELSE ml END AS known FROM joined)"""
_KEYS = f"k AS (SELECT *, coalesce(nullif(normalized_form, ''), nullif(abbr_text, ''), {sql_words('context_before')}[-1]) AS key FROM abbr_records)"
_CASCADE = f"""
        {_KEYS}, {_DICT},
        made AS (SELECT *, list_filter([CASE WHEN regexp_full_match(key, '{WORD}+b;') THEN key[:-3] || 'bus' END, CASE WHEN regexp_full_match(key, '{WORD}+q;') THEN key[:-3] || 'que' END,
                                        CASE WHEN regexp_full_match(key, '{WORD}+p;') THEN key[:-3] || 'pre' END, CASE WHEN starts_with(key, 'q$') THEN 'que' || key[3:] END],
                                       lambda p: p IS NOT NULL AND NOT list_contains(known, p)) AS made FROM known),
        given AS (SELECT *, list_concat(list_transform(known, lambda e: {{'e': e, 'c': 0.8::DOUBLE, 's': 'dictionary'}}), list_transform(made, lambda e: {{'e': e, 'c': 0.4::DOUBLE, 's': 'pattern'}})) AS g FROM made WHERE key IS NOT NULL),
        {sql_answers()},
        sug AS (SELECT given.*, CASE WHEN len(g) > 0 THEN g ELSE list_transform(coalesce(answers, [CASE WHEN contains(key, '$') THEN replace(key, '$', 'n') WHEN contains(key, 'õ') THEN replace(key, 'õ', 'on') ELSE key END]),
                                                                                lambda e: {{'e': e, 'c': 0.8::DOUBLE, 's': 'language_model'}}) END AS sug FROM given LEFT JOIN fixed ON word = key),
        rows AS (SELECT sug.* EXCLUDE (sug), i, sug[i].e AS expansion, sug[i].c AS confidence, sug[i].s AS source FROM sug, unnest(generate_series(1, len(sug))) AS t(i)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY abbr_no ORDER BY confidence DESC, i) AS rank FROM rows)"""
_VALUES = """
        v AS (SELECT dict, abbr, arg_max(array_to_string(expansions, '|'), key_ord) AS value FROM solution_dictionary GROUP BY ALL),
        m AS (SELECT abbr, value FROM v WHERE dict = 'machine'), u AS (SELECT abbr, value FROM v WHERE dict = 'user'),
        clash AS (SELECT abbr, m.value AS machine_value, u.value AS user_value FROM m JOIN u USING (abbr) WHERE m.value IS DISTINCT FROM u.value AND abbr NOT IN ('yt$', 'ye$', 'wt$'))"""

SQL = {
    "dict_lookup": f"WITH k AS (SELECT *, normalized_form AS key FROM abbr_records), {_DICT} SELECT abbr_no, i AS at, known[i] AS expansion FROM known, unnest(generate_series(1, len(known))) AS t(i)",
    "dict_ci_fallback": f"WITH k AS (SELECT *, translate(normalized_form, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS key FROM abbr_records), {_DICT} SELECT abbr_no, i AS at, known[i] AS expansion FROM known, unnest(generate_series(1, len(known))) AS t(i)",
    "suggest_ranked": f"WITH {_CASCADE} SELECT abbr_no, rank, expansion, confidence, source FROM ranked",
    "suggest_top1": f"WITH {_CASCADE} SELECT abbr_no, expansion, confidence, source FROM ranked WHERE rank = 1",
    "long_suggestions": f"""
        WITH {_CASCADE}, w AS (SELECT *, max(length(expansion) > 1) OVER (PARTITION BY abbr_no) AS any_long FROM ranked)
        SELECT abbr_no, row_number() OVER (PARTITION BY abbr_no ORDER BY rank) AS rank, expansion, confidence, source FROM w WHERE length(expansion) > 1 OR NOT any_long""",
    "suggestion_stats": f"""
        WITH {_CASCADE}, per AS (SELECT abbr_no, max(source = 'dictionary') AS d, count_if(source = 'pattern') AS p, max(source = 'language_model') AS l FROM ranked GROUP BY 1)
        SELECT (SELECT count(*) FROM abbr_records) AS total_suggestions, CAST(count_if(d) AS BIGINT) AS dictionary_matches, CAST(sum(p) AS BIGINT) AS pattern_matches, 0::BIGINT AS wordnet_suggestions,
               CAST(count_if(l) AS BIGINT) AS lm_suggestions, (SELECT count(*) FROM k WHERE key IS NULL) AS failed_abbreviations FROM per""",
    "suggest_chosen": f"""
        WITH {_CASCADE}, c AS (SELECT abbr_no, max(gen_ord) AS g, min(expansion) AS e FROM suggestions GROUP BY 1),
        own AS (SELECT abbr_no, {sql_strip("' ' || e")} AS expansion FROM c WHERE g = 0 AND length({sql_strip("' ' || e")}) > 1),
        w AS (SELECT *, max(length(expansion) > 1) OVER (PARTITION BY abbr_no) AS any_long FROM ranked),
        l AS (SELECT *, row_number() OVER (PARTITION BY abbr_no ORDER BY rank) AS r FROM w WHERE length(expansion) > 1 OR NOT any_long)
        SELECT abbr_no, expansion, 1.0::DOUBLE AS confidence, 'custom' AS source FROM own
        UNION ALL SELECT abbr_no, expansion, confidence, source FROM l JOIN c USING (abbr_no) WHERE r = c.g + 1 AND abbr_no NOT IN (SELECT abbr_no FROM own)""",
    "stored_ranked": "SELECT abbr_no, row_number() OVER (PARTITION BY abbr_no ORDER BY confidence DESC NULLS LAST, gen_ord) AS rank, expansion, confidence, source FROM suggestions",
    "lemma_suggestions": f"""
        WITH k AS (SELECT abbr_no, substr(normalized_form, 1, 1) AS key FROM abbr_records WHERE normalized_form <> ''), {_DICT},
        l AS (SELECT DISTINCT unnest(string_split(expansion, ' ')) AS lemma FROM abbr_forms),
        r AS (SELECT lower(substr(lemma, 1, 1)) AS letter, lemma, row_number() OVER (PARTITION BY lower(substr(lemma, 1, 1)) ORDER BY lemma) AS rank FROM l WHERE length(lemma) > 2)
        SELECT abbr_no, rank, lemma AS expansion FROM known JOIN r ON letter = lower(key) WHERE rank <= 3 AND len(known) = 0""",
    "conflict_detect": f"WITH {_VALUES} SELECT abbr, machine_value, user_value FROM clash",
    "conflict_resolve": f"""
        WITH {_VALUES}
        SELECT 'machine' AS dict, m.abbr, CASE WHEN substr(m.abbr, 1, 1) >= 'd' AND substr(m.abbr, 1, 1) < 'p' AND c.abbr IS NOT NULL THEN user_value ELSE m.value END AS value FROM m LEFT JOIN clash c ON m.abbr = c.abbr
        UNION ALL SELECT 'user', u.abbr, CASE WHEN substr(u.abbr, 1, 1) < 'd' AND c.abbr IS NOT NULL THEN machine_value ELSE u.value END FROM u LEFT JOIN clash c ON u.abbr = c.abbr""",
    "dict_merge": f"WITH {_VALUES} SELECT abbr, CASE WHEN u.abbr IS NOT NULL THEN u.value ELSE m.value END AS value FROM m FULL JOIN u USING (abbr)",
    "dict_merge_ascii": f"""
        WITH {_VALUES}, j AS (SELECT abbr, CASE WHEN u.abbr IS NOT NULL THEN u.value ELSE m.value END AS value FROM m FULL JOIN u USING (abbr))
        SELECT * FROM j WHERE regexp_full_match(abbr, '[\\x00-\\x7F]*') AND regexp_full_match(coalesce(value, ''), '[\\x00-\\x7F]*')""",
    "dict_add_custom": f"""
        WITH u AS (SELECT abbr, arg_max(expansions, key_ord) AS xs FROM solution_dictionary WHERE dict = 'user' GROUP BY 1),
        a AS (SELECT abbr_key AS abbr, list_sort(list_distinct(list({sql_strip('expansion')}))) AS more FROM user_decisions
              WHERE source = 'custom' AND length({sql_strip('expansion')}) > 1 AND abbr_key IS NOT NULL GROUP BY 1)
        SELECT abbr, array_to_string(list_concat(coalesce(xs, []), list_filter(coalesce(more, []), lambda x: NOT list_contains(coalesce(xs, []), x))), '|') AS expansions FROM u FULL JOIN a USING (abbr)""",
    "automatic_decisions": f"""
        WITH {_CASCADE}, t AS (SELECT *, coalesce(nullif(abbr_text, ''), nullif(normalized_form, ''), 'unknown_' || abbr_no) AS abbr_key FROM ranked WHERE rank = 1 AND NOT already_expanded)
        SELECT abbr_key, min(abbr_no) AS first_at, arg_max(expansion, abbr_no) AS expansion, arg_max(confidence, abbr_no) AS confidence, arg_max(source, abbr_no) AS source, arg_max(file_path, abbr_no) AS file_path FROM t GROUP BY 1""",
    "abbr_frequency": """
        WITH u AS (SELECT abbr_key, expansion, count(DISTINCT decision_no) AS uses FROM user_decisions WHERE expansion IS NOT NULL GROUP BY ALL),
        m AS (SELECT abbr_key, expansion AS most_used FROM u QUALIFY row_number() OVER (PARTITION BY abbr_key ORDER BY uses DESC, expansion) = 1)
        SELECT normalized_form, count(*) AS n, any_value(most_used) AS most_used FROM abbr_records LEFT JOIN m ON abbr_key = normalized_form WHERE normalized_form IS NOT NULL GROUP BY 1""",
}
