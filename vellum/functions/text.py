"""Scalar functions on abbreviations and contexts, as Column expressions without any UDF."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take for blanks, and its word characters, as Java classes.
BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: The end of a text, or the place before its last line feed.
END = r"(?=\n?\z)"

# Printed markers and their written forms, in the order they are applied.
MACRONS = [("ā", "a$"), ("ē", "e$"), ("ī", "i$"), ("ō", "o$"), ("ū", "u$"), ("n̄", "n$"), ("m̄", "m$")]
TILDES = [("ã", "a$"), ("ẽ", "e$"), ("ĩ", "i$"), ("õ", "o$"), ("ũ", "u$"), ("ñ", "n$")]
RAISED = [("ᵃ", "a$"), ("ᵉ", "e$"), ("ⁱ", "i$"), ("ᵒ", "o$"), ("ᵘ", "u$"), ("ʳ", "r$"), ("ˢ", "s$"), ("ᵗ", "t$")]
SIGNS = [("ꝑ", "p$"), ("ꝓ", "p$"), ("ꝗ", "q$"), ("ꝙ", "q$"), ("ꝯ", "con$")]
MARKERS = [*MACRONS, *TILDES, *RAISED, *SIGNS]
# Endings that count as markers in replacement logs but stay as they are.
KEPT_ENDINGS = [(".mo", ".mo"), (".ma", ".ma"), (".mi", ".mi")]

# Confidence of a suggestion by its source.
CONFIDENCE = {"dictionary": 0.8, "pattern": 0.4, "wordnet": 0.6, "language_model": 0.8, "rule_based": 0.5, "custom": 1.0, "manual": 1.0}

# Answers given for these words while no language model can be reached.
OFFLINE_ANSWERS = {
    "co$cerning": ["concerning"],
    "lear$ed": ["learned"],
    "motiõ": ["motion"],
    "substa$tial": ["substantial"],
    "iudgme$t": ["judgment", "judgement"],
    "argume$ts": ["arguments"],
    "co$sider": ["consider"],
    "demo$strated": ["demonstrated"],
    "mai$tained": ["maintained"],
    "❧": ["pilcrow"],
    "Kingis": ["King's"],
    "Maieſteis": ["Majesty's"],
    "beiring": ["bearing"],
    "incu$ming": ["incoming"],
    "Inglis": ["English"],
    "heines": ["highness"],
    "thair": ["their"],
    "gude": ["good"],
    "Intreatment": ["treatment"],
    "freindly": ["friendly"],
    "vſage": ["usage"],
    "abbreviated$word": ["abbreviatedword"],
    "preſervatiou$": ["preservation"],
    "sta$ding": ["standing"],
    "gra$tit": ["granted"],
    "conditiou$": ["condition"],
    "obedie$ce": ["obedience"],
}

# Abbreviation patterns by language, each a regular expression and its replacements.
PATTERNS = {
    "latin": [(rf"({WORD}+)b;{END}", ["$1bus"]), (rf"({WORD}+)q;{END}", ["$1que"]), (rf"({WORD}+)p;{END}", ["$1pre"]), (r"^q\$", ["que"])],
    "english": [(rf"(?<!{WORD})Dr(?!{WORD})", ["Doctor"]), (rf"(?<!{WORD})Mr(?!{WORD})", ["Mister"]), (rf"(?<!{WORD})St(?!{WORD})", ["Saint"])],
}
_STROKE = r'<g ref="char:cmbAbbrStroke">[^<]+</g>'
_QUE = '<g ref="char:abque"/>'


def strip(text: Column) -> Column:
    """The text without outer blanks of any kind."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def words(text: Column) -> Column:
    """The words between blanks of any kind; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), lambda w: w != "")


def not_empty(text: Column) -> Column:
    """Null for ''."""
    return F.nullif(text, F.lit(""))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another, each seeing what the last one left."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def expand_period(text: Column) -> Column:
    """A stop before the last two small letters becomes ``$``: ``Ill.mo`` gives ``Ill$mo``."""
    return F.regexp_replace(text, rf"\.([a-z]{{2}}){END}", r"\$$1")


def normalize_abbreviation(text: Column, full_chain: bool = False) -> Column:
    """Printed abbreviation marks as ``$``.

    Stroke markup becomes ``$`` after the letter before it, and goes where no letter is before it; else que
    markup becomes ``q$``; else markers are replaced and the ending after a stop is joined. A text with markup gets
    no further step unless ``full_chain`` is set. Null gives null.
    """
    stroked = F.regexp_replace(F.regexp_replace(text, f"^(?:{_STROKE})+", ""), f"(?s)(.)(?:{_STROKE})+", r"$1\$")
    qued = lambda c: F.replace(c, F.lit(_QUE), F.lit("q$"))
    marked = lambda c: expand_period(replace_all(c, MARKERS))
    if full_chain:
        return marked(qued(stroked))
    return F.when(text.rlike(_STROKE), stroked).when(F.contains(text, F.lit(_QUE)), qued(text)).otherwise(marked(text))


def basic_normalize(text: Column) -> Column:
    """The shorter chain: macron after a plain letter, macron and tilde letters, the ending after a stop."""
    return expand_period(replace_all(F.regexp_replace(text, "([A-Za-z])̄", r"$1\$"), [*MACRONS, *TILDES]))


def denormalize_expansion(abbreviation: Column, expansion: Column) -> Column:
    """The expansion as it is."""
    return expansion


def pattern_expansions(text: Column, language: str = "latin", patterns: list[tuple[str, list[str]]] | None = None) -> Column:
    """Array of what the patterns of a language make of a text; a pattern counts only if it matches at the start.

    ``patterns`` stands in for the language's own. Other languages have none. Repeated results are given once.
    """
    made = []
    for regex, templates in PATTERNS.get(language.lower(), []) if patterns is None else patterns:
        for template in templates:
            made.append(F.when(text.rlike(f"\\A(?:{regex})"), F.regexp_replace(text, regex, template)))
    return F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast("array<string>")


def lookup_key(normalized: Column, abbreviation: Column, before: Column) -> Column:
    """What a suggestion is looked up by: the normalized form, else the abbreviation, else the last word before; null if all are empty."""
    last = F.try_element_at(words(before), F.lit(-1))
    return F.coalesce(not_empty(normalized), not_empty(abbreviation), last)


def placeholder(text: Column) -> Column:
    """``$`` as ``n``."""
    return F.replace(text, F.lit("$"), F.lit("n"))


def offline_expansions(key: Column) -> Column:
    """Array of answers while no language model can be reached: the fixed ones, else ``$`` as ``n``, else ``õ`` as ``on``, else the word itself."""
    fixed = F.create_map(*(x for k, v in OFFLINE_ANSWERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    guess = F.when(F.contains(key, F.lit("$")), placeholder(key)).when(F.contains(key, F.lit("õ")), F.replace(key, F.lit("õ"), F.lit("on"))).otherwise(key)
    known = F.when(key.isin(*OFFLINE_ANSWERS), F.try_element_at(fixed, key))
    return F.when(key.isNull() | (key == ""), F.array().cast("array<string>")).otherwise(F.coalesce(known, F.array(guess)))


def prompt(abbreviation: Column, before: Column, after: Column, metadata: Column | None = None, count: int = 3, fields: tuple[str, ...] = ("language", "title", "date", "source")) -> Column:
    """The request to a language model, with a line for each metadata field, even an empty one; null metadata has none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    about = F.lit("")
    if metadata is not None:
        lines = [x for f in fields for x in (F.lit(f"{f.capitalize()}: "), text(metadata.getField(f)), F.lit("\n"))]
        about = F.when(metadata.isNull(), "").otherwise(F.concat(*lines))
    # The wording of the request.
    head = f"Expand the following abbreviation into exactly {count} distinct single-word expansions. Separate each expansion by a comma only, with no extra text.\n\nAbbreviation: "
    return F.concat(F.lit(head), text(abbreviation), F.lit("\nContext before: "), text(before), F.lit("\nContext after: "), text(after), F.lit("\nAdditional information:\n"), about)


def parse_answer(answer: Column) -> Column:
    """The expansions in a language model's answer: between commas, without outer blanks, no empty ones."""
    return F.filter(F.transform(F.split(answer, ","), strip), lambda x: x != "")


def combined_context(before: Column, abbreviation: Column, after: Column) -> Column:
    """Both contexts around the abbreviation; empty ones keep their blank."""
    return F.concat(F.coalesce(before, F.lit("")), F.lit(" "), F.coalesce(abbreviation, F.lit("")), F.lit(" "), F.coalesce(after, F.lit("")))


def instruction(template: str, **fields: Column) -> Column:
    """A format template filled with columns. The template is read once, so braces in the data stay as they are."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def entry_id(abbreviation: Column, path: Column) -> Column:
    """An id for entries that have none, the same for the same abbreviation and path."""
    return F.concat(F.lit("abbr_"), F.md5(F.concat(F.coalesce(abbreviation, F.lit("")), F.coalesce(path, F.lit("")))))


def expansion_id(path: Column, node: Column) -> Column:
    """An id for an inserted expansion, the same for the same place."""
    return F.concat(F.lit("expan_"), F.substring(F.md5(F.concat_ws("#", path, node.cast("string"))), 1, 8))


def _marked_word(text: Column) -> Column:
    return F.filter(words(text), lambda w: F.contains(w, F.lit("$")) | F.contains(w, F.lit("õ")) | F.contains(w, F.lit("ā")))


def display_token(text: Column, shorten: bool = False) -> Column:
    """Of a text of more than two words the first with a marker, if any; with ``shorten``, else ``...`` and the last word."""
    long = F.size(words(text)) > 2
    marked = F.try_element_at(_marked_word(text), F.lit(1))
    rest = F.concat(F.lit("..."), F.try_element_at(words(text), F.lit(-1))) if shorten else text
    return F.when(long, F.coalesce(marked, rest)).otherwise(text)


def truncate(text: Column, most: int = 50) -> Column:
    """A text longer than ``most`` characters cut, with ``...``, to that length."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def last_words(text: Column, n: int = 5) -> Column:
    """The last ``n`` words, parted by one blank."""
    w = words(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def first_words(text: Column, n: int = 5) -> Column:
    """The first ``n`` words, parted by one blank."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def stamp_name(moment: Column, prefix: str) -> Column:
    """A name with a moment to the second."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(moment, "yyyyMMdd_HHmmss"))
