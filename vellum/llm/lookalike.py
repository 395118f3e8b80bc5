"""Text that looks the same but differs in its characters.

Method: confusables skeleton. A text is decomposed, every character is replaced by the prototype
of its look-alikes, and the result is decomposed again; two texts look the same exactly when their
skeletons are equal. Letter case, macron against tilde, long against round s, raised against
ordinary letters, and a mark against none stay apart.

The table is a rule, not a list: characters with a wide, narrow, font, small, no-break or ligature
decomposition take the parts of that decomposition; format characters, controls, fillers and
variation selectors vanish; every blank becomes a space. Only the letters that other alphabets share
with the Latin one in look are listed.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Letters and signs of other alphabets, then the Latin ones they look like. Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu, and others.
_ALIKE = [
    ("асԁеһіјӏорԛѕухѵԝү", "acdehijlopqsyxvwy"),
    ("АВСЕԌНІЈКМОРԚЅТХУѴԜҮ", "ABCEGHIJKMOPQSTXYVWY"),
    ("αινορυϲϳ", "aivopucj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("օսհցոյՕՍՏԼ", "ouhgnjOUSL"),
    ("ⲟⲣⲥⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "opcBHIKMNOPCTYX"),
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ᴄᴏᴜᴠᴡᴢꜱ", "couvwzs"),
    ("ɑɡªº", "agᵃᵒ"),
    ("‐‑‘’ʼ", "--'''"),
    ("̦̅͂", "̧̄̃"),
]
_LISTED = {ord(a): b for left, right in _ALIKE for a, b in zip(left, right, strict=True)}
# Characters without width that are no format characters.
_NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_ALIKE_TAGS = ("<wide>", "<narrow>", "<font>", "<small>", "<noBreak>")
_PARTS = "\ue000"
_KEPT_COMPAT = {0x017F, 0x1E9B, 0x00B5}


class _Prototypes(dict):
    """Prototype by code point, worked out on first use; ``str.translate`` reads it."""

    def __missing__(self, code: int) -> str:
        self[code] = found = self._prototype(code)
        return found

    def _prototype(self, code: int) -> str:
        if code in _LISTED:
            return _LISTED[code]
        ch = chr(code)
        if ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
            return " "
        if code in _NO_WIDTH or unicodedata.category(ch) in ("Cf", "Cc"):
            return ""
        tag, *parts = unicodedata.decomposition(ch).split() or [""]
        if code not in _KEPT_COMPAT and (tag in _ALIKE_TAGS or tag == "<compat>" and parts and parts[0] != "0020"):
            return "".join(self[int(p, 16)] for p in parts)
        return ch


_PROTOTYPES = _Prototypes()
_GREEK = re.compile("[α-ω]")
_FOREIGN = {ord(b): a for left, right in _ALIKE[2:3] for a, b in zip(left, right, strict=True) if a not in "ϲϳ"}


def _decomposed(text: str) -> str:
    """The text decomposed, its characters replaced by prototypes, decomposed again; blanks are kept where they are.

    Only characters that have another prototype are looked for, since most have none.
    """
    text = text if text.isascii() else unicodedata.normalize("NFD", text)
    moved = [ch for ch in set(text) if _PROTOTYPES[ord(ch)] != ch]
    if moved:
        text = re.sub("[" + "".join(map(re.escape, moved)) + "]", lambda found: _PROTOTYPES[ord(found[0])], text)
    return text if text.isascii() else unicodedata.normalize("NFD", text)


def skeleton(text: str | None) -> str | None:
    """The skeleton of one text, null for null. Runs of blanks count as one, outer ones not at all."""
    return None if text is None else " ".join(_decomposed(text).split())


def skeletons(texts: list[str]) -> list[str]:
    """The skeletons of many texts, by one pass over all their characters."""
    if not texts:
        return []
    if any(_PARTS in t for t in texts):  # the parting character itself occurs
        return [skeleton(t) for t in texts]
    return [" ".join(t.split()) for t in _decomposed(_PARTS.join(texts)).split(_PARTS)]


def reading(skel: str) -> str:
    """The term a skeleton stands for: lower case, composed, in Latin letters.

    A word that keeps a Greek letter without a Latin look-alike is Greek, so its other letters are
    written in Greek again.
    """
    low = skel.lower()
    if _GREEK.search(low):
        low = " ".join(w.translate(_FOREIGN) if _GREEK.search(w) else w for w in low.split(" "))
    return unicodedata.normalize("NFC", low)


def readings(texts: list[str]) -> list[str]:
    """The readings of the skeletons of many texts, by passes over all their characters; texts with Greek are read one by one."""
    found = skeletons(texts)
    if not found or any(_PARTS in s for s in found):
        return [reading(s) for s in found]
    read = unicodedata.normalize("NFC", _PARTS.join(found).lower()).split(_PARTS)
    return [reading(s) if _GREEK.search(r) else r for s, r in zip(found, read, strict=True)]


def _by_value(values: pd.Series, f) -> pd.Series:
    """``f`` over the list of distinct values that aren't null, spread back to their rows."""
    codes, distinct = pd.factorize(values)
    found = pd.Series([*f(list(distinct)), None], dtype=object)
    return found.take(codes).reset_index(drop=True)


@pandas_udf(StringType())
def _skeleton_udf(values: pd.Series) -> pd.Series:
    return _by_value(values, skeletons)


@pandas_udf(StringType())
def _key_udf(values: pd.Series) -> pd.Series:
    return _by_value(values, readings)


def skeleton_of(column: Column | str) -> Column:
    """Column of skeletons; null stays null, a blank text gives ''. Arrow batches, each distinct value worked once."""
    return _skeleton_udf(column)


def term_key(column: Column | str) -> Column:
    """Column of terms: skeleton, lower case, composed. Equal exactly for texts alike but for case."""
    return _key_udf(column)


def find_lookalikes(texts: DataFrame, forms: DataFrame, key: list[str], fields: list[str], max_forms: int = 200_000) -> DataFrame:
    """Values of ``fields`` that look like an accepted form but consist of other characters.

    Returns ``key`` columns, ``field``, ``form_id``, one row for each value and form. Null values give
    no row, as do blank ones, values equal to any form, and values that look like none. Repeated rows
    of ``texts`` repeat their result; repeated forms give a row for each ``form_id``. Further columns of
    either table are ignored, whatever their names.

    Each distinct value is turned into its skeleton once: rows are first reduced to those with
    characters outside plain ASCII or outer blanks, for other values look like a form only by being it.
    ``forms`` is a reference table; it is broadcast while its row count, read first, is at most
    ``max_forms``, and joined by shuffle beyond that.
    """
    accepted = forms.select(F.col("form_id"), F.col("form").alias("__form")).where(F.col("__form").isNotNull())
    small = accepted.limit(max_forms + 1).count() <= max_forms
    keyed = accepted.select("form_id", skeleton_of("__form").alias("__skel"))
    exact = accepted.select(F.col("__form").alias("__value")).distinct()
    long = texts.select(*key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("__value")) for f in fields))).alias("__x"))
    long = long.select(*key, "__x.field", "__x.__value").where(F.col("__value").isNotNull())
    plain = F.col("__value").rlike(r"^[\x21-\x7e]([\x20-\x7e]*[\x21-\x7e])?\z") & ~F.col("__value").contains("  ")
    ascii_forms = accepted.where(~F.col("__form").rlike(r"^[\x21-\x7e]([\x20-\x7e]*[\x21-\x7e])?\z") | F.col("__form").contains("  "))
    odd = long if _any_plain_alike(ascii_forms) else long.where(~plain)
    found = odd.join(F.broadcast(exact) if small else exact, "__value", "left_anti").withColumn("__skel", skeleton_of("__value"))
    return found.join(F.broadcast(keyed) if small else keyed, "__skel").where(F.col("__skel") != "").select(*key, "field", "form_id")


def _any_plain_alike(forms: DataFrame) -> bool:
    """Whether some form, itself no plain ASCII, has a plain ASCII skeleton, so that plain values may look like it."""
    return not forms.where(skeleton_of("__form").rlike(r"^[\x20-\x7e]*$")).isEmpty()


def groups_by_look(texts: DataFrame, fields: list[str], key: str) -> DataFrame:
    """One row for each spelling of a field that shares its skeleton with another of that field: ``field``, ``spelling``, ``n`` rows, ``first_key`` and ``n_spellings`` of its group.

    Null texts give no row. Spellings are counted before skeletons are formed, so a frequent value is
    one row, and a skeleton's group holds spellings, not texts.
    """
    long = texts.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("spelling")) for f in fields))).alias("x")).select("key", "x.*")
    spellings = long.where("spelling IS NOT NULL").groupBy("field", "spelling").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
    keyed = spellings.withColumn("skeleton", skeleton_of("spelling"))
    sizes = keyed.groupBy("field", "skeleton").agg(F.count("*").alias("n_spellings"))
    return keyed.join(sizes, ["field", "skeleton"]).where("n_spellings > 1").select("field", "spelling", "n", "first_key", "n_spellings")
