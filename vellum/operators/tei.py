"""Scanning TEI documents for abbreviations.

Each document is parsed once, in an Arrow batch of a Python worker; a document that can't be parsed
gives a row with its error and costs no other document. Normalisation that needs no tree is left to Columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import basic_normalize, normalize_abbreviation
from vellum.operators.xmltree import TEI, XML, Node, parse

STROKE, QUE = "char:cmbAbbrStroke", "char:abque"
META = ("title", "author", "date", "language", "source", "genre")
META_SCHEMA = "struct<" + ", ".join(f"{m}: string" for m in META) + ">"
_SCAN = f"file_path string, error string, valid_tei boolean, metadata {META_SCHEMA}, found array<struct<kind: string, kind_ord: int, node_ord: int, parent_tag: string, abbr_id: string, xpath: string, line_number: int, abbr_text: string, formed: string, word: string, context_before: string, context_after: string, words_before: string, words_after: string, already_expanded: boolean>>"


def metadata(root: Node) -> dict[str, str]:
    """Title, author, date, language, source and genre from the header; '' where there is none."""
    tei = [n for n in root.walk() if n.space == TEI]

    def within(node: Node, *names: str) -> bool:
        """Whether the parents are these, the nearest first."""
        for name in names:
            node = node.parent
            if node is None or node.local != name or node.space != TEI:
                return False
        return True

    def first(name: str, *above: str) -> Node | None:
        return next((n for n in tei if n.local == name and within(n, *above)), None)

    text = lambda n: n.content() if n is not None else ""
    date = first("date", "publicationStmt") or next((n for n in tei if n.local == "date" and any(a.local == "sourceDesc" for a in n.ancestors())), None)
    language = first("language", "langUsage", "profileDesc")
    terms = [n for n in tei if n.local == "term" and any(a.local == "textClass" and within(a, "profileDesc") for a in n.ancestors())]
    return {
        "title": text(first("title", "titleStmt")),
        "author": text(first("author", "titleStmt")),
        "date": "" if date is None else date.attributes.get("when", date.content()),
        "language": "" if language is None else language.attributes.get("ident", ""),
        "source": text(first("bibl", "sourceDesc")),
        "genre": ", ".join(filter(None, (t.content() for t in terms[:3]))),
    }


def scan(root: Node, with_g: bool = True) -> list[tuple[str, int, Node]]:
    """Abbreviation elements: all ``abbr``, then ``g`` of the two marks, then ``am``, the last two outside ``expan``; each kind in document order."""
    kinds: dict[str, list[Node]] = {"abbr": [], "g": [], "am": []}
    for node in root.walk():
        if node.space != TEI or node.local not in kinds:
            continue
        if node.local == "g" and (not with_g or node.attributes.get("ref") not in (STROKE, QUE)):
            continue
        if node.local == "abbr" or not any(a.local == "expan" and a.space == TEI for a in node.ancestors()):
            kinds[node.local].append(node)
    return [(kind, i, node) for i, (kind, nodes) in enumerate(kinds.items()) for node in nodes]


def _sibling(node: Node, step: int) -> Node | None:
    among = node.parent.elements
    at = next(i for i, c in enumerate(among) if c is node) + step
    return among[at] if 0 <= at < len(among) else None


def already_expanded(node: Node) -> bool:
    """Whether an expansion is there: beside it in a ``choice``, beside the ``abbr`` around an ``am`` in a ``choice``, or as the next element."""
    parent = node.parent
    if parent is None:
        return False
    if parent.local == "choice" and any(c is not node and c.local == "expan" for c in parent.elements):
        return True
    if node.local == "am" and parent.local == "abbr" and parent.parent is not None and parent.parent.local == "choice" and any(c.local == "expan" for c in parent.parent.elements):
        return True
    after = _sibling(node, 1)
    return after is not None and after.local == "expan"


def contexts(node: Node) -> tuple[str, str]:
    """Text after the sibling before, else the parent's first; and the text of the sibling after, else what follows the element."""
    before, after = _sibling(node, -1), _sibling(node, 1)
    left = before.tail if before is not None and before.tail else node.parent.text
    right = after.text if after is not None and after.text else node.tail
    return left.strip(), right.strip()


def _around(node: Node) -> tuple[str, str]:
    """The parent's text before and after the element, taken one level deep, without the element's own."""
    parts = ["", ""]
    parts[0] = node.parent.text
    at = 0
    for child in node.parent.children:
        if child is node:
            at = 1
            parts[1] += child.tail
        else:
            parts[at] += (child.text if child.kind == "element" else "") + child.tail
    return parts[0], parts[1]


def form_of_g(node: Node) -> tuple[str, str | None]:
    """The written form a ``g`` stands for, and the one word around it.

    A stroke gives the parent's text with ``$`` in its place, ``m$`` where nothing comes before; with no text at all
    around it, the first longer word within the parent with ``$`` after its first likely letter. The que mark gives the parent's first
    text and ``q$``. Any other mark is its own text.
    """
    if node.attributes.get("ref") == QUE:
        return node.parent.text.strip() + "q$", None
    if node.attributes.get("ref") != STROKE:
        return node.content(), None
    before, after = _around(node)
    left = before.split()[-1] if before[-1:].strip() else ""
    right = after.split()[0] if after[:1].strip() else ""
    word = f"{left}${right}" if left else None
    if before.strip():
        return f"{before.strip()}${after.strip()}", word
    if before or after:
        return f"m${after.strip()}", word
    for w in node.parent.content().split():
        for i in range(1, len(w) - 1):
            if w[i] in "aeioumn":
                return f"{w[: i + 1]}${w[i + 1 :]}", None
    return "m$", None


def word_contexts(node: Node, before: int = 5, after: int = 5) -> tuple[str, str]:
    """Up to so many words on either side, within the parent, or the nearest ancestor that has any text around the element."""
    for ancestor in node.ancestors():
        sides: list[list[str]] = [[], []]
        todo: list[tuple[Node, bool]] = [(ancestor, False)]
        at = 0
        while todo:
            n, tail = todo.pop()
            if tail:
                sides[at].append(n.tail)
            elif n is node:
                at = 1
            elif n.kind == "element":
                sides[at].append(n.text)
                for child in reversed(n.children):
                    todo += [(child, True), (child, False)]
        left, right = "".join(sides[0]).split(), "".join(sides[1]).split()
        if left or right or ancestor.parent is None:
            return " ".join(left[-before:]), " ".join(right[:after])
    return "", ""


def _record(kind: str, kind_ord: int, node: Node) -> dict | None:
    if node.parent is None or kind == "g" and not node.attributes.get("ref"):
        return None
    inner = next((n for n in node.walk() if n.local == "g"), None) if kind == "am" else node if kind == "g" else None
    formed, word = form_of_g(inner) if inner is not None else (None, None)
    before, after = contexts(node)
    words_before, words_after = word_contexts(node)
    return {
        "kind": kind, "kind_ord": kind_ord, "node_ord": node.order, "parent_tag": node.parent.local, "abbr_id": node.attributes.get("xml:id") or node.attributes.get("id"), "xpath": node.path(),
        "line_number": node.line, "abbr_text": node.content(), "formed": formed, "word": word, "context_before": before, "context_after": after, "words_before": words_before, "words_after": words_after,
        "already_expanded": already_expanded(node),
    }


def _scan_batches(batches: Iterator[pd.DataFrame], with_g: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, xml in zip(pdf["file_path"], pdf["xml"], strict=True):
            row = {"file_path": path, "error": None, "valid_tei": False, "metadata": dict.fromkeys(META, ""), "found": []}
            try:
                root = parse(xml)
                row |= {"valid_tei": root.space == TEI, "metadata": metadata(root), "found": [r for k in scan(root, with_g) if (r := _record(*k))]}
            except (expat.ExpatError, TypeError, ValueError, RecursionError) as e:
                row["error"] = str(e)[:200] or type(e).__name__
            rows.append(row)
        yield pd.DataFrame(rows, columns=["file_path", "error", "valid_tei", "metadata", "found"])


def scan_documents(documents: DataFrame, process_g: bool = True) -> DataFrame:
    """One row for each document (``file_path``, ``xml``): ``error``, ``valid_tei``, ``metadata``, and ``found``, its abbreviations.

    A null or unreadable document has an error and nothing found. Valid TEI is a root in its namespace.
    """
    return documents.select("file_path", "xml").mapInPandas(lambda it: _scan_batches(it, process_g), _SCAN)


def normalized_form(kind: Column, text: Column, formed: Column, on: bool = True, full_chain: bool = False) -> Column:
    """The written form: of a ``g``, or an ``am`` with one, what the tree gave; else the text with its marks replaced."""
    if not on:
        return F.when(kind == "g", F.coalesce(formed, text)).otherwise(text)
    return F.coalesce(formed, F.when(kind == "am", basic_normalize(text)).otherwise(normalize_abbreviation(text, full_chain)))


def abbreviations(scanned: DataFrame, include_expanded: bool = False, normalize: bool = True) -> DataFrame:
    """One row for each abbreviation of scanned documents; those already expanded only with ``include_expanded``.

    ``number`` and ``of`` count them within their document. ``normalized_word`` is the one word around a stroke, for looking it up
    instead of the whole ``normalized_form``.
    """
    wanted = F.col("found") if include_expanded else F.filter("found", lambda a: ~a["already_expanded"])
    rows = scanned.select("file_path", "metadata", F.size(wanted).alias("of"), F.posexplode(wanted).alias("at", "a")).select("file_path", (F.col("at") + 1).alias("number"), "of", "a.*", "metadata")
    form = normalized_form(F.col("kind"), F.col("abbr_text"), F.col("formed"), normalize)
    return rows.withColumn("normalized_form", form).withColumn("normalized_word", F.coalesce("word", form)).drop("formed", "word")


def statistics(scanned: DataFrame) -> DataFrame:
    """One row: documents parsed, abbreviations found and not yet expanded, those already expanded, ``abbr`` elements whose form differs from their text, and documents that couldn't be parsed."""
    text = lambda a: normalize_abbreviation(a["abbr_text"]) != a["abbr_text"]
    count = lambda test: F.coalesce(F.sum(F.size(F.filter("found", test))), F.lit(0)).cast("long")
    return scanned.agg(
        F.count_if(F.col("error").isNull()).alias("documents_processed"),
        count(lambda a: ~a["already_expanded"]).alias("abbreviations_found"),
        count(lambda a: a["already_expanded"]).alias("already_expanded"),
        count(lambda a: (a["kind"] == "abbr") & ~a["already_expanded"] & text(a)).alias("normalized_abbr"),
        F.count_if(F.col("error").isNotNull()).alias("malformed_abbr"),
    )


def older_form(parent_text: Column, ref: Column) -> Column:
    """The form an earlier rule gave a ``g``: last letter before it and ``$``, ``m$`` without one; ``q$`` for the que mark."""
    last = F.substring(F.regexp_replace(F.coalesce(parent_text, F.lit("")), r"[\s\p{Z}]+$", ""), -1, 1)
    return F.when(ref == QUE, "q$").when(last != "", F.concat(last, F.lit("$"))).otherwise("m$")


__all__ = ["QUE", "STROKE", "XML", "abbreviations", "scan_documents", "statistics"]
