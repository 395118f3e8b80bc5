"""Writing expansions back into TEI documents."""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.tei import QUE
from vellum.operators.xmltree import Node, indented, parse, serialize


class Patcher:
    """Expansions for one document. ``legacy_tail`` puts an expansion after the text that follows the abbreviation, where it used to land."""

    def __init__(self, path: str, use_choice: bool = False, add_ids: bool = True, legacy_tail: bool = False):
        self.path, self.use_choice, self.add_ids, self.legacy_tail = path, use_choice, add_ids, legacy_tail

    def expand(self, node: Node | None, expansion: str) -> bool:
        """Put the expansion where the element's kind and surroundings want it; False where that can't be."""
        if node is None or node.parent is None or node.local not in ("abbr", "g", "am"):
            return False
        {"abbr": self._abbr, "g": self._g, "am": self._am}[node.local](node, expansion)
        return True

    def _new(self, like: Node, name: str, text: str = "", **attributes: str) -> Node:
        prefix, colon, _ = like.name.rpartition(":")
        return Node(f"{prefix}{colon}{name}", like.space, attributes, text=text)

    def _expan(self, node: Node, text: str = "") -> Node:
        made = self._new(node, "expan", text)
        own = node.attributes.get("xml:id") or node.attributes.get("id")
        if own and self.add_ids:
            made.attributes["corresp"] = f"#{own}"
        if self.add_ids:
            made.attributes["xml:id"] = "expan_" + hashlib.md5(f"{self.path}#{node.order}".encode()).hexdigest()[:8]
        return made

    def _beside(self, node: Node, made: Node) -> None:
        """As the next sibling: what follows the element follows the new one."""
        if not self.legacy_tail:
            made.tail, node.tail = node.tail, ""
        node.parent.put(node.place() + 1, made)

    def _wrap(self, node: Node, made: Node) -> None:
        """Both in a ``choice`` in the element's place."""
        choice = self._new(node, "choice")
        if not self.legacy_tail:
            choice.tail, node.tail = node.tail, ""
        parent, at = node.parent, node.place()
        parent.children.pop(at)
        parent.put(at, choice)
        choice.put(0, node)
        choice.put(1, made)

    def _in_choice(self, choice: Node, made: Node) -> None:
        """As the choice's expansion, in place of the first one there."""
        old = next((c for c in choice.elements if c.local == "expan"), None)
        if old is None:
            choice.put(len(choice.children), made)
        else:
            made.tail = old.tail
            at = old.place()
            choice.children.pop(at)
            choice.put(at, made)

    def _abbr(self, node: Node, expansion: str) -> None:
        if node.parent.local == "choice":
            old = next((c for c in node.parent.elements if c.local == "expan"), None)
            if old is not None:
                old.text = expansion
            else:
                node.parent.put(len(node.parent.children), self._expan(node, expansion))
        elif self.use_choice:
            self._wrap(node, self._expan(node, expansion))
        else:
            self._beside(node, self._expan(node, expansion))

    def _spelled(self, node: Node, mark: Node, expansion: str) -> Node:
        """An expansion that shows the mark in ``am`` and the added letters in ``ex``."""
        made = self._expan(node)
        made.put(0, mark)
        made.put(1, self._new(node, "ex", expansion))
        return made

    def _que(self, node: Node) -> Node:
        am = self._new(node, "am")
        am.put(0, self._new(node, "g", ref=QUE))
        return am

    def _g(self, node: Node, expansion: str) -> None:
        if node.attributes.get("ref") != QUE:
            self._beside(node, self._expan(node, expansion))
            return
        am = node.parent
        if am.local != "am":
            parent, at = node.parent, node.place()
            made = self._spelled(node, self._que(node), expansion)
            made.attributes = {}
            choice, abbr, outer = self._new(node, "choice"), self._new(node, "abbr"), self._new(node, "am")
            choice.tail, node.tail = node.tail, ""
            parent.children.pop(at)
            parent.put(at, choice)
            choice.put(0, abbr)
            choice.put(1, made)
            abbr.put(0, outer)
            outer.put(0, node)
        elif am.parent is not None and am.parent.local == "abbr":
            self._around_abbr(am.parent, self._spelled(node, self._que(node), expansion))
        elif am.parent is not None:
            am.parent.put(len(am.parent.children), self._expan(node, expansion))

    def _am(self, node: Node, expansion: str) -> None:
        if node.parent.local == "abbr":
            mark = copy.deepcopy(_detached(node))
            self._around_abbr(node.parent, self._spelled(node, mark, expansion))
        else:
            self._beside(node, self._expan(node, expansion))

    def _around_abbr(self, abbr: Node, made: Node) -> None:
        made.attributes = {}
        if abbr.parent is not None and abbr.parent.local == "choice":
            self._in_choice(abbr.parent, made)
        elif abbr.parent is not None:
            self._wrap(abbr, made)


def _detached(node: Node) -> Node:
    """A shallow stand-in without parent and tail, so that copying it copies nothing above."""
    return Node(node.name, node.space, dict(node.attributes), None, node.line, node.order, node.kind, node.text, "", [_with_tail(c) for c in node.children])


def _with_tail(node: Node) -> Node:
    made = _detached(node)
    made.tail = node.tail
    return made


def patch(path: str, xml: str, expansions: list[tuple[int, str]], use_choice: bool = False, add_ids: bool = True, legacy_tail: bool = False, pretty: bool = False, drop_blanks: bool = True) -> tuple[str, int]:
    """The document with expansions put in, and how many could be. ``expansions``: element's number in document order, and text.

    Elements are found before anything is changed, then changed in the order given.
    """
    root = parse(xml, drop_blanks)
    nodes = {n.order: n for n in root.walk()}
    patcher = Patcher(path, use_choice, add_ids, legacy_tail)
    done = sum(patcher.expand(nodes.get(at), text) for at, text in expansions)
    return (indented(root) if pretty else serialize(root)), done


def patch_documents(documents: DataFrame, expansions: DataFrame, **options: bool) -> DataFrame:
    """``file_path``, ``xml``, ``expanded``, ``error`` of documents (``file_path``, ``xml``) with their ``expansions``.

    ``expansions``: ``file_path``, ``kind_ord``, ``node_ord``, ``expansion``; applied in that order, once for each element. A
    document without any comes out as it went in, as does one that can't be parsed, with its error. What is gathered for a document is
    bounded by the document itself, for an element is expanded once.
    """
    once = expansions.groupBy("file_path", "kind_ord", "node_ord").agg(F.min("expansion").alias("expansion"))
    listed = once.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("kind_ord", "node_ord", "expansion"))).alias("todo"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, xml, todo in zip(pdf["file_path"], pdf["xml"], pdf["todo"], strict=True):
                pairs = [] if todo is None else [(int(t["node_ord"]), t["expansion"]) for t in todo if t["expansion"] is not None]
                row = (path, xml, 0, None)
                if pairs:
                    try:
                        row = (path, *patch(path, xml, pairs, **options), None)
                    except (expat.ExpatError, TypeError, ValueError, RecursionError) as e:
                        row = (path, xml, 0, str(e)[:200])
                rows.append(row)
            yield pd.DataFrame(rows, columns=["file_path", "xml", "expanded", "error"])

    joined = documents.select("file_path", "xml").join(listed, "file_path", "left")
    return joined.mapInPandas(run, "file_path string, xml string, expanded int, error string")
