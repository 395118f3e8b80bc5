"""A small XML tree that keeps what a patch must give back: prefixes, comments, instructions and line numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

TEI = "http://www.tei-c.org/ns/1.0"
XML = "http://www.w3.org/XML/1998/namespace"


@dataclass(eq=False, slots=True)
class Node:
    """An element, or with ``kind`` other than ``element`` a comment or instruction, whose content is ``text``.

    ``name`` is as written, ``space`` the namespace it stands for. ``order`` numbers elements in document order as parsed.
    """

    name: str
    space: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    line: int | None = None
    order: int = -1
    kind: str = "element"
    text: str = ""
    tail: str = ""
    children: list[Node] = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def content(self) -> str:
        """All text within, outer blanks taken off."""
        found, todo = [], [(self, False)]
        while todo:
            node, after = todo.pop()
            if after:
                found.append(node.tail)
                continue
            if node.kind == "element":
                found.append(node.text)
                for child in reversed(node.children):
                    todo += [(child, True), (child, False)]
        return "".join(found).strip()

    def path(self) -> str:
        """Steps of local names, each with its place among siblings of that name."""
        steps = []
        node: Node | None = self
        while node is not None:
            same = [c for c in node.parent.elements if c.local == node.local] if node.parent else [node]
            steps.append(f"{node.local}[{next(i for i, c in enumerate(same, 1) if c is node)}]")
            node = node.parent
        return "/" + "/".join(reversed(steps))

    def place(self) -> int:
        """Index among the parent's children."""
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def put(self, index: int, node: Node) -> None:
        node.parent = self
        self.children.insert(index, node)


def parse(xml: str | bytes, drop_blanks: bool = True) -> Node:
    """The tree of a document; raises ``expat.ExpatError`` for what isn't well-formed.

    With ``drop_blanks`` text of blanks only is dropped between elements, except within an element whose content
    begins with other text.
    """
    parser = expat.ParserCreate()
    parser.buffer_text = True
    root: list[Node] = []
    stack: list[Node] = []
    spaces: list[dict[str, str]] = [{"": "", "xml": XML}]
    numbered = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal numbered
        declared = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        spaces.append(spaces[-1] | declared if declared else spaces[-1])
        node = Node(name, spaces[-1].get(name.rpartition(":")[0], ""), attributes, stack[-1] if stack else None, parser.CurrentLineNumber, numbered)
        numbered += 1
        (stack[-1].children if stack else root).append(node)
        stack.append(node)

    def end(_: str) -> None:
        stack.pop()
        spaces.pop()

    def text(data: str) -> None:
        if stack[-1].children:
            stack[-1].children[-1].tail += data
        else:
            stack[-1].text += data

    def other(kind: str, name: str, data: str) -> None:
        if stack:
            stack[-1].children.append(Node(name, parent=stack[-1], kind=kind, text=data))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = lambda data: other("comment", "", data)
    parser.ProcessingInstructionHandler = lambda name, data: other("instruction", name, data)
    parser.Parse(xml, True)
    if drop_blanks:
        for node in root[0].walk():
            if node.children and not node.text.strip():
                node.text = ""
                for child in node.children:
                    if not child.tail.strip():
                        child.tail = ""
    return root[0]


def serialize(root: Node, declaration: bool = False) -> str:
    """The document as text. Prefixes, attributes, comments and instructions come out as they came in."""
    found = ['<?xml version="1.0" encoding="UTF-8"?>\n'] if declaration else []
    todo: list[Node | str] = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            found.append(node)
        elif node.kind == "comment":
            found.append(f"<!--{node.text}-->")
        elif node.kind == "instruction":
            found.append(f"<?{node.name} {node.text}?>")
        else:
            attributes = "".join(f" {k}={quoteattr(v)}" for k, v in node.attributes.items())
            if not node.children and not node.text:
                found.append(f"<{node.name}{attributes}/>")
                continue
            found.append(f"<{node.name}{attributes}>{escape(node.text)}")
            todo.append(f"</{node.name}>")
            for child in reversed(node.children):
                todo += [escape(child.tail), child]
    return "".join(found)


def indented(root: Node, step: str = "  ") -> str:
    """The document with each element on a line of its own wherever no text stands between."""
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.kind == "element" and node.children and not node.text.strip() and not any(c.tail.strip() for c in node.children):
            node.text = "\n" + step * (depth + 1)
            for child in node.children:
                child.tail = "\n" + step * (depth + 1)
            node.children[-1].tail = "\n" + step * depth
            todo.extend((c, depth + 1) for c in node.children)
    return serialize(root, declaration=True) + "\n"
