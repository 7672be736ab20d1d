"""XML parts of documents as a bounded tree, without entities or document types."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from xml.parsers import expat

from docloom.functions.limits import TREE_DEPTH, TREE_NODES, ConversionError
from docloom.kernels.base import JS_SPACE

_DECLARATION, _ENCODING = re.compile(r"\A<\?xml[^>]*\?>"), re.compile(r"\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITY = re.compile(rf"<![{JS_SPACE}]*(?:DOCTYPE|ENTITY)\b", re.I | re.A)


class Element:
    """An element: local name, namespace, attributes by local name and (namespace, name), children that are elements or strings."""

    __slots__ = ("attributes", "children", "name", "namespace")

    def __init__(self, name: str, namespace: str, attributes: dict):
        self.name, self.namespace, self.attributes, self.children = name, namespace, attributes, []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def get(self, name: str, namespace: str = "") -> str | None:
        return self.attributes.get((namespace, name))

    def any_get(self, name: str) -> str | None:
        return next((v for (_, n), v in self.attributes.items() if n == name), None)

    def find_all(self, name: str) -> Iterator[Element]:
        """Descendants with this local name in any namespace, in document order."""
        stack = self.children[::-1]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                continue
            if e.name == name:
                yield e
            stack.extend(e.children[::-1])

    def visit(self, handlers: Mapping[str, Callable[[Element], None]]) -> None:
        """Hand each element below to the handler of its name, in document order; what an element with a handler holds is that one's affair."""
        waiting = self.elements()[::-1]
        while waiting:
            e = waiting.pop()
            if e.name in handlers:
                handlers[e.name](e)
            else:
                waiting.extend(e.elements()[::-1])

    def first(self, name: str) -> Element | None:
        return next(self.find_all(name), None)

    def child(self, name: str) -> Element | None:
        for c in self.children:
            if isinstance(c, Element) and c.name == name:
                return c
        return None

    def text(self) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(x.children[::-1])
        return "".join(out)


def reject_entities(source: str) -> None:
    if _ENTITY.search(source):
        raise ConversionError("UNSAFE_XML", "Document type and entity declarations are unsupported.")


def _split(name: str) -> tuple[str, str]:
    namespace, _, local = name.rpartition("\x01")
    return namespace, local


def parse_xml(source: str) -> Element:
    reject_entities(source)
    roots: list[Element] = []
    open_elements: list[Element] = []
    nodes = 0
    names: dict[str, tuple[str, str]] = {}  # a document has few, each many times

    def split(name: str) -> tuple[str, str]:
        if name not in names:
            names[name] = _split(name)
        return names[name]

    def add(node: Element | str) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > TREE_NODES or len(open_elements) > TREE_DEPTH:
            raise ConversionError("INVALID_XML", "Cannot parse document XML: XML exceeds the node or nesting limit.")
        (open_elements[-1].children if open_elements else roots).append(node)

    def start(name: str, attributes: dict) -> None:
        namespace, local = split(name)
        e = Element(local, namespace, {split(k): v for k, v in attributes.items()})
        add(e)
        open_elements.append(e)

    parser = expat.ParserCreate("utf-8", namespace_separator="\x01")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, lambda name: open_elements.pop()
    parser.CharacterDataHandler = lambda data: add(data) if open_elements else None
    try:
        # The text is decoded already; what its declaration says of an encoding no longer holds.
        parser.Parse(_DECLARATION.sub(lambda m: _ENCODING.sub("", m[0]), source).encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as error:
        raise ConversionError("INVALID_XML", f"Cannot parse document XML: {error}") from None
    if not roots:
        raise ConversionError("INVALID_XML", "Cannot parse document XML: Missing root element.")
    return roots[0]
