"""HTML to Markdown: a tolerant tree, cleared of what is active or invisible, and a table of rendering rules."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

from docloom.functions.limits import TREE_DEPTH, TREE_NODES, ConversionError
from docloom.kernels.base import JS_SPACE, Check, Context, Result, cell, decode_text, fenced, table, unchecked, unique

# --- fixed values: elements and attributes that are dropped ---------------------------------------------------------------
DROPPED = set("head script style iframe object embed template noscript meta link svg canvas input button select textarea".split())
# --- end of fixed values ----------------------------------------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that mean something though blank.
KEPT_BLANK = set("a table thead tbody tfoot th td iframe script audio video".split())
#: What an opening tag closes, up to the nearest of the containers named.
CLOSES_P = set("address article aside blockquote center dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
MERGED = "Merged table cells are flattened; spanning cells are not duplicated."
IMAGES = "Images are represented by alt text; embedded-image extraction and OCR are not supported."


class Node:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attributes, self.children, self.parent = name, attributes or {}, [], parent

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self):
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


#: Nodes after which the time is looked at.
CHECK_EVERY = 256


class _Builder(HTMLParser):
    def __init__(self, check: Check = unchecked) -> None:
        super().__init__(convert_charrefs=True)
        self.check = check
        self.root = self.at = Node("body")
        self.depth, self.nodes = 0, 1

    def _count(self, depth: int) -> None:
        self.nodes += 1
        if self.nodes % CHECK_EVERY == 0:
            self.check()
        if self.nodes > TREE_NODES or depth > TREE_DEPTH:
            raise ConversionError("HTML_LIMIT", "HTML exceeds the 100,000-node or 128-level nesting limit.")

    def _up_to(self, node: Node) -> None:
        """Close everything from the current element to node, both included."""
        while True:
            done = self.at is node
            self.at, self.depth = self.at.parent, self.depth - 1
            if done:
                return

    def _imply(self, closed: set[str], within: set[str]) -> None:
        outermost, node = None, self.at
        while node.parent is not None and node.name not in within:
            if node.name in closed:
                outermost = node
            node = node.parent
        if outermost is not None:
            self._up_to(outermost)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._imply({"p"}, {"td", "th", "table", "blockquote", "li", "div", "section", "article"})
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        self._count(self.depth + 1)
        node = Node(tag, {}, self.at)
        for name, value in attrs:
            node.attributes.setdefault(name, value or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        node = self.at
        while node is not None and node.parent is not None:
            if node.name == tag:
                self._up_to(node)
                return
            node = node.parent
        if tag == "p":
            self._count(self.depth + 1)
            self.at.children.append(Node("p", {}, self.at))

    def handle_data(self, data: str) -> None:
        children = self.at.children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            self._count(self.depth + 1)
            children.append(data)

    def handle_comment(self, data: str) -> None:
        self._count(self.depth + 1)


def safe_link(href: str) -> str:
    """The link without white space and control characters, or nothing for other schemes than http, https and mailto."""
    clean = re.sub(r"[\x00-\x20\x7f]", "", href)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", clean)
    if scheme and scheme[1].lower() not in ("http", "https", "mailto"):
        return ""
    try:
        if scheme and scheme[1].lower() != "mailto":
            parts = urlsplit(clean.replace("\\", "/"))
            parts.port  # noqa: B018  raises for a bad one
            # An address after http: without slashes is taken for a host all the same, so there must be something.
            if not clean[scheme.end() :].replace("\\", "/").strip("/"):
                return ""
        elif clean.startswith("//"):
            urlsplit(clean).port  # noqa: B018
    except ValueError:
        return ""
    return re.sub(r"[<>()\[\]\\]", lambda m: f"%{ord(m[0]):x}", clean)


def _clean(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in DROPPED]
        if "href" in node.attributes:
            href = safe_link(node.attributes["href"])
            if href:
                node.attributes["href"] = href
            else:
                del node.attributes["href"]
        stack.extend(c for c in node.children if isinstance(c, Node))


_SPACES = re.compile("[ \t\r\n]+")


def _collapse(root: Node) -> None:
    """Runs of white space become one space, none at the edges of blocks; not within pre."""
    last: list | None = None  # the place of the last text: (children, index)
    keep_before = False

    def trim() -> None:
        if last is not None:
            children, i = last
            children[i] = children[i].removesuffix(" ")

    def visit(node: Node) -> None:
        nonlocal last, keep_before
        for i, child in enumerate(node.children):
            if isinstance(child, str):
                text = _SPACES.sub(" ", child)
                if (last is None or last[0][last[1]].endswith(" ")) and not keep_before and text.startswith(" "):
                    text = text[1:]
                node.children[i] = text
                if text:
                    last, keep_before = [node.children, i], False
            elif child.name == "pre":
                trim()
                last, keep_before = None, False
            elif child.name in BLOCK or child.name == "br":
                trim()
                last, keep_before = None, False
                visit(child)
                trim()
                last, keep_before = None, False
            elif child.name in VOID:
                last, keep_before = None, True
            else:
                visit(child)

    visit(root)
    trim()


_TEXT_ESCAPES = ((re.compile(r"\\"), r"\\\\"), (re.compile(r"\*"), r"\\*"), (re.compile(r"^-"), r"\\-"), (re.compile(r"^\+ "), r"\\+ "), (re.compile(r"^(=+)"), r"\\\1"), (re.compile(r"^(#{1,6}) "), r"\\\1 "), (re.compile("`"), r"\\`"), (re.compile(r"^~~~"), r"\\~~~"), (re.compile(r"\["), r"\\["), (re.compile(r"\]"), r"\\]"), (re.compile("^>"), r"\\>"), (re.compile("_"), r"\\_"), (re.compile(r"^(\d+)\. "), r"\1\\. "))
_EDGE = re.compile(rf"^([{JS_SPACE}]*)(.*?)([{JS_SPACE}]*)$", re.S)


class _Renderer:
    def __init__(self, check: Check = unchecked) -> None:
        self.warnings: list[str] = []
        self.check = check

    def blank(self, node: Node) -> bool:
        if node.name in VOID or node.name in KEPT_BLANK or node.text().strip(JS_SPACE):
            return False
        return not any(x.name in VOID or x.name in KEPT_BLANK for x in node.walk())

    def children(self, node: Node, code: bool = False) -> str:
        out = ""
        for child in node.children:
            if isinstance(child, str):
                piece = child
                if not code:
                    for pattern, to in _TEXT_ESCAPES:
                        piece = pattern.sub(to, piece)
            else:
                piece = self.element(child, code)
            left, right = out.rstrip("\n"), piece.lstrip("\n")
            breaks = min(2, max(len(out) - len(left), len(piece) - len(right)))
            out = left + "\n" * breaks + right
        return out

    def element(self, node: Node, code: bool) -> str:
        self.check()
        block = node.name in BLOCK
        if self.blank(node):
            return "\n\n" if block else self.flank(node, "")
        content = "" if node.name in ("pre", "table") else self.children(node, code or node.name == "code")
        rule = getattr(self, f"_{node.name}", None)
        if block:
            return rule(node, content) if rule else f"\n\n{content.strip(JS_SPACE) if node.name != 'li' else content}\n\n"
        if node.name in VOID:
            return rule(node, content) if rule else ""
        inner = content.strip(JS_SPACE) if rule else content
        return self.flank(node, rule(node, inner)) if rule else content

    def flank(self, node: Node, text: str) -> str:
        """Spaces at the inside edges of an inline element go outside, if nothing there has one already."""
        before, _, after = _EDGE.match(node.text()).groups()
        inside = node.text().strip(JS_SPACE)
        if not inside:
            before, after = before, ""
        return f"{'' if self._has_space(node, -1) else before}{text}{'' if self._has_space(node, 1) else after}"

    @staticmethod
    def _has_space(node: Node, side: int) -> bool:
        siblings = node.parent.children
        i = next(k for k, c in enumerate(siblings) if c is node) + side
        if not 0 <= i < len(siblings):
            return False
        other = siblings[i]
        if isinstance(other, str):
            return other.endswith(" ") if side < 0 else other.startswith(" ")
        return False

    def _heading(self, node: Node, content: str) -> str:
        return f"\n\n{'#' * int(node.name[1])} {content.strip(JS_SPACE)}\n\n"

    _h1 = _h2 = _h3 = _h4 = _h5 = _h6 = _heading

    def _br(self, node: Node, content: str) -> str:
        return "  \n"

    def _hr(self, node: Node, content: str) -> str:
        return "\n\n* * *\n\n"

    def _blockquote(self, node: Node, content: str) -> str:
        return "\n\n" + re.sub("^", "> ", content.strip("\n"), flags=re.M) + "\n\n"

    def _list(self, node: Node, content: str) -> str:
        parent = node.parent
        elements = [c for c in parent.children if isinstance(c, Node)]
        if parent.name == "li" and elements[-1] is node:
            return f"\n{content}"
        return f"\n\n{content}\n\n"

    _ul = _ol = _list

    def _li(self, node: Node, content: str) -> str:
        prefix = "-   "
        if node.parent.name == "ol":
            start = node.parent.attributes.get("start", "")
            items = [c for c in node.parent.children if isinstance(c, Node)]
            place = next(k for k, c in enumerate(items) if c is node)
            prefix = f"{(int(start) if re.fullmatch(r'-?\d+', start) else 1) + place}.  "
        paragraph = content.endswith("\n")
        content = content.strip("\n") + ("\n" if paragraph else "")
        content = content.replace("\n", "\n" + " " * len(prefix))
        last = node.parent.children[-1] is node
        return prefix + content + ("" if last or content.endswith("\n") else "\n")

    def _pre(self, node: Node, content: str) -> str:
        return f"\n\n{fenced(node.text().removesuffix(chr(10)))}\n"

    def _table(self, node: Node, content: str) -> str:
        rows = []
        for row in node.walk():
            if row.name in ("td", "th") and ("colspan" in row.attributes or "rowspan" in row.attributes):
                self.warnings.append(MERGED)
            if row.name == "tr":
                owner = row.parent
                while owner is not None and owner.name != "table":
                    owner = owner.parent
                if owner is node:
                    rows.append([c.text().strip(JS_SPACE) for c in row.children if isinstance(c, Node) and c.name in ("td", "th")])
        return f"\n\n{table(rows)}\n"

    def _img(self, node: Node, content: str) -> str:
        self.warnings.append(IMAGES)
        return f"[Image: {cell(node.attributes.get('alt') or 'Embedded image')}]"

    def _strong(self, node: Node, content: str) -> str:
        return f"**{content}**" if content.strip(JS_SPACE) else ""

    _b = _strong

    def _em(self, node: Node, content: str) -> str:
        return f"*{content}*" if content.strip(JS_SPACE) else ""

    _i = _em

    def _del(self, node: Node, content: str) -> str:
        return f"~~{content}~~"

    _s = _strike = _del

    def _code(self, node: Node, content: str) -> str:
        if not content:
            return ""
        content = re.sub(r"\r?\n|\r", " ", content)
        fence = "`"
        while fence in re.findall("`+", content):
            fence += "`"
        pad = " " if re.search(r"^`|^ .*?[^ ].* $|`$", content) else ""
        return f"{fence}{pad}{content}{pad}{fence}"

    def _a(self, node: Node, content: str) -> str:
        href = node.attributes.get("href")
        if not href:
            return content
        title = re.sub(r"(\n+\s*)+", "\n", node.attributes.get("title", "")).replace('"', '\\"')
        return f"[{content}]({href}" + (f' "{title}"' if title else "") + ")"


def html_to_markdown(html: str, check: Check = unchecked) -> Result:
    builder = _Builder(check)
    builder.feed(html)
    builder.close()
    _clean(builder.root)
    _collapse(builder.root)
    renderer = _Renderer(check)
    return Result(renderer.children(builder.root).strip(JS_SPACE) + "\n", unique(renderer.warnings))


def convert_html(data: bytes, context: Context) -> Result:
    return html_to_markdown(decode_text(data), context.check)
