"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

All visible text comes out once, in document order: blocks are set apart by line ends and blank lines, lists have
markers and indents, table cells are aligned in columns, preformatted text keeps its white space. The scanner and the
builder take any bytes for HTML; work and memory are linear in the page, whatever its nesting.

Of style sheets the rules count whose selectors are compounds of a tag, classes and an id, and whose media are not for
print or speech alone; scripts do not run. Elements nested deeper than DEEPEST become siblings, lists and quotes deeper
than INDENTS are not indented further, and lines of cells with others behind them are wrapped at WIDEST characters.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import slices

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("script style head title template noscript iframe noembed noframes datalist audio video canvas rp desc metadata defs annotation annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
BLOCK = MARGIN | frozenset("address article aside body caption dd details dialog div dt figcaption footer form header hgroup html legend li main nav search section summary tr thead tbody tfoot td th center".split())
#: A start tag closes an open element of these kinds, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["colgroup"] = CLOSES["caption"] = CLOSES["thead"]
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
ENDS_P = (BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}) | {"table"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: For the rest of a page from a tag with a quote that has no end: tags end at the next ">".
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
_NONE, _UNSEEN, _SEEN = (re.compile(p, re.IGNORECASE) for p in (r"display\s*:\s*none", r"visibility\s*:\s*(?:hidden|collapse)", r"visibility\s*:\s*visible"))
_GAPS = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 512  # deeper elements are siblings of their contents, as in browsers
INDENTS = 32
WIDEST = 80  # characters; a longer word does not widen its column
_INTERESTING = frozenset("class id style hidden start colspan rowspan type value open selected multiple".split())
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_PRINT, _SCREEN = (re.compile(p, re.IGNORECASE) for p in (r"\b(?:print|speech)\b", r"\b(?:screen|all)\b|\bnot\s+(?:print|speech)\b"))
# Inputs whose value is not shown, and the labels of those without one.
SILENT = frozenset("hidden checkbox radio password file image range color".split())
LABELS = {"submit": "Submit", "reset": "Reset"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in _INTERESTING and name not in out:
            out[name] = html.unescape(value[1:-1] if value[:1] in "\"'" and value else value)
    return out


class Builder:
    """Start tags, end tags and texts to a tree."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.rules: list[str] = []

    def _close(self, kinds, stop) -> None:
        """Close the open elements of ``kinds`` above the nearest of ``stop``, with all that stands in them."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in stop:
                return
            if tag in kinds:
                del self.stack[k:]

    def start(self, tag: str, attrs: str, closed: bool) -> None:
        if tag == "html" and len(self.stack) > 1:
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ENDS_P:
            self._close({"p"}, SCOPE | {"button"})
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        if self.stack[-1].tag == "head" and tag in BLOCK:
            self.stack.pop()
        self._push(tag, _attributes(attrs) if attrs and not attrs.isspace() else {}, tag in VOID or (closed and tag not in BLOCK))

    def _push(self, tag: str, attrs: dict[str, str], empty: bool = False) -> None:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if not empty and len(self.stack) < DEEPEST:
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "", True)
        elif tag not in ("html", "body"):
            reach = SCOPE - {tag} if tag in SCOPE else SCOPE
            if tag in ("tr", "thead", "tbody", "tfoot", "table"):
                reach = {"table", "template"} - {tag}
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    del self.stack[k:]
                    break
                if self.stack[k].tag in reach:
                    k = 0
                    break
            else:
                k = 0
            if tag == "p" and not k:  # an end without a start makes an empty paragraph
                self._push("p", {}, True)

    def text(self, data: str) -> None:
        if self.stack[-1].tag == "head" and not data.isspace():
            self.stack.pop()
        self.stack[-1].children.append(data)


def parse(source: str) -> Builder:
    """The tree of a page. Comments and declarations vanish; a tag that never ends takes the rest of the page."""
    b, at, n, last, tags = Builder(), 0, len(source), source.rfind(">"), _TAG
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            b.text(html.unescape(source[at:mark]))
        if mark == n:
            break
        two = source[mark + 1 : mark + 2]
        if two == "!" or two == "?":
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 4)
                at = n if end < 0 else end + 3
            elif source.startswith("<![CDATA[", mark):
                end = source.find("]]>", mark + 9)
                b.text(source[mark + 9 : n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", mark)
                at = n if end < 0 else end + 1
            continue
        named = two.isascii() and two.isalpha() or (two == "/" and source[mark + 2 : mark + 3].isalpha() and source[mark + 2 : mark + 3].isascii())
        if not named:
            if two == "/" and mark < last:  # a bogus comment
                at = source.find(">", mark) + 1
            else:
                b.text("<")
                at = mark + 1
            continue
        m = tags.match(source, mark) if mark < last else None
        if m is None and mark < last and tags is _TAG:
            tags = _BROKEN
            m = tags.match(source, mark)
        if m is None:
            break
        slash, tag, attrs = m.groups()
        tag, at = tag.lower(), m.end()
        if slash:
            b.end(tag)
            continue
        b.start(tag, attrs, attrs.endswith("/"))
        if tag in RAW:
            close = _END[tag].search(source, at)
            inner = source[at : n if close is None else close.start()]
            if tag == "style":
                b.rules.append(inner)
            elif tag in ("textarea", "xmp"):
                b.text(html.unescape(inner) if tag == "textarea" else inner)
            at = n if close is None else close.start()
            if close is None:
                break
        elif tag == "plaintext":
            b.text(source[at:])
            break
    return b


#: A compound selector: tag (or none), id (or none), classes.
Rules = dict[str, list[tuple[str, str, frozenset[str]]]]


def _media(head: str) -> bool:
    """Whether what an at-rule holds applies to a screen."""
    return not head.lower().startswith(("@media", "@font-face", "@keyframes", "@page")) or (
        head.lower().startswith("@media") and (not _PRINT.search(head) or bool(_SCREEN.search(head)))
    )


def hidden_selectors(rules: list[str]) -> tuple[Rules, Rules]:
    """(display none, visibility hidden): the compound selectors that style sheets hide, by one of their parts."""
    none: Rules = {}
    unseen: Rules = {}
    for sheet in rules:
        heads, names, text = [], "", ""  # heads: of the open blocks, whether they apply
        for part in re.split(r"([{}])", re.sub(r"/\*.*?(?:\*/|$)", " ", sheet, flags=re.DOTALL)):
            if part == "{":
                head = text.rpartition(";")[2].strip()
                names = "" if head.startswith("@") else head
                heads.append(_media(head) if head.startswith("@") else True)
            elif part == "}":
                if names and all(heads):
                    for kind, found in ((_NONE, none), (_UNSEEN, unseen)):
                        if kind.search(text):
                            _add(found, names)
                names = ""
                if heads:
                    heads.pop()
            else:
                text = part
    return none, unseen


def _add(found: Rules, names: str) -> None:
    for name in names.split(","):
        m = _COMPOUND.fullmatch(name.strip())
        if not m or not name.strip():
            continue
        tag, rest = (m[1] or "").lower().replace("*", ""), re.findall(r"[.#][\w-]+", m[2])
        ids, classes = [x[1:] for x in rest if x[0] == "#"], frozenset(x[1:] for x in rest if x[0] == ".")
        if len(ids) < 2 and (rest or tag):
            found.setdefault(rest[0] if rest else tag, []).append((tag, ids[0] if ids else "", classes))


def _matches(rules: Rules, tag: str, attrs: dict[str, str]) -> bool:
    if not rules:
        return False
    classes = attrs["class"].split() if "class" in attrs else ()
    own = attrs.get("id", "")
    for key in (tag, f"#{own}", *(f".{c}" for c in classes)):
        for t, i, c in rules.get(key, ()):
            if (not t or t == tag) and (not i or i == own) and c.issubset(classes):
                return True
    return False


class Layout:
    """Lines of text: ``margin`` blank lines and breaks are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.due = 0  # 1: a line end, 2: a blank line
        self.space = False
        self.prefix: list[str] = []
        self.marker = ""

    def gap(self, size: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.due, self.space = max(self.due, size), False

    def brk(self) -> None:
        if self.line:
            self.gap(1)
        elif self.lines and self.due < 2:
            self.due += 1

    def _open(self) -> None:
        if not self.line:
            if self.due == 2 and self.lines:
                self.lines.append("")
            self.due = 0
            indent = "".join(self.prefix)
            if self.marker:
                indent, self.marker = indent[: -len(self.marker)] + self.marker if len(indent) >= len(self.marker) else self.marker, ""
            self.line.append(indent)

    def flow(self, text: str) -> None:
        words = _GAPS.sub(" ", text)
        if words[:1] == " ":
            self.space = self.space or bool(self.line)
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        words = words[:-1] if tail else words
        if words:
            self._open()
            self.line.append(" " + words if self.space else words)
        self.space = tail

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                if not self.line:
                    self._open()
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if part:
                self._open()
                self.line.append(part)
                self.space = False

    def done(self) -> str:
        self.gap(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _wrapped(line: str) -> list[str]:
    """A line as lines of at most WIDEST characters, cut between words."""
    if len(line) <= WIDEST:
        return [line]
    out, own = [], ""
    for word in line.split():
        if own and len(own) + 1 + len(word) > WIDEST:
            out.append(own)
            own = word
        else:
            own = f"{own} {word}" if own else word
    return [*out, own]


class _Table:
    """Rows of cells: (lines, columns, rows) each."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def add(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append(([x for x in text.split("\n") if x.strip()], columns, rows))

    def _placed(self) -> list[list[tuple[int, list[str], int]]]:
        """(column, lines, columns) of each row's cells; columns that a cell of an earlier row still fills are passed over."""
        out, filled = [], {}
        for k, cells in enumerate(self.rows):
            own, at = [], 0
            for lines, columns, rows in cells:
                while filled.get(at, 0) > k:
                    at += 1
                own.append((at, lines, columns))
                if rows > 1:
                    filled.update(dict.fromkeys(range(at, at + min(columns, 32)), k + rows))
                at += columns
            out.append(own)
        return out

    def text(self) -> str:
        placed, width = self._placed(), {}
        rows = []
        for own in placed:
            full = [(c, x, n) for c, x, n in own if x]
            full = [(c, [y for z in x for y in _wrapped(z)] if k < len(full) - 1 else x, n) for k, (c, x, n) in enumerate(full)]
            rows.append(full)
            for c, x, n in full:
                if n == 1:
                    width[c] = max(width.get(c, 0), *(len(y) if len(y) <= WIDEST else 0 for y in x))
                else:
                    width.setdefault(c, 0)
        start, at = {}, 0
        for c in sorted(width):
            start[c] = at
            at += width[c] + 2
        lines = []
        for full in rows:
            for k in range(max((len(x) for _, x, _ in full), default=0)):
                line = ""
                for c, x, _ in full:
                    if k < len(x):
                        line = line.ljust(start[c]) if len(line) < start[c] or not line else line + "  "
                        line += x[k]
                lines.append(line.rstrip())
        return "\n".join(lines)


def _number(text: str | None, default: int, least: int, most: int) -> int:
    digits = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return min(most, max(least, int(digits[1]))) if digits else default


def _shown_children(item: Node) -> list:
    """The children that a browser shows: of closed details the summary, of a list of options the selected ones or, where
    one is to be chosen and none is, the first."""
    if item.tag == "details" and "open" not in item.attrs:
        return [c for c in item.children if c.__class__ is Node and c.tag == "summary"][:1]
    if item.tag != "select":
        return item.children
    options, stack = [], [item]
    while stack:
        node = stack.pop()
        if node.tag == "option":
            options.append(node)
        elif node is item or node.tag == "optgroup":
            stack.extend(c for c in reversed(node.children) if c.__class__ is Node)
    chosen = [o for o in options if "selected" in o.attrs]
    if "multiple" in item.attrs:
        chosen = options  # a list box shows all
    elif not chosen:
        chosen = options[:1]
    return [x for o in chosen for x in (o, " ")]


def render(source: str | None) -> str:
    """The visible text of a page; null is empty."""
    if not source:
        return ""
    built = parse(source)
    none, unseen = hidden_selectors(built.rules)
    out = Layout()
    layouts, tables, lists = [out], [], []
    # entries: a text, a node to enter, or a node to leave; shown and pre as they stand there
    stack: list[tuple] = [(built.root, False, True, False)]
    while stack:
        item, leaving, shown, pre = stack.pop()
        out = layouts[-1]
        if item.__class__ is str:
            if shown:
                out.verbatim(item) if pre else out.flow(item)
            continue
        tag = item.tag
        if leaving:
            if tag in ("td", "th") and tables:
                layouts.pop()
                tables[-1].add(out.done(), _number(item.attrs.get("colspan"), 1, 1, 1000), _number(item.attrs.get("rowspan"), 1, 1, 65_534))
            elif tag == "table":
                done = tables.pop()
                out = layouts[-1]
                out.gap(2)
                if text := done.text():
                    out.verbatim(text)
                out.gap(2)
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
                out.gap(1 if lists else 2)
            elif tag == "li":
                if out.marker:  # an item without text
                    out._open()
                out.gap(1)
                out.prefix.pop()
            elif tag == "blockquote" or tag == "dd":
                out.gap(2 if tag == "blockquote" else 1)
                out.prefix.pop()
            elif tag in BLOCK:
                out.gap(2 if tag in MARGIN else 1)
            continue
        a = item.attrs
        if tag in HIDDEN or "hidden" in a or _matches(none, tag, a):
            continue
        style = a.get("style", "")
        if style and _NONE.search(style):
            continue
        if _matches(unseen, tag, a) or (style and _UNSEEN.search(style)):
            shown = False
        if style and _SEEN.search(style):
            shown = True
        if tag == "input":
            kind = a.get("type", "text").strip().lower()
            label = "" if kind in SILENT else a.get("value") or LABELS.get(kind, "")
            if shown and label:
                out.flow(f" {label} ")
            continue
        if tag == "br":
            if shown:
                out.brk()
            continue
        if tag == "wbr" or tag in VOID and tag != "hr":
            continue
        stack.append((item, True, shown, pre))
        pre = pre or tag in ("pre", "textarea", "xmp", "plaintext", "listing")
        if tag in ("td", "th") and tables:
            layouts.append(Layout())
        elif tag == "table":
            out.gap(2)
            tables.append(_Table())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("ul", "ol", "menu"):
            out.gap(1 if lists else 2)
            lists.append([tag, _number(a.get("start"), 1, -(10**9), 10**9)])
        elif tag == "li":
            out.gap(1)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.prefix.append(" " * len(mark) if len(out.prefix) < INDENTS else "")
            out.marker = mark
        elif tag == "blockquote" or tag == "dd":
            out.gap(2 if tag == "blockquote" else 1)
            out.prefix.append("  " if len(out.prefix) < INDENTS else "")
        elif tag in BLOCK:
            out.gap(2 if tag in MARGIN else 1)
        elif tag == "select" and shown:
            out.flow(" ")
        stack.extend((c, False, shown, pre) for c in reversed(_shown_children(item)))
    return layouts[0].done()


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` as ``text_col`` (a column of that name is replaced); null and empty
    pages give an empty text. One row per row, whatever the other columns hold or are called; the page itself is left out of
    the result; an empty table gives an empty result."""
    rest = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            texts, lo, size = [], 0, 0
            for k, page in enumerate(b.column(b.num_columns - 1)):
                texts.append(render(page.as_py()))
                size += len(texts[-1])
                if size > 4e6 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in b.columns[:-1]), pa.array(texts, pa.string())], [*rest, text_col])
                    texts, lo, size = [], k + 1, 0

    rows = pages.select(*rest, F.col(html_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(text_col, T.StringType())]))
