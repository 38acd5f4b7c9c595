"""HTML extraction by layout-aware rendering.

A tree builder reads the markup with the implied tags of HTML (``p``, ``li``, ``dt``/``dd``, ``option``, table parts,
``head``/``body``), visibility rules drop what a browser would not show, and a renderer emits the visible text: blocks on
lines of their own (paragraph-like ones with a blank line around), list markers with nesting, table cells padded
into columns, preformatted text as it is.

Scale: pages are independent; the job is one map without a shuffle, and pages stream through in Arrow batches.

Edge cases: null and empty html give empty text; plain text is text; unclosed and misnested tags, unclosed comments and
quotes are read on; nesting deeper than ``MAX_DEPTH`` is read as siblings (no text is lost); table columns that start over
``ALIGNED`` characters to the right are not aligned, so a page's text stays in proportion to the page (no text is lost); null and
repeated page_ids pass through row by row; an empty table gives an empty result.

Not visible: head, title, script, style, template, noscript, fallback content of embedded media, ``hidden``, inline or
simple style-sheet rules with ``display: none`` or ``visibility: hidden``, closed ``details`` and ``dialog``,
``rp``, ``datalist``, unselected options, attribute texts other than button captions and field values; in SVG, what is outside ``text``
and ``foreignObject`` or in ``defs`` and the like (text that only ``use`` brings in is not shown); annotations and ``mphantom`` of MathML.

Rules in ``@media`` blocks count if the medium fits a screen of ``SCREEN`` pixels; so do ``media`` attributes of style elements.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows

MAX_DEPTH = 200
ALIGNED = 256  # a table column that starts further right is set off by two spaces instead of being padded to

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas "
                   "datalist rp".split())
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc title script style "
                       "template".split())
# A start tag of these ends SVG and MathML, which hold other elements of HTML only below their integration points.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
                     "ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
MAX_COLSPAN = 1_000
SCREEN = (1280, 800)  # CSS pixels, width and height
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol dl menu dir blockquote pre table figure hr fieldset form address xmp listing".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main li dt dd center details summary dialog figcaption "
                            "legend optgroup tr td th tbody thead tfoot caption hgroup search".split())
TABLE_SCOPE = frozenset("table td th caption html template".split())
# A start tag closes these open elements, looked for up to the nearest of the given boundaries.
CLOSES = {
    **{t: (frozenset(["p"]), frozenset(["button"]) | TABLE_SCOPE)
       for t in SPACED - {"table"} | frozenset("div section article aside header footer nav main center details summary dialog "
                                               "figcaption li dt dd hgroup search".split())},
    "table": (frozenset(["p"]), frozenset(["button"]) | TABLE_SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "a": (frozenset(["a"]), TABLE_SCOPE),
    "button": (frozenset(["button"]), TABLE_SCOPE),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "html"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr", "html"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr", "html"])),
    **{t: (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "html"]))
       for t in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}
# An item closes the item before it, through div, p and address, but not out of other blocks.
_ITEM_BOUNDS = (BLOCKS | TABLE_SCOPE) - frozenset(["li", "dt", "dd", "div", "p", "address"])
ITEM_CLOSES = {"li": (frozenset(["li"]), _ITEM_BOUNDS), "dt": (frozenset(["dt", "dd"]), _ITEM_BOUNDS),
               "dd": (frozenset(["dt", "dd"]), _ITEM_BOUNDS)}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>?""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_CSS_SKIP = re.compile(r"""(?s)/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'""")
_CSS_PART = re.compile(r"[{};]")
_MEDIA_TOKEN = re.compile(r"\(|\)|[^()\s]+")
_LENGTH = re.compile(r"([+-]?[\d.]+)(px|em|rem|pt|pc|in|cm|mm|q)?\Z")
_RANGE = re.compile(r"<=|>=|<|>|=")
_PIXELS = {None: 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "q": 2.4 / 2.54}
# Other features of the medium, and what is true of it.
_FEATURES = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover",
             "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "update": "fast", "scan": "progressive",
             "grid": "0", "prefers-contrast": "no-preference", "forced-colors": "none", "display-mode": "browser"}
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if s and not s.isspace():
        for m in _ATTR.finditer(s):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _open_value(s: str) -> bool:
    """Whether attributes end in a value without quotes; a slash at its end is part of it."""
    at = max(s.rfind(c) for c in " \t\n\f\r\"'") + 1
    return "=" in s[at:] or s[:at].rstrip().endswith("=")


def parse(html: str) -> tuple[Node, list[str]]:
    """Tree of the page and the contents of its style elements."""
    root = Node("html", {})
    stack, sheets = [root], []
    foreign = False  # whether any SVG or MathML was opened
    pos, n = 0, len(html)

    def open_(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if len(stack) < MAX_DEPTH:
            stack.append(node)
        return node

    def in_foreign() -> bool:
        """Whether the innermost open element belongs to SVG or MathML and takes no elements of HTML."""
        if foreign:
            for x in reversed(stack):
                if x.tag in ("svg", "math"):
                    return True
                if x.tag in INTEGRATION:
                    return False
        return False

    def close_until(targets: frozenset, bounds: frozenset) -> None:
        """Pop through the outermost open target above the nearest boundary."""
        at = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in targets:
                at = k
            elif stack[k].tag in bounds:
                break
        if at is not None:
            del stack[at:]

    def start(tag: str, attrs: dict[str, str], closed: bool) -> None:
        nonlocal foreign
        if foreign and (closed or tag in BREAKOUT) and in_foreign():
            if tag not in BREAKOUT:
                stack[-1].children.append(Node(tag, attrs))
                return
            while in_foreign():
                stack.pop()
        if tag in ("svg", "math"):
            foreign = True
            if closed:
                return
        if tag in ("html", "body"):
            if tag == "body" and stack[-1].tag == "head":
                stack.pop()
            root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
            return
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ITEM_CLOSES:
            close_until(*ITEM_CLOSES[tag])
        if tag in CLOSES:
            close_until(*CLOSES[tag])
        top = stack[-1].tag
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                open_("tbody", {})
            open_("tr", {})
        elif tag == "tr" and top == "table":
            open_("tbody", {})
        if tag in VOID:
            stack[-1].children.append(Node(tag, attrs))
        else:
            open_(tag, attrs)

    def end(tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            stack[-1].children.append(Node("br", {}))
            return
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].tag
            if name == tag:
                if tag not in BLOCKS and any(x.tag in BLOCKS for x in stack[k + 1:]):
                    del stack[k]  # a formatting element ends; the blocks inside it go on
                else:
                    del stack[k:]
                return
            if name in TABLE_SCOPE and tag not in ("table", "tbody", "thead", "tfoot", "tr") or name == "table":
                break
        if tag == "p":
            stack[-1].children.append(Node("p", {}))

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            text = html[pos:lt]
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if lt == n:
            break
        if html.startswith("<!--", lt):
            e = html.find("-->", lt + 4)
            if html.startswith(("<!-->", "<!--->"), lt):
                e = html.find(">", lt) - 2
            pos = n if e < 0 else e + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            e = html.find(">", lt)
            pos = n if e < 0 else e + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:
            stack[-1].children.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        tag, rest = (m[1], m[2]) if m[1] else (m[3], m[4])
        tag = tag.lower()
        if html[lt + 1] == "/":
            end(tag)
            continue
        attrs = _attributes(rest)
        closed = rest.endswith("/") and not _open_value(rest)
        inside = closed and in_foreign()
        start(tag, attrs, closed)
        if tag in RAW and not inside:
            e = _ENDS[tag].search(html, pos)
            body = html[pos:e.start()]
            if tag == "style":
                if medium_fits(attrs.get("media", "")):
                    sheets.append(body)
            elif tag in ("textarea", "xmp"):
                stack[-1].children.append(unescape(body.removeprefix("\n")) if tag == "textarea" else body)
            pos = e.start()
    return root, sheets


def _feature(words: list[str]) -> bool | None:
    """A media feature in brackets; None if it is not known."""
    text = " ".join(words).lower()
    sides = dict(zip(("width", "height"), SCREEN))
    sides |= {f"device-{k}": v for k, v in sides.items()}

    def value(x: str) -> float | None:
        x = x.strip()
        m = _LENGTH.match(x.replace(" ", ""))
        try:
            return sides[x] if x in sides else float(m[1]) * _PIXELS[m[2]] if m else None
        except ValueError:
            return None

    if ":" not in text and (signs := _RANGE.findall(text)):
        values = [value(x) for x in _RANGE.split(text)]
        if None in values:
            return None
        return all({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[s] for a, s, b in zip(values, signs, values[1:]))
    name, colon, want = (x.strip() for x in text.partition(":"))
    if not colon:
        if name in _FEATURES:
            return _FEATURES[name] not in ("no-preference", "none", "0")
        return True if name in sides or name == "color" else False if name == "monochrome" else None
    if name in _FEATURES:
        return want == _FEATURES[name]
    side, limit = sides.get(name.removeprefix("min-").removeprefix("max-")), value(want)
    if side is None or limit is None:
        return None
    return side >= limit if name.startswith("min-") else side <= limit if name.startswith("max-") else side == limit


def medium_fits(query: str, of=_feature) -> bool:
    """Whether a media query list holds on a wide screen; what is not known does not hold, nor does its negation."""
    def group(tokens: list[str]) -> bool | None:
        result, sign, word = None, False, ""
        terms: list[bool | None] = []
        k = 0
        while k < len(tokens):
            t = tokens[k].lower()
            if t == "(":
                depth, e = 1, k + 1
                while e < len(tokens) and depth:
                    depth += {"(": 1, ")": -1}.get(tokens[e], 0)
                    e += 1
                inner = tokens[k + 1:e - 1] if not depth else tokens[k + 1:]
                nested = inner[:1] == ["("] or [x.lower() for x in inner[:1]] == ["not"]
                got, k = group(inner) if nested else of(inner), e
            elif t in ("not", "and", "or", "only"):
                sign, word = sign or t == "not", word or (t if t in ("and", "or") else "")
                k += 1
                continue
            else:
                got, k = t in ("all", "screen"), k + 1
            terms.append(got)
        if word == "or":
            result = True if True in terms else None if None in terms else False
        else:
            result = False if False in terms else None if None in terms else True
        return result if result is None or not sign else not result

    parts = query.split(",")
    return not query.strip() or any(p.strip() and group(_MEDIA_TOKEN.findall(p)) is True for p in parts)


def _supported(words: list[str]) -> bool:
    return True


def css_rules(text: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the style rules in force, in order. At-rules that are conditions are opened if they hold, others
    left out; rules nested in a style rule have no simple selector and are left out, their conditions count."""
    text = _CSS_SKIP.sub(lambda m: "" if m[0][0] == "/" else '""', text)
    out: list[tuple[str, str]] = []
    # open blocks: selectors of the style rule they belong to (None: none), whether their content counts
    stack: list[tuple[str | None, bool]] = [(None, True)]
    pos = 0
    for m in [*_CSS_PART.finditer(text), None]:
        part = text[pos:m.start() if m else len(text)].strip()
        pos = m.end() if m else pos
        selectors, counts = stack[-1]
        if m and m[0] == "{":
            name, _, rest = part.partition(" ") if part[:1] == "@" else ("", "", "")
            if part[:1] == "@" and "(" in name:
                name, rest = part[:part.index("(")], part[part.index("("):]
            name = name.lower()
            if name == "@media":
                counts = counts and medium_fits(rest)
            elif name == "@supports":
                counts = counts and medium_fits(rest.replace(",", " "), _supported)
            elif name:
                counts = counts and name == "@layer"
            elif selectors is None:
                selectors = part
            else:
                counts = False
            stack.append((selectors, counts))
            continue
        if part and counts and selectors is not None:
            if out and out[-1][0] is selectors:
                out[-1] = (selectors, f"{out[-1][1]};{part}")
            else:
                out.append((selectors, part))
        if m and m[0] == "}" and len(stack) > 1:
            stack.pop()
    return out


_first = itemgetter(0)


class Sheet:
    """``display`` and ``visibility`` of simple selectors (tag, .class, #id and their combinations); later rules win.

    A selector's rules are folded into one. Selectors are found by one of their parts, the one that fewest of them name, so
    a node is compared with those only that share a part with it; equal nodes are looked up once."""

    def __init__(self, sheets: list[str]):
        # selector: last display and last visibility, each with the number of its rule
        rules: dict[tuple[str, ...], list] = {}
        number = 0
        for text in sheets:
            for selectors, body in css_rules(text):
                d, v = _DISPLAY.search(body), _VISIBILITY.search(body)
                if not d and not v:
                    continue
                for s in selectors.split(","):
                    if m := _SIMPLE.match(s.strip()):
                        tag = [] if m[1] in (None, "*") else [m[1].lower()]
                        rule = rules.setdefault((*tag, *sorted(set(re.findall(r"[.#][\w-]+", m[2])))), [(0, None), (0, None)])
                        number += 1
                        if d:
                            rule[0] = (number, d[1].lower())
                        if v:
                            rule[1] = (number, v[1].lower())
        named = Counter(part for selector in rules for part in selector)
        self.by_part: dict[str, list[tuple[frozenset, tuple, tuple]]] = {}
        for selector, (d, v) in rules.items():
            self.by_part.setdefault(min(selector, key=lambda x: (named[x], x), default=""), []).append((frozenset(selector), d, v))
        self.known: dict[tuple, tuple[str | None, str | None]] = {}

    def _found(self, tag: str, classes: str, name: str | None) -> tuple[str | None, str | None]:
        parts = {tag, "", *("." + c for c in classes.split())} | ({"#" + name} if name else set())
        display, visibility = (0, None), (0, None)
        for part in parts:
            for selector, d, v in self.by_part.get(part, ()):
                if selector <= parts:
                    display, visibility = max(display, d, key=_first), max(visibility, v, key=_first)
        return display[1], visibility[1]

    def of(self, node: Node) -> tuple[str | None, str | None]:
        display = visibility = None
        attrs = node.attrs
        if self.by_part:
            key = (node.tag, attrs.get("class", ""), attrs.get("id"))
            if key not in self.known:
                self.known[key] = self._found(*key)
            display, visibility = self.known[key]
        style = attrs.get("style")
        if style:
            display = m[1].lower() if (m := _DISPLAY.search(style)) else display
            visibility = m[1].lower() if (m := _VISIBILITY.search(style)) else visibility
        return display, visibility


class Flow:
    """Lines of text with collapsed spaces and collapsed margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a space is due before the next text
        self.gap = 0  # blank lines due before the next line

    def text(self, s: str) -> None:
        if s.isspace() and not s.strip(" \t\n\f\r"):
            self.space = self.space or bool(self.parts)
            return
        out = _SPACE.sub(" ", s)
        if out[0] == " ":
            self.space = self.space or bool(self.parts)
            out = out[1:]
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = out.endswith(" ")
        self.parts.append(out[:-1] if self.space else out)

    def flush(self) -> None:
        if self.parts:
            self.put("".join(self.parts).replace("\xa0", " "))
            self.parts = []
        self.space = False

    def put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append(line)

    def line_break(self) -> None:
        if self.parts:
            self.flush()
        else:
            self.put("")

    def block(self, blank: bool) -> None:
        self.flush()
        if blank:
            self.gap = 1

    def insert(self, lines: list[str], first: str = "", other: str = "") -> None:
        self.flush()
        for k, line in enumerate(lines):
            self.put(((first if k == 0 else other) + line) if line or k == 0 else "")


def _number(s: str | None, default: int) -> int:
    try:
        return int(s or "")
    except ValueError:
        return default


class Renderer:
    def __init__(self, sheets: list[str]):
        self.sheet = Sheet(sheets)

    def lines(self, nodes: list, visible: bool, pre: bool) -> list[str]:
        flow = Flow()
        self.walk(nodes, flow, visible, pre)
        flow.flush()
        while flow.lines and not flow.lines[-1]:
            flow.lines.pop()
        while flow.lines and not flow.lines[0]:
            flow.lines.pop(0)
        return flow.lines

    def walk(self, nodes: list, flow: Flow, visible: bool, pre: bool) -> None:
        for node in nodes:
            if isinstance(node, str):
                if visible:
                    self.preformatted(node, flow) if pre else flow.text(node)
            else:
                self.element(node, flow, visible, pre)

    @staticmethod
    def preformatted(s: str, flow: Flow) -> None:
        rows = s.replace("\r\n", "\n").replace("\xa0", " ").split("\n")
        for k, row in enumerate(rows):
            if k:
                flow.line_break()
            if row:
                flow.parts.append(row)

    def element(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        tag, attrs = node.tag, node.attrs
        if tag in UNSEEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs):
            return
        display, visibility = self.sheet.of(node)
        if display == "none":
            return
        if visibility:
            visible = visibility not in ("hidden", "collapse")
        if tag == "br":
            if visible:
                flow.line_break()
        elif tag == "input":
            if visible and attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number", "date"):
                flow.text(attrs.get("value", ""))
        elif tag == "svg":
            self.svg(node.children, flow, visible)
        elif tag == "semantics":
            self.walk([c for c in node.children if isinstance(c, str) or c.tag not in ("annotation", "annotation-xml")], flow, visible, pre)
        elif tag == "mphantom":
            self.walk(node.children, flow, False, pre)
        elif tag == "mtr":
            flow.block(False)
            self.walk(node.children, flow, visible, pre)
            flow.block(False)
        elif tag == "mtd":
            self.walk([" ", *node.children], flow, visible, False)
        elif tag == "select":
            self.select(node, flow, visible)
        elif tag == "details" and "open" not in attrs:
            flow.block(False)
            self.walk([c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1], flow, visible, pre)
            flow.block(False)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.items(node, flow, visible, pre)
        elif tag in ("blockquote", "dd"):
            flow.block(tag == "blockquote")
            flow.insert(self.lines(node.children, visible, pre), "  ", "  ")
            flow.block(tag == "blockquote")
        elif tag == "table":
            flow.block(True)
            flow.insert(self.table(node, visible, pre))
            flow.block(True)
        elif tag in ("pre", "listing", "xmp", "textarea"):
            flow.block(True)
            kids = node.children
            if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                kids = [kids[0][1:], *kids[1:]]
            self.walk(kids, flow, visible, True)
            flow.block(True)
        elif tag in BLOCKS and display not in ("inline", "contents") or display == "block":
            flow.block(tag in SPACED)
            self.walk(node.children, flow, visible, pre)
            flow.block(tag in SPACED)
        else:
            self.walk(node.children, flow, visible, pre)

    def svg(self, nodes: list, flow: Flow, visible: bool) -> None:
        """The texts of a drawing, each on a line of its own."""
        for c in nodes:
            if isinstance(c, str) or c.tag in SVG_UNSEEN:
                continue
            display, visibility = self.sheet.of(c)
            if (display or c.attrs.get("display")) == "none":
                continue
            see = visibility or c.attrs.get("visibility")
            seen = see not in ("hidden", "collapse") if see else visible
            if c.tag in ("text", "foreignobject"):
                flow.block(False)
                self.walk([x for x in c.children if isinstance(x, str) or x.tag not in SVG_UNSEEN], flow, seen, False)
                flow.block(False)
            else:
                self.svg(c.children, flow, seen)

    def select(self, node: Node, flow: Flow, visible: bool) -> None:
        options, todo = [], [node]
        while todo:
            x = todo.pop()
            options += [x] if x.tag == "option" else []
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
        if "multiple" not in node.attrs and _number(node.attrs.get("size"), 1) < 2:
            chosen = [o for o in options if "selected" in o.attrs]
            options = chosen[-1:] or options[:1]
        for o in options:
            self.walk([" ", *o.children, " "], flow, visible, False)

    def items(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        flow.block(True)
        number = _number(node.attrs.get("start"), 1)
        loose: list = []
        for c in [*node.children, None]:
            item = isinstance(c, Node) and c.tag == "li"
            if c is not None and not item:
                loose.append(c)
                continue
            if loose:
                flow.insert(self.lines(loose, visible, pre), "  ", "  ")
                flow.gap = 0
                loose = []
            if item and not self.gone(c):
                number = _number(c.attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                see = self.sheet.of(c)[1]
                body = self.lines(c.children, visible if not see else see not in ("hidden", "collapse"), pre)
                if body:
                    flow.insert(body, mark, " " * len(mark))
                    flow.gap = 0
                number += 1
        flow.block(True)

    def gone(self, node: Node) -> bool:
        return "hidden" in node.attrs or self.sheet.of(node)[0] == "none"

    def table(self, node: Node, visible: bool, pre: bool) -> list[str]:
        """Rows with cells padded to their columns; a cell's lines stay in its column. Spans are honoured."""
        captions, rows, after = [], [], []
        todo = list(reversed(node.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                if c.strip() and visible:
                    captions.append(c)
            elif c.tag == "tr":
                if not self.gone(c):
                    rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not self.gone(x)])
                    captions += [x for x in c.children if not (isinstance(x, Node) and x.tag in ("td", "th"))]
            elif c.tag in ("tbody", "thead", "tfoot"):
                if not self.gone(c):
                    todo += list(reversed(c.children))
            elif c.tag not in ("col", "colgroup"):
                captions.append(c)
        head = self.lines(captions, visible, pre)
        busy: list[list[int]] = []  # columns that cells of earlier rows reach into: from, to, the row below the last one
        by_row: list[list[tuple[int, int, list[str]]]] = []
        for r, row in enumerate(rows):
            k, at, spans, got = 0, 0, [], []
            busy = [x for x in busy if x[2] > r]
            for cell in row:
                while at < len(busy) and busy[at][0] <= k:
                    k, at = max(k, busy[at][1]), at + 1
                wide = max(1, min(MAX_COLSPAN, _number(cell.attrs.get("colspan"), 1)))
                tall = max(1, min(len(rows) - r, _number(cell.attrs.get("rowspan"), 1) or len(rows)))
                if tall > 1:
                    spans.append([k, k + wide, r + tall])
                see = self.sheet.of(cell)[1]
                got.append((k, wide, self.lines(cell.children, visible if not see else see not in ("hidden", "collapse"), pre)))
                k += wide
            by_row.append(got)
            if spans:
                merged: list[list[int]] = []
                for x in sorted(busy + spans):
                    if merged and merged[-1][2] == x[2] and merged[-1][1] >= x[0]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(x)
                busy = merged
        width: dict[int, int] = {}
        spanning = []
        for got in by_row:
            for k, wide, lines in got:
                need = max(map(len, lines), default=0)
                if wide > 1 and need:
                    spanning.append((k, wide, need))
                elif need > width.get(k, 0):  # columns without text have no width and no gap
                    width[k] = need
        columns = sorted(width)  # those with text
        for k, wide, need in spanning:  # what a spanning cell lacks goes to its last column
            held = columns[bisect_left(columns, k):bisect_left(columns, k + wide)]
            last, room = k + wide - 1, sum(width[c] + 2 for c in held)
            if need > room - 2:
                if last in width:
                    width[last] += need - room + 2
                else:
                    insort(columns, last)
                    width[last] = max(1, need - room)
        ends = list(accumulate((width[c] + 2 for c in columns), initial=0))
        out: list[str] = []
        for got in by_row:
            starts = [ends[bisect_left(columns, k)] for k, _, _ in got]
            # a line's parts in order; cells that have fewer lines are not looked at again
            open_cells = [(start, lines) for start, (_, _, lines) in zip(starts, got) if lines]
            j = 0
            while open_cells:
                parts, length = [], 0
                for start, lines in open_cells:
                    if lines[j]:
                        room = start - length if start <= ALIGNED else 2 if length else 0
                        parts.append(" " * room + lines[j])
                        length += max(room, 0) + len(lines[j])
                out.append("".join(parts))
                j += 1
                open_cells = [x for x in open_cells if j < len(x[1])]
        return head + out


def extract(html: str | None) -> str:
    """Visible text of a page."""
    if not html:
        return ""
    root, sheets = parse(html)
    return "\n".join(line.rstrip() for line in Renderer(sheets).lines([root], True, False))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and text, one row per row."""
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_rows(src, run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, text string")
