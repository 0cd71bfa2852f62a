"""A recovering HTML tree builder after the WHATWG parsing rules, iterative, in plain Python.

Covered: data, RCDATA, raw text and script tokens; attributes and character references; implied html, head and body;
implied end tags; scopes; the list of active formatting elements with reconstruction, the three-copies rule and the
adoption agency; tables with implied parts and foster parenting; select; svg and math as plain foreign subtrees.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW_TEXT = frozenset("style xmp iframe noembed noframes script".split())
RCDATA = frozenset("textarea title".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search "
    "section summary ul pre listing form table hr xmp plaintext".split()
)
SPECIAL = CLOSES_P | HEADINGS | frozenset(
    "applet area base basefont bgsound body br button caption col colgroup dd dt embed frame frameset head html iframe img input keygen li link "
    "marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track wbr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
TEXT, COMMENT = "-text", "-comment"

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*\Z))*?)(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "text", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def add(self, child: Node, before: Node | None = None) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        if before is None:
            self.children.append(child)
        else:
            self.children.insert(self.children.index(before), child)

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


def tokens(source: str) -> Iterator[tuple]:
    """('text', s), ('comment', s), ('start', tag, attrs, self_closing), ('end', tag); raw text follows its start tag."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    at, end = 0, len(source)
    while at < end:
        mark = source.find("<", at)
        if mark < 0:
            yield "text", _html.unescape(source[at:])
            return
        if mark > at:
            yield "text", _html.unescape(source[at:mark])
        at = mark
        if source.startswith("<!--", at):
            if source.startswith(("<!-->", "<!--->"), at):
                yield "comment", ""
                at = source.index(">", at) + 1
                continue
            close = re.compile(r"--!?>").search(source, at + 4)
            yield "comment", source[at + 4 : close.start() if close else end]
            at = close.end() if close else end
        elif source.startswith(("<!", "<?"), at) or source.startswith("</", at) and not source[at + 2 : at + 3].isalpha():
            if source.startswith("</", at) and at + 2 >= end:
                yield "text", "</"
                return
            close = source.find(">", at)
            body = source[at + 2 : close if close >= 0 else end]
            if not (source.startswith("<!", at) and body[:7].lower() == "doctype") and body:
                yield "comment", body if source[at + 1] != "?" else "?" + body
            at = close + 1 if close >= 0 else end
        elif m := _TAG.match(source, at):
            name = m[2].lower()
            at = m.end()
            if m[1]:
                yield "end", name
                continue
            attrs: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(m[3]):
                value = next((g for g in a.groups()[1:] if g is not None), "")
                attrs.setdefault(a[1].lower(), _html.unescape(value))
            yield "start", name, attrs, bool(m[4])
            if name in RAW_TEXT or name in RCDATA or name == "plaintext":
                close = None if name == "plaintext" else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                body = source[at : close.start() if close else end]
                if name == "textarea" and body.startswith("\n"):
                    body = body[1:]
                if body:
                    yield "text", _html.unescape(body) if name in RCDATA else body
                at = close.start() if close else end
        elif source[at + 1 : at + 2].isalpha() or source.startswith("</", at):
            return  # a tag cut off by the end of the input
        else:
            yield "text", "<"
            at += 1


class _Builder:
    def __init__(self) -> None:
        self.root = Node("-document")
        self.html = Node("html")
        self.root.add(self.html)
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.html]
        self.formatting: list[Node | None] = []
        self.form: Node | None = None
        self.after_head = False

    # -- stack helpers
    @property
    def here(self) -> Node:
        return self.open[-1]

    def in_scope(self, names: frozenset | set, extra: frozenset = frozenset()) -> bool:
        for node in reversed(self.open):
            if node.tag in names:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def pop_to(self, names: set | frozenset) -> None:
        while self.open.pop().tag not in names:
            pass

    def imply_ends(self, but: str = "") -> None:
        while self.here.tag in IMPLIED_END and self.here.tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope({"p"}, frozenset({"button"})):
            self.imply_ends("p")
            self.pop_to({"p"})

    def ensure_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = Node("head")
                self.html.add(self.head)
            del self.open[1:]
            self.body = Node("body")
            self.html.add(self.body)
            self.open.append(self.body)

    def place(self) -> tuple[Node, Node | None]:
        """Where a node goes: the current node, or before the table when it must be foster-parented."""
        if self.here.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.open) - 1, -1, -1):
                table = self.open[i]
                if table.tag == "table":
                    return (table.parent, table) if table.parent is not None else (self.open[i - 1], None)
        return self.here, None

    def insert(self, tag: str, attrs: dict, push: bool = True, plain: bool = False) -> Node:
        node = Node(tag, attrs)
        parent, before = (self.here, None) if plain else self.place()
        parent.add(node, before)
        if push:
            self.open.append(node)
        return node

    # -- active formatting elements
    def reconstruct(self) -> None:
        i = len(self.formatting)
        while i and self.formatting[i - 1] is not None and self.formatting[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.formatting)):
            old = self.formatting[k]
            self.formatting[k] = self.insert(old.tag, dict(old.attrs))

    def push_formatting(self, node: Node) -> None:
        same = []
        for other in reversed(self.formatting):
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(other)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def adopt(self, tag: str) -> bool:
        """The adoption agency algorithm; false if the end tag is to be handled like any other."""
        if self.here.tag == tag and self.here not in self.formatting:
            self.open.pop()
            return True
        for _ in range(8):
            element = None
            for other in reversed(self.formatting):
                if other is None:
                    break
                if other.tag == tag:
                    element = other
                    break
            if element is None:
                return False
            if element not in self.open:
                self.formatting.remove(element)
                return True
            if not self.in_scope({tag}):
                return True
            at = self.open.index(element)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formatting.remove(element)
                return True
            ancestor = self.open[at - 1]
            mark = self.formatting.index(element)
            node = last = block
            i = self.open.index(block)
            inner = 0
            while True:
                inner += 1
                i -= 1
                node = self.open[i]
                if node is element:
                    break
                if inner > 3 and node in self.formatting:
                    k = self.formatting.index(node)
                    del self.formatting[k]
                    mark -= k < mark
                if node not in self.formatting:
                    self.open.remove(node)
                    continue
                clone = Node(node.tag, dict(node.attrs))
                k = self.formatting.index(node)
                self.formatting[k] = clone
                self.open[i] = clone
                node = clone
                if last is block:
                    mark = k + 1
                node.add(last)
                last = node
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                held, self.open = self.open, self.open[: self.open.index(ancestor) + 1]
                parent, before = self.place()
                self.open = held
                parent.add(last, before)
            else:
                ancestor.add(last)
            clone = Node(element.tag, dict(element.attrs))
            for child in list(block.children):
                clone.add(child)
            block.add(clone)
            k = self.formatting.index(element)
            del self.formatting[k]
            mark -= k < mark
            self.formatting.insert(mark, clone)
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, clone)
        return True

    # -- text
    def text(self, data: str) -> None:
        if self.here.tag in RAW_TEXT or self.here.tag in RCDATA or self.here.tag == "plaintext":
            self.append_text(data)
            return
        data = data.replace("\0", "")
        if not data:
            return
        if self.body is None:
            kept = data.lstrip(" \t\n\f")
            if self.here.tag in ("noscript", "template") and self.here is not self.html:
                self.append_text(data)
                return
            if not kept:
                return
            self.ensure_body()
            data = kept
        blank = not data.strip(" \t\n\f")
        if self.here.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if blank:
                self.append_text(data, plain=True)
                return
        elif self.here.tag == "colgroup":
            if blank:
                return
            self.open.pop()
        if self.here.tag not in ("select", "svg", "math", "template"):
            self.reconstruct()
        self.append_text(data)

    def append_text(self, data: str, plain: bool = False) -> None:
        parent, before = (self.here, None) if plain else self.place()
        last = None
        if before is not None:
            i = parent.children.index(before)
            last = parent.children[i - 1] if i else None
        elif parent.children:
            last = parent.children[-1]
        if last is not None and last.tag == TEXT:
            last.text += data
        else:
            parent.add(Node(TEXT, text=data), before)

    # -- tags
    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "body":
            if self.body is None:
                self.ensure_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", attrs)
                self.html.add(self.head)
                self.open.append(self.head)
            return
        if self.body is None:
            if tag in HEAD_TAGS:
                if self.head is None:
                    self.head = Node("head")
                    self.html.add(self.head)
                    self.open.append(self.head)
                if self.here is self.html:
                    self.open.append(self.head)
                self.insert(tag, attrs, push=tag not in VOID and not (closed and tag in VOID), plain=True)
                return
            self.ensure_body()
        if any(n.tag in ("svg", "math") for n in self.open[-12:]) and self.here.tag not in ("foreignobject", "desc", "title", "td", "body", "annotation-xml"):
            if tag not in CLOSES_P and tag not in HEADINGS:
                self.insert(tag, attrs, push=not closed and tag not in VOID)
                return
            while self.here.tag not in ("html", "body") and any(n.tag in ("svg", "math") for n in self.open):
                self.open.pop()
        if self.in_scope({"select"}) and self.here.tag in ("select", "option", "optgroup"):
            if tag in ("option", "optgroup"):
                while self.here.tag == "option" or tag == "optgroup" and self.here.tag == "optgroup":
                    self.open.pop()
                self.insert(tag, attrs)
                return
            if tag in ("input", "textarea", "keygen", "select") or tag in TABLE_PARTS or tag == "table":
                self.pop_to({"select"})
                if tag == "select":
                    return
            else:
                return
        if tag in TABLE_PARTS or tag == "table" and self.here.tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if self.table_part(tag, attrs):
                return
        self.in_body(tag, attrs, closed)

    def table_part(self, tag: str, attrs: dict) -> bool:
        if not any(n.tag == "table" for n in self.open):
            return True  # a stray part is dropped
        if tag == "table":
            self.pop_to({"table"})
            return False
        if not self.in_scope({"table"}, frozenset()) and not self.in_scope({"td", "th", "caption"}):
            return True

        def back(*names: str) -> None:
            while self.here.tag not in (*names, "html", "template"):
                if self.here.tag in ("td", "th", "caption"):
                    self.open.pop()
                    self.clear_formatting()
                else:
                    self.open.pop()

        if tag in ("td", "th"):
            back("tr", "table", "tbody", "thead", "tfoot")
            if self.here.tag == "table":
                self.insert("tbody", {}, plain=True)
            if self.here.tag != "tr":
                self.insert("tr", {}, plain=True)
            self.insert(tag, attrs, plain=True)
            self.formatting.append(None)
        elif tag == "tr":
            back("table", "tbody", "thead", "tfoot")
            if self.here.tag == "table":
                self.insert("tbody", {}, plain=True)
            self.insert(tag, attrs, plain=True)
        elif tag == "col":
            back("table", "colgroup")
            if self.here.tag != "colgroup":
                self.insert("colgroup", {}, plain=True)
            self.insert(tag, attrs, push=False, plain=True)
        else:
            back("table")
            self.insert(tag, attrs, plain=True)
            if tag == "caption":
                self.formatting.append(None)
        return True

    def in_body(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in HEAD_TAGS and tag not in ("noscript", "template"):
            self.insert(tag, attrs, push=tag not in VOID)
            return
        if tag == "frameset" or tag == "frame":
            return
        if tag in CLOSES_P:
            if tag == "form" and self.form is not None:
                return
            self.close_p()
            if tag == "hr":
                self.insert(tag, attrs, push=False)
                return
            node = self.insert(tag, attrs)
            if tag == "form":
                self.form = node
            return
        if tag in HEADINGS:
            self.close_p()
            if self.here.tag in HEADINGS:
                self.open.pop()
            self.insert(tag, attrs)
            return
        if tag in ("li", "dd", "dt"):
            ends = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.tag in ends:
                    self.imply_ends(node.tag)
                    self.pop_to(ends)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
            return
        if tag == "button":
            if self.in_scope({"button"}):
                self.imply_ends()
                self.pop_to({"button"})
            self.reconstruct()
            self.insert(tag, attrs)
            return
        if tag in FORMATTING:
            if tag == "a":
                for other in reversed(self.formatting):
                    if other is None:
                        break
                    if other.tag == "a":
                        self.adopt("a")
                        if other in self.formatting:
                            self.formatting.remove(other)
                        if other in self.open:
                            self.open.remove(other)
                        break
            self.reconstruct()
            if tag == "nobr" and self.in_scope({"nobr"}):
                self.adopt("nobr")
                self.reconstruct()
            self.push_formatting(self.insert(tag, attrs))
            return
        if tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.formatting.append(None)
            return
        if tag == "image":
            tag = "img"
        if tag in VOID:
            if tag not in ("param", "source", "track"):
                self.reconstruct()
            self.insert(tag, attrs, push=False)
            return
        if tag in ("optgroup", "option") and self.here.tag == "option":
            self.open.pop()
        if tag in ("rb", "rtc", "rp", "rt") and self.in_scope({"ruby"}):
            self.imply_ends("rtc" if tag in ("rp", "rt") else "")
        self.reconstruct()
        self.insert(tag, attrs, push=not (closed and tag in ("svg", "math")))

    def end(self, tag: str) -> None:
        if self.here.tag == tag and (tag in RAW_TEXT or tag in RCDATA):
            self.open.pop()
            return
        if self.body is None:
            if tag == "head" and self.head is not None:
                del self.open[1:]
            elif tag in ("body", "html", "br"):
                self.ensure_body()
                if tag == "br":
                    self.insert("br", {}, push=False)
            elif tag in ("noscript", "template") and any(n.tag == tag for n in self.open):
                self.pop_to({tag})
            return
        if tag in ("body", "html"):
            return  # what follows still belongs to the body
        if tag == "p":
            if not self.in_scope({"p"}, frozenset({"button"})):
                self.close_p()
                self.insert("p", {})
            self.imply_ends("p")
            self.pop_to({"p"})
            return
        if tag == "br":
            self.reconstruct()
            self.insert("br", {}, push=False)
            return
        if tag in FORMATTING:
            if self.adopt(tag):
                return
        elif tag in ("td", "th", "caption", "table", "tbody", "thead", "tfoot", "tr", "colgroup"):
            if any(n.tag == tag for n in self.open) and (tag == "table" or self.table_scope(tag)):
                while True:
                    gone = self.open.pop()
                    if gone.tag in ("td", "th", "caption"):
                        self.clear_formatting()
                    if gone.tag == tag:
                        break
            return
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
            return
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.open:
                self.imply_ends()
                if node in self.open:
                    self.open.remove(node)
            return
        elif tag in ("li", "dd", "dt") or tag in CLOSES_P or tag in ("button", "applet", "marquee", "object", "select"):
            extra = frozenset({"ol", "ul"}) if tag == "li" else frozenset()
            if self.in_scope({tag}, extra):
                self.imply_ends(tag)
                self.pop_to({tag})
                if tag in ("applet", "marquee", "object"):
                    self.clear_formatting()
            return
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.tag == tag:
                del self.open[i:]
                return
            if node.tag in SPECIAL:
                return

    def table_scope(self, tag: str) -> bool:
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag in ("table", "html", "template"):
                return False
        return False

    def comment(self, data: str) -> None:
        (self.here if self.body is not None or self.here is not self.html else self.html).add(Node(COMMENT, text=data))


def parse(source: str) -> Node:
    """The document node of a recovered tree; its ``html`` always has a ``head`` and a ``body``."""
    b = _Builder()
    for token in tokens(source):
        if token[0] == "text":
            b.text(token[1])
        elif token[0] == "start":
            b.start(*token[1:])
        elif token[0] == "end":
            b.end(token[1])
        else:
            b.comment(token[1])
    b.ensure_body()
    return b.root
