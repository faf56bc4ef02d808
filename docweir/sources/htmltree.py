"""HTML to a tree, by the tree construction rules of the HTML standard that text extraction depends on."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Groups of element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p "
    "search section summary ul h1 h2 h3 h4 h5 h6 pre listing form li dd dt plaintext table hr xmp".split())
SPECIAL = CLOSES_P | frozenset(
    "applet area base basefont bgsound body br button caption col colgroup embed frame frameset head html iframe img input keygen link "
    "marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr "
    "track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_MARKER = None


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, None
        self.children: list[Element | str] = []

    def append(self, child: Element | str, before: Element | None = None) -> None:
        at = self.children.index(before) if before is not None else len(self.children)
        if isinstance(child, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += child
            else:
                self.children.insert(at, child)
            return
        child.detach()
        at = self.children.index(before) if before is not None else len(self.children)
        self.children.insert(at, child)
        child.parent = self

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def walk(self) -> Iterator[Element]:
        waiting = [self]
        while waiting:
            e = waiting.pop()
            yield e
            waiting += [c for c in reversed(e.children) if isinstance(c, Element)]

    @property
    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            e = waiting.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                waiting += reversed(e.children)
        return "".join(out)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def __eq__(self, other: object) -> bool:
        return self is other

    __hash__ = object.__hash__


class TreeBuilder(HTMLParser):
    """Feeds tokens into a tree below <body>; what belongs to the head is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body = Element("body")
        self.stack: list[Element] = [self.body]
        self.formatting: list[Element | None] = []
        self.started = False  # whether the body has begun
        self.dropping: str | None = None  # element of the head whose content is skipped
        self.strip_feed = False  # a line feed right after <pre> does not count

    # -- places and scopes ----------------------------------------------------------------------------------------------------

    def _in_scope(self, tags: frozenset[str] | set[str], extra: frozenset[str] = frozenset()) -> bool:
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in SCOPE or e.tag in extra:
                return False
        return False

    def _pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def _imply_ends(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def _close_p(self) -> None:
        if self._in_scope({"p"}, frozenset({"button"})):
            self._imply_ends("p")
            self._pop_to({"p"})

    def _put(self, child: Element | str, foster: bool = True) -> None:
        """At the current place; what may not stand between the parts of a table goes in front of it."""
        top = self.stack[-1]
        if foster and top.tag in TABLE_PARTS:
            self._put_by(child, top)
        else:
            top.append(child)

    def _put_by(self, child: Element | str, near: Element) -> None:
        table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
        if table is None or near.tag not in TABLE_PARTS:
            near.append(child)
        elif table.parent is not None:
            table.parent.append(child, before=table)
        else:
            self.stack[self.stack.index(table) - 1].append(child)

    def _open(self, tag: str, attrs: dict[str, str], foster: bool = True) -> Element:
        e = Element(tag, attrs)
        self._put(e, foster)
        self.stack.append(e)
        return e

    # -- formatting elements ----------------------------------------------------------------------------------------------------

    def _note_format(self, e: Element) -> None:
        """At most three equal ones since the last marker."""
        same = []
        for f in reversed(self.formatting):
            if f is _MARKER:
                break
            if f.tag == e.tag and f.attrs == e.attrs:
                same.append(f)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(e)

    def _reopen_formats(self) -> None:
        """Formatting elements that are still active but were closed with their block open again here."""
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not _MARKER and self.formatting[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self._open(old.tag, old.attrs)

    def _to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not _MARKER:
            pass

    def _adopt(self, tag: str) -> None:
        """The adoption agency algorithm for an end tag of a formatting element."""
        top = self.stack[-1]
        if top.tag == tag and top not in self.formatting:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for f in reversed(self.formatting):
                if f is _MARKER:
                    break
                if f.tag == tag:
                    fmt = f
                    break
            if fmt is None:
                self._end_other(tag)
                return
            if fmt not in self.stack:
                self.formatting.remove(fmt)
                return
            at = self.stack.index(fmt)
            if any(e.tag in SCOPE for e in self.stack[at + 1 :]):
                return
            block = next((e for e in self.stack[at + 1 :] if e.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.formatting.remove(fmt)
                return
            above, mark = self.stack[at - 1], self.formatting.index(fmt)
            last, i, rounds = block, self.stack.index(block), 0
            while True:
                rounds += 1
                i -= 1
                node = self.stack[i]
                if node is fmt:
                    break
                if rounds > 3 and node in self.formatting:
                    if self.formatting.index(node) < mark:
                        mark -= 1
                    self.formatting.remove(node)
                if node not in self.formatting:
                    del self.stack[i]
                    continue
                fresh = Element(node.tag, node.attrs)
                self.formatting[self.formatting.index(node)] = fresh
                self.stack[i] = fresh
                if last is block:
                    mark = self.formatting.index(fresh) + 1
                fresh.append(last)
                last = fresh
            last.detach()
            self._put_by(last, above)
            fresh = Element(fmt.tag, fmt.attrs)
            for c in list(block.children):
                if isinstance(c, str):
                    fresh.children.append(c)
                else:
                    fresh.append(c)
            block.children = []
            block.append(fresh)
            gone = self.formatting.index(fmt)
            self.formatting.remove(fmt)
            self.formatting.insert(mark - (gone < mark), fresh)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, fresh)

    def _end_other(self, tag: str) -> None:
        for e in reversed(self.stack[1:]):
            if e.tag == tag:
                self._imply_ends(tag)
                del self.stack[self.stack.index(e) :]
                return
            if e.tag in SPECIAL:
                return

    # -- tokens ---------------------------------------------------------------------------------------------------------------

    def handle_data(self, data: str) -> None:
        if self.dropping:
            return
        if self.strip_feed:
            self.strip_feed = False
            data = data.removeprefix("\n")
        if not self.started:
            data = data.lstrip("\t\n\f\r ")
            if not data:
                return
            self.started = True
        data = data.replace("\0", "")
        if not data:
            return
        top = self.stack[-1]
        if top.tag in TABLE_PARTS and not data.strip("\t\n\f\r "):
            top.append(data)
            return
        self._reopen_formats()
        self._put(data)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.strip_feed = False
        if self.dropping:
            return
        values: dict[str, str] = {}
        for k, v in attrs:  # of repeated attributes the first counts
            values.setdefault(k, v or "")
        if not self.started:
            if tag in HEAD_ONLY:
                if tag not in VOID:
                    self.dropping = tag
                return
            if tag in ("html", "head"):
                return
            self.started = True
        if tag in ("html", "head", "body"):
            return
        if tag in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self._start_table_part(tag, values)
            return
        if tag in CLOSES_P:
            if tag == "table" and self.stack[-1].tag in TABLE_PARTS and self._in_scope({"table"}):
                self._pop_to({"table"})
            if tag in ("li", "dd", "dt"):
                same = {"li"} if tag == "li" else {"dd", "dt"}
                for e in reversed(self.stack):
                    if e.tag in same:
                        self._imply_ends(e.tag)
                        self._pop_to({e.tag})
                        break
                    if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                        break
            self._close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            if tag == "hr":
                self._put(Element("hr", values))
                return
            self._open(tag, values)
            self.strip_feed = tag in ("pre", "listing")
            return
        if tag == "a":
            for f in reversed(self.formatting):
                if f is _MARKER:
                    break
                if f.tag == "a":
                    self._adopt("a")
                    if f in self.formatting:
                        self.formatting.remove(f)
                    if f in self.stack:
                        self.stack.remove(f)
                    break
        if tag == "nobr" and self._in_scope({"nobr"}):
            self._adopt("nobr")
        if tag == "button" and self._in_scope({"button"}):
            self._imply_ends()
            self._pop_to({"button"})
        if tag not in HEAD_ONLY:
            self._reopen_formats()
        if tag == "image":
            tag = "img"
        if tag in VOID:
            self._put(Element(tag, values))
            return
        e = self._open(tag, values)
        if tag in FORMATTING:
            self._note_format(e)
        elif tag in ("applet", "marquee", "object"):
            self.formatting.append(_MARKER)

    def _start_table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not self._in_scope({"table"}) and not any(e.tag == "table" for e in self.stack):
            return  # such a tag means nothing outside a table
        self._end_cell()
        if tag in ("td", "th"):
            self._clear_to({"tr", "table", "tbody", "tfoot", "thead"})
            if self.stack[-1].tag == "table":
                self._open("tbody", {}, False)
            if self.stack[-1].tag != "tr":
                self._open("tr", {}, False)
            self._open(tag, attrs, False)
            self.formatting.append(_MARKER)
        elif tag == "tr":
            self._clear_to({"table", "tbody", "tfoot", "thead"})
            if self.stack[-1].tag == "table":
                self._open("tbody", {}, False)
            self._open(tag, attrs, False)
        else:
            self._clear_to({"table"})
            e = self._open(tag, attrs, False)
            if tag == "col":
                self.stack.remove(e)
            if tag == "caption":
                self.formatting.append(_MARKER)

    def _clear_to(self, tags: set[str]) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag not in tags:
            self.stack.pop()

    def _end_cell(self) -> None:
        """Closes a cell or caption of the innermost table."""
        for e in reversed(self.stack):
            if e.tag == "table":
                return
            if e.tag in ("td", "th", "caption"):
                self._imply_ends()
                self._pop_to({e.tag})
                self._to_marker()
                return

    def handle_endtag(self, tag: str) -> None:
        self.strip_feed = False
        if self.dropping:
            if tag == self.dropping:
                self.dropping = None
            return
        if tag in ("html", "body", "head"):
            return
        if not self.started:
            if tag != "br":
                return
            self.started = True
        if tag == "br":
            self._reopen_formats()
            self._put(Element("br"))
        elif tag == "p":
            if not self._in_scope({"p"}, frozenset({"button"})):
                self._open("p", {})
            self._close_p()
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._imply_ends()
                self._pop_to(HEADINGS)
        elif tag in ("td", "th", "caption"):
            if self._in_scope({tag}):
                self._imply_ends()
                self._pop_to({tag})
                self._to_marker()
        elif tag in ("table", "tr", "tbody", "tfoot", "thead"):
            inner = [e.tag for e in self.stack]
            last = len(inner) - 1 - inner[::-1].index("table") if "table" in inner else 0
            if last and tag in inner[last:]:
                self._end_cell()
                self._pop_to({tag})
        elif tag in ("applet", "marquee", "object"):
            if self._in_scope({tag}):
                self._imply_ends()
                self._pop_to({tag})
                self._to_marker()
        elif tag == "li" or tag in CLOSES_P:
            if self._in_scope({tag}, frozenset({"ol", "ul"}) if tag == "li" else frozenset()):
                self._imply_ends(tag)
                self._pop_to({tag})
        else:
            self._end_other(tag)


def parse_html(html: str) -> Element:
    """The body of a document."""
    b = TreeBuilder()
    b.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
    b.close()
    return b.body
