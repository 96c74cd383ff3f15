"""HTML pages as trees, and rows from them: result pages, pedigrees and statistics tables.

A page is read once, by a tokenizer that keeps a stack of open elements. Elements are numbered in
the order in which they begin, and one knows where its descendants end, so what stands below an
element is a range of numbers. Tags that are left open end where their parent ends or where HTML
says that a following tag ends them; end tags that match nothing open are left out. Plain markup
is cut at its brackets, and what a tag says is worked out once for equal ones; a page in which
anything else stands is read by the standard library's parser from its begin.

Result pages are cut at their runners, and where a part's fields stand is worked out once for parts
of equal tags that begin below equal open elements: of most pages no tree is made.

Only this reading runs in Python, a page at a time, in Arrow batches; fields come out as text, and
what they mean is worked out with columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import pairwise
from operator import itemgetter
from sys import intern

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without content; what a start tag ends if it is open,
# and the elements beyond which it ends nothing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {
    **{tag: (frozenset({"p"}), frozenset("button td th caption".split())) for tag in _BLOCKS},
    "li": (frozenset({"li", "p"}), frozenset("ul ol".split())),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    **{tag: (frozenset("td th".split()), frozenset({"table"})) for tag in ("td", "th")},
    "tr": (frozenset("tr td th".split()), frozenset({"table"})),
    **{tag: (frozenset("thead tbody tfoot tr td th".split()), frozenset({"table"})) for tag in ("thead", "tbody", "tfoot")},
}


# Start and end tags, without their brackets, as plain as they come.
_START = re.compile(r"""[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:.]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)*[ \t\n\r\f]*/?""")
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]([a-zA-Z][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*")
_RAW = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS)
#: Tags that a worker remembers, and tags with the text behind them, and how long these may be.
TAGS, TAG_CHARS = 1 << 14, 256
#: Parts of result pages that a worker remembers, of how many tags at most, and below how many open elements.
PARTS, PART_TAGS, PART_DEPTH = 1 << 12, 1 << 10, 1 << 6


_row_kinds: set[str] = set()


class Start:
    """A start tag: its name and attributes, what it ends, and the result page's fields that may stand in it.

    Tags of one kind differ in nothing that tells where a result page's fields stand.
    """

    __slots__ = ("tag", "attributes", "ended", "bounds", "void", "fields", "row", "kind")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.void = tag, attributes, tag in VOID
        self.ended, self.bounds = ENDS.get(tag, (frozenset(), frozenset()))
        self.fields = [f for f in FIELDS.get(tag, ()) if f[1].met(attributes)]
        self.row = tag == RUNNER_ROW[0] and has_all(attributes, RUNNER_ROW[1])
        pedigree = tag == PEDIGREE_ROW[0] and has_all(attributes, PEDIGREE_ROW[1])
        self.kind = intern(" ".join([f"<{tag}", *["row"] * self.row, *["pedigree"] * pedigree, *[f[0] for f in self.fields]]))
        if self.row:
            _row_kinds.add(self.kind)


def _tag(text: str) -> Start | str | None:
    """What stands between brackets: a start tag, the name of an end tag, nothing for the document's type, None where it is no plain tag."""
    if end := _END.fullmatch(text):
        return end[1].lower()
    if not _START.fullmatch(text):
        return "" if text[:8].lower() == "!doctype" else None
    name = re.match("[a-zA-Z0-9]+", text).group()
    attributes: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(text, len(name)):
        attributes.setdefault(key.lower(), unescape("".join(values)))  # of equal names the first counts
    return Start(name.lower(), attributes)


_known_tag = lru_cache(maxsize=TAGS)(_tag)


def _link(text: str) -> Start | None:
    """A start tag with an address at its end, from what is known of the tag without it; None where it is none."""
    head, at, address = text.rpartition(' href="')
    if not at or address.find('"') != len(address) - 1 or head.endswith("/") or len(head) > TAG_CHARS:
        return None
    bare = _known_tag(head)
    if bare.__class__ is not Start or "href" in bare.attributes:
        return None
    out = Start.__new__(Start)
    out.tag, out.ended, out.bounds, out.void, out.fields, out.row, out.kind = bare.tag, bare.ended, bare.bounds, bare.void, bare.fields, bare.row, bare.kind
    out.attributes = {**bare.attributes, "href": unescape(address[:-1])}
    return out


#: A tag, its kind, the text behind it, and that text with white space joined.
Piece = tuple[Start | str, str, str, str]
_pieces: dict[str, Piece] = {}
_NOTHING: Piece = ("", "", "", "")


def _words(text: str) -> str:
    return " ".join(text.split())


def _with(tag: Start | str, text: str) -> Piece:
    return tag, tag.kind if tag.__class__ is Start else tag, text, _words(text)


def _piece(piece: str) -> Piece | None:
    """A tag and the text behind it; None where there is no plain tag."""
    inside, closed, text = piece.partition(">")
    tag = _link(inside) or (_known_tag(inside) if len(inside) <= TAG_CHARS else _tag(inside))
    if tag is None or not closed:
        return None
    found = _with(tag, unescape(text) if "&" in text else text)
    if len(piece) <= TAG_CHARS and not (tag.__class__ is Start and tag.tag in _RAW):
        if len(_pieces) == TAGS:
            _pieces.clear()
        _pieces[piece] = found
    return found


def cut(page: str) -> list[Piece] | None:
    """The pieces of a page of plain markup; None where something else stands.

    End tags are names; comments and the document's type are empty, as is what stands for the page's begin.
    """
    text, *pieces = page.split("<")
    out = list(map(_pieces.get, pieces))
    joined = False
    for at in [i for i, x in enumerate(out) if x is None]:
        piece = pieces[at]
        if out[at] is not None:
            continue  # of a comment or a script
        if piece.startswith("!--"):
            end = next((i for i in range(at, len(pieces)) if "-->" in pieces[i]), None)
            if end is None:
                return None
            comment, _, behind = "<".join(pieces[at : end + 1])[3:].partition("-->")
            if "--" in comment or comment.startswith((">", "->")) or comment.endswith("-"):
                return None
            out[at : end + 1] = [_with("", unescape(behind))] + [_NOTHING] * (end - at)
            joined |= end > at
            continue
        if (found := _piece(piece)) is None:
            return None
        out[at] = found
        start = found[0]
        if start.__class__ is Start and start.tag in _RAW:
            tag = start.tag
            end = next((i for i in range(at + 1, len(pieces)) if pieces[i][: len(tag) + 1].lower() == f"/{tag}"), None)
            inside, _, behind = "<".join(pieces[at:end]).partition(">")
            if end is None or inside.endswith("/") or any(x.lstrip("/ \t\n\r\f")[: len(tag)].lower() == tag for x in pieces[at + 1 : end]):
                return None
            if (found := _piece(pieces[end])) is None or found[0] != tag:
                return None
            out[at : end + 1] = [_with(start, behind)] + [_NOTHING] * (end - at - 1) + [found]
            joined |= end > at + 1
    out.insert(0, _with("", unescape(text)))
    return [x for x in out if x is not _NOTHING] if joined else out


class Tree(HTMLParser):
    """One page: by element its tag, attributes, parent, depth, the end of its descendants, and its texts."""

    def __init__(self, page: str):
        self._begin()
        if not self._plain(page):
            self._begin()
            super().__init__(convert_charrefs=True)
            self.feed(page)
            self.close()
        while self.open:
            self._leave()

    def _begin(self) -> None:
        self.starts: list[Start] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.chunks: list[str] = []
        self.owners: list[int] = []  # of a chunk, the element in which it stands
        self.first: list[int] = []  # the chunks below an element
        self.last: list[int] = []
        self.open: list[int] = []
        self.standing: dict[str, int] = {}  # open elements by tag

    @property
    def attributes(self) -> list[dict[str, str]]:
        return [s.attributes for s in self.starts]

    @cached_property
    def by_tag(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for n, tag in enumerate(self.tags):
            out.setdefault(tag, []).append(n)
        return out

    @cached_property
    def own(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for n, chunk in zip(self.owners, self.chunks, strict=True):
            out.setdefault(n, []).append(chunk)
        return out

    def _plain(self, page: str) -> bool:
        """Read a page of plain markup; False where something else stands."""
        if (found := cut(page)) is None:
            return False
        for tag, _, text, _ in found:
            self._step(tag)
            if text:
                self.handle_data(text)
        return True

    def _step(self, tag: Start | str) -> None:
        if tag.__class__ is Start:
            self._enter(tag)
        elif tag:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._enter(Start(tag, {k: v or "" for k, v in reversed(attrs)}))  # of equal names the first counts

    def _enter(self, start: Start) -> None:
        tag, tags, stack, ended = start.tag, self.tags, self.open, start.ended
        if ended and any(self.standing.get(t) for t in ended):
            at = last = len(stack)
            while at and tags[stack[at - 1]] not in start.bounds:
                at -= 1
                if tags[stack[at]] in ended:
                    last = at
            while len(stack) > last:
                self._leave()
        n, begin = len(tags), len(self.chunks)
        self.starts.append(start)
        tags.append(tag)
        self.parents.append(stack[-1] if stack else -1)
        self.ends.append(n + 1)
        self.first.append(begin)
        self.last.append(begin)
        if not start.void:
            stack.append(n)
            self.standing[tag] = self.standing.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.standing.get(tag):
            while self.tags[self._leave()] != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.chunks.append(data)
        self.owners.append(self.open[-1] if self.open else -1)

    def _leave(self) -> int:
        n = self.open.pop()
        self.standing[self.tags[n]] -= 1
        self.ends[n] = len(self.tags)
        self.last[n] = len(self.chunks)
        return n

    def depth(self, n: int) -> int:
        out = 0
        while (n := self.parents[n]) >= 0:
            out += 1
        return out

    def text(self, n: int) -> str:
        """All text below an element, white space joined."""
        return _words("".join(self.chunks[self.first[n] : self.last[n]]))

    def own_text(self, n: int) -> str:
        """The text that stands in an element itself, not in elements below."""
        return _words("".join(self.own.get(n, ())))

    def find(self, tag: str, has: dict[str, str] | None = None, begin: int = 0, end: int | None = None) -> Iterator[int]:
        """Elements of a range, by tag and attributes; a class is met by any element that has all its words."""
        numbers = self.by_tag.get(tag, [])
        for i in range(bisect_left(numbers, begin), len(numbers)):
            n = numbers[i]
            if end is not None and n >= end:
                return
            if not has or has_all(self.starts[n].attributes, has):
                yield n

    def below(self, n: int) -> tuple[int, int]:
        return n + 1, self.ends[n]


def has_all(mine: dict[str, str], has: dict[str, str]) -> bool:
    """Whether attributes are these; a class is met by any that has all its words."""
    return all(k in mine and (v == mine[k] or (k == "class" and set(v.split()) <= set(mine[k].split()))) for k, v in has.items())


@dataclass(frozen=True)
class Field:
    """Where a field stands: a tag and one of its attributes, and what is taken of it."""

    tag: str
    key: str
    value: str | None = None
    take: str = "text"

    def met(self, attributes: dict[str, str]) -> bool:
        return self.key in attributes and (self.value is None or has_all(attributes, {self.key: self.value}))

    def taken(self, tree: Tree, n: int) -> str | None:
        """The field of an element that meets it: its text, or an attribute."""
        return tree.text(n) if self.take == "text" else tree.own_text(n) if self.take == "own" else tree.starts[n].attributes.get(self.take)


def fields(tree: Tree, of_race: bool, begin: int = 0, end: int | None = None) -> dict[str, tuple[Field, int]]:
    """The race's or a runner's fields in a range, each with the first element that meets it."""
    out: dict[str, tuple[Field, int]] = {}
    for n in range(begin, len(tree.tags) if end is None else end):
        for name, field, race in tree.starts[n].fields:
            if race == of_race:
                out.setdefault(name, (field, n))
    return out


def texts_of(tree: Tree, found: dict[str, tuple[Field, int]]) -> dict[str, str | None]:
    return {name: field.taken(tree, n) for name, (field, n) in found.items()}


# Where the fields of a result page stand.
RACE_FIELDS = {
    "course": Field("main", "data-analytics-coursename", take="data-analytics-coursename"),
    "off": Field("main", "data-analytics-race-date-time", take="data-analytics-race-date-time"),
    "going": Field("span", "class", "rp-raceTimeCourseName_condition"),
    "race_name": Field("h2", "class", "rp-raceTimeCourseName__title"),
    "race_class": Field("span", "class", "rp-raceTimeCourseName_class"),
    "band": Field("span", "class", "rp-raceTimeCourseName_ratingBandAndAgesAllowed"),
    "hurdles": Field("span", "data-test-selector", "rp-raceTimeCourseName_hurdles"),
    "dist": Field("span", "data-test-selector", "block-distanceInd"),
    "dist_full": Field("span", "data-test-selector", "block-fullDistanceInd"),
    "ran": Field("span", "data-test-selector", "rp-raceInfo__value rp-raceInfo__value_black"),
}
RUNNER_ROW = ("tr", {"class": "rp-horseTable__mainRow"})
RUNNER_FIELDS = {
    "pos": Field("span", "data-test-selector", "text-horsePosition", "own"),
    "draw": Field("sup", "class", "rp-horseTable__pos__draw"),
    "num": Field("span", "class", "rp-horseTable__saddleClothNo"),
    "btn": Field("span", "class", "rp-horseTable__pos__length"),
    "horse": Field("a", "data-test-selector", "link-horseName"),
    "horse_href": Field("a", "data-test-selector", "link-horseName", "href"),
    "country": Field("span", "class", "rp-horseTable__horse__country"),
    "sp": Field("span", "class", "rp-horseTable__horse__price"),
    "jockey": Field("a", "data-test-selector", "link-jockeyName"),
    "jockey_href": Field("a", "data-test-selector", "link-jockeyName", "href"),
    "trainer": Field("a", "data-test-selector", "link-trainerName"),
    "trainer_href": Field("a", "data-test-selector", "link-trainerName", "href"),
    "owner_href": Field("a", "data-test-selector", "link-silk", "href"),
    "silk_url": Field("img", "class", "rp-horseTable__silk", "src"),
    "age": Field("td", "data-test-selector", "horse-age"),
    "stones": Field("span", "data-ending", "st"),
    "pounds": Field("span", "data-ending", "lb"),
    "headgear": Field("span", "class", "rp-horseTable__headGear"),
    "official": Field("td", "data-ending", "OR"),
    "rpr": Field("td", "data-ending", "RPR"),
    "ts": Field("td", "data-ending", "TS"),
    "prize": Field("div", "data-test-selector", "text-prizeMoney"),
    "comment": Field("tr", "class", "rp-horseTable__commentRow"),
}
#: By tag: name, field, and whether it is the race's.
FIELDS: dict[str, list[tuple[str, Field, bool]]] = {}
for _fields, _race in ((RACE_FIELDS, True), (RUNNER_FIELDS, False)):
    for _name, _field in _fields.items():
        FIELDS.setdefault(_field.tag, []).append((_name, _field, _race))
PEDIGREE_ROW = ("tr", {"data-test-selector": "block-pedigreeInfoFullResults"})
PARENTS = ("sire", "dam", "damsire")


def pedigree_of(tree: Tree, n: int) -> dict[str, str | None]:
    """Sex and parents of a pedigree cell."""
    links = []
    for a in tree.find("a", None, *tree.below(n)):
        country = next(tree.find("span", None, *tree.below(a)), None)
        links.append((tree.own_text(a), tree.starts[a].attributes.get("href"), None if country is None else tree.text(country)))
    return pedigree(tree.own_text(n), tree.text(n), links)


def pedigree[T](own: T, text: str, links: list[tuple[T, T, T]]) -> dict[str, T]:
    """Sex, then links to sire - dam ( damsire ), each with its text, address and country; a cell without a dash has no sire."""
    out: dict[str, T] = {"pedigree": own}
    for name, (link, href, country) in zip(PARENTS if "-" in text else PARENTS[1:], links, strict=False):
        out |= {name: link, f"{name}_href": href, f"{name}_country": country}
    return out


PEDIGREE_FIELDS = ["pedigree", *[f"{p}{x}" for p in PARENTS for x in ("", "_href", "_country")]]


RACE_COLUMNS, RUNNER_COLUMNS = [*RACE_FIELDS, "rows"], [*RUNNER_FIELDS, *PEDIGREE_FIELDS]
_AT = {name: i for i, name in enumerate(RUNNER_COLUMNS)}


def tree_runners(tree: Tree) -> tuple[dict[str, str | None], list[list[str | None]]]:
    """The race's fields with the page's number of rows, and the columns of each runner; what belongs to a runner stands from its row to the next one's."""
    rows, out = list(tree.find(*RUNNER_ROW)), []
    for i, n in enumerate(rows):
        table = _table_of(tree, n)
        end = min(rows[i + 1] if i + 1 < len(rows) else len(tree.tags), len(tree.tags) if table is None else tree.ends[table])
        runner = texts_of(tree, fields(tree, False, n, end))
        for cell in _pedigree_cells(tree, n, end):
            runner |= pedigree_of(tree, cell)
        out.append([runner.get(c) for c in RUNNER_COLUMNS])
    return texts_of(tree, fields(tree, True)) | {"rows": str(len(rows))} if rows else {}, out


def _table_of(tree: Tree, n: int) -> int | None:
    return next((p for p in _ancestors(tree, n) if tree.tags[p] == "table"), None)


def _pedigree_cells(tree: Tree, begin: int, end: int) -> list[int]:
    cells = [next(tree.find("td", None, *tree.below(row)), None) for row in tree.find(*PEDIGREE_ROW, begin, end)]
    return [c for c in cells if c is not None]


def _ancestors(tree: Tree, n: int) -> Iterator[int]:
    while (n := tree.parents[n]) >= 0:
        yield n


#: Where a text stands, by tags of a part: behind one of them; or that tag and its attribute; or behind some of them.
Place = tuple[int | None, int | None, str | list[int] | None]


_NONE: Place = (-1, None, None)


class Part:
    """Where the fields stand in a part of a result page: what is before the first runner, or one runner up to the next.

    It is worked out from the part's tags and the elements that are open where it begins, and holds
    for all parts of which these are of the same kinds: a text is that behind some of the part's
    tags, an attribute that of one of them. Where an element that is taken is still open when the
    next part begins, the part is not ``whole``, and the page's tree must be asked.
    """

    __slots__ = ("race", "runner", "others", "cells", "after", "whole")

    def __init__(self, begun: tuple[str, ...], tags: tuple[Start | str, ...], last: bool):
        tree = Tree.__new__(Tree)
        tree._begin()
        for tag in begun:  # none ends another: they stood open together
            tree._enter(Start(tag, {}))
        n = begin = len(tree.tags)
        places = [-1] * begin
        for i, tag in enumerate(tags):
            tree._step(tag)
            places += [i] * (len(tree.tags) - len(places))
            tree.handle_data("")
        end = len(tree.tags)
        if not last:  # the next runner's row, for what it ends
            tree._enter(Start(RUNNER_ROW[0], {}))
            tree.open.pop()
        self.after = () if last else tuple(tree.tags[k] for k in tree.open)
        open_ = set() if last else set(tree.open)
        while last and tree.open:
            tree._leave()
        self.whole = len(self.after) <= PART_DEPTH
        behind: dict[int, list[int]] = {}
        for i, owner in enumerate(tree.owners):
            behind.setdefault(owner, []).append(i)

        def place(field: Field, n: int) -> Place:
            if field.take not in ("text", "own"):
                return None, places[n], field.take
            self.whole &= n not in open_
            behind_it = behind.get(n, []) if field.take == "own" else range(tree.first[n], tree.last[n])
            return (behind_it[0], None, None) if len(behind_it) == 1 else (None, None, list(behind_it))

        def places_of(found: dict[str, tuple[Field, int]]) -> dict[str, Place]:
            return {name: place(*x) for name, x in found.items()}

        text, own = Field("", "", take="text"), Field("", "", take="own")
        self.race = places_of(fields(tree, True, begin, end))
        runner: dict[str, Place] = {}
        self.cells = []
        if tags[0].__class__ is Start:
            table = _table_of(tree, n)
            end = min(end, tree.ends[table]) if table is not None and table not in open_ else end
            runner = places_of(fields(tree, False, n, end))
            self.whole &= not any(row in open_ for row in tree.find(*PEDIGREE_ROW, n, end))
            for cell in _pedigree_cells(tree, n, end) if self.whole else ():
                links = []
                for a in tree.find("a", None, *tree.below(cell)):
                    country = next(tree.find("span", None, *tree.below(a)), None)
                    links.append((place(own, a), (None, places[a], "href"), _NONE if country is None else place(text, country)))
                found = [[(_AT[name], x) for name, x in pedigree(place(own, cell), dash, links).items()] for dash in ("", "-")]
                self.cells.append((place(text, cell), *found))
        # texts behind one tag are taken at once; -1 is what stands for none
        self.runner = itemgetter(*[-1 if (one := runner.get(c, _NONE)[0]) is None else one for c in RUNNER_COLUMNS])
        self.others = [(_AT[name], x) for name, x in runner.items() if x[0] is None]


_parts: dict[tuple, Part] = {}


def part_of(begun: tuple[str, ...], tags: tuple[Start | str, ...], kinds: tuple[str, ...], last: bool) -> Part:
    key = begun, kinds, last
    if (part := _parts.get(key)) is None:
        part = Part(begun, tags, last)
        if len(tags) <= PART_TAGS:
            if len(_parts) == PARTS:
                _parts.clear()
            _parts[key] = part
    return part


def _taken(place: Place, tags: tuple[Start | str, ...], texts: tuple[str, ...], words: tuple[str | None, ...]) -> str | None:
    one, tag, x = place
    if one is not None:
        return words[one]
    return tags[tag].attributes.get(x) if tag is not None else _words("".join([texts[i] for i in x]))


def page_runners(page: str) -> tuple[dict[str, str | None], list[list[str | None]]]:
    """What ``tree_runners`` tells, from a page's parts where these do, else from its tree."""
    if (found := cut(page)) is None:
        return tree_runners(Tree(page))
    all_tags, all_kinds, all_texts, all_words = zip(*found, strict=True)
    rows = [i for i, kind in enumerate(all_kinds) if kind in _row_kinds]
    begun: tuple[str, ...] = ()
    race: dict[str, str | None] = {}
    out = []
    for a, b in pairwise([0, *rows, len(found)]) if rows else ():
        tags, texts, words = all_tags[a:b], all_texts[a:b], (*all_words[a:b], None)
        part = part_of(begun, tags, all_kinds[a:b], b == len(found))
        if not part.whole:
            return tree_runners(Tree(page))
        begun = part.after
        for name, place in part.race.items():
            if name not in race:
                race[name] = _taken(place, tags, texts, words)
        if a:
            row = list(part.runner(words))
            for at, place in part.others:
                row[at] = _taken(place, tags, texts, words)
            for text, dashless, dashed in part.cells:
                for at, place in dashed if "-" in _taken(text, tags, texts, words) else dashless:
                    row[at] = _taken(place, tags, texts, words)
            out.append(row)
    return race | {"rows": str(len(rows))} if rows else {}, out


# Tables of statistics, by what the first cell of their rows is about.
STATS_TABLE, STATS_ROW = ("table", {"data-test-selector": "RC-table"}), ("tr", {"class": "ui-table__row"})
STATS_KINDS = ("horse", "jockey", "trainer")


def stats_rows(tree: Tree) -> Iterator[dict[str, str | None]]:
    """One row for each cell of a statistics table besides the name: kind, name, measure, value."""
    for table in tree.find(*STATS_TABLE):
        for row in tree.find(*STATS_ROW, *tree.below(table)):
            cells = [(tree.starts[n].attributes.get("data-test-selector", ""), tree.text(n)) for n in tree.find("td", None, *tree.below(row))]
            kind = next((k for k in STATS_KINDS if cells and k in cells[0][0]), None)
            for selector, value in cells[1:]:
                yield {"kind": kind, "name": cells[0][1], "measure": selector.removeprefix("RC-").removesuffix("__row"), "value": value}


def element_rows(tree: Tree) -> Iterator[dict]:
    for n, tag in enumerate(tree.tags):
        yield {"n": n, "parent": tree.parents[n], "after": tree.ends[n], "tag": tag, "attributes": list(tree.starts[n].attributes.items()), "own": tree.own_text(n)}


def _parsed(pages: DataFrame, key: str, html: str, schema: pa.Schema, ddl: str, rows_of: Callable[[str], Iterator[dict]], step: int = 1024) -> DataFrame:
    """Rows of pages, with the page's key in front; a page is read in its own step, and rows, of however many pages, are given on in batches of ``step``."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for i, page in enumerate(batch.column(1)):
                page = page.as_py()
                for row in rows_of(page) if page else ():
                    found.append(row)
                    owners.append(i)
                    if len(found) == step:
                        yield _batch(found, batch.column(0), owners, schema)
                        found, owners = [], []
            if found:
                yield _batch(found, batch.column(0), owners, schema)

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, f"`{key}` {kind}, {ddl}")


def _batch(rows: list[dict], keys: pa.Array, owners: list[int], schema: pa.Schema) -> pa.RecordBatch:
    columns = [keys.take(pa.array(owners))] + [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, names=["key", *schema.names])


def _text_columns(names: list[str]) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.string()) for n in names]), ", ".join(f"`{n}` string" for n in names)


def elements(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """One row for each element of each page: n, parent (-1 for none), after (the first number past its descendants), tag, attributes, own text.

    Null and empty pages have no elements; repeated keys are read each.
    """
    schema = pa.schema([("n", pa.int32()), ("parent", pa.int32()), ("after", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("own", pa.string())])
    return _parsed(pages, key, html, schema, "n int, parent int, after int, tag string, attributes map<string,string>, own string", lambda page: element_rows(Tree(page)))


def race_texts(pages: DataFrame, key: str = "url", html: str = "html", step: int = 1024) -> DataFrame:
    """The race's fields of each result page and ``runners``, an array of theirs, all as text; a field that is not there is null.

    ``rows`` is the page's number of runner rows. A page of more than ``step`` runners has a row for each so many of them.
    """
    kind = pages.select(key).schema[0].dataType.simpleString()
    struct, (schema, ddl) = pa.struct([(c, pa.string()) for c in RUNNER_COLUMNS]), _text_columns(RACE_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            races, owners, ends, runners = [], [], [0], []

            def made(keys=batch.column(0)) -> pa.RecordBatch:
                columns = [pa.array(c, pa.string()) for c in zip(*runners, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(struct)))
                flat = _batch(races, keys, owners, schema)
                return pa.RecordBatch.from_arrays([*flat.columns, lists], names=[*flat.schema.names, "runners"])

            for i, page in enumerate(batch.column(1)):
                page = page.as_py()
                race, rows = page_runners(page) if page else ({}, [])
                for a in range(0, len(rows), step):
                    runners += rows[a : a + step]
                    races.append(race)
                    owners.append(i)
                    ends.append(len(runners))
                    if len(runners) >= step:
                        yield made()
                        races, owners, ends, runners = [], [], [0], []
            if runners:
                yield made()

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, f"`{key}` {kind}, {ddl}, runners array<struct<{', '.join(f'{c}: string' for c in RUNNER_COLUMNS)}>>")


def runner_texts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """One row a runner of each result page, all fields as text; a field that is not there is null. ``rows`` is the page's number of runner rows."""
    return race_texts(pages, key, html).select(F.col(key), *RACE_COLUMNS, F.inline("runners"))


def stats_texts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """One row for each measure of each name in the statistics tables of pages."""
    return _parsed(pages, key, html, *_text_columns(["kind", "name", "measure", "value"]), lambda page: stats_rows(Tree(page)))


def pedigree_texts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """One row for each pedigree of each page."""

    def rows(page: str) -> Iterator[dict]:
        tree = Tree(page)
        for row in tree.find(*PEDIGREE_ROW):
            for cell in tree.find("td", None, *tree.below(row)):
                yield pedigree_of(tree, cell)

    return _parsed(pages, key, html, *_text_columns(PEDIGREE_FIELDS), rows)
