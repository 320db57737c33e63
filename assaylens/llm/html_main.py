"""Main text of web pages, by wrappers inferred per host.

A wrapper is a regular expression without unions that all pages of a host fit: tags, text
slots, repeated groups and optional groups. A page alone is a wrapper once its repetitions
are folded. Two wrappers are aligned, and mismatches are resolved as they come up: a group
that stands once here and repeatedly there becomes repeated, what stands on one side only
becomes optional, and text that differs becomes a slot, while text that never differs
stays a literal of the template.

Pages are folded where they are read and summed up by structure, so a host with a third
of all pages sends a few structures per task. These are aligned in rounds of at most
about ``FAN_IN`` per group, until few wrappers per host are left: one, unless pages of
different kinds would make it longer than ``NODES``. A page is then aligned with the one
of its host's wrappers that is most like it, a very long page piece by piece, and the text of its slots is taken, of those inside the article
if the page has one. What a page alone has, and all of the few pages of a small host, is
a slot. A page that does not fit gets the roles of what does fit and its own structure
for the rest.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import ascii_lower, stored

FAN_IN = 32
PAGES = 3  # different pages that must agree on a text before it is a literal
NODES = 400  # nodes of a wrapper; structures that would take it further get one of their own
INSIDE = 6  # the same for a text in an article, as pages of a series may begin alike
LONGEST = 4 * NODES  # nodes of a folded page that are aligned at once; longer ones are aligned in pieces

# fixed values: elements of HTML by what they do to the text
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object select button".split())
VOID = frozenset("area base br col embed hr input link meta param source track".split())
IMPLIED = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup".split())
# elements of implied end that the start of another one ends as well
ENDED_BY = {
    "dt": frozenset(("dd",)),
    "dd": frozenset(("dt",)),
    "td": frozenset("th tr tbody thead tfoot".split()),
    "th": frozenset("td tr tbody thead tfoot".split()),
    "tr": frozenset("tbody thead tfoot".split()),
    "thead": frozenset("tbody tfoot".split()),
    "tbody": frozenset("thead tfoot".split()),
    "tfoot": frozenset("tbody thead".split()),
    "colgroup": frozenset("tr tbody thead tfoot".split()),
    "p": IMPLIED
    | frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre search section summary table ul".split()
    ),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dl table".split())  # what an implied end does not reach beyond
BOILERPLATE = frozenset("nav aside form footer menu dialog head".split())
MAIN = frozenset("article main".split())
# fixed values: words in class, id and role that mark what is not the article
ASIDE_WORDS = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|"
    r"cookies?|consent|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|"
    r"comments?|commentlist|disqus|replies|respond|widget|toolbar|pagination|complementary|contentinfo"
)
# fixed values: words that do so alone or beside words of place only, as in site-header, not in article-header
ALONE_WORDS = frozenset("side header alert search notice notices login".split())
PLACES = frozenset(
    "site top page global main left right bar box form area wrap wrapper container block panel inner column col "
    "message 0".split()
)
# fixed values: names that tell a state or a subject of what is around them, as has-sidebar or comments-open do
QUALIFIERS = frozenset("has with no without is not category tag topic".split())
STATES = frozenset("open closed enabled disabled fixed on off".split())
# fixed values: what is no main text even if article elements are in it
OTHER_TEXTS = re.compile(r"comments?|commentlist|disqus|reply|replies|respond|related|recommended|ads?|advert\w*")
# elements that end where these open, if the page never ends them
UNENDED = frozenset("article main h1".split())
UNENDED_MENU = UNENDED | frozenset("h2 p section".split())
LANDMARKS = frozenset("article main h1 header nav footer".split())  # a form with one is around a page
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.IGNORECASE)
_ID = re.compile(r"(?:^|(?<=\s))id\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", re.IGNORECASE)


_CLOSING = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.IGNORECASE) for n in RAW}


# ---------------------------------------------------------------- reading a page


@dataclass
class Token:
    """An opening or closing tag, or a block of text."""

    name: str  # "" for text
    closing: bool = False
    marks: str = ""
    text: str = ""
    named: str = ""  # the marks without what tells single headings and paragraphs apart

    @property
    def key(self) -> str:
        if not self.name:
            return "#"
        return f"{'/' if self.closing else ''}{self.name}{'.' + self.named if self.named else ''}"


def tokens(page: str | None) -> list[Token]:
    """Block-level tags and the texts between them; white space is single, ends are trimmed."""
    page = page or ""
    out: list[Token] = []
    words: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append(Token("", text=text))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            words.append(page[at:])
            break
        words.append(page[at:start])
        m = _PIECE.match(page, start)
        if m is None:  # a sign, not a tag
            words.append("<")
            at = start + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or name in INLINE:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing:
                at = _close(page, name, at)
            continue
        flush()
        if name == "br":
            continue
        attributes = (m[3] or m[6] or "") if not closing else ""
        marks = named = _marks(attributes)
        if marks and (name in IMPLIED or name in HEADINGS):
            named = _marks(_ID.sub(" ", attributes))
        out.append(Token(name, closing, marks, named=named))
    flush()
    return out


def _marks(attributes: str) -> str:
    found = _MARKS.findall(attributes)
    return re.sub(r"\d+", "0", " ".join(sorted(" ".join(x for f in found for x in f if x).lower().split())))


def _close(page: str, name: str, at: int) -> int:
    """Where an element ends whose content is no text.

    A script, style sheet, title or text area that never ends takes the rest of the page,
    other elements that never end take nothing.
    """
    m = _CLOSING[name].search(page, at)
    if m:
        return m.end()
    return len(page) if name in ("script", "style", "title", "textarea") else at


# ---------------------------------------------------------------- wrappers


@dataclass
class Node:
    """A tag, a text, a repeated group (+) or an optional one (?)."""

    kind: str
    key: str = ""
    body: list[Node] = field(default_factory=list)
    # hashes of the texts that all pages have here, each with up to INSIDE different pages
    texts: dict[int, tuple[int, ...]] = field(default_factory=dict)
    at: list[tuple[int, int]] = field(default_factory=list)  # tokens of a page and their hashes, while one is read

    @property
    def low(self) -> int:
        return min(self.texts, default=0)

    @property
    def high(self) -> int:
        return max(self.texts, default=-1)

    def sign(self) -> str:
        if self.kind in "+?":
            inner = "\x1f".join(n.sign() for n in self.body)
            return f"+({inner})" if self.kind == "+" else inner
        return self.key

    def dump(self) -> list:
        if self.kind in "+?":
            return [self.kind, [n.dump() for n in self.body]]
        return [self.kind, self.key] if self.kind == "t" else [self.kind, *([h, *p] for h, p in sorted(self.texts.items()))]


def load(data: list) -> Node:
    """A node from its JSON form."""
    if data[0] in "+?":
        return Node(data[0], body=[load(d) for d in data[1]])
    if data[0] == "t":
        return Node("t", data[1])
    return Node("#", "#", texts={h: tuple(pages) for h, *pages in data[1:]})


def _join(a: Node, b: Node, within: bool = False) -> Node:
    """Two nodes of equal sign as one; within a page all texts stay, of two pages those of both."""
    if a.kind == "#":
        kept = a.texts.keys() | b.texts.keys() if within else a.texts.keys() & b.texts.keys()
        texts = {h: tuple(sorted({*a.texts.get(h, ()), *b.texts.get(h, ())})[:INSIDE]) for h in kept}
        return Node("#", "#", [], texts, a.at + b.at)
    if a.kind == "t":
        return Node("t", a.key)
    if a.kind == "?" or b.kind == "?":
        left = a.body if a.kind == "?" else [a]
        right = b.body if b.kind == "?" else [b]
        return Node("?", body=[_join(x, y, within) for x, y in zip(left, right, strict=True)])
    return Node("+", body=[_join(x, y, within) for x, y in zip(a.body, b.body, strict=True)])


_REPEAT = re.compile(r"(.{1,12}?)\1+", re.DOTALL)


def fold(nodes: list[Node], passes: int = 3) -> list[Node]:
    """Repetitions, the shortest first, as repeated groups."""
    for _ in range(passes):
        codes: dict[str, str] = {}
        line = "".join(codes.setdefault(n.sign(), chr(0x100 + len(codes))) for n in nodes)
        out: list[Node] = []
        last = 0
        for m in _REPEAT.finditer(line):
            size = len(m[1])
            out += nodes[last : m.start()]
            body = nodes[m.start() : m.start() + size]
            for k in range(m.start() + size, m.end(), size):
                body = [_join(x, y, True) for x, y in zip(body, nodes[k : k + size], strict=True)]
            if size == 1 and body[0].kind == "+":
                out += body
            elif size == 1 and body[0].kind == "t":
                out += body  # a tag repeated with nothing in it
            else:
                out.append(Node("+", body=body))
            last = m.end()
        if not last:
            break
        nodes = out + nodes[last:]
    return nodes


def own_wrapper(page: list[Token], kept: list[tuple[int, bool]] | None = None) -> list[Node]:
    """The wrapper of one page; ``kept`` is its outline, if that is known.

    Pages with the same text, template and all, are one page however often they come.
    """
    nodes = []
    number = xxhash.xxh64_intdigest(main_text(page, set(), kept)) >> 1
    for k, token in enumerate(page):
        if token.name:
            # ends that may be left out tell nothing
            if not token.closing or token.name not in IMPLIED:
                nodes.append(Node("t", token.key))
        else:
            h = xxhash.xxh64_intdigest(token.text) >> 1
            nodes.append(Node("#", "#", [], {h: (number,)}, [(k, h)]))
    return fold(nodes)


def _grouped(nodes: list[Node], other: list[Node]) -> list[Node]:
    """Members that stand in a row like a group of the other wrapper, as that group."""
    for group in [n for n in other if n.kind in "+?"]:
        body = [n.sign() for n in group.body]
        out, k = [], 0
        signs = [n.sign() for n in nodes]
        while k < len(nodes):
            if signs[k : k + len(body)] == body and (len(body) > 1 or group.kind == "+"):
                out.append(Node("+" if group.kind == "+" else "?", body=nodes[k : k + len(body)]))
                k += len(body)
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def pairs(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node], list[tuple[str, int, int, int, int]]]:
    """Both wrappers with groups made alike, and the steps that turn the first into the second."""
    a, b = _grouped(a, b), _grouped(b, a)
    # two groups in a row that are now the same one
    a, b = fold(a, 1), fold(b, 1)
    matcher = SequenceMatcher(None, [n.sign() for n in a], [n.sign() for n in b], autojunk=False)
    return a, b, matcher.get_opcodes()


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """A wrapper that the pages of both fit."""
    a, b, steps = pairs(a, b)
    out: list[Node] = []
    for step, a0, a1, b0, b1 in steps:
        if step == "equal":
            out += [_join(x, y) for x, y in zip(a[a0:a1], b[b0:b1], strict=True)]
            continue
        for part in (a[a0:a1], b[b0:b1]):
            plain: list[Node] = []
            for n in part:
                if n.kind == "?":
                    out += [Node("?", body=plain)] * bool(plain) + [n]
                    plain = []
                else:
                    plain.append(n)
            out += [Node("?", body=plain)] * bool(plain)
    return out


def size(nodes: list[Node]) -> int:
    """Nodes of a wrapper, those of groups included."""
    return sum(1 + size(n.body) for n in nodes)


def _alike(a: set[str], b: set[str]) -> float:
    """The share of nodes that two wrappers have in common."""
    return len(a & b) / (len(a | b) or 1)


def _place(out: list[list[Node]], w: list[Node]) -> None:
    """Align a wrapper with the nearest of some that it fits, or add it to them."""
    signs = {n.sign() for n in w}
    # the sort is stable: of equally near ones the first
    for k in sorted(range(len(out)), key=lambda k: -_alike(signs, {n.sign() for n in out[k]})):
        grown = align(out[k], w)
        if size(grown) <= max(NODES, size(out[k]), size(w)):
            out[k] = grown
            return
    out.append(w)


def families(wrappers: list[list[Node]]) -> list[list[Node]]:
    """As few wrappers as hold many within NODES; the order of the input does not matter."""
    out: list[list[Node]] = []
    for w in sorted(wrappers, key=lambda w: (len(w), [n.sign() for n in w], json.dumps([n.dump() for n in w]))):
        _place(out, w)
    return out


def merge(wrappers: list[list[Node]]) -> list[Node]:
    """The first wrapper for many; the only one if they fit into one."""
    return families(wrappers)[0]


def pieces(own: list[Node]) -> list[list[Node]]:
    """A page's wrapper in stretches that can be aligned."""
    return [own[k : k + LONGEST] for k in range(0, len(own), LONGEST)]


def nearest(
    known: list[tuple[list[Node], set[str]]], own: list[Node], inside: Set[int] = frozenset()
) -> set[int]:
    """Tokens of a page that are literals of those of its host's wrappers that are nearest to its pieces.

    ``inside`` are those in an article, which more pages must agree on.
    """
    found: set[int] = set()
    for piece in pieces(own) if known else ():
        signs = {n.sign() for n in piece} if len(known) > 1 else set()
        wrapper, _ = max(known, key=lambda w: _alike(signs, w[1]))
        found |= roles(wrapper, piece, inside)
    return found


def roles(wrapper: list[Node], own: list[Node], inside: Set[int] = frozenset()) -> set[int]:
    """Tokens of a page that are literals of its host's wrapper."""
    a, b, steps = pairs(wrapper, own)
    found: set[int] = set()

    def walk(x: Node, y: Node) -> None:
        if x.kind == "?" or y.kind == "?":
            left = x.body if x.kind == "?" else [x]
            right = y.body if y.kind == "?" else [y]
        elif y.kind == "#":
            found.update(k for k, h in y.at if len(x.texts.get(h, ())) >= (INSIDE if k in inside else PAGES))
            return
        else:
            left, right = x.body, y.body
        for p, q in zip(left, right, strict=True):
            walk(p, q)

    for step, a0, a1, b0, _ in steps:
        if step == "equal":
            for k in range(a1 - a0):
                walk(a[a0 + k], b[b0 + k])
    return found


# ---------------------------------------------------------------- the article


def main_text(page: list[Token], literals: Set[int], kept: list[tuple[int, bool]] | None = None) -> str:
    """The texts of the article in page order, joined by one space.

    The text is that of the slots, so literals of the template are left out, as is what
    the outline leaves out. If there are slots in an article or main element, only those
    count, else all, whatever their length.
    """
    slots = [(k, inside) for k, inside in (outline(page) if kept is None else kept) if k not in literals]
    marked = [k for k, inside in slots if inside]
    return " ".join(page[k].text for k in marked or [k for k, _ in slots])


def outline(page: list[Token]) -> list[tuple[int, bool]]:
    """The texts outside boilerplate, each with whether it stands in an article or main element.

    Boilerplate are elements by their kind or by words of their class, id or role. Those
    that the page never ends do not reach past the start of an article. A form around a
    page is none, and if the only articles of a page stand in elements marked by their
    class, those marks do not count, but for comments, related articles and adverts.
    """
    walk = _Walk(page)
    plain, unended = walk.forms, walk.unended
    if plain or unended:
        walk = _Walk(page, plain, unended)
    if walk.around and not any(inside for _, inside in walk.kept):
        around = {k for k in walk.around if page[k].name not in BOILERPLATE and not _other(page[k].marks)}
        walk = _Walk(page, plain | around, unended)
    return walk.kept


class _Walk:
    """One way through a page.

    ``plain`` are openings of elements that are no boilerplate whatever they look like,
    ``unended`` those of boilerplate that the page never ends.
    """

    def __init__(self, page: list[Token], plain: Set[int] = frozenset(), unended: Set[int] = frozenset()) -> None:
        self.kept: list[tuple[int, bool]] = []
        self.around: set[int] = set()  # openings of elements around an article or main element
        self.forms: set[int] = set()  # openings of forms around a page
        self.unended: set[int] = set()
        stack: list[tuple[str, bool, bool, int]] = []  # name, inside boilerplate, inside main, number
        for k, token in enumerate(page):
            if not token.name:
                if stack and stack[-1][0] == "head":
                    stack.pop()
                skip, inside = stack[-1][1:3] if stack else (False, False)
                if not skip:
                    self.kept.append((k, inside))
                continue
            if token.closing:
                self._end(stack, token.name)
                continue
            _implied(stack, token.name)
            if unended:
                for depth, (name, _, _, at) in enumerate(stack):
                    if at in unended and token.name in (UNENDED_MENU if name in ("nav", "menu", "header") else UNENDED):
                        del stack[depth:]
                        break
            if token.name in VOID:
                continue
            skip, inside = stack[-1][1:3] if stack else (False, False)
            own, main = _kind(token, inside)
            if k in plain:
                own = False
            if main and not own:
                for _, _, _, at in reversed(stack):
                    if at in self.around:
                        break
                    self.around.add(at)
            if token.name in LANDMARKS:
                self.forms.update(at for name, _, _, at in stack[-8:] if name == "form")
            if own and token.name not in IMPLIED:
                self.unended.add(k)
            stack.append((token.name, skip or own, inside or main, k))

    def _end(self, stack: list[tuple[str, bool, bool, int]], name: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                self.unended.discard(stack[depth][3])
                del stack[depth:]
                return
            if name in IMPLIED and _holds(stack[depth][0], name):
                return


def _kind(token: Token, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is an article or main element."""
    name = token.name
    if name in IMPLIED:
        return _aside(token.marks, inside), False
    if name == "article":
        other = any(OTHER_TEXTS.fullmatch(re.sub(r"-(?:body|item|0)$", "", m)) for m in token.marks.split())
        return other, True
    main = name == "main" or "main" in token.marks.split() and name not in ("body", "html")
    if name in ("body", "html", "main"):
        return False, main
    if name == "header":
        return not inside, main
    return name in BOILERPLATE or _aside(token.marks, inside), main


@lru_cache(100_000)
def _aside(marks: str, inside: bool) -> bool:
    """Whether words of class, id and role mark boilerplate; headers in an article are its own."""
    for mark in marks.split():
        parts = [p for p in re.split(r"[-_]+", mark) if p]
        if not parts or len(parts) > 1 and (parts[0] in QUALIFIERS or parts[-1] in STATES):
            continue
        if any(ASIDE_WORDS.fullmatch(p) for p in parts):
            return True
        alone = [p for p in parts if p in ALONE_WORDS]
        if alone and not (inside and alone == ["header"]) and all(p in ALONE_WORDS or p in PLACES for p in parts):
            return True
    return False


def _other(marks: str) -> bool:
    """Whether words of class, id and role mark what is no main text, articles in it included."""
    return any(OTHER_TEXTS.fullmatch(p) for p in re.split(r"[-_\s]+", marks))


def _holds(outer: str, name: str) -> bool:
    """Whether an end that may be left out stays inside an open element."""
    return outer in LISTS or outer in ("td", "th") and name not in ENDED_BY["td"] | {"td"}


def _implied(stack: list[tuple[str, bool, bool, int]], name: str) -> None:
    """Elements whose end may be left out end where one opens that they cannot hold."""
    if stack and stack[-1][0] == "head" and name not in VOID:
        stack.pop()
    found = len(stack)
    for depth in range(len(stack) - 1, -1, -1):
        outer = stack[depth][0]
        if outer in IMPLIED and (outer == name or name in ENDED_BY.get(outer, ())):
            found = depth
        elif outer not in ("div", "address") and outer not in IMPLIED or _holds(outer, name):
            break
        elif outer in ("div", "address") and name not in ("li", "dd", "dt"):
            break
    del stack[found:]


# ---------------------------------------------------------------- on Spark


def host(url: Column) -> Column:
    """The host of a URL; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct structures of a batch, each with its texts summed up."""
    for batch in batches:
        seen: dict[tuple[str, str], list[Node]] = {}
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for own in pieces(own_wrapper(tokens(page.as_py()))):
                for n in _texts(own):
                    n.at = []
                key = (name, "\x1e".join(n.sign() for n in own))
                known = seen.get(key)
                seen[key] = [_join(x, y) for x, y in zip(known, own, strict=True)] if known else own
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in seen], pa.string()),
                pa.array([xxhash.xxh64_intdigest(s) >> 1 for _, s in seen], pa.int64()),
                pa.array([json.dumps([n.dump() for n in w]) for w in seen.values()], pa.string()),
            ],
            names=["host", "shape", "wrapper"],
        )


def _texts(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        if n.kind == "#":
            yield n
        yield from _texts(n.body)


def _merge_group(group: pd.DataFrame) -> pd.DataFrame:
    merged = families([[load(d) for d in json.loads(w)] for w in group["wrapper"]])
    written = [json.dumps([n.dump() for n in w]) for w in merged]
    return pd.DataFrame(
        {
            "host": [group["host"].iloc[0]] * len(merged),
            "shape": [xxhash.xxh64_intdigest(w) >> 1 for w in written],
            "wrapper": written,
        }
    )


def _useful(written: pd.Series) -> pd.Series:
    """Whether wrappers have literals; others tell nothing about a page."""
    return written.map(lambda w: any(len(p) >= PAGES for d in json.loads(w) for n in _texts([load(d)]) for p in n.texts.values()))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper) for every host: the list of its wrappers that have literals, stored.

    In each round the structures of a host are dealt into groups of about ``fan_in`` by
    their hash and each group is merged. A host is done once it has one wrapper, or its
    wrappers were all in one group, or a round leaves more than nine in ten of them.
    """
    source = pages.select(host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    left = stored(source.mapInArrow(_structures, "host string, shape bigint, wrapper string"), "structures")
    before = None
    done: DataFrame | None = None
    while True:
        sizes = left.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if before is not None:
            sizes = sizes.join(before.withColumnRenamed("sized", "host").withColumnRenamed("n", "was").drop("ready"), "host")
        else:
            sizes = sizes.withColumn("was", F.lit(None).cast("bigint"))
        ready = (F.col("n") <= 1) | F.coalesce(
            (F.col("was") <= fan_in) | (F.col("n") > F.col("was") * 0.9), F.lit(False)
        )
        sizes = stored(sizes.select(F.col("host").alias("sized"), "n", ready.alias("ready")), "sizes")
        joined = left.join(sizes, F.col("host") == F.col("sized"))
        ended = joined.where("ready").select("host", "wrapper")
        done = ended if done is None else done.unionByName(ended)
        if sizes.where("NOT ready").isEmpty():
            break
        groups = F.ceil(F.col("n") / fan_in)
        dealt = joined.where("NOT ready").select(
            "host", "shape", "wrapper", F.pmod(F.xxhash64("shape", "wrapper"), groups).alias("group")
        )
        left = stored(
            dealt.groupBy("host", "group").applyInPandas(_merge_group, "host string, shape bigint, wrapper string"),
            "wrappers",
        )
        before = sizes
    useful = F.pandas_udf(_useful, "boolean")
    listed = F.array_sort(F.collect_list(F.when(F.col("useful"), F.col("wrapper"))))
    whole = done.withColumn("useful", useful("wrapper")).groupBy("host").agg(
        F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("wrapper")
    )
    return stored(whole, "host-wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[tuple[list[Node], set[str]]]] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            read = tokens(page.as_py())
            if wrapper is not None and wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                loaded = [[load(d) for d in w] for w in json.loads(wrapper)]
                known[wrapper] = [(w, {n.sign() for n in w}) for w in loaded]
            kept = outline(read)
            literals: set[int] = set()
            if wrapper and known[wrapper]:
                inside = {k for k, article in kept if article}
                literals = nearest(known[wrapper], own_wrapper(read, kept), inside)
            texts.append(main_text(read, literals, kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"]
        )


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """For each page: id, url, text and n_chars (code points).

    NULL and empty pages, and pages without an article, have an empty text. Pages without
    a host share one wrapper. Every row is read for itself, so repeated ids and rows do
    not matter; no pages give no rows. Other columns are not looked at.
    """
    found = wrappers(pages, url_col, html_col)
    source = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
        host(F.col(f"`{url_col}`")).alias("host"),
    )
    same = found.withColumnRenamed("host", "wrapper_host")
    joined = source.join(same, F.col("host") == F.col("wrapper_host"), "left")
    texts = joined.select("id", "url", "html", "wrapper").mapInArrow(_extract, "id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
