"""Main text of web pages by wrapper inference: union-free regular expressions over token streams, one per host.

1. Each page becomes a pattern: its elements in order, each run of text as a slot; neighbours that repeat (paragraphs, list items, three
   containers or more alike) are one repeated group. Inline markup belongs to the text. A slot knows its characters, those in links,
   and the least hashes of its texts and of the pages that hold it.
2. The distinct patterns of a host are aligned one after the other by longest common subsequences: what only one side has becomes optional,
   what a mismatch leaves beside its like becomes repeated, slots that meet add up what they know. The outcome, one pattern
   without unions, is the host's wrapper. Many patterns are aligned in portions and the partial wrappers after them, so
   no host has to fit in one task.
3. The wrapper tells which of its slots hold the main text: a slot whose text never varies is the template's, one made of links is a menu,
   one in an article is main text. Words of classes only break ties: they exclude a container unless it holds most of the text.
4. Each page is matched against its host's wrapper, as a regular expression, so every run of text gets a slot by its position.
   The texts of the chosen slots, in page order, are the result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate, repeat

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.llm.joins import sized
from corvane.llm.url_filter import host_of
from corvane.session import cut, give_back, workers_can_import

#: Patterns or partial wrappers that are aligned in one group, on average.
PORTION = 200
#: Elements nested deeper aren't told apart by the alignment: their texts count as slots of their ancestor at this depth. What
#: they are (menu, article) is kept at any depth.
DEEPEST = 160
#: Least hashes of texts and pages that a slot keeps, so that up to so many different ones are counted exactly.
LEAST = 3
#: Patterns that a task adds up before it sends them on.
_HELD = 20_000
#: Bytes of bit vectors that an alignment holds; longer sequences are halved first.
_VECTORS = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {"script", "style", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "title", "textarea", "select", "button", "noframes", "audio", "video", "datalist"}
_FOREIGN = {"svg", "math"}  # only these close themselves by a slash
_INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br nobr picture source data ruby rt rp rb".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_CONTENT = {"article", "main"}
_NOT_MAIN = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "search"}
_NOT_MAIN_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
_NOT_MAIN_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus replies respond responses feedback sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer footnav masthead topbar toolbar pagination pager widget".split())
#: Words that say nothing of their own beside such a word: `ad-slot`, but not `social-history`.
_BESIDE = set("area bar bars block bottom box button buttons card cards col column container content count counts field fields form group header icon icons inner item items js left line link links list main nav outer page pane panel placeholder post posts primary reader readers right row secondary section site slot slots space text title top unit user users view wrap wrapper zone".split())
#: Adverts are told even on elements that aren't containers.
_ADVERT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored"}
#: Reader comments and adverts are often articles too.
_NOT_AN_ARTICLE = {"comment", "reply", "ad", "advert", "advertisement", "sponsored", "promo"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "article", "main", "header", "center", "details", "hgroup", "#root"}


@lru_cache(1 << 14)
def _signature(tag: str, attributes: str) -> str:
    """Tag, marks, role and the words of class, id and itemprop: `div!.ad`; digits tell pages apart, not templates.

    Marks: `*` the attributes say main text, `-` a role says it isn't, `!` words say it isn't, `^` they say header.
    """
    words, marks = [], set()
    for m in _ATTRIBUTE.finditer(attributes):
        value, name = m[2] or m[3] or m[4] or "", m[1].lower()
        own = [w.lower() for w in _WORDS.findall(value)]
        words += [("role-" if name == "role" else "") + w for w in own]
        if name == "role":
            marks |= ({"*"} if set(own) & {"main", "article"} else set()) | ({"-"} if set(own) & _NOT_MAIN_ROLES else set())
            continue
        for one in value.split():
            said = {w.lower() for w in _WORDS.findall(one)}
            if said >= {"article", "body"}:
                marks.add("*")
            told = _NOT_MAIN_WORDS if tag in _CONTAINERS else _ADVERT_WORDS
            if said & told and said <= _NOT_MAIN_WORDS | _BESIDE:
                marks.add("!")
            if "header" in said and said <= _BESIDE | _NOT_MAIN_WORDS:
                marks.add("^")
        if tag in _CONTENT and set(own) & _NOT_AN_ARTICLE:
            marks.add("!")
    return ".".join([tag + "".join(sorted(marks)), *dict.fromkeys(words)])


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>", re.I)


def parse(html: str | None) -> list:
    """The page as nested [key, children]; a child (text, link characters) is a run of text, white space made single, not empty."""
    root: list = ["#root", []]
    stack, tags, places = [root], ["#root"], [0]
    opened: dict[str, list[int]] = {}  # by tag, where in the stack it is open
    run: list[str] = []
    links, in_link = 0, False
    at, html = 0, html or ""

    def flush() -> None:
        nonlocal run, links
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                stack[-1][1].append((text, min(links, len(text))))
        run, links = [], 0

    def close(n: int) -> None:
        for tag in tags[n:]:
            opened[tag].pop()
        del stack[n:], tags[n:], places[n:]

    def last(names: set[str]) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    while True:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            run.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), m[1] == "/"
        if tag in _INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                run.append("\n")
            continue
        if tag in _RAW and not ends:  # what it holds is no text, but it ends no block either
            if tag not in _FOREIGN or not m[3].endswith("/"):
                end = _raw_end(tag).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in _VOID and tag != "hr":
            continue
        flush()
        if ends:
            if opened.get(tag):
                close(opened[tag][-1])
            in_link = False
            continue
        if tag in _CLOSES_P and opened.get("p"):
            close(opened["p"][-1])
        if tag in _CLOSES and last(_CLOSES[tag]) > last(_SCOPES[tag]):
            close(last(_CLOSES[tag]))
        if tag in _VOID:
            continue
        if tag == "body" or tag == "html":
            continue
        node: list = [_signature(tag, m[3]), []]
        place_here = _step(places[-1], node[0])
        # beyond the cap a tag is still opened, so that its end tag closes it and no ancestor; its text goes to the ancestor
        if len(stack) < DEEPEST or place_here != places[-1]:
            stack[-1][1].append(node)
        else:
            node = stack[-1]
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
        tags.append(tag)
        places.append(place_here)
    flush()
    _refine(root)
    return root


def _refine(node: list) -> frozenset:
    """Tell elements without a class apart by what they hold: `div[p]` isn't `div[ul]`."""
    held = set()
    for kid in node[1]:
        if isinstance(kid, list):
            _refine(kid)
            held.add(_tag(kid[0]))
        else:
            held.add("#")
    if node[0] in ("div", "section", "td", "center", "table", "ul", "ol"):
        node[0] += "[" + ",".join(sorted(held)) + "]"
    return frozenset(held)


def _tag(key: str) -> str:
    return re.split(r"[.\[*!^-]", key, maxsplit=1)[0]


# A pattern is [key, repeated, optional, children, known]; the key of a text slot is "#", that of a repeated group of several the keys in
# brackets. known: of a slot [characters, of these in links, least hashes of texts, of pages], else None.

#: Elements of running text, whose neighbours repeat; two containers alike may be two places of the template.
_RUNNING = set("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre option figure".split())


def _collapse(items: list[list]) -> list[list]:
    """Tandem repeats of one, two or three items as repeated groups: of running text from two on, of others from four on."""
    for width in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(items):
            keys = [x[0] for x in items[i : i + width]]
            n = 1
            while len(keys) == width and items[i + n * width : i + (n + 1) * width] and [x[0] for x in items[i + n * width : i + (n + 1) * width]] == keys:
                n += 1
            if n < (2 if all(_tag(k) in _RUNNING or k == "#" for k in keys) else 4):
                out.append(items[i])
                i += 1
                continue
            group = items[i : i + width]
            for k in range(1, n):
                group = [align(a, b) for a, b in zip(group, items[i + k * width : i + (k + 1) * width])]
            out.append(_repeated(group))
            i += n * width
        items = out
    return items


def _repeated(group: list[list]) -> list:
    first = group[0]
    return [first[0], True, *first[2:]] if len(group) == 1 else ["(" + " ".join(x[0] for x in group) + ")", True, False, group, None]


def _least(a: list, b: list) -> list:
    return sorted({*a, *b})[:LEAST]


def _together(a: list | None, b: list | None) -> list | None:
    """What two slots that meet know."""
    if a is None or b is None:
        return a or b
    return [a[0] + b[0], a[1] + b[1], _least(a[2], b[2]), _least(a[3], b[3])]


def pattern(node: list, page: int = 0) -> list:
    """The pattern of a parsed element of a page."""
    kids = [["#", False, False, [], [len(k[0]), k[1], [number((k[0],))], [page]]] if isinstance(k, tuple) else pattern(k, page) for k in node[1]]
    return [node[0], False, False, _collapse(kids), None]


def align(a: list, b: list) -> list:
    """The least pattern of both, whose keys are the same."""
    return [a[0], a[1] or b[1], a[2] or b[2], _align(a[3], b[3]), _together(a[4], b[4])]


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by bit vectors (Hyyrö 2004)."""
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    n, m = len(x) - lo - hi, len(y) - lo - hi
    inner = _common(x[lo : lo + n], y[lo : lo + m]) if n and m else []
    return [*((k, k) for k in range(lo)), *((i + lo, j + lo) for i, j in inner), *((len(x) - k, len(y) - k) for k in range(hi, 0, -1))]


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """Bit vectors after each of y: a zero bit is where the common subsequence with so much of x grows."""
    where: dict[str, int] = {}
    for i, k in enumerate(x):
        where[k] = where.get(k, 0) | 1 << i
    full = (1 << len(x)) - 1
    v, out = full, []
    for k in y:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    if len(y) > 1 and len(x) * len(y) > 8 * _VECTORS:  # Hirschberg: the best place to cut x where y is halved
        half = len(y) // 2
        ends = lambda v: [0, *accumulate(1 - (v >> i & 1) for i in range(len(x)))]
        left, right = ends(_last(x, y[:half])), ends(_last(x[::-1], y[half:][::-1]))[::-1]
        at = max(range(len(x) + 1), key=lambda i: left[i] + right[i])
        return common(x[:at], y[:half]) + [(i + at, j + half) for i, j in common(x[at:], y[half:])]
    rows = _lengths(x, y)
    out, col, row = [], len(x), len(y)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                out.append((col, row))
    return out[::-1]


def _last(x: list[str], y: list[str]) -> int:
    where: dict[str, int] = {}
    for i, k in enumerate(x):
        where[k] = where.get(k, 0) | 1 << i
    full = v = (1 << len(x)) - 1
    for k in y:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _align(x: list[list], y: list[list]) -> list[list]:
    """What a longest common subsequence of keys matches is aligned; the rest becomes optional."""
    out, i, j = [], 0, 0
    optional = lambda p: [p[0], p[1], True, *p[3:]]
    for a, b in [*common([p[0] for p in x], [p[0] for p in y]), (len(x), len(y))]:
        out += [optional(p) for p in x[i:a]] + [optional(p) for p in y[j:b]]
        if a < len(x):
            out.append(align(x[a], y[b]))
        i, j = a + 1, b + 1
    return _collapse_same(out)


def _collapse_same(items: list[list]) -> list[list]:
    """Neighbours with one key of which a mismatch left one over, or that repeat, are one repeated group."""
    out: list[list] = []
    for x in items:
        if out and out[-1][0] == x[0] and (out[-1][1] or out[-1][2] or x[1] or x[2]):
            both = align(out[-1], x)
            out[-1] = [both[0], True, out[-1][2] and x[2], *both[3:]]
        else:
            out.append(x)
    return out


def expression(p: list) -> str:
    """A pattern as a regular expression to read."""
    inner = "#" if p[0] == "#" else ("".join(map(expression, p[3])) if p[0][0] == "(" else f"<{p[0]}>" + "".join(map(expression, p[3])) + "</>")
    mark = "*" if p[1] and p[2] else "+" if p[1] else "?" if p[2] else ""
    return f"({inner}){mark}" if mark else inner


def slots(p: list, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    """(path, slot) of the text slots in order; path: the elements from the top, as (key, number of the element)."""
    for k, kid in enumerate(p[3]):
        if kid[0] == "#":
            yield path, kid
        else:
            yield from slots(kid, path if kid[0][0] == "(" else (*path, (kid[0], (*(path[-1][1] if path else ()), k, id(kid)))))


def texts(node: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path, text, link characters) of the page's runs of text in order."""
    for kid in node[1]:
        if isinstance(kid, tuple):
            yield path, *kid
        else:
            yield from texts(kid, (*path, kid[0]))


def number(path: tuple[str, ...]) -> int:
    h = xxhash.xxh64_intdigest("/".join(path).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _step(inside: int, key: str, words: bool = True) -> int:
    """place() of an element with this key in one at `inside`; words: whether marks by words of classes count."""
    if inside < 0:
        return -1
    head = re.split(r"[.\[]", key, maxsplit=1)[0]
    tag, marks = _tag(head), head[len(_tag(head)) :]
    if tag in _CONTENT or "*" in marks:
        return -1 if "!" in marks and words and tag in _CONTENT else 1
    if tag in _NOT_MAIN or "-" in marks or (tag == "header" and not inside):
        return -1
    if words and ("!" in marks or ("^" in marks and not inside)):
        return -1
    return inside


def place(path: tuple[str, ...]) -> int:
    """-1: not main text; 1: in an article; 0: neither is said by the elements around."""
    inside = 0
    for key in path:
        inside = _step(inside, key)
    return inside


def choose(wrapper: list) -> list[int]:
    """For each slot of a wrapper, in order: 1 main text in an article, 2 main text of pages without one, 0 not main text.

    The template's are slots with one text on LEAST different pages or more, while others of the kind vary as much; headings of an article are its own,
    and so is what makes up half of the articles' text or more.
    A slot outside of articles that is links for the most part is a menu. A container that only words exclude stays if it has half of the text or more.
    """
    own = list(slots(wrapper))
    out, groups = [0] * len(own), {1: [], 2: []}
    tied: dict[int, tuple] = {}
    for n, (path, slot) in enumerate(own):
        inside, by_words = 0, None
        for key, who in path:
            step = _step(inside, key)
            if step < 0:
                step = _step(inside, key, False)
                if step < 0:
                    inside = -1
                    break
                by_words = by_words or who
            inside = step
        chars, links, _, _ = slot[4]
        if inside < 0 or (not inside and 2 * links > chars):
            continue
        groups[1 if inside else 2].append(n)
        if by_words:
            tied[n] = by_words
    for kind, members in groups.items():
        varied = any(len(own[n][1][4][2]) >= LEAST for n in members)
        fixed = lambda n: len(own[n][1][4][3]) >= LEAST and len(own[n][1][4][2]) == 1 and not (kind == 1 and own[n][0] and _tag(own[n][0][-1][0]) in _HEADINGS)
        still = {n for n in members if varied and fixed(n)}
        chars = lambda some: sum(own[n][1][4][0] for n in some)
        if kind == 1 and 2 * chars(still) >= chars(members):  # a story that many pages tell under other titles is no template
            still = set()
        members = [n for n in members if n not in still]
        total = chars(members)
        held: dict[tuple, int] = {}
        for n in members:
            if n in tied:
                held[tied[n]] = held.get(tied[n], 0) + own[n][1][4][0]
        for n in members:
            if n not in tied or 2 * held[tied[n]] >= total:
                out[n] = kind
    return out


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Matcher:
    """A wrapper as a regular expression with numbered slots."""

    def __init__(self, wrapper: list):
        self.size = 0
        self.root = self._leaves(wrapper[3])

    def _leaves(self, items: list[list]) -> dict:
        """The items of an element in order, groups opened: keys, what each costs to pass over, where one may go back to, and what each holds."""
        keys, cost, back, inner = [], [], [], []

        def add(items: list[list], optional: bool) -> None:
            for key, repeated, own, kids, _ in items:
                at = len(keys)
                if key[0] == "(":
                    add(kids, optional or own)
                else:
                    keys.append(key)
                    cost.append(0 if optional or own else 1)
                    back.append(set())
                    if key == "#":
                        inner.append(self.size)
                        self.size += 1
                    else:
                        inner.append(self._leaves(kids))
                if repeated:
                    back[-1].add(at)

        add(items, False)
        where: dict[str, list[int]] = {}
        for k, key in enumerate(keys):
            where.setdefault(key, []).append(k)
        return {"cost": [0, *accumulate(cost)], "back": [sorted(b) for b in back], "inner": inner, "where": where}

    def slots_of(self, tree: list) -> list[int | None]:
        """The slot of each run of text of a page in order; None where the page isn't matched."""
        out: list[int | None] = []
        self._match(tree[1], self.root, out)
        return out

    def _match(self, kids: list, own: dict | None, out: list) -> None:
        """The match that leaves the fewest of the page's items over, then of the wrapper's that aren't optional."""
        found: list[int | None] = [None] * len(kids)
        if own is not None and kids:
            cost, back, where = own["cost"], own["back"], own["where"]
            left = len(cost) + 1  # an item of the page left over costs more than any of the wrapper's
            live: dict[int, int] = {0: 0}
            trail = []
            for kid in kids:
                after: dict[int, tuple[int, int, int | None]] = {}
                targets = where.get("#" if isinstance(kid, tuple) else kid[0], ())
                for at, c in live.items():
                    if at not in after or c + left < after[at][0]:
                        after[at] = (c + left, at, None)
                    for leaf in targets:
                        if leaf >= at:
                            d = c + cost[leaf] - cost[at]
                            for to in (leaf + 1, *back[leaf]):
                                if to not in after or d < after[to][0]:
                                    after[to] = (d, at, leaf)
                trail.append(after)
                live = {to: x[0] for to, x in after.items()}
                if len(live) > 4:  # one that is behind and dearer than another by what lies between can't win
                    best = min(live.values())
                    live = {to: c for to, c in live.items() if c <= best + len(cost)}
            end = min(live, key=lambda to: (live[to] + cost[-1] - cost[to], to))
            for k in range(len(kids) - 1, -1, -1):
                _, end, found[k] = trail[k][end]
        for kid, leaf in zip(kids, found):
            if isinstance(kid, tuple):
                out.append(own["inner"][leaf] if leaf is not None else None)
            else:
                self._match(kid[1], own["inner"][leaf] if leaf is not None else None, out)


def extract(html: str | None, matcher: Matcher | None, chosen: list[int] | None) -> str:
    tree = parse(html)
    found = list(texts(tree))
    which = matcher.slots_of(tree) if matcher else [None] * len(found)
    # what no slot takes is judged by its elements alone
    kinds = [chosen[w] if w is not None else {1: 1, 0: 2, -1: 0}[place(path)] for w, (path, _, _) in zip(which, found)]
    kind = 1 if 1 in kinds else 2
    return "\n\n".join(t for k, (_, t, _) in zip(kinds, found) if k == kind)


_READ = "host string, pattern string, of long, slot int, chars long, links long, texts array<long>, pages array<long>"


def _bare(p: list, known: list) -> list:
    """A pattern without what its slots know, which goes to a list in order."""
    if p[0] == "#":
        known.append(p[4])
    return [p[0], int(p[1]), int(p[2]), [_bare(k, known) for k in p[3]]]


def _known(p: list, known: Iterator[list]) -> list:
    """The inverse of _bare()."""
    return [p[0], bool(p[1]), bool(p[2]), [_known(k, known) for k in p[3]], next(known) if p[0] == "#" else None]


def _json(x: list) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) to the distinct patterns of each host: a row with the pattern, and one for each of its slots."""
    kinds = [("host", pa.string()), ("pattern", pa.string()), ("of", pa.int64()), ("slot", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("texts", pa.list_(pa.int64())), ("pages", pa.list_(pa.int64()))]
    held: dict[tuple, list] = {}

    def rows() -> pa.RecordBatch:
        out = []
        for (host, p), known in held.items():
            of = number((p,))
            out.append((host, p, of, -1, None, None, None, None))
            out += [(host, None, of, k, *x) for k, x in enumerate(known)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html")):
            html = html.as_py() or ""
            known: list = []
            key = (host.as_py(), _json(_bare(pattern(parse(html), number((html,))), known)))
            held[key] = [_together(a, b) for a, b in zip(held[key], known)] if key in held else known
        if len(held) >= _HELD:
            yield rows()
            held.clear()
    if held:
        yield rows()
    give_back()


def _fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    out: list | None = None
    for p, known in sorted(zip(group["pattern"], group["known"]), key=lambda x: x[0]):
        p = _known(json.loads(p), iter(json.loads(known)))
        out = p if out is None else align(out, p)
    known = []
    bare = _json(_bare(out, known))
    return pd.DataFrame({"host": [key[0]], "pattern": [bare], "known": [_json(known)]})


def infer(patterns: DataFrame) -> DataFrame:
    """Distinct (host, pattern, known) to one wrapper a host."""
    while True:
        sizes = patterns.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 1
        if most == 1:
            return patterns
        parts = patterns.join(sized(sizes, 64), "host").withColumn("portion", F.pmod(F.xxhash64("pattern"), F.ceil(F.col("n") / PORTION)))
        patterns = cut(parts.groupBy("host", "portion").applyInPandas(_fold, "host string, pattern string, known string"))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pattern, known, chosen): each host's wrapper, what its slots know, and which of them hold the main text."""
    workers_can_import(pages.sparkSession)
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_read, _READ)
    # a task's copies of a pattern are one row a slot already; those of different tasks are added up here
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, LEAST)
    summed = read.groupBy("host", "of", "slot").agg(F.max("pattern").alias("pattern"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), least("texts").alias("texts"), least("pages").alias("pages"))
    slot = F.struct("slot", F.to_json(F.array(F.col("chars"), F.col("links"))).alias("sums"), F.to_json("texts").alias("texts"), F.to_json("pages").alias("pages"))
    known = F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, slot))), lambda x: F.concat(F.lit("["), F.translate(x["sums"], "[]", ""), F.lit(","), x["texts"], F.lit(","), x["pages"], F.lit("]")))
    patterns = cut(summed.groupBy("host", "of").agg(F.max("pattern").alias("pattern"), F.concat(F.lit("["), F.array_join(known, ","), F.lit("]")).alias("known")).select("host", "pattern", "known"))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["chosen"] = [choose(_known(json.loads(p), iter(json.loads(k)))) for p, k in zip(b["pattern"], b["known"])]
            yield b

    return infer(patterns).mapInPandas(chosen, "host string, pattern string, known string, chosen array<int>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: page_id, url, text (its main text, blocks joined by an empty line) and n_chars.

    Null and empty html give an empty text. Null urls and urls without :// share the empty host. Null and repeated ids are rows of their own;
    an empty table gives an empty result; other columns are ignored. The pages are read twice and not shuffled, unless the
    wrappers of all hosts are too large to be broadcast.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    w = cut(wrappers(pages, url_col, html_col).select("host", "pattern", "chosen"))

    @F.pandas_udf(StringType())
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(256)
        def matcher(p: str) -> Matcher:
            return Matcher(_known(json.loads(p), repeat(None)))

        for html, p, chosen in batches:
            yield pd.Series([extract(x, matcher(q) if q else None, c) for x, q, c in zip(html, p, chosen)], index=html.index, dtype=object)
        give_back()

    out = own.join(sized(w, F.length("pattern") + 4 * F.size("chosen")), "host", "left").select("page_id", "url", of("html", "pattern", "chosen").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
