"""Main text of web pages by inferring a wrapper for each host.

A wrapper is a union-free regular expression over a page's elements and texts: elements in order, each once, optional
or repeated, text slots, and repeated groups. Pages of a host are aligned with its wrapper one after the other. Where
they differ, equal neighbours become a repeated element, a run of elements that comes again becomes a repeated group,
what one side lacks becomes optional, and texts that differ become a slot, while texts that are always the same stay
template text. The wrapper of a host then tells which of its elements holds the main text: from the page down, it is the
one in which most of the text lies that differs from page to page and isn't in links. Names and tags only weigh in. Each page
is matched with the wrapper to read that out.

Elements of one name are told apart by what they hold, only text, mostly links, or blocks, as many pages have no names at all.

Alignment combines: a task folds its pages into a wrapper per host, those are folded by (host, salt) and then by host, so
that a host with very many pages costs no task more than its own pages. Elements may lie in each other as deep as a page has
them: recursion is by plain Python calls, which take no C stack, and tasks lift the limit of their number.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nested calls that a task may make, some five for each level of a page.
CALLS = 5_000_000
#: A task hands on the wrappers it has so far when their JSON may have grown to about so many items.
ITEMS_KEPT = 500_000
TABLE_CELLS = 90_000  # longer lists are aligned by halves
SALTS = 64
BROADCAST_BYTES = 32 << 20
OPTIONAL, REPEATED = 1, 2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Fixed lists of HTML: elements by how they lie in the text, and what they are for.
RAW = frozenset("script style textarea noscript template iframe xmp noembed noframes title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = frozenset("ul ol dl table select root".split())
NOT_TEXT = frozenset(
    "head nav header footer aside form menu dialog button select option input textarea svg canvas audio video object math "
    "script style noscript template iframe title".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|articlebody|content|post|entry|story|main|maincontent)(?:$|[-_\s])", re.I)
NOT_TEXT_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|sidebar|menu|nav\w*|breadcrumbs?|"
    r"footer|header|masthead|comments?|repl(?:y|ies)|respond|disqus|share|sharing|social|related|newsletter|subscribe|signup|"
    r"popup|modal|overlay|login|search|widget|toolbar|pagination|pager|skip)(?:$|[-_\s\d])",
    re.I,
)


#: Elements whose name says how they lie in a text; all others are told apart by what they hold.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption hr body html".split())
#: How much more the text of an element counts whose tag or name says that it is the main one.
NAMED = 10
#: How much less template text counts: all pages of a host may be copies of one.
TEMPLATE = 0.1
#: An element is gone into as long as one inside holds this share of its text.
MOST = 0.6


class Node:
    __slots__ = ("label", "kids", "_key", "_text")

    def __init__(self, label: str):
        self.label, self.kids, self._key, self._text = label, [], None, None

    def text(self) -> tuple[int, int]:
        """Characters below, and those in links."""
        if self._text is None:
            parts = [k.text() if isinstance(k, Node) else (len(k[0].strip()), len(k[0].strip()) * k[1]) for k in self.kids]
            self._text = sum(p[0] for p in parts), sum(p[1] for p in parts)
        return self._text

    def key(self) -> str:
        """The label, and for most elements what they hold: text (T), mostly links (L) or blocks (B)."""
        if self._key is None:
            if self.label.partition(".")[0] in TEXT_LEVEL:
                self._key = self.label
            else:
                size, linked = self.text()
                holds = "L" if 2 * linked > size else "B" if any(isinstance(k, Node) for k in self.kids) else "T"
                self._key = f"{self.label}|{holds}"
        return self._key


def _label(tag: str, attributes: str) -> str:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = " ".join(found[k] for k in ("id", "class", "role") if found.get(k))
    names = re.sub(r"\d+", "0", html.unescape(names)).strip()
    return f"{tag}.{' '.join(names.split())}" if names else tag


def _deep() -> None:
    if sys.getrecursionlimit() < CALLS:
        sys.setrecursionlimit(CALLS)


def parse(page: str) -> Node:
    """The page's blocks and texts as a tree. Texts are (text, in a link); inline elements are looked through."""
    _deep()
    root = Node("root")
    stack, links, at, n = [root], 0, 0, len(page)
    tags = ["root"]  # of the stack's elements
    places: dict[str, list[int]] = {}

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            stack[-1].kids.append((piece, links > 0))
        elif piece:
            stack[-1].kids.append((" ", False))

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def close(names, scoped: bool) -> None:
        k = last(names)
        if not k or scoped and last(SCOPES) > k:
            return
        for t in tags[k:]:
            places[t].pop()
        del stack[k:], tags[k:]

    def push(tag: str, attributes: str) -> None:
        node = Node(_label(tag, attributes))
        stack[-1].kids.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        tags.append(tag)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or not m[0].endswith(">"):
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID:
                close({tag}, False)
            elif tag == "br":
                text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag == "a":
            links += 1
        elif tag in VOID:
            text(" ")
            if tag == "hr":
                stack[-1].kids.append(Node("hr"))
        elif tag not in INLINE:
            if tag in CLOSES_P:
                close({"p"}, True)
            if tag in SAME_CLOSES:
                close(SAME_CLOSES[tag], True)
            links = 0
            push(tag, m[3] or m[6])
    return root


# A wrapper's items: text ["#", marks, hash or 0, characters, characters in links, times], element [label, marks, items],
# group ["()", marks, items]. Marks are OPTIONAL and REPEATED.


def _key(item) -> str:
    return f"({','.join([_key(x) for x in item[2]])})" if item[0] == "()" else item[0]


def _unify(a, b):
    """The item that covers two with the same key."""
    if a[0] == "#":
        return ["#", a[1] | b[1], a[2] if a[2] == b[2] else 0, a[3] + b[3], a[4] + b[4], a[5] + b[5]]
    return [a[0], a[1] | b[1], align(a[2], b[2])]


def _fold(items: list) -> list:
    """Equal neighbours become one repeated item, runs that come again a repeated group."""
    out: list = []
    for item in items:
        if out and _key(out[-1]) == _key(item):
            out[-1] = _unify(out[-1], item)
            out[-1][1] |= REPEATED
        else:
            out.append(item)
    size = 2
    while 2 * size <= len(out):
        keys = [_key(x) for x in out]
        number = {k: i for i, k in enumerate(set(keys))}
        ids = np.array([number[k] for k in keys])
        same = np.concatenate(([0], np.cumsum(ids[:-size] == ids[size:])))
        starts = np.flatnonzero(same[size:] - same[:-size] == size)
        if not len(starts):
            size += 1
            continue
        i, stop = int(starts[0]), int(starts[0]) + 2 * size
        while stop + size <= len(out) and keys[stop : stop + size] == keys[i : i + size]:
            stop += size
        runs = [out[k : k + size] for k in range(i, stop, size)]
        whole = runs[0]
        for run in runs[1:]:
            whole = [_unify(x, y) for x, y in zip(whole, run, strict=True)]
        out[i:stop] = [["()", REPEATED, whole]]
    return out


def _grouped(items: list, others: list) -> list:
    """Runs that the other side has as a group become such groups here."""
    for group in others:
        if group[0] == "()":
            keys, i = [_key(x) for x in group[2]], 0
            while i + len(keys) <= len(items):
                if [_key(x) for x in items[i : i + len(keys)]] == keys:
                    items = items[:i] + [["()", 0, items[i : i + len(keys)]]] + items[i + len(keys) :]
                i += 1
    return items


def align(xs: list, ys: list) -> list:
    """The items that cover both lists: the longest common subsequence is kept, the rest becomes optional."""
    if [_key(x) for x in xs] == [_key(y) for y in ys]:
        return [_unify(x, y) for x, y in zip(xs, ys, strict=True)]
    xs, ys = _grouped(xs, ys), _grouped(ys, xs)
    a, b = [_key(x) for x in xs], [_key(y) for y in ys]
    out, i, j = [], 0, 0
    for p, q in [*_common(a, b), (len(a), len(b))]:
        out += [[x[0], x[1] | OPTIONAL, *x[2:]] for x in xs[i:p]] + [[y[0], y[1] | OPTIONAL, *y[2:]] for y in ys[j:q]]
        if p < len(a):
            out.append(_unify(xs[p], ys[q]))
        i, j = p + 1, q + 1
    return _fold(out)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the longest common subsequence of a and each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; long lists are halved where the halves' lengths add up to the most."""
    if len(a) > 1 and len(a) * len(b) > TABLE_CELLS:
        ids = {key: i for i, key in enumerate({*a, *b})}
        x, y = (np.array([ids[key] for key in keys], np.int32) for keys in (a, b))
        half = len(a) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def items_of(node: Node) -> list:
    """A page's own wrapper below a node, its repeats folded."""
    _deep()
    out = []
    for kid in node.kids:
        if isinstance(kid, Node):
            out.append([kid.key(), 0, items_of(kid)])
        elif not kid[0].isspace():
            clean = " ".join(kid[0].split())
            out.append(["#", 0, zlib.crc32(clean.encode("utf-8", "replace")) | 1 << 32, len(clean), len(clean) * kid[1], 1])
    return _fold(out)


def _kinds(label: str) -> frozenset:
    """What an element says of the text in it. Of nested main elements the outer has as much text, and articles come first."""
    if not is_text(label):
        return frozenset(("no text",))
    tag, _, names = label.partition("|")[0].partition(".")
    if tag == "article":
        return frozenset(("main", "article"))
    return frozenset(("main",)) if tag in MAIN_TAGS or names and MAIN_NAMES.search(names) else frozenset()


def is_text(label: str) -> bool:
    """Whether an element with this label may hold main text."""
    tag, _, names = label.partition("|")[0].partition(".")
    return tag not in NOT_TEXT and not (names and tag not in MAIN_TAGS and NOT_TEXT_NAMES.search(names))


def _own(item) -> float:
    """The characters of an item that speak for main text: not in links, and those of template text for little."""
    if item[0] == "#":
        return 0.0 if 2 * item[4] > item[3] else (item[3] - item[4]) * (TEMPLATE if _template(item) else 1.0)
    return sum([_own(x) for x in item[2]]) if item[0] == "()" or is_text(item[0]) else 0.0


def _weight(item, weights: dict[int, float]) -> float:
    """What speaks for an item: its own characters, those of elements called the main one NAMED times, however deep they lie.

    weights gets it for each item, by the item's identity.
    """
    if item[0] == "#":
        found = _own(item)
    else:
        inside = [_weight(x, weights) for x in item[2]]
        found = 0.0 if item[0] != "()" and not is_text(item[0]) else sum(inside)
        if found and item[0] != "()" and _kinds(item[0]):
            found = max(found, NAMED * _own(item))
    weights[id(item)] = found
    return found


def _template(item) -> bool:
    """Whether a text is the same on all of several pages."""
    return bool(item[2]) and not item[1] and item[5] > 1


def _varies(items: list) -> bool:
    for x in items:
        if not x[2] if x[0] == "#" else _varies(x[2]):
            return True
    return False


def main_of(wrapper: list):
    """The wrapper's element with the main text, or None.

    From the page down: the element that holds most of the text that speaks for it, as long as there is one of blocks. Text that tag
    or name call the main one counts NAMED times, for the element itself and for all that it lies in.
    """
    _deep()
    weights: dict[int, float] = {}
    for item in wrapper:
        _weight(item, weights)
    found, items = None, wrapper
    while True:
        flat = _flat(items)
        rated = [(weights[id(x)], x) for x in flat if x[0] != "#" and is_text(x[0])]
        best = max(rated, key=lambda x: x[0], default=(0.0, None))
        whole = sum([r for r, _ in rated]) + sum([weights[id(x)] for x in flat if x[0] == "#"])
        if not best[0] or best[0] < MOST * whole or not any(x[0] != "#" for x in best[1][2]):
            return found
        named = found is not None and _kinds(found[0])
        if named and not _kinds(best[1][0]):
            return found
        if found is not None and best[1][0].partition(".")[0] in TEXT_LEVEL - {"body", "html", "table", "tbody", "tr", "td"}:
            return found
        found, items = best[1], best[1][2]


def _flat(items: list) -> list:
    """The items in order, groups replaced by what they hold."""
    out, todo = [], list(reversed(items))
    while todo:
        item = todo.pop()
        if item[0] == "()":
            todo += reversed(item[2])
        else:
            out.append(item)
    return out


def _matched(node: Node, items: list | None) -> list[tuple]:
    """(kid, item) for a node's kids in order: the next item with the kid's key that isn't used up, or the first one again."""
    flat, places, used, out = _flat(items or []), {}, {}, []
    for i, item in enumerate(flat):
        places.setdefault(item[0], []).append(i)
    for kid in node.kids:
        key = kid.key() if isinstance(kid, Node) else "#"
        at = places.get(key)
        if at is None:
            out.append((kid, None))
            continue
        turn = used.get(key, 0)
        hit = flat[at[min(turn, len(at) - 1)]]
        if isinstance(kid, Node) or not kid[0].isspace():
            used[key] = turn if hit[1] & REPEATED and turn + 1 >= len(at) else turn + 1
        out.append((kid, hit))
    return out


def extract(page: str, wrapper: list) -> str:
    """The main text of a page: blocks joined by blank lines, white space inside them single spaces.

    Where the page has the wrapper's main element, its text counts, elsewhere that of the body, but for elements that hold
    none by their tag or name. Unless tag or name call it the main one, template text and slots that are mostly links don't
    count either, if any text in it differs from page to page.
    """
    main, root = main_of(wrapper), parse(page)
    blocks: list[list[str]] = [[]]

    def walk(node: Node, items: list | None, inside: bool) -> None:
        for kid, item in _matched(node, items):
            if not isinstance(kid, Node):
                drop = item is not None and not inside and (_template(item) or item[4] * 2 > item[3])
                blocks[-1].append(" " if drop else kid[0])
            elif is_text(kid.label):
                blocks.append([])
                walk(kid, item[2] if item else None, inside)
                blocks.append([])

    def seek(node: Node, items: list | None) -> bool:
        found = False
        for kid, item in _matched(node, items):
            if isinstance(kid, Node) and is_text(kid.label):
                if item is main:
                    blocks.append([])
                    walk(kid, item[2], bool(_kinds(item[0])) or not _varies(item[2]))
                    blocks.append([])
                    found = True
                else:
                    found |= seek(kid, item[2] if item else None)
        return found

    if main is None or not seek(root, wrapper):
        walk(root, wrapper, not _varies(wrapper))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def pack(items: list) -> str:
    """A wrapper as JSON without nesting: texts as they are, elements and groups with how many items they hold, in order."""
    rows, todo = [], list(reversed(items))
    while todo:
        item = todo.pop()
        if item[0] == "#":
            rows.append(item)
        else:
            rows.append([item[0], item[1], len(item[2])])
            todo += reversed(item[2])
    return json.dumps([len(items), rows], ensure_ascii=True, separators=(",", ":"))


def unpack(data: str) -> list:
    top, rows = json.loads(data)
    out: list = []
    open_lists = [(out, top)]
    for row in rows:
        while len(open_lists[-1][0]) == open_lists[-1][1]:
            open_lists.pop()
        if row[0] == "#":
            open_lists[-1][0].append(row)
        else:
            held: list = []
            open_lists[-1][0].append([row[0], row[1], held])
            open_lists.append((held, row[2]))
    return out


@lru_cache(maxsize=64)
def _wrapper(data: str | None) -> list:
    return unpack(data) if data else []


def _fold_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts that a task meets; when they have grown large they are handed on and begun anew."""
    salt, found, size = TaskContext.get().partitionId() % SALTS, {}, 0

    def out() -> pa.RecordBatch:
        columns = [list(found), [salt] * len(found), [pack(w) for w in found.values()]]
        types = (pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_host", "_salt", "_wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            items = items_of(parse(page or ""))
            if host in found:
                found[host] = align(found[host], items)
            else:
                found[host], size = items, size + (page or "").count("<")
            if size > ITEMS_KEPT:
                yield out()
                found, size = {}, 0
    yield out()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    _deep()
    data = sorted(rows["_wrapper"])
    whole = unpack(data[0])
    for other in data[1:]:
        whole = align(whole, unpack(other))
    return pd.DataFrame({"_host": [rows["_host"].iloc[0]], "_salt": [0], "_wrapper": [pack(whole)]})


def host_of(url):
    """The host of a URL in lower case; empty for a null URL or one without a host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, *, url_col="url", html_col="html") -> DataFrame:
    """(_host, _wrapper): the wrapper of each host, as JSON, aligned over all of its pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_page"))
    schema = "_host string, _salt int, _wrapper string"
    parts = rows.mapInArrow(_fold_task, schema)
    parts = parts.groupBy("_host", "_salt").applyInPandas(_merge, schema)
    return parts.groupBy("_host").applyInPandas(_merge, schema).select("_host", "_wrapper")


def _extract_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, data = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [extract(p or "", _wrapper(w)) for p, w in zip(pages, data, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or blank page has an empty text; pages with a null URL are aligned with each other; repeated rows are alike; an
    empty table gives no rows; further columns are ignored.
    """
    wrappers = materialize(infer(pages, url_col=url_col, html_col=html_col))
    size = wrappers.agg(F.sum(F.octet_length("_wrapper") + F.octet_length("_host"))).first()[0] or 0
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("_page"),
        host_of(F.col(url_col)).alias("_host"),
    )
    found = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "_host", "left")
    found = found.select("page_id", "url", "_page", "_wrapper")
    return found.mapInArrow(_extract_task, "page_id long, url string, text string, n_chars long")
