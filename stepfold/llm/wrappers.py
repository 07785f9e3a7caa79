"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read into a tree (tags that HTML leaves open are closed, inline markup melts into its text; what is nested
over DEPTH deep is part of the element there, and no text is lost). Elements are told by their tag and names; names
that number things are alike, and ids count only where they say something. Pages of one host are aligned, one after the
other, into a wrapper: neighbours of one kind fold into a repeated group, what only some pages have becomes an optional
group, texts that differ become text slots, texts that never differ are constants, long ones by their hash. Groups
that under one page in RARE has are left out of wrappers of many pages, so a wrapper's size doesn't grow with the pages.
Two lists of groups are aligned between their common ends and the keys that occur once in either, in about linear time.
Aligning is done by each task for each host it meets, and tasks' wrappers are aligned in turn, in two rounds with
salted hosts; no task holds the pages of a host, only one wrapper of them.

From its wrapper a host gets the path to its main text: an article (or main) element with most of the text in slots, or
else, from the body down, the group that holds all text in slots but that of unwanted groups. A page gives all text
under that path, constants too, without menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
told by tag, role or name; constants beside the path are left out by their place alone. Only a page without the path,
or the one page of a host, is read by its own tree alone: by its article or main elements, or whole.

Null or empty html gives an empty text; a null url has the host ''. Repeated pages are rows of their own. Pages of any
length are read whole. Only page_id, url and html are read, so other columns of any name do not matter. Of groups with
equal text the first leads. Wrappers are broadcast while there are at most BROADCAST_ROWS hosts, else joined by host.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch

BROADCAST_ROWS = 20_000
#: Shares of salted hosts that are merged before a host's wrappers meet.
SALT = 32
#: Longest constant that a wrapper holds as it is, and pages that must agree before a text is one.
CONSTANT_CHARS, CONSTANT_PAGES = 80, 5
#: Depth of a tree; below it there are only unwanted and main elements, a few deep.
DEPTH, MORE = 80, 10
#: A wrapper of this many pages or more leaves out groups that fewer than one in so many have.
RARE = 64
#: Pairs of groups that a table of common subsequences may have.
PAIRS = 2500

# fixed names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are skipped whole, and those of them whose content is raw text in HTML: without an end tag it goes on to the end of the page.
RAW = set("script style textarea title noscript template iframe svg math object".split())
RAW_TEXT = set("script style textarea title iframe".split())
NEVER = set("head nav header footer aside form button select option dialog menu".split())
CLOSES_P = set("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tr td th ul".split())
#: Tags of running text: a constant heading or paragraph beside the text belongs to it.
WRITTEN = set("blockquote dd dl dt figure h1 h2 h3 h4 h5 h6 li ol p pre ul".split())
#: Tags whose ids are targets of links, which say nothing of the element's part in the page.
UNNAMED = set("h1 h2 h3 h4 h5 h6 p li dt dd".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of names in class, id or role that mark what isn't main text, and words that say no more than a place or a shape.
_MARKS = re.compile(
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|sidebar|side|aside|widget\w*|menu|nav\w*|breadcrumbs?|"
    r"footer|foot|header|masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|search|pagination|pager|complementary|contentinfo|toolbar",
    re.I,
)
_PLACES = re.compile(r"site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|sticky|fixed|mobile|desktop|user|reader|box|bar|block|area|section|panel|container|wrap\w*|inner|outer|column|col|row|slot|unit|list|thread|form|buttons?|icons?|links?|posts?|articles|stories|[#0-9]+", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBER = re.compile(r"[0-9]+")

#: A tree is [key, children]; a key is the tag and its names; a text child is a string.
Tree = list


@lru_cache(maxsize=1 << 16)
def marks(name: str) -> bool:
    """Whether a name, word by word, says that something isn't main text and nothing else: side-bar and cookie_notice do, side-effects and Related_work do not."""
    words = [x for x in re.split(r"[-_]+", name) if x]
    return any(_MARKS.fullmatch(x) for x in words) and all(_MARKS.fullmatch(x) or _PLACES.fullmatch(x) for x in words)


def key_of(tag: str, attributes: str) -> str:
    """The tag and the names of an element that other pages share: no numbers of three digits in classes and roles, none at all in ids, and ids only of elements without a class or that aren't wanted, never of headings, paragraphs and items."""
    found: dict[str, list[str]] = {"class": [], "id": [], "role": []}
    for kind, *values in _NAMES.findall(attributes):
        found[kind.lower()] += "".join(values).split()
    short = [_NUMBER.sub(lambda m: m[0] if len(m[0]) < 3 else "#", x) for x in found["class"] + found["role"]]
    ids = [_NUMBER.sub("#", x) for x in found["id"]] if tag not in UNNAMED else []
    names = {*short, *(x for x in ids if marks(x) or not short and tag not in WRITTEN | {"article", "main", "body"})}
    return " ".join([tag, *sorted(names)])


def parse(html: str) -> Tree:
    root: Tree = ["", []]
    stack, at = [("", root)], 0
    depth = {id(root): 0}
    endless: set[str] = set()

    def text(piece: str) -> None:
        children = stack[-1][1][1]
        if children and isinstance(children[-1], str):
            children[-1] += piece
        else:
            children.append(piece)

    def close(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                within = stack[k][1] is stack[k - 1][1]
                del stack[k:]
                if within:
                    text(" ")
                return
            if stack[k][0] in stop:
                return

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            # an end tag alone and what is closed at once have no content; other elements without an end tag keep theirs
            if not m[1] and not (tag in ("svg", "math") and m[3].endswith("/")):
                if tag not in endless and (end := _END[tag].search(html, at)):
                    at = end.end()
                elif tag in RAW_TEXT:
                    at = len(html)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            continue
        if m[1]:
            if tag in ("p", "br"):
                text(" ")
            if tag != "br":
                close({tag}, {"article", "main", "body"} - {tag} if tag in CLOSES_P and tag not in ("article", "div", "section") else set())
            continue
        if tag in VOID:
            text(" ")
            continue
        if tag in CLOSES_P:
            close({"p"}, CLOSES_P - {"p"})
        if tag in ITEMS:
            close({tag} | ({"dt", "dd"} & set(ITEMS) if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else set()), ITEMS[tag])
        key, above = key_of(tag, m[3]) if m[3] else tag, stack[-1][1]
        deep = depth[id(above)]
        if deep < DEPTH or deep < DEPTH + MORE and (tag in ("article", "main") or unwanted(key)):
            node: Tree = [key, []]
            depth[id(node)] = deep + 1
            above[1].append(node)
            stack.append((tag, node))
        else:
            text(" ")
            stack.append((tag, above))
    if at < len(html):
        text(unescape(html[at:]))
    return root


def unwanted(key: str) -> bool:
    tag, _, names = key.partition(" ")
    return tag in NEVER or bool(names and tag not in ("body", "html", "article", "main") and any(map(marks, names.split())))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def collect(tree: Tree, out: list[str]) -> list[str]:
    for child in tree[1]:
        if isinstance(child, str):
            if block := squeeze(child):
                out.append(block)
        elif not unwanted(child[0]):
            collect(child, out)
    return out


# A wrapper is [key, least, most, children, pages]: least 0 for optional groups, most 2 for repeated ones. A text slot
# is ["", least, most, constant or None, pages, characters].


def _hashed(text: str) -> str:
    return "#" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def wrap(tree: Tree, least: int = 1) -> list:
    children = []
    for child in tree[1]:
        if isinstance(child, str):
            if block := squeeze(child):
                children.append(["", 1, 1, block if len(block) <= CONSTANT_CHARS else _hashed(block), 1, len(block)])
        elif child[0].partition(" ")[0] != "head":
            children.append(wrap(child))
    return [tree[0], least, 1, folded(children), 1]


def folded(items: list) -> list:
    """Repeated runs of one, two or three items as one repeated group each."""
    for period in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period and [x[0] for x in out[-period:]] == [x[0] for x in out[-2 * period : -period]]:
                last = out[-period:]
                del out[-period:]
                for k, x in enumerate(last):
                    out[k - period] = merge(out[k - period], x, same_page=True)
                    out[k - period][2] = 2
        items = out
    return items


def merge(a: list, b: list, same_page: bool = False) -> list:
    pages = max(a[4], b[4]) if same_page else a[4] + b[4]
    least, most = min(a[1], b[1]), max(a[2], b[2])
    if a[0] == "" and not isinstance(a[3], list) and not isinstance(b[3], list):
        # the texts of a repeated group on one page are a constant together
        both = None if None in (a[3], b[3]) or not same_page else _hashed(f"{a[3]}\0{b[3]}")
        return ["", least, most, a[3] if a[3] == b[3] else both, pages, a[5] + b[5]]
    children = align(a[3], b[3], same_page)
    if pages >= RARE:
        children = [c for c in children if c[4] * RARE >= pages]
    return [a[0], least, most, children, pages]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists of keys: a longest one of short lists; of long ones that between the keys which either has once, in the order that keeps most of these."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, x, y = todo.pop()
        while lo < hi and x < y and a[lo] == b[x]:
            out.append((lo, x))
            lo, x = lo + 1, x + 1
        while lo < hi and x < y and a[hi - 1] == b[y - 1]:
            hi, y = hi - 1, y - 1
            out.append((hi, y))
        if lo == hi or x == y:
            continue
        if (hi - lo) * (y - x) <= PAIRS:
            out += _longest(a[lo:hi], b[x:y], lo, x)
            continue
        once = Counter(a[lo:hi]), Counter(b[x:y])
        place = {k: j for j, k in enumerate(b[x:y], x) if once[1][k] == 1}
        anchors = _ascending([(i, place[k]) for i, k in enumerate(a[lo:hi], lo) if once[0][k] == 1 and k in place])
        if not anchors:  # each key with its next occurrence
            spots: dict[str, list[int]] = {}
            for j in range(x, y):
                spots.setdefault(b[j], []).append(j)
            for i in range(lo, hi):
                own = spots.get(a[i], [])
                if (k := bisect_left(own, x)) < len(own):
                    out.append((i, own[k]))
                    x = own[k] + 1
            continue
        out += anchors
        ends = [(lo - 1, x - 1), *anchors, (hi, y)]
        todo += [(i + 1, p, j + 1, q) for (i, j), (p, q) in zip(ends, ends[1:], strict=False) if i + 1 < p and j + 1 < q]
    return sorted(out)


def _longest(a: list[str], b: list[str], at: int, by: int) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((at + i, by + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs, ascending in the first, that ascends in the second as well."""
    ends: list[int] = []
    last: list[int] = []
    before = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        last[k : k + 1] = [n]
        before.append(last[k - 1] if k else -1)
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list, b: list, same_page: bool = False) -> list:
    """The groups of two lists in a common order; what one of them lacks becomes optional."""
    out, i, j = [], 0, 0
    for p, q in [*_common([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], 0, *x[2:]] for x in [*a[i:p], *b[j:q]]]
        if p < len(a):
            out.append(merge(a[p], b[q], same_page))
        i, j = p + 1, q + 1
    return folded(out)


def slots(w: list) -> int:
    """Characters in the text slots of a wrapper, without those of unwanted groups and of constants."""
    if not isinstance(w[3], list):
        return 0 if w[3] is not None and w[4] >= CONSTANT_PAGES else w[5]
    return 0 if unwanted(w[0]) else sum(map(slots, w[3]))


def _descend(w: list, share: float, stop: set[str] = frozenset()) -> list[str]:
    """The keys from single group to single group, each with at least that share of the text in slots of the one above, down to an article or main element, or to where groups of the tags in `stop` are."""
    path, here = [], w
    while not (path and path[-1].partition(" ")[0] in ("article", "main")):
        groups = [c for c in here[3] if isinstance(c[3], list) and not unwanted(c[0])]
        total = slots(here)
        best = max(groups, key=slots, default=None)
        if best is None or not total or slots(best) < share * total or best[2] > 1 or any(c[0].partition(" ")[0] in stop for c in groups):
            break
        path.append(best[0])
        here = best
    return path


def rule(w: list) -> list[str]:
    """The path of keys to the main text: to an article with most of the text, else to the lowest group with all of it and the headings beside it."""
    if w[4] < 2:
        return []
    path = _descend(w, 0.6)
    return path if path and path[-1].partition(" ")[0] in ("article", "main") else _descend(w, 1, WRITTEN)


def _find(tree: Tree, tags: tuple[str, ...]) -> list[Tree]:
    out = []
    for child in tree[1]:
        if not isinstance(child, str) and not unwanted(child[0]):
            out += [child] if child[0].partition(" ")[0] in tags else _find(child, tags)
    return out


def main_text(html: str | None, path: list[str] | None) -> str:
    tree = parse(html or "")
    found = [tree]
    for key in path or []:
        found = [c for t in found for c in t[1] if not isinstance(c, str) and c[0] == key]
    if not path or not found:
        found = _find(tree, ("article",)) or _find(tree, ("main",)) or [tree]
    elif inner := [x for t in found if t[0].partition(" ")[0] not in ("article", "main") for x in _find(t, ("article",))]:
        found = inner
    return " ".join(b for t in found for b in collect(t, []))


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of each host, from all of its pages."""

    def fold(rows: Iterator[tuple[str, list]], held: dict[str, list]) -> None:
        for host, w in rows:
            held[host] = merge(held[host], w) if host in held else w

    def each_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            fold(((h, wrap(parse(x or ""))) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), held)
            if len(held) > 5000:  # many hosts: their wrappers go on as they are
                yield send(held)
                held = {}
        yield send(held)

    def send(held: dict[str, list]) -> pa.RecordBatch:
        task = TaskContext.get().partitionId() % SALT
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([task] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "salt", "wrapper"])

    def each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if host not in held and held:
                    yield send(held)
                    held = {}
                fold([(host, json.loads(w))], held)
        yield send(held)

    schema = "host string, salt int, wrapper string"
    parts = pages.select("host", "html").mapInArrow(each_task, schema)
    salted = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(each_group, schema)
    return salted.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(each_group, schema).select("host", "wrapper")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = hosted(pages)
    found = Scratch(spark, "wrappers").write(infer(rows), "wrappers")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, list[str]] = {}
        for batch in batches:
            texts = []
            for html, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if w is not None and w not in rules:
                    rules = {} if len(rules) > 5000 else rules
                    rules[w] = rule(json.loads(w))
                texts.append(main_text(html, rules.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, schema)
