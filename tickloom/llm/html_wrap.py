"""Main-text extraction by wrapper inference per host.

A page becomes a stream of block tags and text slots. Within a page, neighbouring repeats are folded into
repeated groups; two streams of a host are aligned tag by tag, and every mismatch is resolved without unions:
what only one side has becomes optional, a run of equal neighbours becomes repeated, differing text becomes a
slot. Aligning all pages of a host this way gives its wrapper, a union-free regular expression over tags and
slots with the text mass of every slot. The wrapper decides once per host which slots are the article: those
below its article or main element, else below the deepest element that still holds most of the text, without
menus, headers, footers, asides, forms, adverts, notices, comments and code. Such an element is told by its tag or by a
whole class, id or role token, and is not left out where it encloses the article or holds most of the text.

Alignment runs in three steps so that no host is one task: pages of a host that meet in a slice are folded into
one stream where they are read, streams of a host are aligned in bounded groups until one is left, and pages
look their wrapper up. Pages whose stream lacks the wrapper's article slots get a wrapper of their own.

Rows: null or empty html gives an empty text; a null url is a host of its own name (empty); null ids and
repeated rows are kept; other columns are ignored; a page of any length is read whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html import unescape
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import map_slices, small
from tickloom.session import materialize

GROUP = 32  # streams of a host aligned in one task
DEPTH = 200  # elements nested deeper open no level of their own; their text stays where it stands
MOST = 0.6  # share of the text that the article must hold where no element names it

# How HTML elements behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template title textarea iframe svg math object select option button canvas audio video".split())
TO_THE_END = {"script", "style", "textarea"}
BLOCK = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr menu head center".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "caption"}
# Elements and words in class, id or role that mark what is not the article.
NOT_MAIN = {"nav", "aside", "form", "head", "menu", "fieldset", "footer"}
OUTSIDE_ONLY = {"header"}
NOT_MAIN_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup share sharing social related recommended widget login search pagination pager toolbar alert masthead".split()
)
COMMENT_WORDS = {"comment", "comments", "respond", "disqus"}
# What a name made of such words may hold besides; "has-sidebar", "no-sidebar" or "related-work" are no such names.
PLACE_WORDS = set("area bar block bottom box button buttons container form group inner item items left link links list outer panel post posts right row section site slot top unit wrap wrapper x".split())
HEADED = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}

# Flags of a node.
OPTIONAL, REPEATED, ASIDE, ARTICLE = 1, 2, 4, 8
ASIDE_OUTSIDE = 16  # marked by the id of a heading or section, which inside the article is an anchor
FIRM = 32  # an element that is never the article, whatever its text mass
COMMENTS = 64
MAIN = 128  # an article that a page has once
OPENED = 256  # marked, and still part of the article or around it

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+[^\s\"'>=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\s*/)*)\s*>|</?[a-zA-Z][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^-_0-9]+")


def _marks(token: str) -> set[str]:
    """The words by which a whole class, id or role token marks what is not the article."""
    if token in NOT_MAIN_WORDS:
        return {token}
    parts = set(_PARTS.findall(token))
    return parts & NOT_MAIN_WORDS if parts <= NOT_MAIN_WORDS | PLACE_WORDS else set()


def _step(tag: str, attributes: str) -> tuple[str, int]:
    """(name of a path step, flags)."""
    name, flags = tag, (ASIDE if tag in NOT_MAIN else 0) | (FIRM if tag in NOT_MAIN - {"form", "fieldset"} else 0)
    flags |= ARTICLE if tag in ("article", "main") else 0
    flags |= MAIN if tag == "main" else 0
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or (kind == "style" and "display:none" in value.replace(" ", "")):
                flags |= ASIDE
            elif kind in ("class", "id", "role"):
                marks = set().union(*map(_marks, value.split()))
                if marks:
                    flags |= ASIDE_OUTSIDE if kind == "id" and tag in HEADED else ASIDE
                    flags |= COMMENTS if marks & COMMENT_WORDS else 0
                if kind == "role" and value == "main":
                    flags |= ARTICLE | MAIN
                if value:
                    name += "." + _DIGITS.sub("0", value.replace("/", "-"))
    if flags & ARTICLE or tag in ("html", "body"):
        flags &= ARTICLE | MAIN
    return name, flags


def events(html: str):
    """("open", step, flags), ("close",), ("text", raw) and ("break",) of a page; closing tags close what they must."""
    stack: list[str] = []
    opened: Counter[str] = Counter()
    at, n = 0, len(html)

    def pop() -> tuple[str, tuple]:
        tag = stack.pop()
        opened[tag] -= 1
        return tag, ("close",) if len(stack) < DEPTH else ("break",)

    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            yield "text", text
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                while True:
                    top, left = pop()
                    yield left
                    if top == tag:
                        break
            elif tag in BLOCK:
                yield ("break",)
        elif tag in RAW:
            # a slash closes drawings and players, but no script or style; those run to the end if nothing closes them
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if tag in TO_THE_END or not m[3].endswith("/") else None
            if end:
                at = end.end()
            elif tag in TO_THE_END:
                return
        elif tag == "br":
            yield "text", " "
        elif tag in VOID or tag not in BLOCK:
            if tag in BLOCK:
                yield ("break",)
        else:
            if tag in CLOSES_P and opened["p"] and not {"td", "th", "li"} & set(stack[len(stack) - stack[::-1].index("p") :]):
                while True:
                    top, left = pop()
                    yield left
                    if top == "p":
                        break
            elif tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1] == tag:
                yield pop()[1]
            stack.append(tag)
            opened[tag] += 1
            yield ("open", *_step(tag, m[3])) if len(stack) <= DEPTH else ("break",)
    while stack:
        yield pop()[1]


# ---- wrappers: a node is [step, flags, text mass, children] ----

SLOT = "#"


def stream(html: str) -> list:
    """The wrapper of one page."""
    root = ["", 0, 0, []]
    stack = [root]
    for e in events(html):
        if e[0] == "open":
            node = [e[1], e[2], 0, []]
            stack[-1][3].append(node)
            stack.append(node)
        elif e[0] == "close":
            stack.pop()
        elif e[0] == "text" and not e[1].isspace():
            children = stack[-1][3]
            size = len(e[1].strip())
            if children and children[-1][0] == SLOT:
                children[-1][2] += size
            else:
                children.append([SLOT, 0, size, []])
    return _folded(root)


def _merge(a: list, b: list) -> list:
    """One node for two of the same step."""
    return [a[0], a[1] | b[1], a[2] + b[2], _align(a[3], b[3])]


def _repeat(children: list) -> list:
    """Runs of the same step become one repeated node."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = _merge(out[-1], c)
            if c[0] != SLOT:
                out[-1][1] |= REPEATED
        else:
            out.append(c)
    return out


def _folded(node: list) -> list:
    """Fold repeats bottom-up: single nodes first, then groups of up to four neighbours."""
    children = _repeat([_folded(c) if c[3] else c for c in node[3]])
    for width in (2, 3, 4):
        at = 0
        while at + 2 * width <= len(children):
            if [c[0] for c in children[at : at + width]] == [c[0] for c in children[at + width : at + 2 * width]]:
                for k in range(width):
                    children[at + k] = _merge(children[at + k], children[at + width + k])
                    children[at + k][1] |= REPEATED
                del children[at + width : at + 2 * width]
            else:
                at += 1
    return [node[0], node[1], node[2], children]


def _matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of ``a`` and ``b`` that stand for the same step, in order."""
    x, y = [c[0] for c in a], [c[0] for c in b]
    if x == y:
        return [(i, i) for i in range(len(x))]
    # longest common subsequence of what is left of each side, a row of bits per place of ``a`` (a zero bit: one longer);
    # every so many rows are kept and the rows between made again, so memory is linear
    n, m = len(x), len(y)
    where: dict[str, int] = {}
    for j, s in enumerate(y):
        where[s] = where.get(s, 0) | 1 << (m - 1 - j)
    full, step = (1 << m) - 1, isqrt(n) + 1

    def rows(low: int, high: int, row: int) -> dict[int, int]:
        out = {high: row}
        for i in range(high - 1, low - 1, -1):
            hit = row & where.get(x[i], 0)
            row = ((row + hit) | (row - hit)) & full
            out[i] = row
        return out

    kept, row = {n: full}, full
    for low in range((n - 1) // step * step, -1, -step):
        row = kept[low] = rows(low, min(low + step, n), row)[low]
    held = rows(0, min(step, n), kept[min(step, n)])

    def best(i: int, j: int) -> int:
        return m - j - (held[i] & ((1 << (m - j)) - 1)).bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if i + 1 not in held:
            low = i // step * step
            held = rows(low, min(low + step, n), kept[min(low + step, n)])
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def _align(a: list, b: list) -> list:
    """Union-free alignment: matched nodes merge, what one side lacks becomes optional."""
    if not a or not b:
        return [[c[0], c[1] | (c[0] != SLOT), c[2], c[3]] for c in a or b]
    out: list = []
    i = j = 0
    for p, q in [*_matched(a, b), (len(a), len(b))]:
        out += [[c[0], c[1] | (c[0] != SLOT), c[2], c[3]] for c in [*a[i:p], *b[j:q]]]
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return _repeat(out)


def align(a: list, b: list) -> list:
    return _merge(a, b)


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    if node[0] == SLOT:
        return SLOT
    inner = "".join(map(expression, node[3]))
    if not node[0]:
        return inner
    text = f"<{node[0]}>{inner}</{node[0].split('.')[0]}>"
    if node[1] & REPEATED:
        return f"({text}){'*' if node[1] & OPTIONAL else '+'}"
    return f"({text})?" if node[1] & OPTIONAL else text


def _mass(node: list, inside: bool = False) -> int:
    """Text below a node, without what is not the article."""
    if _skipped(node[0], node[1], inside):
        return 0
    inside |= bool(node[1] & ARTICLE)
    return (node[2] if node[0] == SLOT else 0) + sum(_mass(c, inside) for c in node[3])


def _whole(node: list) -> int:
    """All text below a node."""
    return (node[2] if node[0] == SLOT else 0) + sum(map(_whole, node[3]))


def _skipped(step: str, flags: int, inside: bool) -> bool:
    if flags & OPENED:
        return False
    return bool(flags & ASIDE) or (not inside and (bool(flags & ASIDE_OUTSIDE) or step.split(".")[0] in OUTSIDE_ONLY))


def _outermost(node: list, inside: bool = False):
    """(node, whether inside an article) of the skipped elements that no other skipped element holds."""
    if _skipped(node[0], node[1], inside):
        yield node, inside
        return
    inside |= bool(node[1] & ARTICLE)
    for c in node[3]:
        yield from _outermost(c, inside)


def _copy(node: list) -> list:
    return [*node[:3], [_copy(c) for c in node[3]]]


def _holds(node: list, flag: int) -> bool:
    """Whether an element with ``flag`` and some text stands below."""
    return bool(node[1] & flag and _whole(node)) or any(_holds(c, flag) for c in node[3])


def _open(wrapper: list, wanted) -> bool:
    """Open the outermost skipped elements that ``wanted`` names, and those below them in turn."""
    some, again = False, True
    while again:
        again = False
        for node, inside in list(_outermost(wrapper)):
            if wanted(node, inside):
                node[1] |= OPENED
                some = again = True
    return some


def article_paths(wrapper: list) -> list[str]:
    """Paths of the elements whose slots are the article.

    A marked element is skipped unless it is around the article: one that holds the main element, or articles and
    most of the text, is opened, and so is one that holds an article when there is none outside marked elements and
    it has half of the text that stands there (else its articles are teasers or comments). Inside the article, and where no element names it, one that holds most of
    the page's text is opened too. Opened elements inside the article are paths of their own."""
    most = MOST * _whole(wrapper)

    def heavy(node):
        return most > 0 and not node[1] & FIRM and _whole(node) >= most

    def around(node, inside):
        if inside or node[1] & FIRM:
            return inside and heavy(node) and not node[1] & COMMENTS
        return _holds(node, MAIN) or (heavy(node) and not node[1] & COMMENTS and _holds(node, ARTICLE))

    def named() -> list[str]:
        found: list[str] = []

        def find(node, path):
            if _skipped(node[0], node[1], False):
                return
            here = f"{path}/{node[0]}" if node[0] else path
            if node[1] & ARTICLE:
                # a main element around article elements gives way to them
                inner = len(found)
                for c in node[3]:
                    find(c, here)
                if len(found) == inner and _mass(node, True):
                    found.append(here)
                    opened(node, here, found)
                return
            for c in node[3]:
                find(c, here)

        find(wrapper, "")
        return sorted(set(found))

    def opened(node, path, found):
        """Paths of opened elements below an article."""
        for c in node[3]:
            here = f"{path}/{c[0]}"
            if c[1] & OPENED:
                found.append(here)
            if not _skipped(c[0], c[1], True):
                opened(c, here, found)

    wrapper = _copy(wrapper)
    _open(wrapper, around)
    found = named()
    for share, flags in ((2, FIRM | COMMENTS), (1, 0)):
        rest = _mass(wrapper)
        while not found and _open(wrapper, lambda node, inside: not inside and not node[1] & flags and _holds(node, ARTICLE) and share * _whole(node) >= rest):
            _open(wrapper, around)
            found = named()
    if found:
        return found
    _open(wrapper, lambda node, inside: heavy(node))
    node, path = wrapper, ""
    total = _mass(wrapper)
    while total:
        largest = [c for c in node[3] if c[0] != SLOT and not c[1] & REPEATED and _mass(c) >= MOST * total]
        if not largest:
            break
        node = largest[0]
        path += "/" + node[0]
    if not total:
        return []
    found = [path]
    opened(node, path, found)
    return found


def extract(html: str, paths: list[str]) -> tuple[str, bool]:
    """(main text, whether any of ``paths`` was met): the blocks below the paths, in page order."""
    wanted = set(paths)
    around = {p[:at] for p in paths for at, c in enumerate(p) if c == "/"}
    blocks: list[str] = []
    now: list[str] = []
    stack: list[tuple[bool, bool]] = []  # (inside the article, skipped)
    path: list[str] = []
    inside, skip, met = "" in wanted, False, "" in wanted

    def flush():
        if now:
            text = " ".join(unescape("".join(now)).split())
            if text:
                blocks.append(text)
            now.clear()

    for e in events(html):
        kind = e[0]
        if kind == "text":
            if inside and not skip:
                now.append(e[1])
        elif kind == "open":
            flush()
            stack.append((inside, skip))
            path.append(e[1])
            if not skip:
                here = "/" + "/".join(path)
                if here in wanted:
                    inside = met = True
                elif here not in around or inside:
                    skip = _skipped(e[1], e[2], inside and "" not in wanted)
        elif kind == "close":
            flush()
            inside, skip = stack.pop()
            path.pop()
        else:
            flush()
    flush()
    return "\n".join(blocks), met


def page_text(html: str | None, paths: list[str] | None) -> str:
    if not html:
        return ""
    text, met = extract(html, paths) if paths else ("", False)
    if not met:
        text, _ = extract(html, article_paths(stream(html)))
    return text


def _pages(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON): one wrapper per host, aligned from all its pages."""

    def fold(part: pa.RecordBatch):
        found: dict[str, list] = {}
        for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
            if page:
                one = stream(page)
                found[h] = align(found[h], one) if h in found else one
        return {"host": list(found), "wrapper": [json.dumps(w) for w in found.values()]} if found else None

    def join(key, table):
        rows = sorted(table.column("wrapper").to_pylist())
        one = json.loads(rows[0])
        for r in rows[1:]:
            one = align(one, json.loads(r))
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(one)]})

    current = materialize(map_slices(pages.select("host", "html"), fold, "host string, wrapper string", column="html"), "wrappers")
    while True:
        per_host = current.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = per_host.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return current
        groups = per_host.select("host", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
        dealt = current.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("groups")).cast("int"))
        current = materialize(dealt.select("host", "part", "wrapper").groupBy("host", "part").applyInArrow(join, "host string, wrapper string"), "wrappers")


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    pages = _pages(df, key, url, html)

    def roots(part: pa.RecordBatch):
        return {"host": part.column("host"), "paths": [article_paths(json.loads(w)) for w in part.column("wrapper").to_pylist()]}

    known = small(map_slices(wrappers(pages), roots, "host string, paths array<string>", column="wrapper"), "article-paths")
    held = pages.join(known, "host", "left").select("id", "url", "html", "paths")

    def run(part: pa.RecordBatch):
        texts = [page_text(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
        return {"id": part.column("id"), "url": part.column("url"), "text": texts}

    return map_slices(held, run, "id long, url string, text string", column="html")
