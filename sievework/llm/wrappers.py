"""Main text of web pages by wrappers: union-free expressions inferred per host."""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import json
import re
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.work import column, table

#: Fixed names. Elements that begin a block of text; all others are part of the text around them.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary header footer nav aside form fieldset hgroup center dialog menu template search".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style head title noscript template svg math iframe object canvas audio video select textarea button option datalist map".split())
#: Of these, the ones whose content is raw text: without an end tag they go on to the page's end.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id and role, that mark what is not the article.
ASIDE = frozenset("nav footer aside form dialog menu search".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs copyright cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login comment comments commentlist discussion disqus replies reply respond share sharing social related recommended recommendations pagination pager searchform form complementary contentinfo".split()
)
#: Words that may also name the frame around an article: they count where no article or main is inside.
LAYOUT = frozenset("nav navbar navigation menu menubar sidebar aside footer foot widget toolbar search overlay banner".split())
#: Words of heads: of the page where no article or main is around or inside, else of the article.
HEADS = frozenset("header masthead".split())
#: Words of an article or main element that is no article of the page's own.
REMARKS = frozenset("comment comments reply replies related recommended sponsored promo".split())
MARKS = "!~^"
MARKED = frozenset(MARKS)
#: Elements that name what follows them: their text is kept though it is the same on many pages.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 hgroup dt th caption summary".split())
#: All elements whose name alone says something about the text in them.
NAMED = ASIDE | LABELS | {"article", "main", "header"}
#: A start tag closes an open one of these, up to the nearest element that holds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")

#: Sequences whose table of common runs would be larger than this are aligned by their longest matching stretches instead.
TABLE = 1 << 20
#: Forms of a host that one step aligns.
STEP = 32
#: Bytes of forms that a task holds before it hands them on.
HELD = 1 << 25

# A form is ["t"] (a slot: its text varies), ["t", digest, least, greatest] (the same text wherever it was seen, and the range
# of likeness() of the pages that have it), ["e", name, [forms]], ["?", form] or ["+", [forms]].
TEXT = ["t"]


def name_of(tag: str, attributes: str) -> str:
    """The element's name, with a mark of MARKS if its attributes say that it may not be the article."""
    if attributes and "=" in attributes:
        for value in _MARKED.findall(attributes):
            found = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if tag in ("article", "main"):
                if REMARKS.intersection(found):
                    return f"{tag}!"
                continue
            for mark, these in zip(MARKS, (WORDS, LAYOUT, HEADS), strict=True):
                if these.intersection(found):
                    return tag + mark
    return tag


class Node:
    __slots__ = ("children", "name")

    def __init__(self, name: str):
        self.name = name
        self.children: list[Node | str] = []


def parsed(page: str) -> Node:
    """The tree of a page's blocks; a child that is a string is the text of a block, decoded."""
    root = Node("")
    stack, held = [root], []
    open_: dict[str, int] = {}  # how many of each element are on the stack
    endless: set[str] = set()  # silent elements that have no end tag any more
    at = 0
    page_end = len(page)

    def shut(depth: int) -> None:
        for node in stack[depth:]:
            open_[node.name.rstrip(MARKS)] -= 1
        del stack[depth:]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].children.append(text)

    while at < page_end:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in SILENT:
            if not closing and not attributes.endswith("/") and tag not in endless:
                end = _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    if tag in RAW:
                        at = page_end
            held.append(" ")
            continue
        if tag in ("br", "hr"):
            held.append(" ")
            continue
        if tag not in BLOCKS or tag in VOID:
            continue
        flush()
        if closing:
            if open_.get(tag):
                shut(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name.rstrip(MARKS) == tag))
            continue
        if stack[-1].name.rstrip(MARKS) == "p":
            shut(len(stack) - 1)
        closes, within = CLOSES.get(tag, ((), ()))
        if any(open_.get(x) for x in closes):
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth].name.rstrip(MARKS)
                if name in within:
                    break
                if name in closes:
                    shut(depth)
        node = Node(name_of(tag, attributes))
        open_[tag] = open_.get(tag, 0) + 1
        stack[-1].children.append(node)
        stack.append(node)
    flush()
    return root


def key(form: list) -> str:
    """What forms must share to be aligned."""
    if form[0] == "t":
        return "#"
    if form[0] == "e":
        return form[1]
    if form[0] == "?":
        return key(form[1])
    return " ".join(key(x) for x in form[1])


def core(form: list) -> list:
    return core(form[1]) if form[0] == "?" else form


def merged(a: list, b: list) -> list:
    """The least form of both: two of one key, aligned inside; optional if either is."""
    optional = a[0] == "?" or b[0] == "?"
    a, b = core(a), core(b)
    if "+" in (a[0], b[0]):
        out = ["+", aligned(a[1] if a[0] == "+" else [a], b[1] if b[0] == "+" else [b])]
    elif a[0] == "t":
        out = ["t", a[1], min(a[2], b[2]), max(a[3], b[3])] if len(a) == len(b) == 4 and a[1] == b[1] else TEXT
    else:
        out = ["e", a[1], folded(aligned(a[2], b[2]))]
    return ["?", out] if optional else out


def aligned(a: list, b: list) -> list:
    """Two sequences as one: the longest common run of keys in order; mismatches become optional."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    if len(ka) * len(kb) > TABLE:
        steps = difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes()
    else:
        steps = _steps(ka, kb)
    out = []
    for kind, i, to_i, j, to_j in steps:
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(a[i:to_i], b[j:to_j], strict=True)]
        else:
            out += [["?", core(x)] for x in (*a[i:to_i], *b[j:to_j])]
    return out


def _steps(ka: list[str], kb: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """How the longest common run of keys in order leads from one to the other, a key at a time."""
    longest = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i in range(len(ka) - 1, -1, -1):
        for j in range(len(kb) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(longest[i + 1][j], longest[i][j + 1])
    i = j = 0
    while i < len(ka) or j < len(kb):
        if i < len(ka) and j < len(kb) and ka[i] == kb[j]:
            yield "equal", i, i + 1, j, j + 1
            i, j = i + 1, j + 1
        elif j == len(kb) or (i < len(ka) and longest[i + 1][j] >= longest[i][j + 1]):
            yield "delete", i, i + 1, j, j
            i += 1
        else:
            yield "insert", i, i, j, j + 1
            j += 1


def folded(forms: list) -> list:
    """Neighbouring repeats (of one to four forms) as one repeated group each; the shortest repeats first."""
    span = 1
    while span <= 4:
        keys = [key(x) for x in forms]
        out, i = [], 0
        while i < len(forms):
            mine = keys[i : i + span]
            if mine != keys[i + span : i + 2 * span]:
                out.append(forms[i])
                i += 1
                continue
            group = forms[i : i + span]
            i += span
            while keys[i : i + span] == mine:
                group = aligned(group, forms[i : i + span])
                i += span
            if span == 1:
                inner, optional = core(group[0]), group[0][0] == "?"
                whole = inner if inner[0] == "+" else ["+", [inner]]
                out.append(["?", whole] if optional else whole)
            else:
                out.append(["+", group])
        span, forms = (1, out) if len(out) < len(forms) else (span + 1, forms)
    return forms


def form_of(node: Node, like: int = 0) -> list:
    return ["e", node.name, folded([["t", digest(x), like, like] if isinstance(x, str) else form_of(x, like) for x in node.children])]


def shape(form: list) -> list:
    """A form without its texts."""
    if form[0] == "t":
        return TEXT
    if form[0] == "e":
        return ["e", form[1], [shape(x) for x in form[2]]]
    return ["?", shape(form[1])] if form[0] == "?" else ["+", [shape(x) for x in form[1]]]


def written(form: list) -> str:
    """A form as JSON of a flat list: each part, then those inside it, so deep pages need no deep JSON."""
    out: list = []
    rest = [form]
    while rest:
        x = rest.pop()
        if x[0] == "t":
            out.append(x)
            continue
        inside = [x[1]] if x[0] == "?" else x[2] if x[0] == "e" else x[1]
        out.append([x[0], len(inside), x[1]] if x[0] == "e" else [x[0], len(inside)])
        rest += inside[::-1]
    return json.dumps(out, separators=(",", ":"))


def read(text: str) -> list:
    """The form that written() wrote."""
    made: list = []
    for x in reversed(json.loads(text)):
        if x[0] == "t":
            made.append(x)
            continue
        inside = [made.pop() for _ in range(x[1])]
        made.append(["?", inside[0]] if x[0] == "?" else ["e", x[2], inside] if x[0] == "e" else ["+", inside])
    return made[0]


class deep:  # noqa: N801
    """While it lasts, Python functions may call themselves for every block that is inside another."""

    def __enter__(self) -> None:
        self.before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.before, 10**7))

    def __exit__(self, *_: object) -> None:
        sys.setrecursionlimit(self.before)


def inferred(forms: list[list]) -> list:
    """One wrapper for all forms: those of one shape as one, then the shapes aligned one after the other, in a fixed order."""
    of: dict[str, list] = {}
    for form in forms:
        name = written(shape(form))
        of[name] = merged(of[name], form) if name in of else form
    return functools.reduce(merged, [of[name] for name in sorted(of)])


def matched(form: list, node: Node) -> list[tuple[tuple[str, ...], str, bool]] | None:
    """The page's texts, with the names around them and whether they are the template's; None if the wrapper does not fit.

    A text is the template's if it was the same in all pages that have it, and
    at least two of them are unlike each other. A label is not.
    """
    fits, chain = _match(form, node, (), {})
    return _flat(chain) if fits else None


def _match(form: list, node: Node, path: tuple[str, ...], known: dict) -> tuple[bool, tuple | list | None]:
    """Whether an element fits, and the chain of its texts. `known` holds what was matched before."""
    if form[1] != node.name:
        return False, None
    at = id(form), id(node)
    if at not in known:
        known[at] = _fill(form[2], node.children, inside(path, node.name), known)
    return known[at]


def _flat(chain: tuple | list | None) -> list:
    """The texts of a chain: a list of them, or a pair of chains, or nothing."""
    out, rest = [], [chain]
    while rest:
        x = rest.pop()
        if isinstance(x, list):
            out.extend(x)
        elif x is not None:
            rest += [x[1], x[0]]
    return out


def inside(path: tuple[str, ...], name: str) -> tuple[str, ...]:
    """The path into an element, of the names that say anything about a text in it, without repeats."""
    if path[-1:] == (name,) or not (name[-1:] in MARKED or name in NAMED):
        return path
    return (*path, name)


def _fill(forms: list, children: list, path: tuple[str, ...], known: dict) -> tuple[bool, tuple | list | None]:
    """The chain of texts of `children` by `forms`: of all ways that fit, the one whose first optional and repeated forms take most.

    A repeated form goes on from a child once, whatever led there: the first way
    is the preferred one. So the time is in proportion to the children.
    """
    named = LABELS.intersection(x.rstrip(MARKS) for x in path)
    begun: dict[int, set[int]] = {}

    def one(form: list, at: int, chain: tuple | None) -> list[tuple[int, tuple | None]]:
        """Where this form can end that begins at a child, the preferred end first, and the chain of texts there."""
        if form[0] == "?":
            return [*one(form[1], at, chain), (at, chain)]
        if form[0] == "+":
            before = begun.setdefault(id(form), set())
            open_, ends = [(at, chain)] if at not in before else [], {}
            before.add(at)
            while open_:
                for end, found in run(form[1], *open_.pop()).items():
                    if end not in ends:
                        ends[end] = found
                        if end not in before:
                            before.add(end)
                            open_.append((end, found))
            return sorted(ends.items(), key=lambda x: -x[0])
        if at == len(children):
            return []
        child = children[at]
        if form[0] == "t":
            if not isinstance(child, str):
                return []
            common = len(form) == 4 and form[2] < form[3] and form[1] == digest(child)
            return [(at + 1, (chain, [(path, child, common and not named)]))]
        fits, inner = (False, None) if isinstance(child, str) else _match(form, child, path, known)
        return [(at + 1, (chain, inner))] if fits else []

    def run(some: list, at: int, chain: tuple | None) -> dict[int, tuple | None]:
        """Where the forms can end one after the other."""
        states = {at: chain}
        for form in some:
            after: dict[int, tuple | None] = {}
            for begin, before in states.items():
                for end, found in one(form, begin, before):
                    after.setdefault(end, found)
            states = after
        return states

    ends = run(forms, 0, None)
    return len(children) in ends, ends.get(len(children))


def walked(node: Node) -> Iterator[tuple[tuple[str, ...], str]]:
    """The texts of a page that its host's wrapper does not fit, in order."""
    rest: list[tuple[tuple[str, ...], Node | str]] = [((), node)]
    while rest:
        path, x = rest.pop()
        if isinstance(x, str):
            yield path, x
        else:
            here = inside(path, x.name)
            rest += [(here, y) for y in reversed(x.children)]


@functools.lru_cache(1 << 14)
def apart(path: tuple[str, ...]) -> bool:
    """Whether a slot is in something that is not the article. A header within the article is of it."""
    tags = [name.rstrip(MARKS) for name in path]
    centers = [i for i, tag in enumerate(tags) if tag in ("article", "main")]
    first, last = (centers[0], centers[-1]) if centers else (len(path), -1)
    for i, (name, tag) in enumerate(zip(path, tags, strict=True)):
        if tag in ASIDE:
            return True
        if tag not in ("html", "body", "article", "main") or name[-1:] == "!":
            mark = name[-1:] if name != tag and tag not in ("html", "body") else ""
            if mark == "!" or (mark == "~" and i > last) or ((mark == "^" or tag == "header") and not first <= i and i > last):
                return True
    return False


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def article(texts: list[tuple]) -> list[tuple]:
    """Those of a page's texts that are in its article.

    The article is the first of the elements article and main that the page
    has; a page with neither gives all that are not apart.
    """
    texts = [x for x in texts if not apart(x[0])]
    for where in ("article", "main"):
        if inside := [x for x in texts if where in x[0]]:
            return inside
    return texts


def likeness(tree: Node) -> int:
    """A number that pages share as likely as their articles share runs of three words: copies do, other pages hardly."""
    words = " ".join(x[1] for x in article(list(walked(tree)))).encode("utf-8", "surrogatepass").split()
    return min(zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))


def main_text(page: str, wrapper: list) -> str:
    """The texts of the wrapper's slots in the article, without the template's. A page that it does not fit gives all texts of its article."""
    tree = parsed(page)
    with deep():
        texts = matched(wrapper, tree)
    return " ".join(x[1] for x in article(list(walked(tree)) if texts is None else texts) if len(x) == 2 or not x[2])


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, wrapper): the wrapper of each host from all its pages, as written().

    Each page's tokens become a form with its repeats folded. Forms of one shape
    are one form, first in each task and then over all: texts that differ are
    slots and equal ones stay. The different shapes of a host are then aligned, in
    the order of their digests. Both go by steps of STEP forms, each step's
    results being the next one's forms, so no task holds all forms of a host.
    Neither the number nor the order nor the partitions of pages count.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list] = {}
        held = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()), pa.array([written(f) for f in rows.values()], pa.string())], names=["host", "shape", "form"])
            rows.clear()
            return made

        for batch in batches:
            for where, text in zip(column(batch, "host").to_pylist(), column(batch, page).to_pylist(), strict=True):
                tree = parsed(text or "")
                with deep():
                    form = form_of(tree, likeness(tree))
                    name = written(shape(form))
                    at = where, digest(name) - (1 << 63)
                    if at in rows:
                        rows[at] = merged(rows[at], form)
                    else:
                        rows[at] = form
                        held += len(name)
                if held >= HELD:
                    yield out()
                    held = 0
        if rows:
            yield out()

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        with deep():
            whole = functools.reduce(merged, [read(f) for f in rows.sort_values(["shape", "form"])["form"]])
            return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [rows["shape"].min()], "form": [written(whole)]})

    def reduced(rows: DataFrame, *by: str) -> DataFrame:
        while True:
            place = F.row_number().over(Window.partitionBy(*by).orderBy("shape", "form"))
            steps = rows.withColumn("step", F.floor((place - 1) / STEP)).groupBy(*by, "step")
            rows = table(steps.applyInPandas(align, "host string, shape long, form string"), "wrappers")
            if rows.groupBy(*by).count().filter("count > 1").isEmpty():
                return rows

    shapes = table(pages.select(host(url).alias("host"), page).mapInArrow(forms, "host string, shape long, form string"), "forms")
    return reduced(reduced(shapes, "host", "shape"), "host").select("host", F.col("form").alias("wrapper"))


def extracted(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the main text of each and its n_chars.

    Wrappers are inferred per host (wrappers()) and matched with each page; the
    slots in the article give the text, and what is the same on all unlike pages
    at one place of the wrapper is left out as the template's, but for headings:
    references decoded, white space of a block one space, blocks joined by one
    space. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are known by
    the elements and attribute words listed above. A null or empty page has an
    empty text, a null address the host "". A page that the wrapper of its host
    does not fit is read by its own tokens. Columns of the added names are replaced.
    """
    pages = pages.drop(*[c for c in (text, "n_chars") if c in pages.columns])
    known = wrappers(pages, url, page)
    met = pages.withColumn("__host", host(url)).join(known.withColumnsRenamed({"host": "__host", "wrapper": "__wrapper"}), "__host", "left").select(*pages.columns, "__wrapper")
    names = pages.columns
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in batches:
            out = []
            for p, w in zip(*[column(batch, c).to_pylist() for c in (page, "__wrapper")], strict=True):
                if w not in seen:
                    seen[w] = read(w)
                out.append(main_text(p or "", seen[w]))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*names, text, "n_chars"])

    return met.mapInArrow(run, schema)
