"""HTML extraction over a stored-pages table.

Spark has no HTML parser, so exactly one Python hop exists: ``extract_html``
(``mapInArrow``, stdlib ``html.parser``) builds a tag-soup tree per page and
evaluates *all* requested selectors in one pass. It emits one row per page with
arrays of raw matches; every rule on top of it (selector fallback by rank,
first-present field, href resolution, thresholds, status) is a Spark column
expression in the operators below, so the plan stays JVM-side after the hop.

All selectors of a page are looked up in one walk of its tree: a selector is filed under its id, its
first class, its first attribute or its tag, an element asks for what it has, and only what is filed
there is tested. So a page costs what its elements and matches cost, however many selectors there are.

Tree model (tag soup): a start tag opens an element (void elements close at
once); an end tag closes the nearest open element with that name, or is ignored;
script/style bodies are raw text and, like comments, never part of element text.
Selector grammar: ``tag``, ``.cls``, ``#id``, ``[a]``, ``[a="v"]``, ``[a*="v"]``
and combinations on one element (no combinators).
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions.text import absolute_url, base_of, clean_text, contains_any, py_strip, relative_date

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))

# --------------------------------------------------------------- selectors

_SEL_RE = re.compile(r"""
    (?P<tag>[A-Za-z][A-Za-z0-9-]*|\*)?
    (?P<rest>(?:\.[-\w]+|\#[-\w]+|\[[^\]]+\])*)$""", re.X)
_PART_RE = re.compile(r"""\.(?P<cls>[-\w]+)|\#(?P<id>[-\w]+)|\[\s*(?P<attr>[-\w:]+)\s*(?:(?P<op>\*?=)\s*(?P<q>["']?)(?P<val>.*?)(?P=q))?\s*\]""")


def parse_selector(sel: str) -> tuple:
    """-> (tag|None, classes, id|None, [(attr, op|None, value)])."""
    m = _SEL_RE.match(sel.strip())
    if not m:
        raise ValueError(f"unsupported selector: {sel!r}")
    tag = m.group("tag")
    tag = None if tag in (None, "*") else tag.lower()
    classes, ident, attrs = [], None, []
    for p in _PART_RE.finditer(m.group("rest") or ""):
        if p.group("cls"):
            classes.append(p.group("cls"))
        elif p.group("id"):
            ident = p.group("id")
        else:
            attrs.append((p.group("attr").lower(), p.group("op"), p.group("val")))
    return tag, tuple(classes), ident, tuple(attrs)


class _Node:
    __slots__ = ("tag", "attrs", "children", "cls")

    def __init__(self, tag: str, attrs: dict):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.cls = (attrs.get("class") or "").split()


class _Raw(str):
    """Body of script/style: kept in the tree, excluded from element text."""


class _Comment(_Raw):
    """Comment: a string node of the tree, never part of element text."""


class _Decl(_Raw):
    """Doctype / declaration string."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: ("" if v is None else v) for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, {k: ("" if v is None else v) for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        top = self.stack[-1]
        top.children.append(_Raw(data) if top.tag in RAW_TEXT else data)

    def handle_comment(self, data):
        self.stack[-1].children.append(_Comment(data))

    def handle_decl(self, decl):
        self.stack[-1].children.append(_Decl(decl))


def parse_html(html: str) -> _Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _matches(node: _Node, sel: tuple) -> bool:
    tag, classes, ident, attrs = sel
    if tag is not None and node.tag != tag:
        return False
    for c in classes:
        if c not in node.cls:
            return False
    if ident is not None and node.attrs.get("id") != ident:
        return False
    for name, op, val in attrs:
        if name not in node.attrs:
            return False
        have = " ".join(node.cls) if name == "class" else node.attrs[name]
        if op == "=" and have != val:
            return False
        if op == "*=" and (not val or val not in have):
            return False
    return True


class SelectorIndex:
    """Selectors filed by what an element must have to match them."""

    def __init__(self, selectors: Sequence[tuple]):
        self.selectors = list(selectors)
        self.by: dict[tuple, list[int]] = {}
        for no, (tag, classes, ident, attrs) in enumerate(self.selectors):
            at = ("#", ident) if ident is not None else (".", classes[0]) if classes else ("[", attrs[0][0]) if attrs else ("", tag)
            self.by.setdefault(at, []).append(no)
        self.tested = 0  # selectors held against an element so far

    def of(self, node: _Node) -> list[int]:
        """The selectors that match an element, in their order."""
        by, found = self.by, []
        for at in (("", node.tag), ("", None), ("#", node.attrs.get("id")), *[(".", c) for c in dict.fromkeys(node.cls)], *[("[", a) for a in node.attrs]):
            for no in by.get(at, ()):
                self.tested += 1
                if _matches(node, self.selectors[no]):
                    found.append(no)
        return found


class _Walk:
    """One pre-order walk: the elements, where the subtree of each ends, and the elements that match each selector."""

    def __init__(self, root: _Node, index: SelectorIndex):
        self.elements, self.ends, self.links = [], [], []
        self.hits: list[list[int]] = [[] for _ in index.selectors]
        stack: list = [c for c in reversed(root.children) if isinstance(c, _Node)]
        while stack:
            n = stack.pop()
            if isinstance(n, int):
                self.ends[n] = len(self.elements)
                continue
            at = len(self.elements)
            self.elements.append(n)
            self.ends.append(at + 1)
            if n.tag == "a":
                self.links.append(at)
            for no in index.of(n):
                self.hits[no].append(at)
            inner = [c for c in reversed(n.children) if isinstance(c, _Node)]
            if inner:
                stack.append(at)
                stack.extend(inner)

    def inside(self, places: list[int], at: int) -> list[int]:
        """Of ascending places those inside the element."""
        return places[bisect_left(places, at + 1):bisect_left(places, self.ends[at])]

    def match(self, at: int, texts: bool = True, **extra) -> dict:
        node = self.elements[at]
        a = bisect_left(self.links, at + 1)
        inner = self.elements[self.links[a]] if a < len(self.links) and self.links[a] < self.ends[at] else None
        return {"tag": node.tag, "cls": " ".join(node.cls), "parts": _text_parts(node) if texts else [],
                "href": node.attrs.get("href"), "inner_href": inner.attrs.get("href") if inner else None, **extra}


def _text_parts(node: _Node) -> list[str]:
    """Text nodes under ``node`` in document order (no script/style/comments)."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, _Node):
            stack.extend(reversed(n.children))
        elif not isinstance(n, _Raw):
            out.append(n)
    return out


def _text_nodes(root: _Node) -> list[dict]:
    """Every string node (text, script/style body, comment, doctype) with its parent."""
    out, stack = [], [(root, None)]
    while stack:
        n, parent = stack.pop()
        if isinstance(n, _Node):
            stack.extend((c, n) for c in reversed(n.children))
        elif parent is not None:
            kind = ("comment" if isinstance(n, _Comment) else "decl" if isinstance(n, _Decl)
                    else "raw" if isinstance(n, _Raw) else "text")
            out.append({"node_no": len(out), "kind": kind, "parent_tag": parent.tag,
                        "parent_cls": " ".join(parent.cls), "text": str(n)})
    return out


MATCH_T = "tag string, cls string, parts array<string>, href string, inner_href string"
FIELD_T = f"array<struct<field:string, rank:int, n:int, {MATCH_T}>>"
ALL_T = f"array<struct<field:string, rank:int, el_no:int, {MATCH_T}>>"
_INNER = ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in MATCH_T.split(", "))
CARD_T = f"array<struct<card_rank:int, card_no:int, {_INNER}, found:array<struct<field:string, rank:int, el_no:int, {_INNER}>>>>"
NODE_T = "array<struct<node_no:int, kind:string, parent_tag:string, parent_cls:string, text:string>>"

#: what a worker holds of a batch's matches at a time: those of pages with so many bytes in all (a page counts
#: as ``PAGE_BYTES`` at least), so that its memory depends on neither the size of a batch nor that of a partition
SLICE_BYTES, PAGE_BYTES = 1 << 18, 1 << 10


class PagePlan:
    """What is asked of a page: named lists of selectors, all in one index."""

    def __init__(self, fields: dict | None = None, all_of: dict | None = None, cards: Sequence[str] = (), card_fields: dict | None = None,
                 card_all: dict | None = None, text_nodes: bool = False, texts: bool = True, first_of: tuple[str, str] | None = None):
        self.text_nodes, self.texts, self.first_of = text_nodes, texts, first_of
        asked = [(kind, f, r, sel) for kind, named in (("field", fields), ("all", all_of), ("card", {"": cards}), ("card_field", card_fields), ("card_all", card_all))
                 for f, sels in (named or {}).items() for r, sel in enumerate([sels] if isinstance(sels, str) else sels)]
        self.index = SelectorIndex([parse_selector(sel) for *_, sel in asked])
        self.asked: dict[str, list[tuple]] = {}
        for no, (kind, f, r, _) in enumerate(asked):
            self.asked.setdefault(kind, []).append((f, r, no))

    def _of(self, kind: str) -> list[tuple]:
        return self.asked.get(kind, [])

    def page(self, html) -> tuple[list, list, list, list, str | None]:
        """fields, all_of, cards, nodes and the error of a page (see ``extract_html``)."""
        error = None
        try:
            root = parse_html(html if isinstance(html, str) else "")
        except Exception as exc:  # P14: a bad page is reported, the rest continue
            root, error = _Node("[document]", {}), f"{type(exc).__name__}: {exc}"
        walk, texts = _Walk(root, self.index), self.texts
        hits = walk.hits
        fields = [walk.match(hits[no][0], texts, field=f, rank=r, n=len(hits[no])) for f, r, no in self._of("field") if hits[no]]
        if self.first_of:
            tag, token = self.first_of
            first = next((i for i, e in enumerate(walk.elements) if e.tag == tag and token.lower() in " ".join(e.cls).lower()), None)
            if first is not None:
                fields.append(walk.match(first, texts, field="first", rank=0, n=1))
        all_of = [walk.match(at, texts, field=f, rank=r, el_no=i) for f, r, no in self._of("all") for i, at in enumerate(hits[no])]
        cards = []
        for _, rank, no in self._of("card"):
            for n, at in enumerate(hits[no]):
                found = []
                for f, r, inner in self._of("card_field"):
                    mine = bisect_left(hits[inner], at + 1)
                    if mine < len(hits[inner]) and hits[inner][mine] < walk.ends[at]:
                        found.append(walk.match(hits[inner][mine], texts, field=f, rank=r, el_no=0))
                for f, r, inner in self._of("card_all"):
                    found += [walk.match(x, texts, field=f, rank=r, el_no=i) for i, x in enumerate(walk.inside(hits[inner], at))]
                cards.append(walk.match(at, texts, card_rank=rank, card_no=n, found=found))
            if cards:  # the first selector that hits supplies all cards
                break
        return fields, all_of, cards, _text_nodes(root) if self.text_nodes else [], error


def _arrow(*fields: tuple[str, pa.DataType]) -> pa.DataType:
    return pa.list_(pa.struct(list(fields)))


_MATCH_A = [("tag", pa.string()), ("cls", pa.string()), ("parts", pa.list_(pa.string())), ("href", pa.string()), ("inner_href", pa.string())]
_ALL_A = _arrow(("field", pa.string()), ("rank", pa.int32()), ("el_no", pa.int32()), *_MATCH_A)
#: the columns of ``_page_schema`` after those that are kept
PAGE_A = {"fields": _arrow(("field", pa.string()), ("rank", pa.int32()), ("n", pa.int32()), *_MATCH_A), "all_of": _ALL_A,
          "cards": _arrow(("card_rank", pa.int32()), ("card_no", pa.int32()), *_MATCH_A, ("found", _ALL_A)),
          "nodes": _arrow(("node_no", pa.int32()), *[(c, pa.string()) for c in ("kind", "parent_tag", "parent_cls", "text")]), "parse_error": pa.string()}


def _page_slices(batch: pa.RecordBatch, html_col: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE_BYTES`` (one page at least)."""
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column(html_col)).to_pylist()):
        size = max(size or 0, PAGE_BYTES)
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if held:
        yield batch.slice(start)


def _page_rows(rows: pa.RecordBatch, keep: Sequence[str], pages: Sequence[tuple]) -> pa.RecordBatch:
    found = [pa.array(column, kind) for column, kind in zip(zip(*pages), PAGE_A.values())]
    return pa.RecordBatch.from_arrays([*[rows.column(k) for k in keep], *found], [*keep, *PAGE_A])


def extract_html(df: DataFrame, keep: Sequence[str], html_col: str = "html", *,
                 fields: dict[str, Sequence[str]] | None = None,
                 all_of: dict[str, Sequence[str]] | None = None,
                 cards: Sequence[str] | None = None,
                 card_fields: dict[str, Sequence[str]] | None = None,
                 card_all: dict[str, Sequence[str]] | None = None,
                 text_nodes: bool = False, texts: bool = True, first_of: tuple[str, str] | None = None) -> DataFrame:
    """One pass per page over every requested selector.

    Output: ``keep`` columns plus
      * ``fields``  first match of each page-level (field, rank) selector and ``n`` hits;
      * ``all_of``  every match of each (field, rank) selector, ``el_no`` in document order;
      * ``cards``   one struct per card of the first card selector that hits: the card itself and
        in ``found`` the first match of each card field selector inside it (``card_all``: every
        match, ``el_no``);
      * ``nodes``   every text node with its parent tag/class (when ``text_nodes``);
      * ``parse_error`` null, or the error of a page that could not be parsed (its arrays are
        empty; the other pages continue).

    ``texts=False`` leaves the text of every match empty (counts and links need none).
    ``first_of`` = (tag, token) puts into ``fields`` the first element of that tag whose
    classes (lower-cased) contain the token, as field 'first'.
    """
    keep = list(keep)
    asked = dict(fields=fields, all_of=all_of, cards=list(cards or []), card_fields=card_fields, card_all=card_all,
                 text_nodes=text_nodes, texts=texts, first_of=first_of)
    PagePlan(**asked)  # an unsupported selector fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = PagePlan(**asked)
        for batch in batches:
            for rows in _page_slices(batch, html_col):
                yield _page_rows(rows, keep, [plan.page(html) for html in rows.column(html_col).to_pylist()])

    schema = _page_schema(df, keep)
    # only the key columns and the html travel to Python; Spark bounds an Arrow batch by bytes
    # (spark.sql.execution.arrow.maxBytesPerBatch), and its matches are made and handed on slice by slice
    return df.select(*keep, html_col).mapInArrow(run, schema)


def _page_schema(df: DataFrame, keep: Sequence[str]) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return f"{kept}, fields {FIELD_T}, all_of {ALL_T}, cards {CARD_T}, nodes {NODE_T}, parse_error string"


def extract_cards_by_source(pages: DataFrame, config: DataFrame, keep: Sequence[str], html_col: str = "html") -> DataFrame:
    """H1-H5 of pages of many sources, each by its own selectors, in one scan and one walk a page.

    ``config`` (``sources/config.source_plans``): one row a source with its selectors as JSON; it is small, its
    size is checked there. Pages of a source without a row drop out. Adds all columns of ``config``, ``cards``,
    ``parse_error`` and ``n_cards``.
    """
    met = pages.join(F.broadcast(config), "source")
    keep = [*keep, *[c for c in config.columns if c not in keep and c != "selectors"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, PagePlan] = {}
        for batch in batches:
            for rows in _page_slices(batch, html_col):
                pages = []
                for selectors, html in zip(rows.column("selectors").to_pylist(), rows.column(html_col).to_pylist()):
                    if selectors not in plans:
                        named = json.loads(selectors)
                        plans[selectors] = PagePlan(cards=named.pop("job_card", []), card_fields=named)
                    pages.append(plans[selectors].page(html))
                yield _page_rows(rows, keep, pages)

    out = met.select(*keep, "selectors", html_col).mapInArrow(run, _page_schema(met, keep))
    return out.select(*keep, "cards", "parse_error", F.size("cards").cast("bigint").alias("n_cards"))


# ------------------------------------------------------------ text columns

def element_text(m: Column, mode: str = "clean") -> Column:
    """Text of a match struct.

    ``clean``: concatenate text nodes then collapse whitespace (``_clean_text(get_text())``);
    ``raw``:   concatenation only (``get_text()``);
    ``strip``: strip each node, drop empty ones, join with ' ' (``get_text(' ', strip=True)``);
    ``strip_concat``: the same joined with '' (``get_text(strip=True)``).
    """
    parts = m["parts"]
    if mode == "raw":
        return F.array_join(parts, "")
    if mode == "clean":
        return clean_text(F.array_join(parts, ""))
    if mode in ("strip", "strip_concat"):
        sep = " " if mode == "strip" else ""
        return F.array_join(F.filter(F.transform(parts, py_strip), lambda x: x != ""), sep)
    raise ValueError(mode)


def _field_is(name: str):
    """Predicate for HOF filters (a factory: HOF lambdas must take exactly one argument)."""
    return lambda x: x["field"] == F.lit(name)


# ---------------------------------------------------------------- operators

def select_text(pages: DataFrame, fields: dict[str, Sequence[str]], keep: Sequence[str] = ("page_id",),
                mode: str = "clean") -> DataFrame:
    """H2: per page and field, the text of the lowest-rank selector with an element.

    An element that exists but is empty wins ('' returned); no element -> ''.
    """
    ex = extract_html(pages, keep, fields=fields)
    cols = [F.col(k) for k in keep]
    for f in fields:
        hit = F.filter("fields", _field_is(f))
        first = F.array_min(F.transform(hit, lambda x: F.struct(x["rank"].alias("rank"), x["parts"].alias("parts"))))
        cols.append(F.coalesce(element_text(first, mode), F.lit("")).alias(f))
    return ex.select(*cols)


def extract_cards(pages: DataFrame, card_selectors: Sequence[str], keep: Sequence[str] = ("page_id",),
                  mode: str = "clean") -> DataFrame:
    """H1: the first card selector with at least one hit supplies all cards of a page."""
    ex = extract_html(pages, keep, cards=card_selectors)
    return (ex.select(*keep, F.explode("cards").alias("c"))
            .select(*keep, F.col("c.card_rank").alias("card_rank"), F.col("c.card_no").cast("bigint").alias("card_no"),
                    element_text(F.col("c"), mode).alias("card_text")))


def extract_postings(pages: DataFrame, source_cfg: dict, keep: Sequence[str] = ("page_id",),
                     base_col: Column | None = None, link_mode: str = "title",
                     source_name: str | None = None) -> DataFrame:
    """H1-H5 + P2/P5: cards -> postings (title required, link resolution, source tag).

    ``link_mode='title'``: for each title selector in rank order, the element itself if it is
    an ``<a>`` else its first inner ``<a>``; the first non-empty href wins; a path starting
    with '/' is joined to ``base_col`` (default: the configured base url).
    ``link_mode='link'``: the first ``link`` selector element's href or '' (no base join).
    """
    ex = extract_card_fields(pages, source_cfg, keep, link_mode)
    return postings_from_cards(ex, source_cfg, keep, base_col, link_mode, source_name)


POSTING_FIELDS = ["title", "company", "location", "salary", "description"]


def extract_card_fields(pages: DataFrame, source_cfg: dict, keep: Sequence[str], link_mode: str = "title") -> DataFrame:
    """One parse per page: card selectors + every field selector inside each card.

    Adds ``n_cards``: number of cards under the H1 fallback rule (0 = no selector hit).
    """
    sels = source_cfg["selectors"]
    cf = {n: sels.get(n, []) for n in POSTING_FIELDS}
    if link_mode == "link":
        cf["link"] = sels.get("link", ["a.base-card__full-link"])
    ex = extract_html(pages, keep, cards=sels["job_card"], card_fields=cf)
    return ex.select(*keep, "cards", "parse_error", F.size("cards").cast("bigint").alias("n_cards"))


def card_posting(base: Column) -> dict[str, Column]:
    """The fields of the card in column ``card``: texts, ``title_url`` (joined to ``base``) and ``link_url`` (as it stands)."""
    mine = F.col("card.found")

    def first(name: str, *parts: str) -> Column:
        return F.array_min(F.transform(F.filter(mine, _field_is(name)), lambda x: F.struct(x["rank"].alias("rank"), *[x[p].alias(p) for p in parts])))

    out = {n: F.coalesce(element_text(first(n, "parts"), "clean"), F.lit("")) for n in POSTING_FIELDS}
    hrefs = F.transform(F.filter(mine, _field_is("title")), lambda x: F.struct(
        x["rank"].alias("rank"), F.when(x["tag"] == "a", x["href"]).otherwise(x["inner_href"]).alias("h")))
    href = F.array_min(F.filter(hrefs, lambda x: F.coalesce(x["h"], F.lit("")) != ""))["h"]
    out["title_url"] = F.coalesce(absolute_url(href, base), F.lit(""))
    out["link_url"] = F.coalesce(first("link", "href")["href"], F.lit(""))
    return out


def postings_from_cards(ex: DataFrame, source_cfg: dict, keep: Sequence[str], base_col: Column | None = None,
                        link_mode: str = "title", source_name: str | None = None) -> DataFrame:
    """Card rows (from ``extract_card_fields``) -> one posting per card with a title."""
    card_rows = ex.select(*keep, F.explode("cards").alias("card"))  # a card carries its own fields only
    got = card_posting(base_col if base_col is not None else F.lit(source_cfg.get("base_url", "")))
    res = card_rows.select(*keep, F.col("card.card_rank").alias("card_rank"), F.col("card.card_no").cast("bigint").alias("card_no"),
                           *[got[n].alias(n) for n in POSTING_FIELDS], got[f"{link_mode}_url"].alias("url")).filter(F.col("title") != "")
    if source_name is not None:
        res = res.withColumn("source", F.lit(source_name))
    return res


def postings_by_source(ex: DataFrame, keep: Sequence[str], page_base: Column | None = None) -> DataFrame:
    """Postings of ``extract_cards_by_source``: links as the source's ``link_mode`` and ``base_url`` say."""
    got = card_posting(page_base if page_base is not None else F.col("base_url"))
    url = F.when(F.col("link_mode") == "link", got["link_url"]).otherwise(got["title_url"])
    return (ex.withColumn("card", F.explode("cards"))
            .select(*keep, F.col("card.card_rank").alias("card_rank"), F.col("card.card_no").cast("bigint").alias("card_no"),
                    *[got[n].alias(n) for n in POSTING_FIELDS], url.alias("url")).filter(F.col("title") != ""))


def description_probe(pages: DataFrame, card_selectors: Sequence[str],
                      probes: Sequence[str] = tuple(fixed.CARD_DESCRIPTION_PROBE),
                      min_len: int = fixed.CARD_DESCRIPTION_PROBE_MIN_LEN, preview: int = 150, n_divs: int = 5,
                      keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """In the first card of a page, the first probe selector whose stripped text is
    longer than ``min_len`` (selector rank, length, preview); when none qualifies, those of the
    card's first ``n_divs`` divs that do, as (class, length) - the listing is the feature."""
    ex = extract_html(pages, keep, cards=card_selectors, card_fields={"probe": probes}, card_all={"div": ["div"]})
    first_card = F.coalesce(F.get("cards", F.lit(0))["found"], F.slice(F.flatten(F.col("cards.found")), 1, 0))
    stripped = lambda x: py_strip(F.array_join(x["parts"], ""))  # noqa: E731 - get_text().strip()
    cand = F.transform(F.filter(first_card, _field_is("probe")),
                       lambda x: F.struct(x["rank"].alias("rank"), stripped(x).alias("t")))
    hit = F.array_min(F.filter(cand, lambda x: F.length(x["t"]) > min_len))
    divs = F.transform(F.filter(first_card, lambda x: (x["field"] == "div") & (x["el_no"] < n_divs)),
                       lambda x: F.struct(x["el_no"].alias("el_no"), x["cls"].alias("cls"),
                                          F.length(stripped(x)).alias("n")))
    listed = F.array_sort(F.filter(divs, lambda x: x["n"] > min_len))
    return ex.select(
        *keep, hit["rank"].cast("bigint").alias("probe_rank"), F.length(hit["t"]).cast("bigint").alias("length"),
        F.substring(hit["t"], 1, preview).alias("preview"),
        F.when(hit.isNull(), F.transform(listed, lambda x: F.concat(x["cls"], F.lit(":"), x["n"].cast("string"))))
        .alias("divs"))


def page_rejects(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The pages that the parser rejects, with the error (they yield no matches elsewhere)."""
    return (extract_html(pages, keep, texts=False).filter(F.col("parse_error").isNotNull())
            .select(*keep, F.col("parse_error").alias("error")))


def detail_extract(pages: DataFrame, selectors: Sequence[str], date_selectors: Sequence[str], date_words: Sequence[str],
                   keep: Sequence[str] = ("page_id",), min_len: int = fixed.DESCRIPTION_MIN_LEN, mode: str = "clean",
                   footer_token: str = fixed.FOOTER_CLASS_TOKEN, footer_pattern: str = fixed.RELATIVE_DATE_PATTERN,
                   error_text: str = fixed.DESCRIPTION_ERROR) -> DataFrame:
    """H6-H8 from one parse: ``description, status, error, posted_date`` of a detail page.

    The description is the first selector's text longer than ``min_len``; the date is the first
    date selector's text with a date word, else the relative date in the first footer element.
    A page that cannot be parsed has status 'failed' and the parser's error.
    """
    ex = extract_html(pages, keep, fields={"d": selectors, "date": date_selectors}, first_of=("div", footer_token))

    def texts(name):
        return F.transform(F.filter("fields", _field_is(name)),
                           lambda x: F.struct(x["rank"].alias("rank"), element_text(x, mode).alias("t")))

    seen = ex.select(*keep, "parse_error", texts("d").alias("d"), texts("date").alias("dates"),
                     element_text(F.get(F.filter("fields", _field_is("first")), F.lit(0)), "clean").alias("footer"))
    acc = F.array_min(F.filter("d", lambda x: F.length(x["t"]) > min_len))
    date = F.array_min(F.filter("dates", lambda x: contains_any(x["t"], date_words)))["t"]
    last = F.coalesce(F.array_max("d")["t"], F.lit(""))
    return seen.select(
        *keep, F.coalesce(acc["t"], F.lit("")).alias("description"),
        F.when(acc.isNotNull(), "success").otherwise("failed").alias("status"),
        F.coalesce("parse_error", F.when(acc.isNull() & (last == ""), F.lit(error_text))).alias("error"),
        F.coalesce(date, relative_date(F.col("footer"), footer_pattern), F.lit("")).alias("posted_date"))


def page_links(pages: DataFrame, token: str, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """H9: count of ``<a href>`` links whose href (lower-cased) contains ``token``."""
    ex = extract_html(pages, keep, all_of={"a": ["a[href]"]}, texts=False)
    hits = F.filter("all_of", lambda x: F.lower(x["href"]).contains(token.lower()))
    return ex.select(*keep, F.size("all_of").cast("bigint").alias("n_links"),
                     F.size(hits).cast("bigint").alias("n_token_links"))


def absolute_links(pages: DataFrame, selector: str = "a", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """F2 over every link: paths starting with '/' joined to the page's scheme://host."""
    ex = extract_html(pages, keep, all_of={"a": [selector]}, texts=False)
    return (ex.select(*keep, F.explode("all_of").alias("m"))
            .select(*[k for k in keep if k != "url"], F.col("m.el_no").cast("bigint").alias("link_no"),
                    F.col("m.href").alias("href"),
                    absolute_url(F.col("m.href"), base_of(F.col("url"))).alias("abs_url")))


def description_pick(pages: DataFrame, selectors: Sequence[str], keep: Sequence[str] = ("page_id",),
                     min_len: int = fixed.DESCRIPTION_MIN_LEN, mode: str = "clean",
                     error_text: str = fixed.DESCRIPTION_ERROR) -> DataFrame:
    """H6/H7: first selector whose text is longer than ``min_len`` (strict).

    status 'success'/'failed'; description '' on failure; ``error`` set when the text of
    the last element examined was empty or no selector matched at all.
    """
    ex = extract_html(pages, keep, fields={"d": selectors})
    cand = F.transform("fields", lambda x: F.struct(x["rank"].alias("rank"), element_text(x, mode).alias("t")))
    ok = F.filter(cand, lambda x: F.length(x["t"]) > min_len)
    acc = F.array_min(ok)
    last_seen = F.array_max(cand)  # all selectors are examined when none is accepted
    return ex.select(
        *keep,
        F.coalesce(acc["t"], F.lit("")).alias("description"),
        F.when(acc.isNotNull(), "success").otherwise("failed").alias("status"),
        F.when(acc.isNull() & (F.coalesce(last_seen["t"], F.lit("")) == ""), F.lit(error_text))
        .cast("string").alias("error"),
        acc["rank"].cast("bigint").alias("rank"))


def date_text_pick(pages: DataFrame, selectors: Sequence[str], words: Sequence[str],
                   keep: Sequence[str] = ("page_id",), mode: str = "clean") -> DataFrame:
    """H8 (first part): first selector element whose text contains a date word (any case)."""
    ex = extract_html(pages, keep, fields={"d": selectors})
    cand = F.transform("fields", lambda x: F.struct(x["rank"].alias("rank"), element_text(x, mode).alias("t")))
    ok = F.filter(cand, lambda x: contains_any(x["t"], words))
    return ex.select(*keep, F.coalesce(F.array_min(ok)["t"], F.lit("")).alias("posted_date"))


def footer_date(pages: DataFrame, class_token: str = fixed.FOOTER_CLASS_TOKEN,
                pattern: str = fixed.RELATIVE_DATE_PATTERN, tag: str = "div",
                keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """H8 (fallback): first ``div`` whose class (lower-cased) contains the token -> F8 rule."""
    ex = extract_html(pages, keep, first_of=(tag, class_token))
    first = F.get("fields", F.lit(0))
    txt = element_text(first, "clean")
    return ex.select(*keep, F.coalesce(relative_date(txt, pattern), F.lit("")).alias("posted_date"))


def text_node_grep(pages: DataFrame, tokens: Sequence[str] = tuple(fixed.TEXT_NODE_TOKENS),
                   width: int = fixed.TEXT_NODE_PREVIEW, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Text nodes containing any token (case-sensitive), parent tag/classes, stripped preview."""
    ex = extract_html(pages, keep, text_nodes=True)
    hit = F.filter("nodes", lambda x: contains_any(x["text"], tokens, lower=False))
    return (ex.select(*keep, F.explode(hit).alias("n"))
            .select(*keep, F.col("n.node_no").cast("bigint").alias("node_no"), F.col("n.kind").alias("kind"),
                    F.col("n.parent_tag").alias("parent_tag"), F.col("n.parent_cls").alias("parent_cls"),
                    F.substring(py_strip(F.col("n.text")), 1, width).alias("text")))


def source_line_grep(pages: DataFrame, html_col: str = "html", tokens=("Posted",), lower_tokens=("ago",),
                     width: int = fixed.SOURCE_LINE_PREVIEW, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """First raw source line holding a token (case-sensitive) or a lower token in any case.

    Pure Spark: split -> filter -> [0] -> strip -> cut; guarded by a page-level test.
    """

    def hit(x):
        return contains_any(x, tokens, lower=False) | contains_any(x, lower_tokens, lower=True)

    html = F.col(html_col)
    guard = contains_any(html, tokens, lower=False) | contains_any(html, lower_tokens, lower=False)
    first = F.filter(F.split(html, "\n"), hit)[0]
    return pages.select(*keep, F.when(guard, F.substring(py_strip(first), 1, width)).alias("line"))


def selector_hits(pages: DataFrame, selectors: Sequence[str], keep: Sequence[str] = ("page_id",),
                  accept_len: int = fixed.DESCRIPTION_MIN_LEN) -> DataFrame:
    """Per selector: pages with a hit, total elements, first-element text accepted."""
    ex = extract_html(pages, keep, fields={"s": selectors})
    per = ex.select(F.explode("fields").alias("m")).select(
        F.col("m.rank").alias("rank"), F.col("m.n").alias("n"),
        (F.length(element_text(F.col("m"), "clean")) > accept_len).alias("accepted"))
    sel_df = pages.sparkSession.createDataFrame([(i, s) for i, s in enumerate(selectors)], "rank int, selector string")
    agg = per.groupBy("rank").agg(F.count("*").alias("pages_hit"), F.sum("n").cast("bigint").alias("elements"),
                                  F.count_if("accepted").alias("pages_accepted"))
    # the selector list is a caller-supplied config list (bounded), safe to broadcast
    return (F.broadcast(sel_df).join(agg, "rank", "left")
            .select("selector", F.coalesce("pages_hit", F.lit(0)).cast("bigint").alias("pages_hit"),
                    F.coalesce("elements", F.lit(0)).cast("bigint").alias("elements"),
                    F.coalesce("pages_accepted", F.lit(0)).cast("bigint").alias("pages_accepted")))


def selector_samples(pages: DataFrame, selectors: Sequence[str], k: int = 3, width: int = 200,
                     keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Per page and selector, the number of hits and the first ``k`` hit texts
    (stripped, cut to ``width``) in document order - a probe report, the cut is the feature.
    Map-only: every match of a page is already in that page's row."""
    ex = extract_html(pages, keep, all_of={"s": selectors})
    sel = F.array(*[F.lit(x) for x in selectors])
    per = F.transform(F.sequence(F.lit(0), F.lit(len(selectors) - 1)), lambda r: F.struct(
        F.element_at(sel, r + 1).alias("selector"),
        F.size(F.filter("all_of", lambda x: x["rank"] == r)).cast("bigint").alias("n"),
        F.transform(F.filter("all_of", lambda x: (x["rank"] == r) & (x["el_no"] < k)),
                    lambda x: F.substring(py_strip(F.array_join(x["parts"], "")), 1, width)).alias("samples")))
    return (ex.select(*keep, F.explode(per).alias("p")).filter(F.col("p.n") > 0)
            .select(*keep, "p.selector", "p.n", "p.samples"))


def selector_first_hits(pages: DataFrame, selectors: Sequence[str], k: int = 3, width: int = 200, page: str = "page_id") -> DataFrame:
    """O5 + H12 over the whole table: the first ``k`` hits of each selector in (page, document) order.

    A rank that is cut right away is a bounded top-k to Spark: every task keeps k rows a selector before
    the shuffle, so what meets in one task is k rows a task, however many hits there are."""
    ex = extract_html(pages, [page], all_of={"s": selectors})
    sel = F.array(*[F.lit(x) for x in selectors])
    # a page can give k hits at most, so no more of it is unpacked
    hits = (ex.select(page, F.explode(F.filter("all_of", lambda x: x["el_no"] < k)).alias("m"))
            .select(F.element_at(sel, F.col("m.rank") + 1).alias("selector"), page, F.col("m.el_no").cast("bigint").alias("el_no"),
                    F.substring(py_strip(F.array_join("m.parts", "")), 1, width).alias("sample")))
    place = F.row_number().over(Window.partitionBy("selector").orderBy(page, "el_no"))
    return hits.withColumn("place", place).filter(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def card_counts(pages: DataFrame, card_selectors: Sequence[str], keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Number of cards per page under the H1 fallback rule (0 when no selector hits)."""
    ex = extract_html(pages, keep, fields={"c": card_selectors}, texts=False)
    first = F.array_min(F.transform("fields", lambda x: F.struct(x["rank"].alias("rank"), x["n"].alias("n"))))
    return ex.select(*keep, F.coalesce(first["n"], F.lit(0)).cast("bigint").alias("n_cards"))
