"""Main text of web pages by site style trees.

Pages of one host share templates. Their element trees are merged: nodes with the same path of
element names (with class, id and role) are one node of the host's style tree. For every node two
distributions over the host's different pages are kept, the sequences of its children (presentation)
and the texts below it (content); their normalised entropies make its importance, content alone that
of a node without child elements. Template parts look the same everywhere and get a low one; branches
below ``IMPORTANT`` are removed from each page, unless they hold most of its text. Names in class, id
and role (sidebar, comments, content, ...; whole tokens) scale the importance, and decide alone for
nodes with too few different pages to compare. Elements that say what they are decide: nav, footer,
aside and the like go while other text is left, and article or main is all that counts if there is one.

Pages are told apart by their text, before anything is counted. Only the nodes of different pages and
counts by (host, node, hash) are shuffled, so a host with a third of all pages is many keys; what goes
back to the pages is the short list of nodes a host removes.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import keep, short_batches

IMPORTANT = 0.25
#: Different pages a host must have before its own templates count.
COMPARED = 3
#: Entropies are divided by the logarithm of the pages that hold the node, at most so many: a larger host needs no more variety.
VARIETY = 64
#: Factors of importance for names beside the main text and of the main text.
BESIDE, INSIDE = 0.4, 2.0

#: Elements that begin a block, that never have content, whose content is no markup.
BLOCKS = frozenset(
    "html body head div section article main header footer nav aside form fieldset ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog menu "
    "search hgroup center button select option optgroup label iframe object video audio canvas svg template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element on the left is closed when one on the right begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "head": frozenset(["body"]),
}
#: Elements that are not rendered as text; elements, and tokens of class, id or role, beside the main text.
UNSEEN = frozenset("head template noscript svg canvas iframe object video audio".split())
ASIDE_TAGS = frozenset("nav footer aside form button select label dialog menu search".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar aside widget related recommended share sharing social comment comments "
    "commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login search searchbox pagination pager toolbar skip copyright legal tags complementary "
    "contentinfo".split())
#: Names of the main text.
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article main content post entry story articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|xmp|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NUMBER = re.compile(r"\d+")
_NUMBERED = re.compile(r"[-_]?\d+$")
_PARTS = re.compile(r"[-_]+")
_HIDDEN = re.compile(
    r"(?:^|[\s\"'])(?:hidden(?=[\s/]|$|\s*=)(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true\b|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_QUOTED = re.compile(r"(\b(?!style\b|aria-hidden\b|hidden\b)[\w:-]+\s*=\s*)(?:\"[^\"]*\"|'[^']*')", re.I)


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


class _Node:
    """An open element: its label, its path in the style tree, and what it says of the text below it."""
    __slots__ = ("tag", "path", "name", "unseen", "side", "article", "children", "texts")

    def __init__(self, tag: str, path: bytes, name: int, unseen: bool, side: bool, article: bool) -> None:
        self.tag, self.path, self.name, self.unseen, self.side, self.article = tag, path, name, unseen, side, article
        self.children: list[bytes] = []
        self.texts: list[bytes] = []


class Block(NamedTuple):
    """A text with the hashes of the paths above it, those named beside and inside the main text, and its elements' say."""
    paths: tuple[int, ...]
    beside: tuple[int, ...]
    inside: tuple[int, ...]
    side: bool
    article: bool
    text: str


_LABELS: dict[tuple[str, str], tuple[bytes, int, bool]] = {}


def _shared_tokens(kind: str, value: str) -> str:
    """Tokens of an attribute as other pages of the site may have them: numbers made equal, long slugs left out."""
    most = 2 if kind == "id" else 3
    tokens = {_NUMBER.sub("0", w) for w in value.lower().split()}
    return " ".join(sorted(w for w in tokens if len(_PARTS.split(w)) <= most))


def _label(tag: str, attributes: str) -> tuple[bytes, int, bool]:
    """Label of an element in the style tree; -1, 0 or 1 as its names put it beside or into the main text; whether it is hidden."""
    known = _LABELS.get((tag, attributes))
    if known:
        return known
    names = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)]
    tokens = {_NUMBERED.sub("", w) for _, value in names for w in value.lower().split()}
    name = 0 if tag in ("html", "body") else bool(tokens & MAIN_WORDS) - bool(tokens & ASIDE_WORDS)
    hidden = tag not in ("html", "body") and bool(_HIDDEN.search(_QUOTED.sub(r"\1x", attributes)))
    label = f"{tag} {name}" + "".join(f" {k}={v}" for k, v in sorted((k, _shared_tokens(k, v)) for k, v in names) if v)
    found = (label.encode("utf-8", "replace"), name, hidden)
    if len(_LABELS) < 20_000:
        _LABELS[tag, attributes] = found
    return found


def page_blocks(page: str, nodes: dict | None = None) -> list[Block]:
    """All text blocks that are rendered.

    With ``nodes``, (path hash, 0 or 1, name) gets the hashes of the sequences of children (0, if
    there are child elements) and of the texts below (1) of every element; path 0 stands for the page.
    """
    root = _Node("", b"", 0, False, False, False)
    stack, blocks, buffer = [root], [], []

    def flush() -> None:
        if not buffer:
            return
        text = "".join(buffer)
        buffer.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        top = stack[-1]
        if text and not top.unseen:
            top.texts.append(text.encode("utf-8", "replace"))
            top.children.append(b"#")
            paths = [(_hash(n.path), n.name) for n in stack[1:]]
            blocks.append(Block(tuple(p for p, _ in paths), tuple(p for p, n in paths if n < 0), tuple(p for p, n in paths if n > 0),
                                top.side, top.article, text))

    def close() -> None:
        node = stack.pop()
        stack[-1].texts += node.texts
        if nodes is not None and not node.unseen:
            path = _hash(node.path)
            if any(c != b"#" for c in node.children):
                nodes.setdefault((path, 0, node.name), []).append(_hash(b"\x00".join(node.children)))
            nodes.setdefault((path, 1, node.name), []).append(_hash(b"\x00".join(node.texts)))

    at = 0
    for token in _TOKEN.finditer(page):
        start = token.start()
        if start > at:
            buffer.append(page[at:start])
        at = token.end()
        tag = token[3]
        if tag is None:
            if token[1]:
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag in ("br", "hr", "img", "input"):
                flush()
            continue
        flush()
        if token[2]:
            if any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        while tag in CLOSED_BY.get(stack[-1].tag, ()):
            close()
        label, name, hidden = _label(tag, token[4])
        above = stack[-1]
        side = tag in ASIDE_TAGS or tag == "header" and not any(n.article or n.name > 0 for n in stack)
        above.children.append(label)
        node = _Node(tag, above.path + b"/" + label, name, above.unseen or hidden or tag in UNSEEN, above.side or side, above.article or tag in MAIN_TAGS)
        if token[4].endswith("/") and tag in ("svg", "iframe"):
            continue
        stack.append(node)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    if nodes is not None:
        nodes[0, 1, 0] = [_hash(b"\x00".join(root.texts))]
    return blocks


def _most(part: list[Block], whole: list[Block]) -> bool:
    return 2 * sum(len(b.text) for b in part) > sum(len(b.text) for b in whole)


class Template(NamedTuple):
    """What a host's pages say of shared nodes: branches of low importance, and named ones that proved important."""
    removed: frozenset[int]
    spared: frozenset[int]


def main_text(page: str, template: Template | None) -> str:
    """The blocks in page order, without branches of low importance; names decide where the host says nothing.

    Branches with most of the page's text stay. If article or main elements, or named main parts,
    hold most of the text, only that counts; what would leave nothing is not applied.
    """
    blocks = page_blocks(page)
    kept = [b for b in blocks if not b.side] or blocks
    under: dict[int, list[Block]] = {}
    for b in kept:
        found = set(b.beside)
        if template is not None:
            found = (found - template.spared) | template.removed.intersection(b.paths)
        for path in found:
            under.setdefault(path, []).append(b)
    gone = {path for path, part in under.items() if not _most(part, kept)}
    kept = [b for b in kept if gone.isdisjoint(b.paths)] or kept
    for part in ([b for b in kept if b.article], [b for b in kept if b.inside]):
        if _most(part, kept):
            return " ".join(b.text for b in part)
    return " ".join(b.text for b in kept)


def host_of(url) -> object:
    """Column: host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


_NODES = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("path", T.ArrayType(T.LongType())),
    T.StructField("kind", T.ArrayType(T.IntegerType())), T.StructField("name", T.ArrayType(T.IntegerType())), T.StructField("hash", T.ArrayType(T.LongType())),
])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page: its text's hash, and each of its nodes once."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes: dict = {}
            page_blocks(page.as_py(), nodes)
            rows.append((host, nodes.pop((0, 1, 0))[0], *([k[i] for k in nodes] for i in range(3)),
                         [v[0] if len(v) == 1 else _hash(str(v).encode()) for v in nodes.values()]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_NODES.fieldNames())


def removed_nodes(pages: DataFrame) -> DataFrame:
    """(host, removed, spared): hashes of paths of low importance, and of named ones without, for hosts with enough different pages.

    Only nodes that several pages share are listed, and numbers in names are one, so a host's list
    is as long as its templates and not as its pages. ``pages`` has host and html. A page counts a node once, with all its occurrences; importance is
    the mean of the entropies, each divided by the logarithm of the pages that hold the node.
    """
    different = keep(pages.select("host", "html").mapInArrow(_nodes, _NODES).dropDuplicates(["host", "page"]), "page-nodes")
    counts = (
        different.select("host", F.explode(F.arrays_zip("path", "kind", "name", "hash")).alias("x")).select("host", "x.*")
        .groupBy("host", "path", "kind", "name", "hash").agg(F.count("*").alias("n"))
    )
    spread = counts.groupBy("host", "path", "kind", "name").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("bits"))
    entropy = F.when(F.col("total") > 1, F.least(
        (F.log("total") - F.col("bits") / F.col("total")) / F.log(F.least("total", F.lit(VARIETY))), F.lit(1.0))).otherwise(1.0)
    scale = F.when(F.col("name") < 0, BESIDE).when(F.col("name") > 0, INSIDE).otherwise(1.0)
    importance = spread.groupBy("host", "path", "name").agg(F.avg(entropy).alias("importance"), F.max("total").alias("total"))
    low = F.col("importance") * scale < IMPORTANT
    none = F.expr("cast(array() as array<bigint>)")
    found = importance.where((F.col("total") >= COMPARED) & (low | (F.col("name") < 0))).groupBy("host").agg(
        F.collect_set(F.when(low, F.col("path"))).alias("removed"), F.collect_set(F.when(~low, F.col("path"))).alias("spared"))
    enough = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= COMPARED)
    return enough.join(found, "host", "left").select("host", F.coalesce("removed", none).alias("removed"), F.coalesce("spared", none).alias("spared"))


_TEXTS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py(), Template(frozenset(removed.as_py()), frozenset(spared.as_py())) if removed.is_valid else None)
                 for page, removed, spared in zip(batch.column(2), batch.column(3), batch.column(4))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=_TEXTS.fieldNames())


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null html is empty and gives an empty text; pages without a host share the empty one. Repeated
    rows and null ids give a row each; further columns are ignored; an empty table gives no rows.
    """
    short_batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    removed = keep(removed_nodes(rows), "removed-nodes")
    return rows.join(removed, "host", "left").select("page_id", "url", "html", "removed", "spared").mapInArrow(_extract, _TEXTS)
