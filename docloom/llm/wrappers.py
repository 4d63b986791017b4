"""Wrappers of pages of one host by union-free expression inference (problem 2, the method named).

A page is a stream of tokens: tags and texts. Pages of one host that use the same tags form a class; its wrapper begins as the
first page and is aligned with the next, token by token. Two texts that differ become a slot; where tags differ, the square
before is looked for (a run of tokens that ends like the tokens just read), which becomes a repeated group, else the shorter
detour becomes optional. The result holds plain tokens, `#TEXT` slots, `( ... )+` groups and `( ... )?` options, and no unions.

Whole pages are aligned, however long. A class of many pages is dealt out to tasks, whose wrappers are aligned with one another
afterwards. Which pages a wrapper reads is found by reading them all with it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.markup import TAG

SLOT = "#TEXT"
#: Pages of one class that a task aligns.
PART = 2_000
#: Tags that open a structural element.
ELEMENTS = {**{f"<h{i}>": "heading" for i in range(1, 7)}, "<li>": "list_item", "<pre>": "code_block", "<math>": "formula"}

Node = str | tuple  # a token, or ("+" | "?", list of nodes)


def tokens(text: str) -> list[str]:
    """Tags without attributes, lower case, and the texts between them."""
    out: list[str] = []
    at = 0
    for m in TAG.finditer(text):
        if text[at : m.start()].strip():
            out.append("=" + " ".join(text[at : m.start()].split()))
        name = re.match(r"<\s*(/?)\s*([A-Za-z0-9!]+)", m[0])
        if name:
            out.append(f"<{name[1]}{name[2].lower()}>")
        at = m.end()
    if text[at:].strip():
        out.append("=" + " ".join(text[at:].split()))
    return out


def is_text(x: Node) -> bool:
    return isinstance(x, str) and (x == SLOT or x.startswith("="))


def _matches(node: Node, page: list[str], at: int) -> int:
    """Where the page goes on after node has been read from at; -1 if it cannot be read."""
    if isinstance(node, tuple):
        n = at
        while (m := _read(node[1], page, n)) > n:
            n = m
            if node[0] == "?":
                break
        return n if n > at or node[0] == "?" else -1
    if at >= len(page):
        return -1
    if is_text(node):
        return at + 1 if is_text(page[at]) and (node == SLOT or node == page[at]) else -1
    return at + 1 if page[at] == node else -1


def _read(nodes: list[Node], page: list[str], at: int) -> int:
    for n in nodes:
        at = _matches(n, page, at)
        if at < 0:
            return -1
    return at


def _slotted(seq: list[str]) -> list[Node]:
    return [SLOT if is_text(x) else x for x in seq]


def _plain(nodes: list[Node]) -> list[Node]:
    return [SLOT if is_text(x) else x for x in nodes]


def _square(done: list[Node], page: list, at: int) -> tuple[int, int] | None:
    """(how many of the last nodes form one round, where the page goes on) if the page repeats the end of the wrapper."""
    if at >= len(page) or is_text(page[at]) or not (done and isinstance(done[-1], str) and done[-1].startswith("</")):
        return None
    for n in range(2, len(done) + 1):
        if done[-n] == page[at]:
            end = _read(_plain(done[-n:]), page, at)
            if end > at:
                return n, end
    return None


def _places(tokens: list) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for i, x in enumerate(tokens):
        if isinstance(x, str) and not is_text(x):
            at.setdefault(x, []).append(i)
    return at


def _next(places: dict[str, list[int]], token: Node, after: int) -> int | None:
    """How far the next such tag is."""
    at = places.get(token, []) if isinstance(token, str) else []
    k = bisect_right(at, after)
    return at[k] - after if k < len(at) else None


def align(wrapper: list[Node], page: list[str]) -> list[Node]:
    """The wrapper that also reads page."""
    out: list[Node] = []
    of_wrapper, of_page = _places(wrapper), _places(page)
    i = j = 0
    while i < len(wrapper) or j < len(page):
        if i < len(wrapper) and (end := _matches(wrapper[i], page, j)) >= 0 and (end > j or isinstance(wrapper[i], tuple)):
            out.append(wrapper[i])
            i, j = i + 1, end
            continue
        if i < len(wrapper) and j < len(page) and is_text(wrapper[i]) and is_text(page[j]):
            out.append(SLOT)
            i, j = i + 1, j + 1
            continue
        # one side repeats what was just read: a group
        if (hit := _square(out, page, j)) is not None:
            n, j = hit
            while (m := _read(_plain(out[-n:]), page, j)) > j:
                j = m
            out[-n:] = [("+", _plain(out[-n:]))]
            continue
        if (hit := _square(out, wrapper, i)) is not None:
            n, i = hit
            out[-n:] = [("+", _plain(out[-n:]))]
            continue
        # else one side has something more: the shorter detour to a common tag is optional
        skip_w = _next(of_wrapper, page[j], i) if j < len(page) else None
        skip_p = _next(of_page, wrapper[i], j) if i < len(wrapper) else None
        if skip_w is None and skip_p is None:
            if i < len(wrapper):
                out.append(wrapper[i] if isinstance(wrapper[i], tuple) and wrapper[i][0] == "?" else ("?", _plain(wrapper[i : i + 1])))
                i += 1
            if j < len(page):
                out.append(("?", _plain(page[j : j + 1])))
                j += 1
        elif skip_p is None or skip_w is not None and skip_w <= skip_p:
            out.append(("?", _plain(wrapper[i : i + skip_w])))
            i += skip_w
        else:
            out.append(("?", _plain(page[j : j + skip_p])))
            j += skip_p
    return _tidy(out)


def _tidy(nodes: list[Node]) -> list[Node]:
    """Equal neighbours that are groups or options are one, and a round that stands before its own group is part of it."""
    out: list[Node] = []
    for n in nodes:
        if isinstance(n, tuple):
            if out and out[-1] == n:
                continue
            size = len(n[1])
            while n[0] == "+" and len(out) >= size and [SLOT if is_text(x) else x for x in out[-size:]] == n[1]:
                del out[-size:]
        out.append(n)
    return out


def show(nodes: list[Node]) -> str:
    return " ".join(n if isinstance(n, str) else f"({show(n[1])}){n[0]}" for n in nodes)


def dumped(nodes: list[Node]) -> str:
    return json.dumps(nodes, ensure_ascii=False)


def loaded(text: str) -> list[Node]:
    def node(x) -> Node:
        return x if isinstance(x, str) else (x[0], [node(y) for y in x[1]])

    return [node(x) for x in json.loads(text)]


def as_page(nodes: list[Node]) -> list[str]:
    """A page that the wrapper reads and that has one round of everything in it."""
    return [y for x in nodes for y in ([x] if isinstance(x, str) else as_page(x[1]))]


def _aligned(df: DataFrame, keys: list[str], column: str, page_of) -> DataFrame:
    """One wrapper for all rows of the same keys; rows stream through sorted and only the wrapper is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n, wrapper = None, 0, []
        for pdf in batches:
            out = []
            for *k, more, text in zip(*(pdf[c] for c in keys), pdf["pages"], pdf[column], strict=True):
                page = page_of(text)
                if k != current:
                    if current is not None:
                        out.append((*current, n, dumped(wrapper)))
                    current, n, wrapper = k, more, _tidy(list(page))
                else:
                    n, wrapper = n + more, align(wrapper, page)
            if out:
                yield pd.DataFrame(out, columns=[*keys, "pages", "wrapper"])
        if current is not None:
            yield pd.DataFrame([(*current, n, dumped(wrapper))], columns=[*keys, "pages", "wrapper"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", pages long, wrapper string"
    return df.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64(column)).mapInPandas(run, schema)


def classed(pages: DataFrame, host: str, text: str, id: str | None) -> DataFrame:
    """(id, host, tags, text) of the pages that hold tags."""
    src = pages.select((F.col(id) if id else F.lit(None).cast("string")).alias("id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).where("host is not null and text is not null").where(F.col("text").contains("<"))

    @F.pandas_udf("string")
    def tags(t: pd.Series) -> pd.Series:
        return t.map(lambda x: " ".join(sorted({y for y in tokens(x) if y.startswith("<")})))

    return src.select("id", "host", tags("text").alias("tags"), "text").where("tags <> ''")


def infer(pages: DataFrame, host: str = "host", text: str = "content") -> DataFrame:
    """(host, tags, pages, wrapper): the wrapper of each host's pages that use the same tags, as JSON; show() writes it out.

    Null hosts and texts and pages without tags take no part. A class of one page has that page as wrapper.
    """
    return _infer(classed(pages, host, text, None))


def _infer(src: DataFrame) -> DataFrame:
    sizes = src.groupBy("host", "tags").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = src.join(sizes, ["host", "tags"]).select("host", "tags", F.pmod(F.xxhash64("text"), "parts").cast("int").alias("part"), F.lit(1).alias("pages"), "text")
    parts = _aligned(dealt, ["host", "tags", "part"], "text", tokens)
    return _aligned(parts, ["host", "tags"], "wrapper", lambda w: as_page(loaded(w)))


def elements(pages: DataFrame, id: str = "chunk_id", host: str = "host", text: str = "content") -> DataFrame:
    """(id, element, element_no): structural elements of the pages that the wrapper of their class of two pages or more reads.

    An element is typed by the tag that opens it: the wrapper says that the page repeats or fills it, not what it is.
    """
    src = classed(pages, host, text, id)
    met = src.join(_infer(src).where("pages > 1").select("host", "tags", "wrapper"), ["host", "tags"])
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, list[Node]] = ("", [])
        for pdf in batches:
            out = []
            for i, t, w in zip(pdf["id"], pdf["text"], pdf["wrapper"], strict=True):
                if w != held[0]:
                    held = w, loaded(w)
                page = tokens(t)
                if _read(held[1], page, 0) != len(page):
                    continue
                count: dict[str, int] = {}
                for e in (ELEMENTS[x] for x in page if x in ELEMENTS):
                    count[e] = count.get(e, 0) + 1
                    out.append((i, e, count[e]))
            yield pd.DataFrame(out, columns=["id", "element", "element_no"])

    return met.select("id", "text", "wrapper").mapInPandas(run, f"id {kind}, element string, element_no int").distinct().withColumnRenamed("id", id)
