"""Splitting oversized texts at natural boundaries, by packing the tree of their structure.

A text is read as a tree: sections by heading level, blocks (paragraphs, lists, tables, fenced code), items with the items below
them by indent, lines, sentences, words, characters. Fenced code has lines, but no items and sentences. Sibling subtrees are merged bottom-up as long as they fit; only a node that is too large
itself is descended into. Each piece but the first then begins with the end of the piece before it, the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2_000
OVERLAP = 200

_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+\S")
_FENCE = re.compile(r"(?m)^[ \t]*(```|~~~)")
_ITEM = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_GAP = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_WORD = re.compile(r"\s+|(?<=[,;:，、；：])")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？｡])[」』”’）]*|(?<=[।؟])\s*")


def _cuts(pattern: re.Pattern, text: str, a: int, b: int, ends: bool) -> list[int]:
    """Inner cut positions of text[a:b]: where matches end, or where they start."""
    found = {m.end() if ends else m.start() for m in pattern.finditer(text, a, b)}
    return sorted(x for x in found if a < x < b)


def _fences(text: str) -> list[tuple[int, int]]:
    out, opened = [], None
    for m in _FENCE.finditer(text):
        if opened is None:
            opened = (m.start(), m.group(1))
        elif m.group(1) == opened[1]:
            line = text.find("\n", m.end())
            out.append((opened[0], len(text) if line < 0 else line + 1))
            opened = None
    if opened is not None:
        out.append((opened[0], len(text)))
    return out


#: The level of list items.
ITEMS = 7


class _Tree:
    """Children of a span, level by level, found only when the span is descended into."""

    def __init__(self, text: str):
        self.text = text
        self.fences = _fences(text)
        self.headings: list[list[int]] = [[] for _ in range(6)]
        for m in _HEADING.finditer(text):
            if not self._fenced(m.start()):
                self.headings[len(m.group(1)) - 1].append(m.start())

    def _fenced(self, at: int) -> bool:
        i = bisect_left(self.fences, (at + 1, 0)) - 1
        return i >= 0 and self.fences[i][0] <= at < self.fences[i][1]

    def split(self, a: int, b: int, level: int) -> list[int]:
        t = self.text
        if level < 6:  # headings of one rank; deeper ones belong to the section they stand in
            of = self.headings[level]
            return of[bisect_left(of, a + 1) : bisect_left(of, b)]
        if level == 6:  # blocks: fenced code, and what empty lines part
            cuts = {x for f in self.fences for x in f if a < x < b}
            cuts |= {x for x in _cuts(_GAP, t, a, b, True) if not self._fenced(x)}
            return sorted(cuts)
        if level == ITEMS:  # the items with the least indent; those below them belong to them
            items = [(m.start(), len(m.group("indent").expandtabs(4))) for m in _ITEM.finditer(t, a, b) if m.start() > a and not self._fenced(m.start())]
            least = min((indent for _, indent in items), default=0)
            return [x for x, indent in items if indent == least]
        if level == 8:
            return _cuts(_LINE, t, a, b, True)
        if level == 9:
            return [x for x in _cuts(_SENTENCE, t, a, b, True) if not self._fenced(x - 1)]
        if level == 10:
            return _cuts(_WORD, t, a, b, True)
        return []


def _pack(tree: _Tree, a: int, b: int, level: int, limit: int) -> list[tuple[int, int]]:
    """Cover text[a:b] by spans of at most ``limit``: too large children are packed on their own, neighbours then merged."""
    if b - a <= limit:
        return [(a, b)]
    while level <= 10:
        cuts = tree.split(a, b, level)
        if cuts:
            break
        level += 1
    else:
        return [(x, min(x + limit, b)) for x in range(a, b, limit)]
    spans: list[tuple[int, int]] = []
    edges = [a, *cuts, b]
    for x, y in zip(edges, edges[1:]):
        # an item may have items below it
        parts = [(x, y)] if y - x <= limit else _pack(tree, x, y, level if level == ITEMS else level + 1, limit)
        for p in parts:
            if spans and p[1] - spans[-1][0] <= limit:
                spans[-1] = (spans[-1][0], p[1])
            else:
                spans.append(p)
    return spans


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) from 0 of each piece. Every piece has at most ``limit`` characters; each but the first starts exactly
    ``overlap`` characters before the end of the one before. A text within the limit is one piece, null or empty is none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    own = limit - overlap
    cores = _pack(_Tree(text), 0, len(text), 0, own)
    # the first piece has no overlap: give it what still fits
    merged = [cores[0]]
    for c in cores[1:]:
        if len(merged) == 1 and c[1] <= limit:
            merged[0] = (0, c[1])
        else:
            merged.append(c)
    out = []
    for k, (a, b) in enumerate(merged):
        out.append((a if k == 0 else max(a - overlap, 0), b))
    # a piece that starts before the second one's overlap would skip it where the first piece is shorter than the overlap
    return out


def split_texts(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = True) -> DataFrame:
    """Per row of ``items`` and piece: the other columns, ``piece_no`` from 1, ``start_pos``, ``end_pos`` (characters from 1) and ``piece``.

    With ``only_long``, texts within the limit are left out in the JVM. Null and empty texts have no pieces. Rows are
    processed on their own, whole, without a shuffle.
    """
    others = [c for c in items.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != text) + ", piece_no int, start_pos int, end_pos int, piece string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, n, a + 1, b, t[a:b]) for k, t in enumerate(p[text]) for n, (a, b) in enumerate(pieces(t, limit, overlap), 1)]
            hits = pd.DataFrame(rows, columns=["_k", "piece_no", "start_pos", "end_pos", "piece"])
            yield pd.concat([p[others].iloc[hits["_k"]].reset_index(drop=True), hits.drop(columns="_k")], axis=1)

    chosen = items.where(F.length(text) > limit) if only_long else items.where(F.length(text) > 0)
    return chosen.mapInPandas(run, schema)
