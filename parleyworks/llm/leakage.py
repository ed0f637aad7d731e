"""Evaluation texts that leaked into documents.

Texts are brought to one form: compatibility forms resolved, letter case and marks of composition made equal, invisible
characters dropped, words (runs of letters and digits) taken. Any run of ``run`` words of an item holds, among pieces of
``piece`` words laid end to end over the item, at least budget + 1 whole pieces; so a document with at most ``budget`` errors in
such a run holds one of them exactly. Piece hits are looked up by a rolling window of words against a table of the items'
pieces; around a hit Myers' bit-parallel distance gives the errors of the stretch, and the least of them is reported: 0 for a
passage that is there word by word, up to the budget for one that was edited.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

#: Consecutive words of an item that make a leak.
RUN = 12
#: Edits, in words, that a stretch may differ by (0: exact runs only).
BUDGET = 2
#: The most items that are held in memory on every executor at once; more are matched in passes one after the other.
ITEMS_PER_BLOCK = 20_000

_WORD = re.compile(r"[^\W_]+")
# marks belong to the letter before them: a vowel sign doesn't end a word
_MARKED_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
#: Characters that are not seen.
INVISIBLE = "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff]"
_INVISIBLE = re.compile(INVISIBLE)


def plain_words(text: str | None) -> list[str]:
    """The words of a text in the form in which texts are compared. Null and empty texts have none."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    t = _INVISIBLE.sub("", text)
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return _MARKED_WORD.findall(t)


def piece_length(run: int = RUN, budget: int = BUDGET) -> int:
    """The longest piece of which every run of ``run`` words holds budget + 1 whole ones, wherever the run begins.

    A run holds at least floor((run - (piece - 1)) / piece) pieces of a row laid end to end.
    """
    return max(p for p in range(1, run + 1) if (run - (p - 1)) // p >= budget + 1)


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Myers' bit-parallel edit distance: for each position of ``text``, the least distance of ``pattern`` to a stretch ending there."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    out = []
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = (down | (~(vertical | up) & full)) & full
        minus = up & vertical
        out.append(score)
    return out


class Pieces:
    """The pieces of all items of a block, by their words."""

    def __init__(self, items: list[tuple[object, str]], run: int = RUN, budget: int = BUDGET):
        self.run, self.budget = run, budget
        self.piece = piece_length(run, budget)
        self.ids: list[object] = []
        self.words: list[list[int]] = []
        self.code: dict[str, int] = {}
        self.at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = [self.code.setdefault(w, len(self.code)) for w in plain_words(text)]
            k = len(self.words)
            self.ids.append(item_id)
            self.words.append(words)
            for a in range(0, len(words) - self.piece + 1, self.piece):
                self.at[tuple(words[a : a + self.piece])].append((k, a))

    def leaks(self, text: str | None) -> list[tuple[object, int]]:
        """The items of which the text holds a run, with the least errors of such a run."""
        found: list[tuple[object, int]] = []
        plain = plain_words(text)
        if len(plain) < self.run - self.budget:
            return found
        code = self.code
        words = [code.get(w, -1) for w in plain]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        p = self.piece
        unknown = -1
        for k, w in enumerate(words):
            if w < 0:
                unknown = k
            elif k - unknown >= p:
                for item, a in self.at.get(tuple(words[k - p + 1 : k + 1]), ()):
                    hits[item].append((k - p + 1, a))
        for item, at in hits.items():
            errors = self._errors(words, self.words[item], at)
            if errors <= self.budget:
                found.append((self.ids[item], errors))
        return found

    def _errors(self, doc: list[int], item: list[int], hits: list[tuple[int, int]]) -> int:
        """The least distance of a run of the item about one of its pieces (item's place a) to what lies about the hit (document's place d)."""
        run, budget, p = self.run, self.budget, self.piece
        least = budget + 1
        seen: set[tuple[int, int]] = set()
        for d, a in hits:
            low, high = max(0, a + p - run), min(len(item), a + run)
            for start in range(low, min(a, high - run) + 1):
                # hits of one diagonal share their runs
                if (start, d - a) in seen:
                    continue
                seen.add((start, d - a))
                at = d - (a - start)
                near = doc[max(0, at - budget) : at + run + budget]
                # a run has at most ``least`` - 1 words that don't occur there at all, or its distance is no less
                there = set(near)
                if sum(w in there for w in item[start : start + run]) <= run - least:
                    continue
                least = min(least, min(myers(item[start : start + run], near), default=run))
                if not least:
                    return 0
        return least


def leaked(docs: DataFrame, items: DataFrame, ws: Workspace, run: int = RUN, budget: int = BUDGET, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, errors): every document with the items of which it holds at least ``run`` consecutive words with at most ``budget``
    words changed, left out or added; errors is the least of these (0: word by word).

    The items are the stated, small side: they go to the executors in blocks of at most about ``per_block``, one pass over the documents
    after the other, so no more than a block is in memory anywhere; no document moves. An item with fewer words than ``run`` cannot
    leak. Null and empty texts hold nothing.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // per_block))
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}
    schema = f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {kinds[item_id]}, errors int"
    out = None
    for b in range(blocks):
        rows = items.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)).select(item_id, text).orderBy(item_id).collect()
        held = spark.sparkContext.broadcast(Pieces([(r[0], r[1]) for r in rows], run, budget))

        def scan(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            pieces = held.value
            for p in parts:
                yield pd.DataFrame([(d, i, e) for d, t in zip(p[doc_id], p[text]) for i, e in pieces.leaks(t)], columns=[doc_id, item_id, "errors"])

        found = docs.where(F.length(text) > 0).select(doc_id, text).mapInPandas(scan, schema)
        if blocks > 1:
            found = ws.save(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy(doc_id, item_id).agg(F.min("errors").alias("errors"))
