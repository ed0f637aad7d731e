"""Sentence boundaries across languages and scripts.

The layout is read first: fenced code, empty lines, headings, list items, quote marks and speaker labels open units. Inside a
paragraph every terminator, closed quotation or bracket with one, and (in scripts without one) every blank is a candidate; a
maximum-entropy classifier decides each from the words around it: their case, length, digits and script, how often they end or
open paragraphs (counted over all documents), how a quotation was led in, and whether they are known abbreviations. It is trained on
reliable boundaries: breaks between paragraphs, read as if a blank (or nothing) parted them, against places that lower case, a
comma, an abbreviation or a number shows to be none, and places within sentences. What a candidate's features depend on is a short
tuple, so its score is worked out once for all candidates that are alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights are fitted on about this many documents, those with the least hash of their id; words are counted in all.
TRAINING_TEXTS = 4_000
#: A word seen less often has no rate.
LEAST_SEEN = 5
#: Words that a task counts before it gives the counts on.
HELD_WORDS = 200_000

# Abbreviations that a word or number follows within the sentence.
CONTINUING = frozenset(
    "mr mrs ms dr prof st rev hon gen col lt sgt capt jan feb mar apr jun jul aug sep sept oct nov dec sec fig figs eq ch vol ed eds cf vs viz e.g i.e eg ie al resp "
    "no nos nr p pp pg par art abs bzw ca z z.b d d.h h u u.a o.ä v.a vgl s siehe evtl ggf inkl zzgl hr fr frau dipl ing "
    "m mm mme mlle me p.ex ex env réf chap sr sra srta sres dra dres ud uds pág págs núm p.ej ej tel av av. fasc cap aprox. "
    "т т.е п пп рис см стр гл тыс млн млрд ул им г-н г-жа проф акад ср напр д-р डॉ श्री د أ أ.د ص م".split()
)
# Abbreviations that may end a sentence or not.
ENDING = frozenset("etc usw p.m a.m pm am u.s u.k e.u u.n d.c inc ltd co corp jr sr. approx aprox ap uu ee.uu др т.д т.п и.др e h n.chr v.chr u.s.w др. проч".split())

_FENCE = re.compile(r"[ \t]*(?:>[ \t]*)*(?P<mark>`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_BULLET = re.compile(r"[ \t]*(?:>[ \t]*)*[-*+•‣–][ \t]+(?=\S)")
_NUMBER = re.compile(r"[ \t]*(?:>[ \t]*)*(?P<n>\d{1,3})[.)][ \t]+(?=\S)")
_QUOTE = re.compile(r"[ \t]*>[ \t]*")
_SPEAKER = re.compile(r"[ \t]*(?:>[ \t]*)*(?:\*\*|__)?(?P<who>User|Assistant|System|Human|AI|Q|A|Reviewer|Me|You|Bot|Agent|Speaker[ \t]?\w{0,3})[ \t]?:(?:\*\*|__)?(?=\s|$)", re.I)
_SPAN = re.compile(r"`[^`\n]*(?:\n(?!\s*\n)[^`\n]*)?`|[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"]+")
_STOPS = re.compile(r"[.!?…‼⁇⁈⁉。！？｡．।॥؟۔։።᠃]+")
_STOP = re.compile(r"(?P<term>[.!?…‼⁇⁈⁉]+|[。！？｡．]+|[।॥]+|[؟۔]+|[։።᠃]+)(?P<close>(?:[\"'”’»›)\]」』）】》*_]|“(?=\s|$|[.,;:!?]))*)(?P<gap>\s*)")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[ \t]*\n?[ \t]+(?=[฀-๿A-Za-z0-9`\"“(])|(?<=[฀-๿])\n(?=[฀-๿])")
_THAI = re.compile("[฀-๿]")
_WIDE = "。！？｡．।॥"
_OPENERS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "„": "“”", "‹": "›", "‘": "’"}
# vowel signs and tone marks belong to words, though they are no letters
_SIGNS = "\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0963\u0970-\u097f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_MARK = re.compile("[" + re.escape("".join(_OPENERS) + "".join(_OPENERS.values()) + '"') + "]")
_SMALL = re.compile("[a-zß-öø-ÿа-яёđłšžčćřůőű]+")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞА-ЯЁĐŁŠŽČĆŘŮŐŰ]+")
#: A word that ends a stretch, read backwards.
_LAST = re.compile(rf"(?:[^\W_]|[{_SIGNS}]|(?<=[^\W_])[.'’-])+")
_FIRST = re.compile(rf"[^\W_](?:[^\W_]|[{_SIGNS}])*")
#: A terminator that no blank follows: a small word before it and a capitalised one after it.
_TIGHT = re.compile(r"(?P<term>[.!?])(?=[^\W\d_a-z][^\W\d_A-Z]*(?:[\s,]|$))")
_BEFORE_TIGHT = re.compile(r"(?<![\w./@-])[^\W\d_]*[^\W\d_A-Z]{2,}$")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]|(?<=[a-z])[A-Z][a-z]|\.[a-z]{1,5}\b)")
_CJK = re.compile("[぀-ヿ㐀-鿿]")


def blocks(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, body, end, whole) of the parts that no unit crosses: body is where the text after a mark or label begins, whole
    parts (fenced code) are one unit. Start and end are at characters that are no blanks."""
    out: list[tuple[int, int, int, bool]] = []
    n = len(text)
    at = 0
    start = body = last = -1
    listed: int | None = None  # the number of the list item that the paragraph is in, 0 for a bullet

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, body, last, False))
        start = -1

    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        if not line.strip():
            close()
            listed = None
            at = stop + 1
            continue
        first = at + len(line) - len(line.lstrip())
        # what a line may be shows in its first character
        lead = text[first]
        fence = _FENCE.match(line) if lead in "`~>" else None
        if fence:
            close()
            listed = None
            mark = fence.group("mark")
            end = stop
            look = stop + 1
            while look < n:
                e = text.find("\n", look)
                e = n if e < 0 else e
                other = text[look:e].strip().lstrip("> ")
                end = e
                look = e + 1
                if other.startswith(mark) and not other.strip(mark[0]):
                    break
            piece = text[first:end].rstrip()
            out.append((first, first, first + len(piece), True))
            at = look if look > stop else stop + 1
            continue
        opened = None
        heading = _HEADING.match(line) if lead == "#" else None
        speaker = _SPEAKER.match(line) if ":" in line else None
        bullet = _BULLET.match(line) if lead in "-*+•‣–>" else None
        number = _NUMBER.match(line) if lead == ">" or lead.isdigit() else None
        quote = _QUOTE.match(line) if lead == ">" else None
        if heading:
            opened = first
        elif speaker:
            opened = at + speaker.end()
            listed = None
        elif bullet and (start < 0 or listed is not None or text[last - 1 : last] in ".!?:。！？：;"):
            opened, listed = at + bullet.end(), 0
        elif number and (start < 0 or listed is not None and int(number.group("n")) in (listed + 1, 1) or text[last - 1 : last] in ":："):
            opened, listed = at + number.end(), int(number.group("n"))
        elif quote and not (start >= 0 and text[start] == ">"):
            opened = at + quote.end()
        elif start < 0:
            opened = first
        if opened is not None:
            close()
            start, body = first, opened
            inner = _SPEAKER.match(text[opened:stop]) if opened > first and not speaker else None
            if inner:
                body = opened + inner.end()
        last = at + len(line.rstrip())
        if heading:
            close()
        at = stop + 1
    close()
    return out


def _quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(open, close) of quotations and brackets of text[a:b] that are closed there, outermost only."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _MARK.finditer(text, a, b):
        k, c = m.start(), m.group()
        if stack and c in stack[-1][0]:
            _, o = stack.pop()
            spans.append((o, k))
        elif c == '"':
            if any(s[0] == '"' for s in stack):
                while stack and stack[-1][0] != '"':
                    stack.pop()
                _, o = stack.pop()
                spans.append((o, k))
            else:
                stack.append(('"', k))
        elif c in _OPENERS and not (c == "‘" and k > a and text[k - 1].isalnum()):
            stack.append((_OPENERS[c], k))
        elif c in ")]）」』»”】》" and any(c in s[0] for s in stack):
            while stack and c not in stack[-1][0]:
                stack.pop()
            _, o = stack.pop()
            spans.append((o, k))
    spans.sort()
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] > out[-1][1]:
            out.append(s)
    return out


_DIGITS = re.compile(r"\d+")


def _last_word(text: str, a: int, b: int) -> str:
    m = _LAST.match(text[max(a, b - 40) : b][::-1])
    return m.group()[::-1].lower() if m else ""


def _first_word(text: str, a: int, b: int) -> str:
    m = _FIRST.search(text, a, min(b, a + 40))
    return m.group() if m and m.start() - a <= 4 else ""


def _shape(word: str) -> str:
    return word if not word or word.isalpha() else _DIGITS.sub("#", word)


def _uncased(word: str) -> str:
    """The key of a word where letter case says nothing."""
    return "~" + word.lower()


def candidates(text: str, start: int, body: int, end: int) -> list[tuple[int, int, str, str, str, int]]:
    """(end of the unit, start of the next, terminator, closers, kind, opener) inside a part: kind is ``stop``, ``tight``, ``quote``
    (with the place where the quotation or bracket opened) or ``blank``."""
    spans = _quoted(text, body, end)
    code = [(m.start(), m.end()) for m in _SPAN.finditer(text, body, end)] if text.find("`", body, end) >= 0 or text.find("://", body, end) >= 0 else []
    found = []

    def inside(k: int, among: list[tuple[int, int]] = spans) -> tuple[int, int] | None:
        at = bisect_left(among, (k, 0)) - 1
        return among[at] if at >= 0 and among[at][0] < k <= among[at][1] else None

    def in_code(k: int) -> tuple[int, int] | None:
        at = bisect_left(code, (k + 1, 0)) - 1
        return code[at] if at >= 0 and code[at][0] <= k < code[at][1] else None

    past = body
    for at in [m.start() for m in _STOPS.finditer(text, body, end)]:
        if at < past:
            continue
        m = _STOP.match(text, at, end)
        past = m.end("close")
        inner = in_code(at)
        # a terminator right after a link belongs to the sentence
        if inner and m.end("term") < inner[1]:
            continue
        after = m.end()
        if after >= end:
            continue
        wide = m.group("term")[-1] in _WIDE
        closed = inside(at)
        if closed:
            if closed[1] >= m.end("close") or not m.group("close"):
                continue
            found.append((m.end("close"), after, m.group("term"), m.group("close"), "quote", closed[0]))
            continue
        if not wide and not m.group("gap"):
            # without a blank only scripts that need none can go on, and dots there are a pause
            if not (m.group("term")[-1] in "؟!?" and _CJK.match(text, after)):
                continue
        found.append((m.end("close"), after, m.group("term"), m.group("close"), "stop", -1))
    for m in _TIGHT.finditer(text, body, end):
        at = m.start("term")
        if text[at + 1].isupper() and _BEFORE_TIGHT.search(text, max(body, at - 60), at) and not inside(at) and not in_code(at):
            found.append((at + 1, at + 1, m.group("term"), "", "tight", -1))
    for m in _THAI_GAP.finditer(text, body, end) if _THAI.search(text, body, end) else ():
        if not inside(m.start()) and not in_code(m.start()):
            found.append((m.start(), m.end(), "", "", "blank", -1))
    found.sort()
    return found


_CLOSED = re.compile(r"[.!?。！？।؟…][\"'”’»)\]」』）]*$")


class Counts:
    """How often words end paragraphs (``final``) among all places where they could (``seen``), and how often words open paragraphs
    (``opening``) among all their occurrences (``any``); ``used`` are the words after a candidate or at a paragraph's head, ``kept``
    those whose counts matter however small they are."""

    def __init__(self) -> None:
        self.final: Counter = Counter()
        self.seen: Counter = Counter()
        # of texts where case says something, and of the others
        self.opening: tuple[Counter, Counter] = (Counter(), Counter())
        self.any: tuple[Counter, Counter] = (Counter(), Counter())
        self.used: set[str] = set()
        self.kept_before: set[str] = set()
        self.kept: set[str] = set()

    def __len__(self) -> int:
        return len(self.seen) + len(self.any[0]) + len(self.any[1])

    def add(self, text: str, fitted: bool) -> None:
        """Count a text; ``fitted``: the classifier is fitted on it."""
        cased = _cased(text)
        side = 0 if cased else 1
        used = set()
        for s, b, e, whole in blocks(text):
            if whole:
                continue
            if _CLOSED.search(text[max(b, e - 6) : e]):
                w = _shape(_last_word(text, b, len(text[:e].rstrip("\"'”’»)]」』）.!?。！？।؟…"))))
                self.final[w] += 1
                self.seen[w] += 1
            head = _first_word(text, b, e)
            used.add(head)
            self.opening[side][head] += 1
            self.any[side].update(_FIRST.findall(text, b, e))
            for c in candidates(text, s, b, e):
                w = _shape(_last_word(text, b, c[0] - len(c[2]) - len(c[3])))
                v = _first_word(text, c[1], e)
                self.seen[w] += 1
                used.add(v)
                if c[4] == "tight":
                    self.kept_before.add(w)
                    self.kept.add(v if cased else _uncased(v))
        # a word in its own case where case says something, else in small letters
        used = used if cased else {_uncased(w) for w in used}
        self.used |= used
        if fitted:
            self.kept |= used

    def rows(self) -> Iterator[tuple[str, str, int, int, bool, bool]]:
        """(side, word, count, of, used, kept), both sides of a candidate."""
        for w, n in self.seen.items():
            yield "before", w, self.final[w], n, True, w in self.kept_before
        opening, every = Counter(self.opening[0]), Counter(self.any[0])
        for held, out in ((self.opening, opening), (self.any, every)):
            for part in held:
                for w, n in part.items():
                    out[_uncased(w)] += n
        for w in every.keys() | opening.keys() | self.used:
            yield "after", w, opening[w], every[w], w in self.used, w in self.kept


def corpus_counts(docs: DataFrame, fitted: Column, text: str = "text") -> DataFrame:
    """(side, word, count, of) over all texts: ``count`` of ``of`` occurrences of a word before (after) a candidate end (open) a paragraph.

    Each task counts, the rest is summed by word. Left out are words that no candidate stands beside, and words seen less than LEAST_SEEN
    times unless a decision needs them: next to a terminator without a blank, or in a text the classifier is fitted on (``fitted``).
    """
    schema = "side string, word string, n bigint, of bigint, used boolean, kept boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["side", "word", "n", "of", "used", "kept"]
        held = Counts()
        for p in parts:
            for t, f in zip(p["text"], p["fitted"]):
                held.add(t, bool(f))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame(list(held.rows()), columns=names)
                    held = Counts()
        yield pd.DataFrame(list(held.rows()), columns=names)

    counted = docs.where(F.length(text) > 0).select(F.col(text).alias("text"), fitted.alias("fitted")).mapInPandas(run, schema)
    summed = counted.groupBy("side", "word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), F.max("used").alias("used"), F.max("kept").alias("kept"))
    before = (F.col("of") >= LEAST_SEEN) | F.col("kept") & (F.col("n") > 0)
    after = F.col("used") & ((F.col("of") >= LEAST_SEEN) | F.col("kept"))
    return summed.where(F.when(F.col("side") == "before", before).otherwise(after)).select("side", "word", "n", "of")


class Boundaries:
    """The classifier with the counts it is fed from: rows (side, word, count, of) of ``corpus_counts``."""

    def __init__(self, texts: list[str], counts: Iterable[tuple[str, str, int, int]], rounds: int = 300):
        self.final: Counter = Counter()
        self.seen: Counter = Counter()
        self.opening: Counter = Counter()
        self.any: Counter = Counter()
        for side, w, n, of in counts:
            part, whole = (self.final, self.seen) if side == "before" else (self.opening, self.any)
            whole[w] = of
            if n:
                part[w] = n
        self.weights: dict[str, float] = {}
        self.memo: dict[tuple, bool] = {}
        rows, labels = [], []
        for text in texts:
            own = [p for p in blocks(text) if not p[3]]
            cased = _cased(text)
            for k, (_, b, e, _) in enumerate(own):
                for c in candidates(text, _, b, e):
                    label = self._reliable(text, b, e, c, cased)
                    if label is not None:
                        rows.append(self.signature(text, b, e, c, cased))
                        labels.append(label)
                # two words within a sentence, read as if only a terminator parted them
                words = [m.group() for m, _ in zip(_FIRST.finditer(text, b, e), range(6))]
                if len(words) == 6:
                    joined = f"{words[3]}.{words[4]}"
                    c = (len(words[3]) + 1, len(words[3]) + 1, ".", "", "tight", -1)
                    rows.append(self.signature(joined, 0, len(joined), c, cased))
                    labels.append(0)
                # a break between two paragraphs, read as if only a blank parted them, or nothing
                if k + 1 < len(own):
                    m = re.search(r"(?P<term>[.!?。！？।؟…]+)(?P<close>[\"'”’»)\]」』）]*)$", text[max(b, e - 8) : e])
                    nxt = own[k + 1]
                    following = text[nxt[1] : nxt[2]]
                    if m:
                        joined = text[b:e] + " " + following
                        opened = max((o for o, c in _quoted(text, b, e) if c == e - 1), default=b - 1) - b if m.group("close") else -1
                        c = (e - b, e - b + 1, m.group("term"), m.group("close"), "quote" if m.group("close") else "stop", opened)
                        rows.append(self.signature(joined, 0, len(joined), c, cased))
                        labels.append(1)
                        if not m.group("close") and self.seen[_shape(_last_word(text, b, e - len(m.group("term"))))]:
                            joined = text[b:e] + following
                            rows.append(self.signature(joined, 0, len(joined), (e - b, e - b, m.group("term"), "", "tight", -1), cased))
                            labels.append(1)
                    elif _THAI.match(text, e - 1) and _THAI.match(following):
                        joined = text[b:e] + " " + following
                        rows.append(self.signature(joined, 0, len(joined), (e - b, e - b + 1, "", "", "blank", -1), cased))
                        labels.append(1)
        self._fit([self.features(r) for r in rows], labels, rounds)

    def _reliable(self, text: str, b: int, e: int, c: tuple, cased: bool) -> int | None:
        end, nxt, term, close, kind = c[:5]
        following = text[nxt]
        if following in _PAUSE:
            return 0
        if kind == "blank":
            # in a script without terminators a blank is as reliable as a break: words aren't parted by any, but numbers are
            return 0 if following.isdigit() else 1
        if kind == "tight":
            # rather a name with a dot, unless both words are used to ending and opening sentences
            ends, opens = self._used(text, b, e, c, cased)
            return None if ends and opens else 0
        word = _last_word(text, b, end - len(term) - len(close))
        if term == "." and not close and word in CONTINUING:
            return 0
        if kind == "quote" and c[5] >= 0:
            begins, told, bracket, caseless = _lead(text, b, c)
            if bracket:
                return int(begins and not (cased and following.islower()))
            if caseless:
                return int(told and not begins)
            if begins and following in "—–-":
                return 0
            if not cased:
                return int(told)
        w = _first_word(text, nxt, e)
        if cased and following.islower() and not _NAME.match(text, nxt) and self.opening[w] * 50 < self.any[w] and text[b:nxt].lower() != text[b:nxt]:
            return 0
        return None

    def _used(self, text: str, b: int, e: int, c: tuple, cased: bool) -> tuple[bool, bool]:
        """Whether the word before a candidate ends, and the word after it opens, more than every fiftieth time."""
        w, v = _shape(_last_word(text, b, c[0] - len(c[2]) - len(c[3]))), _first_word(text, c[1], e)
        v = v if cased else _uncased(v)
        return self.final[w] * 50 > self.seen[w], self.opening[v] * 50 > self.any[v]

    def signature(self, text: str, b: int, e: int, c: tuple, cased: bool) -> tuple:
        """What the features of a candidate depend on."""
        end, nxt, term, close, kind, opener = c
        following = text[nxt]
        w = _first_word(text, nxt, e)
        w = w if cased else _uncased(w)
        upper, lower = following.isupper(), following.islower()
        case = "pause" if following in _PAUSE else "upper" if upper else "lower" if lower else "digit" if following.isdigit() else "mark" if not following.isalpha() else "plain"
        if upper or lower:
            if _NAME.match(text, nxt):
                case = "name"  # of a file or a variable: its case says nothing
            elif not cased:
                case = "uncased"
        n = self.any[w]
        opens = self.opening[w] / n if n >= LEAST_SEEN else -1
        opened = "none" if opens < 0 else "0" if opens == 0 else "low" if opens < 0.01 else "some" if opens < 0.05 else "often"
        mark = "wide" if term and term[-1] in _WIDE else "dots" if term.startswith(("...", "…")) else "dot" if term == "." else term[-1:] or "blank"
        more: tuple = ()
        if kind == "tight":
            more = self._used(text, b, e, c, cased)
        elif kind == "quote" and opener >= 0:
            begins, told, bracket, caseless = _lead(text, b, c)
            more = (begins, told, bracket, caseless, cased, following in "—–-")
        elif term in (".", "．") and not close:
            word = _last_word(text, b, end - len(term))
            shape = _shape(word)
            n = self.seen[shape]
            rate = self.final[shape] / n if n >= LEAST_SEEN else -1
            before = ""
            if word.isdigit() and (m := _BEFORE_NUMBER.search(text[max(b, end - 30) : end - len(term)])):
                before = m.group(1).lower()
            more = ("none" if rate < 0 else "0" if rate == 0 else "low" if rate < 0.03 else "some" if rate < 0.15 else "often", "#" if word.isdigit() else word, before)
        return (kind, case, mark, opened, more)

    @staticmethod
    def features(signature: tuple) -> list[str]:
        kind, case, mark, opened, more = signature
        if kind == "tight":
            return [f"tight|ends={more[0]}|opens={more[1]}", f"tight|case={case}", f"tight|ends={more[0]}", f"tight|opens={more[1]}"]
        out = ["bias", f"mark={mark}", f"mark={mark}|case={case}", f"kind={kind}|case={case}", f"opens={opened}|case={case}", f"mark={mark}|case={case}|opens={opened}"]
        if kind == "quote" and more:
            begins, told, bracket, caseless, cased, dash = more
            lead = f"begins={begins}|told={told}"
            out += [f"{lead}|bracket={bracket}", f"bracket={bracket}|begins={begins}|case={case}", f"caseless={caseless}|bracket={bracket}|{lead}", f"cased={cased}|bracket={bracket}|{lead}", f"dash={dash}|bracket={bracket}|begins={begins}"]
        elif more:
            rates, word, before = more
            known = "go" if word in CONTINUING else "end" if word in ENDING else "no"
            size = "one" if len(word) == 1 and word.isalpha() else "number" if word == "#" else "short" if len(word) <= 3 else "long"
            out += [f"final={rates}", f"final={rates}|case={case}", f"known={known}", f"known={known}|case={case}|opens={opened}", f"size={size}", f"size={size}|case={case}", f"dots={'.' in word}|case={case}"]
            if word == "#":
                out += [f"number|opens={opened}|case={case}", f"before={before}", f"before={before}|opens={opened}"]
            else:
                out.append(f"word={word[:12]}")
        return out

    def _fit(self, rows: list[list[str]], labels: list[int], rounds: int) -> None:
        if not rows or len(set(labels)) < 2:
            self.weights = {"bias": 1.0, "known=go": -6.0, "kind=stop|case=lower": -4.0, "tight|ends=True|opens=True": 1.0}
            return
        count = Counter(f for r in rows for f in r)
        names = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 3))}
        owner = np.array([k for k, r in enumerate(rows) for f in r if f in names])
        column = np.array([names[f] for r in rows for f in r if f in names])
        y = np.array(labels, dtype=np.float64)
        # either class weighs the same, among the terminators without a blank and among the others
        share = np.zeros(len(y))
        tight = np.array([r[0].startswith("tight") for r in rows])
        for part in (tight, ~tight):
            share[part] = np.where(y[part] == 1, 0.5 / max(1, y[part].sum()), 0.5 / max(1, (1 - y[part]).sum())) * part.sum()
        w, first, second = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for t in range(1, rounds + 1):
            z = np.bincount(owner, weights=w[column], minlength=len(y))
            error = share * (1 / (1 + np.exp(-z)) - y)
            grad = np.bincount(column, weights=error[owner], minlength=len(w)) / len(y) + 1e-4 * w
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights = {f: float(w[k]) for f, k in names.items()}

    def divides(self, text: str, b: int, e: int, c: tuple, cased: bool) -> bool:
        """Whether a candidate is a boundary, as the classifier has it."""
        key = self.signature(text, b, e, c, cased)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[key] = sum(self.weights.get(f, 0.0) for f in self.features(key)) > 0
        return known


#: What no sentence opens with.
_PAUSE = ",;:，；：、)]）」』»”"
_BEFORE_NUMBER = re.compile(r"([^\W\d_]+\.?)\s+\d+$")
_BOUNDS = ".!?。！？।؟…\"”»」』）)"


def _lead(text: str, b: int, c: tuple) -> tuple[bool, bool, bool, bool]:
    """Of a closed quotation or bracket: whether it opens a sentence, whether a colon leads it in, whether it is a bracket, and whether a
    letter of a script without case follows."""
    lead, following = text[max(b, c[5] - 40) : c[5]].rstrip(), text[c[1]]
    return not lead or lead[-1] in _BOUNDS, lead.endswith((":", "：")), text[c[5]] in "(（[【", following.isalpha() and not (following.isupper() or following.islower())


def _cased(text: str) -> bool:
    """Whether letter case says something: the text has both capitals and small letters in number."""
    small, capital = sum(map(len, _SMALL.findall(text))), sum(map(len, _CAPITAL.findall(text)))
    return not (small and capital * 200 < small) and not (capital and small * 4 < capital)


def units(text: str | None, model: Boundaries) -> list[tuple[int, int]]:
    """(start, end) from 0 of the sentence units of a text; they cover it but for blanks. Null, empty and blank texts have none."""
    if not text:
        return []
    out = []
    cased = _cased(text)
    for start, body, end, whole in blocks(text):
        if whole or end - body < 2:
            out.append((start, end))
            continue
        at = start
        for c in candidates(text, start, body, end):
            if c[0] > at and c[0] > body and model.divides(text, body, end, c, cased):
                out.append((at, c[0]))
                at = c[1]
        out.append((at, end))
    return out


def train(docs: DataFrame, sample: int = TRAINING_TEXTS, id_col: str = "doc_id", text: str = "text") -> Boundaries:
    """A classifier fitted on about ``sample`` texts, those with the least hash of their id, with the words counted over all texts."""
    known = docs.where(F.length(text) > 0).select(F.xxhash64(id_col).alias("h"), F.col(text).alias("text"))
    n = known.count()
    bound = -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, sample / max(1, n))))
    fitted = F.col("h") <= F.lit(bound)
    counts = corpus_counts(known, fitted).toArrow()
    texts = [r["text"] for r in known.where(fitted).orderBy("h").limit(2 * sample).collect()]
    return Boundaries(texts, zip(*(c.to_pylist() for c in counts.columns)))


def sentence_units(docs: DataFrame, model: Boundaries, text: str = "text") -> DataFrame:
    """Per row of ``docs`` and unit: the other columns, ``start_pos`` and ``end_pos`` (characters from 1). Whole texts, no shuffle."""
    others = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + ", start_pos int, end_pos int"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for p in parts:
            rows = [(k, a + 1, b) for k, t in enumerate(p[text]) for a, b in units(t, m)]
            hits = pd.DataFrame(rows, columns=["_k", "start_pos", "end_pos"])
            yield pd.concat([p[others].iloc[hits["_k"]].reset_index(drop=True), hits.drop(columns="_k")], axis=1)

    return docs.where(F.length(text) > 0).mapInPandas(run, schema)
