"""Languages of texts and of the stretches of mixed texts.

Code, paths and identifiers are taken out. The script of a word narrows the languages that it can be of; a word model with a
letter-trigram fallback scores it for each of those; Viterbi with a penalty for a switch (small between sentences, large inside
one) labels every word. The runs of its path are the segments; sentences get the language of most of their words. A stretch whose
words and letters are far from what its best language has is of none that the model knows (``und``). All texts of a batch take their
Viterbi steps together, so a step is a few array operations. The model is trained on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training texts per language; the sample is the rows with the least hash of their id.
TRAINING_TEXTS = 400
#: Costs of a switch between two sentences, between two lines, and inside a sentence.
SWITCH_SENTENCE, SWITCH_LINE, SWITCH_INSIDE = 3.0, 2.0, 9.0
#: The most that one word may speak for one language against another.
CLIP = 7.0
#: A sentence has so many words, or so many characters of a script without spaces, unless the text has no longer one or it is clear.
MIN_WORDS, MIN_CHARS = 3, 5
#: A shorter sentence counts if each of its words is in its language and all together speak for it, against the next, by so much.
CLEAR = 9.0

#: A stretch is of no known language if it has so many words, at most this share of them known in its language, and letters on average so
#: many standard deviations less likely than those of the language's own words.
LEAST_WORDS, KNOWN_SHARE, ODD = 4, 0.1, 2.8
UNDETERMINED = "und"

# Labels in other spellings, by code.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "ru": "rus russian русский", "ja": "jpn japanese 日本語", "zh": "zho chi cmn chinese mandarin 中文",
    "ko": "kor korean 한국어", "ar": "ara arabic العربية", "hi": "hin hindi हिन्दी", "th": "tha thai ไทย", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands", "uk": "ukr ukrainian українська", "pl": "pol polish polski", "tr": "tur turkish türkçe", "vi": "vie vietnamese",
    "sv": "swe swedish svenska", "cs": "ces cze czech", "da": "dan danish", "fi": "fin finnish", "el": "ell gre greek", "he": "heb hebrew",
}
# Words for an unknown language.
UNKNOWN = ("", "und", "n/a", "na", "unknown", "none", "null", "?", "-", "xx", "zxx", "mul", "undefined", "undetermined", "other", "auto", "nan")

_SCRIPTS = (
    ("hangul", "ᄀ-ᇿ㄰-㆏가-힣"),
    ("cjk", "ぁ-ヿㇰ-ㇿｦ-ﾟ々〆一-鿿㐀-䶿"),
    ("thai", "฀-๿"),
    ("devanagari", "ऀ-ॣॱ-ॿ"),
    ("arabic", "ؠ-ٟٮ-ۓەۺ-ۿ"),
    ("cyrillic", "Ѐ-ԯ"),
    ("greek", "Ͱ-Ͽ"),
    ("hebrew", "א-ת"),
    ("latin", "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"),
)
_TOKEN = re.compile(
    "|".join(f"(?P<{name}>[{chars}]{'+' if name != 'latin' else '+(?:[' + chr(39) + '’-][' + chars + ']+)*'})" for name, chars in _SCRIPTS) + r"|(?P<line>[\n|]+)|(?P<stop>[.!?…]+(?=[\s\"'”’»)\]*_]|$)|[。！？｡।؟]+)"
)
_KANA = re.compile("[ぁ-ヿｦ-ﾟ]")
_NO_SPACES = ("cjk", "thai")
_CODE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`"
    # from the start of a word only: blobs, links and paths, names with underscores or digits, in camel case, with dots
    r"|(?<![A-Za-z0-9_])(?:[A-Za-z0-9+/=_-]{40,}"
    r"|(?:(?=[A-Za-z.~@:#-]*[_/\\0-9])[A-Za-z0-9_.~@:#?&=/\\-]*[A-Za-z_/\\](?:[A-Za-z0-9_.@:#?&=/\\-]*[A-Za-z0-9_/\\])?"
    r"|[a-z]+[A-Z][A-Za-z0-9]*(?:\.[A-Za-z][A-Za-z0-9]*)*|[A-Za-z][A-Za-z-]*(?:\.[A-Za-z][A-Za-z0-9]*)+)(?:\([^)\n]*\)|\[[^\]\n]*\])?)",
    re.S,
)
_CODE_LINE = re.compile(
    r"(?m)^[ \t>]*(?:\d+[ \t]+)?(?:"
    # a statement's end; prose that ends so has more words and no signs
    r"[^\n]*\{|[^\n]*[=(){}\[\]<>\"$][^\n]*;|\w+(?:[ \t]+\w+)?;|[{}\[\]();,]+"
    r"|(?:import|from|def|const|let|var|return|export|private|public|static|class|function|set|cd|node|echo|app|git)\b[^\n]*[=({;:][^\n]*"
    r"|(?:if|for|while)\b(?:[ \t]*\([^\n]*|[^\n]*[=<>(][^\n]*:|[^\n]*[ \t]:)"
    r"|set -[a-z]|cd [^\n]*&&[^\n]*|<[^\n]*>|#!?[ \t]*see[^\n]*|[\w.\" -]{1,40}\"?[ \t]*(?:=|:=)[ \t]*[^\n]*|\"[^\"\n]*\":[^\n]*|[A-Z_]{3,}=[^\n]*|\[[^\n\]]*\]"
    # a setting: a name in small letters and one value
    r"|(?:-[ \t]+)?[a-z][a-z0-9_.-]*:[ \t]*(?:\S*[^A-Za-z\s]\S*|[A-Za-z][\w-]*)?"
    r")[ \t]*$"
)
_CODE_MARK = re.compile(r"[;{}=<>\[\]#]|\bset -|&&|\":|[(][^)]*:|(?m:^[ \t>-]*[a-z][a-z0-9_.-]*:)|(?m:\b(?:if|for|while)\b[^\n]*:[ \t]*$)")
_CLUSTER = regex.compile(r"\X")


def composed(text: str) -> tuple[str, list[int] | None]:
    """The text in composed form, and for each of its characters (and the end) the place in the original; None where nothing changed."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    parts, place = [], []
    for m in _CLUSTER.finditer(text):
        c = unicodedata.normalize("NFC", m.group())
        parts.append(c)
        place += [m.start()] * len(c) if len(c) != len(m.group()) else range(m.start(), m.end())
    return "".join(parts), [*place, len(text)]


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names in any spelling; None for no label, a word for unknown, or one not known."""
    if label is None:
        return None
    low = label.strip().lower()
    if low in UNKNOWN:
        return None
    head = re.split(r"[-_ (]", low)[0]
    return _BY_NAME.get(low) or _BY_NAME.get(head)


_BY_NAME = {word: code for code, words in NAMES.items() for word in (code, *words.split())}


def _plain(word: str, script: str) -> str:
    w = word.lower()
    if script == "latin" and not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    return w


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, form, start, end) of the words and boundaries of a text without its code; kind is a script, ``line`` or ``stop``."""
    if "\n" in text or "`" in text or "=" in text or "/" in text or "_" in text or re.search(r"[A-Za-z0-9]\.[A-Za-z]|[a-z][A-Z0-9(]|;|:$", text):
        keep = lambda m: re.sub(r"[^\n]", " ", m.group(0))
        text = _CODE.sub(keep, text)
        if _CODE_MARK.search(text):
            text = _CODE_LINE.sub(keep, text)
    return [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


class Model:
    """Word scores by language, trained on (language, text) pairs."""

    def __init__(self, samples: list[tuple[str, str]], words: int = 40_000):
        self.langs = sorted({lang for lang, _ in samples})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.count: dict[str, Counter] = defaultdict(Counter)
        letters: dict[str, Counter] = defaultdict(Counter)
        scripts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in samples:
            for kind, form, _, _ in tokens(composed(text)[0]):
                if kind in ("line", "stop"):
                    continue
                scripts[lang][kind] += len(form)
                if kind in _NO_SPACES:
                    self.count[lang].update(form)
                else:
                    w = _plain(form, kind)
                    self.count[lang][w] += 1
                    padded = f" {w} "
                    letters[lang].update(padded[k : k + 3] for k in range(len(padded) - 2))
        self.of_script: dict[str, list[int]] = defaultdict(list)
        for lang in self.langs:
            total = sum(scripts[lang].values()) or 1
            for script, n in scripts[lang].items():
                # a passage in another script doesn't make it one of the language's: Latin names and terms occur everywhere
                if n >= 0.5 * total:
                    self.of_script[script].append(at[lang])
        self.total = {lang: sum(c.values()) for lang, c in self.count.items()}
        self.count = {lang: Counter(dict(c.most_common(words))) for lang, c in self.count.items()}
        self.tri = dict(letters)
        self.tri_total = {lang: sum(c.values()) for lang, c in letters.items()}
        self.cache: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray] | None] = {}
        # how likely the letters of a language's own words are: the mean and spread that the test for unknown languages needs
        self.usual = np.zeros((len(self.langs), 2), dtype=np.float32)
        for lang in self.langs:
            own = [(self._letters(w, lang), n) for w, n in self.count[lang].items() if len(w) > 1]
            values, weights = np.array([v for v, _ in own] or [0.0]), np.array([n for _, n in own] or [1.0])
            mean = np.average(values, weights=weights)
            self.usual[at[lang]] = mean, max(0.1, np.sqrt(np.average((values - mean) ** 2, weights=weights)))

    def _letters(self, w: str, lang: str) -> float:
        """Log likelihood of a word's letters, per trigram."""
        padded, tri, t = f" {w} ", self.tri.get(lang, {}), self.tri_total.get(lang, 0)
        return sum(log((tri.get(padded[k : k + 3], 0) + 0.02) / (t + 0.02 * 20_000)) for k in range(len(padded) - 2)) / max(1, len(w))

    def _log(self, w: str, lang: str, script: str) -> float:
        n, total = self.count.get(lang, {}).get(w, 0), self.total.get(lang, 0)
        if script in _NO_SPACES:
            return log((n + 0.05) / (total + 0.05 * 5_000))
        guess = max(self._letters(w, lang) * max(1, len(w)), -60.0)
        smooth = 5.0 * np.exp(guess / max(1, len(w)) * 3)
        return log((n + smooth) / (total + 5.0))

    def scores(self, kind: str, form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Log scores by language, the best at 0; whether the word is known, and how odd its letters are (in standard deviations), by
        language. None for a script that no language of the model is written in."""
        key = (kind, form if kind in _NO_SPACES else _plain(form, kind))
        if key in self.cache:
            return self.cache[key]
        able = self.of_script.get(kind, [])
        out = None
        if able:
            out = np.full(len(self.langs), -4 * CLIP, dtype=np.float32)
            if kind == "cjk":
                kana = bool(_KANA.search(form))
                able_now = [k for k in able if kana == (self.langs[k] == "ja") or not kana] or able
                sums = {k: sum(self._log(c, self.langs[k], kind) for c in form) for k in able_now}
            else:
                sums = {k: self._log(key[1], self.langs[k], kind) if len(able) > 1 else 0.0 for k in able}
            best = max(sums.values())
            for k, v in sums.items():
                out[k] = max(v - best, -CLIP * (max(1, len(form) // 4) if kind == "cjk" else 1))
            known, odd = np.ones(len(self.langs), dtype=np.float32), np.zeros(len(self.langs), dtype=np.float32)
            if kind not in _NO_SPACES:
                for k in sums:
                    known[k] = key[1] in self.count.get(self.langs[k], ())
                    odd[k] = 0.0 if known[k] else (self.usual[k, 0] - self._letters(key[1], self.langs[k])) / self.usual[k, 1]
            out = (out, known, odd)
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[key] = out
        return out


def label_texts(model: Model, texts: list[str | None]) -> tuple[list[list[tuple[str, float, int, int]]], list[list[tuple[str, float, int, int]]]]:
    """For each text its sentences, and its segments: lists of (language, confidence, start, end) in order, from 0, as places in the text
    as given; nothing for texts without language.

    Segments are the runs of one language in the Viterbi path, over sentences and inside them; a whole segment may be ``und``. A
    sentence gets the language that the path gives most of its words. The confidence is the share of its words in that
    language, weighted by how clearly the scores speak for it. Short sentences count where
    their words speak clearly for one language, and the longest where a text has nothing else; ``und`` ones don't count.
    """
    n = len(model.langs)
    place: dict[int, int] = {}
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    word, gaps, begins, ends, loose, sentences = [], [], [], [], [], []
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    sentence = 0
    for k, text in enumerate(texts):
        gap = 2
        sentence += 1
        plain, origin = composed(text) if text else ("", None)
        for kind, form, start, end in tokens(plain) if plain else ():
            if kind == "line" or kind == "stop":
                sentence += 1
                gap = max(gap, 2 if kind == "line" else 1)
                continue
            s = model.scores(kind, form)
            if s is not None:
                at = place.get(id(s))
                if at is None:
                    at = place[id(s)] = len(rows)
                    rows.append(s)
                word.append(at)
                gaps.append(gap)
                begins.append(origin[start] if origin else start)
                ends.append(origin[end] if origin else end)
                loose.append(kind in _NO_SPACES)
                sentences.append(sentence)
                gap = 0
        first[k + 1] = len(word)
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    runs: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    if not word:
        return out, runs
    word = np.array(word)
    scores = np.stack([r[0] for r in rows])[word]
    cost = np.array([SWITCH_INSIDE, SWITCH_SENTENCE, SWITCH_LINE], dtype=np.float32)[np.array(gaps)]
    path = _viterbi(scores, cost, first)

    begin, end, free = np.array(begins), np.array(ends), np.array(loose)
    weight = np.where(free, np.maximum(1, (end - begin) // 2), 1).astype(np.float32)
    known, odd = np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows])

    def judged(new: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the stretches that begin where ``new`` is set: first word, language, whether the path has no other, margin, confidence, whether it is of no known language, and its end."""
        heads, number = np.flatnonzero(new), np.cumsum(new) - 1
        share = np.zeros((len(heads), n), dtype=np.float32)
        np.add.at(share, (number, path), weight)
        lang = share.argmax(axis=1)
        at = np.arange(len(word))
        mine, others = scores[at, lang[number]], scores.copy()
        others[at, lang[number]] = -np.inf
        margin = np.add.reduceat(mine - others.max(axis=1), heads) if n > 1 else np.full(len(heads), CLIP)
        sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        own, whole = share[np.arange(len(heads)), lang], share.sum(axis=1)
        words = np.diff(np.append(heads, len(word)))
        strange = np.add.reduceat(odd[word, lang[number]], heads) / words
        unknown = (words >= LEAST_WORDS) & (np.add.reduceat(known[word, lang[number]], heads) <= KNOWN_SHARE * words) & (strange > ODD) & ~np.logical_or.reduceat(free, heads)
        confidence = np.where(unknown, 1 - np.add.reduceat(known[word, lang[number]], heads) / words, own / whole * sure)
        return heads, lang, own == whole, margin, np.round(confidence, 4), unknown, end[np.append(heads[1:], len(word)) - 1]

    opens = np.zeros(len(word), dtype=bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    heads, lang, alone, margin, confidence, unknown, tails = judged(opens | (np.diff(sentences, prepend=-1) != 0))
    whole = (np.diff(np.append(heads, len(word))) >= MIN_WORDS) | (np.logical_or.reduceat(free, heads) & (np.add.reduceat(end - begin, heads) >= MIN_CHARS))
    whole |= (margin >= CLEAR) & alone
    owner = np.searchsorted(first, heads, side="right") - 1
    found: list[list[int]] = [[] for _ in texts]
    for s, k in enumerate(owner.tolist()):
        if not unknown[s]:
            found[k].append(s)
    for k, own in enumerate(found):
        kept = [s for s in own if whole[s]] or sorted(own, key=lambda s: int(begin[heads[s]] - tails[s]))[:1]
        out[k] = [(model.langs[lang[s]], float(confidence[s]), int(begin[heads[s]]), int(tails[s])) for s in kept]

    heads, lang, _, _, confidence, unknown, tails = judged(opens | (np.diff(path, prepend=-1) != 0))
    owner = np.searchsorted(first, heads, side="right") - 1
    for s, k in enumerate(owner.tolist()):
        runs[k].append((UNDETERMINED if unknown[s] else model.langs[lang[s]], float(confidence[s]), int(begin[heads[s]]), int(tails[s])))
    return out, runs


def _viterbi(scores: np.ndarray, cost: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best language of every word, all texts' steps taken together; text k has the words first[k] to first[k + 1]."""
    n = scores.shape[1]
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths, starts = lengths[order], first[:-1][order]
    best = np.zeros((len(order), n), dtype=np.float32)
    back = np.zeros((len(scores), n), dtype=np.int8)
    every = np.arange(n, dtype=np.int8)[None, :]
    for t in range(int(sorted_lengths[0])):
        live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
        at = starts[:live] + t
        if t == 0:
            best[:live] = scores[at]
            continue
        now = best[:live]
        top = now.argmax(axis=1)
        switched = now[np.arange(live), top] - cost[at]
        stay = now >= switched[:, None]
        back[at] = np.where(stay, every, top[:, None].astype(np.int8))
        best[:live] = np.where(stay, now, switched[:, None]) + scores[at]
    path = np.zeros(len(scores), dtype=np.int8)
    state = best.argmax(axis=1)
    for t in range(int(sorted_lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
        at = starts[:live] + t
        path[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return path


def train(labelled: DataFrame, per_lang: int = TRAINING_TEXTS, id_col: str = "id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of at most ``per_lang`` labelled texts a language, those with the least hash of their id (no window over a whole language)."""
    known = labelled.select(F.lower(F.trim(lang_col)).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).where("lang is not null and length(text) > 0 and length(lang) = 2")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # a hash threshold that leaves about per_lang texts; the sample differs with the ids only
    span = 2**64
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        bound = -(2**63) + min(span - 1, int(span * min(1.0, 1.25 * per_lang / n)))
        keep = keep | ((F.col("lang") == lang) & (F.col("h") <= F.lit(bound)))
    rows = known.where(keep).orderBy("h").collect()
    taken: Counter = Counter()
    samples = []
    for r in rows:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per_lang:
            samples.append((r["lang"], r["text"]))
    return Model(samples)


def segments(items: DataFrame, model: Model, text: str = "text", sentences: bool = False) -> DataFrame:
    """Per row of ``items`` and stretch of one language: the other columns, ``lang``, ``confidence``, ``start_pos``, ``end_pos``
    (characters from 1 of the text as given). With ``sentences``, per row and whole sentence.

    Null and empty texts and texts of code alone give none. Rows are processed whole, without a shuffle.
    """
    others = [c for c in items.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != text) + ", lang string, confidence double, start_pos int, end_pos int"
    held = items.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for p in parts:
            rows = [(k, lang, sure, a + 1, b) for k, found in enumerate(label_texts(m, list(p[text]))[0 if sentences else 1]) for lang, sure, a, b in found]
            hits = pd.DataFrame(rows, columns=["_k", "lang", "confidence", "start_pos", "end_pos"])
            yield pd.concat([p[others].iloc[hits["_k"]].reset_index(drop=True), hits.drop(columns="_k")], axis=1)

    return items.where(F.length(text) > 0).mapInPandas(run, schema)
