"""Secret scan: fixed patterns, then password guess-cost dynamic programming over values that stand in a credential context.

The guess cost of a value is the least, over all ways to cut it into spans, of the sum of log10 guesses of the spans:
listed words (plain, capitalised, reversed, with look-alike characters), dates and years, repeats, keyboard walks,
alphabet runs, and brute force per character. Words are ranked by a short list of usual passwords and, after it, by
frequency in the corpus (learn_words). A context value that no pattern covers is a secret when no cheap segmentation
exists, whatever its characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # maximal runs, so the same as filtering AKIA[A-Z0-9]+ by length
_HEX = re.compile(r"[0-9a-f]{16,}")
_LETTERS = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,20}(?![^\W\d_])")
_KEYWORD = re.compile(r"passw|secret|token|api_?key|passphrase|pwd|credential", re.I | re.A)
_CONTEXT = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api_?key|credentials?)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"'<>]+)", re.I | re.A)
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_SHORT = rf"(?:{_YEAR}|\d\d)"
_DATES = [re.compile(x) for x in (_YEAR, rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}", rf"{_DAY}([-/._]?){_MONTH}\1{_SHORT}", rf"{_MONTH}([-/._]?){_DAY}\1{_SHORT}")]

# Usual words of passwords and placeholders, most usual first; a word's guesses are its place. Corpus words come after.
WORDS = (
    "password pass admin login user test example sample dummy change changeme letmein welcome secret token key qwerty master "
    "hello love dragon monkey sunshine princess football baseball shadow superman iloveyou summer winter spring autumn server "
    "root guest default access private public none null true false here your my the and value string please enter insert "
    "placeholder redacted hidden forgot reset required optional invalid correct wrong new old"
).split()
#: Look-alike characters; 1, ! and 7 have a second reading.
_ALIKE = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "l", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}
_READINGS = [str.maketrans(_ALIKE), str.maketrans({**_ALIKE, "1": "i", "!": "l", "7": "l"})]
_KEYS = {key: (r, c) for r, row in enumerate(("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")) for c, key in enumerate(row)}
_KEYS |= {shifted: _KEYS[key] for shifted, key in zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./", strict=True)}
_STEPS = {(0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)}  # the rows of a keyboard are shifted by half a key
_CUT = math.log10(2)


def _step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to the next, None where they are not neighbours."""
    p, q = _KEYS.get(a), _KEYS.get(b)
    d = (q[0] - p[0], q[1] - p[1]) if p and q else None
    return d if d in _STEPS else None


class WordRanks:
    """Guesses by word: places in WORDS, then in `corpus` (words by falling frequency)."""

    def __init__(self, corpus: list[str] = ()):  # type: ignore[assignment]
        self.rank: dict[str, int] = {}
        for w in [*WORDS, *corpus]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))

    def spans(self, value: str, low: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, log10 guesses) of every listed word of three letters or more in a value."""
        n = len(value)
        forms = [(low, 0.0)] + [(x, 1.0) for x in dict.fromkeys(low.translate(t) for t in _READINGS) if x != low]
        for text, extra in forms:
            back = text[::-1]
            for i in range(n):
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    case = 0.3 if value[i:j] != low[i:j] else 0.0
                    if rank := self.rank.get(text[i:j]):
                        yield i, j, math.log10(rank) + extra + case
                    if rank := self.rank.get(back[n - j : n - i]):
                        yield i, j, math.log10(rank) + extra + case + _CUT


_PLAIN = WordRanks()


def pattern_spans(value: str, low: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of dates, maximal repeats, maximal keyboard walks and maximal alphabet or digit runs."""
    n = len(value)
    for i in range(n):
        if low[i].isdecimal():
            for rx, cost in zip(_DATES, (2.1, 4.6, 4.6, 4.6), strict=True):
                if m := rx.match(low, i):
                    yield i, m.end(), cost
    for size in (1, 2, 3, 4):  # units of one to four characters, twice or more (a single one three times or more)
        i = 0
        while i + size < n:
            j = i + size
            while j < n and low[j] == low[j - size]:
                j += 1
            if j - i >= max(3, 2 * size):
                yield i, j, (math.log10(12) if size == 1 else size) + math.log10((j - i) / size)
            i = max(i + 1, j - size + 1)
    i = 0
    while i + 1 < n:
        j, turns, way = i + 1, 0, None
        while j < n and (d := _step(low[j - 1], low[j])):
            turns += d != way and way is not None
            way = d
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(47 * (j - i)) + turns * math.log10(5)
        i = max(j - 1, i + 1)
    for step in (1, -1):
        i = 0
        while i + 1 < n:
            j = i + 1
            while j < n and ord(low[j]) - ord(low[j - 1]) == step and low[j].isalnum() and low[j - 1].isalnum():
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(52 * (j - i))
            i = max(j - 1, i + 1)


def guess_cost(value: str, words: WordRanks = _PLAIN) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value. Linear in the value's length."""
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}
    for found in (words.spans(value, low), pattern_spans(value, low)):
        for i, j, cost in found:
            ends.setdefault(j, []).append((i, cost))
    for j in range(1, n + 1):
        best[j] = best[j - 1] + 1.0
        for i, cost in ends.get(j, ()):
            best[j] = min(best[j], best[i] + cost + (_CUT if i else 0.0))
    return best[n]


def learn_words(docs: DataFrame, limit: int = 20_000, counters: int = 1 << 16, text_col: str = "text") -> list[str]:
    """At most `limit` words of 3 to 20 letters by falling frequency over all texts.

    Tasks keep frequent words in Misra-Gries summaries, so counts may be low by at most one in `counters` words read, and
    what is shuffled is bounded by the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(_LETTERS.findall(text.lower()))
            if len(counts) > 2 * counters:
                off = sorted(counts.values(), reverse=True)[counters]
                counts = Counter({w: c - off for w, c in counts.items() if c > off})
        top = counts.most_common(counters)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(limit).collect()
    return [r["word"] for r in rows]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


class _Cover:
    """Characters that sorted spans hold together, as merged runs."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in spans:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and end <= self.ends[at]


def all_spans(text: str, least_cost: float = 8.0, words: WordRanks = _PLAIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], dict[int, float]]:
    """(base spans, all spans, guess cost by start of context values). No added span is covered by base ones."""
    base = base_spans(text)
    added, costs = [], {}
    if _KEYWORD.search(text):
        cover = _Cover(base)
        for m in _CONTEXT.finditer(text):
            start = m.start(1)
            value = m[1].rstrip(".,;:!?)]}&")
            end = start + len(value)
            if len(value) < min(8, least_cost) or cover.holds(start, end):  # a character costs 1 at most
                continue
            costs[start] = guess_cost(value, words)
            if costs[start] >= least_cost:
                added.append((start, 3, end))
    return base, sorted(base + added), costs


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, words: list[str] = (), least_cost: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # type: ignore[assignment]
    """doc_id, counts by kind, base_sha256, spans, and found: array of (kind, start, end, value, log10_guesses).

    words: as learn_words() gives them. Null and empty texts give no spans (base_sha256 of the empty string). One output
    row per input row, repeated ones too, null ids kept.
    """
    ranks = WordRanks(words)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,value:string,log10_guesses:double>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, found = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base, every, costs = all_spans(text, least_cost, ranks)
                for k in range(4):
                    counts[k].append(sum(1 for x in every if x[1] == k))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                found.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e], "log10_guesses": costs[s] if k == 3 else guess_cost(text[s:e], ranks)} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(found, item)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, words: list[str] = (), mark: str = "[SECRET]", least_cost: float = 8.0, text_col: str = "text") -> DataFrame:  # type: ignore[assignment]
    """docs with every secret span of text_col replaced by mark; other columns and rows unchanged, null texts stay null."""
    schema, ranks = docs.schema, WordRanks(words)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, _, e in all_spans(text, least_cost, ranks)[1]:
            if e > at:
                out += [text[at : max(s, at)], mark if s >= at else ""]
                at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return docs.mapInArrow(run, schema)
