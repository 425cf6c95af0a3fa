"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

An n-gram never reaches past the blank before its word, so a text's score is the sum of its words' scores; each worker
remembers words (a bounded number), and new words are scored together in numpy. All languages share one table per order:
a sorted array of n-gram hashes with, for each language, the discounted probability, and one of contexts with the
weight given to the next lower order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .batches import small

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MAX_WORDS = 250_000
#: Share of texts of a known language that rejection is set to lose.
FALSE_REJECTION = 0.002


@dataclass
class LanguageModels:
    langs: list[str]
    order: int
    alphabet: int
    grams: list[np.ndarray]  # by order: sorted hashes
    probs: list[np.ndarray]  # by order: (gram, language) discounted probability
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]  # by order: (context, language) weight of the lower order
    usual: np.ndarray  # by language: mean, spread between texts, spread of a symbol, deviations beyond which a text is rejected


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][i]: of the k symbols that end at i, 1 <= k <= order."""
    out = [np.zeros(len(codes), np.uint64)]
    acc = np.zeros(len(codes), np.uint64)
    power = np.uint64(1)
    for k in range(1, order + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k - 1 :] = codes[: max(0, len(codes) - k + 1)]
        acc = acc + (shifted + np.uint64(1)) * power
        with np.errstate(over="ignore"):
            power = power * _MULT
        out.append(mix(acc + np.uint64(k)))
    return out


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ' w1 w2 ... ' and, for each place, how many symbols lie after the blank before it (0 at the first)."""
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = codes == 32
    last = np.maximum.accumulate(np.where(blank, np.arange(len(codes)), 0))
    before = np.concatenate(([0], last[:-1]))
    return codes, np.arange(len(codes)) - before


def _row(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, len(table) where absent."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = len(table) - 1
    return np.where(table[at] == keys, at, len(table))


def _one_language(words: list[str], order: int, alphabet: int) -> tuple[list, list]:
    codes, reach = _symbols(words)
    hashes = _hashes(codes, order)
    use = np.arange(1, len(codes))
    per_order = []
    for k in range(1, order + 1):
        at = use[reach[use] >= k - 1]
        gram, first, count = np.unique(hashes[k][at], return_index=True, return_counts=True)
        place = at[first]
        per_order.append((gram, place, count.astype(float), reach[place] == k - 1))
    grams, contexts = [], []
    for k in range(1, order + 1):
        gram, place, count, at_start = per_order[k - 1]
        if k < order:  # continuation counts: how many different symbols stand before the n-gram
            longer = per_order[k]
            tail, kinds = np.unique(hashes[k][longer[1]], return_counts=True)
            row = _row(tail, gram)
            kinds = np.append(kinds, 0)[row]
            count = np.where(at_start | (kinds == 0), count, kinds)
        ones, twos = float((count == 1).sum()), float((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        before = hashes[k - 1][place - 1] if k > 1 else np.zeros(len(place), np.uint64)
        context, inverse = np.unique(before, return_inverse=True)
        total = np.bincount(inverse, count)
        kinds = np.bincount(inverse)
        grams.append((gram, np.maximum(count - discount, 0) / total[inverse]))
        contexts.append((context, discount * kinds / total))
    return grams, contexts


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], absent: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys) + 1, len(parts)), absent, np.float32)
    for j, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), j] = v
    return keys, values


def words_of(text: str | None) -> list[str]:
    """Every run of letters (general category L, with the marks on them), lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def _tail_quantile(values: np.ndarray, rate: float) -> float:
    """Value exceeded at about `rate`, by an exponential tail over the highest fifth."""
    base = float(np.quantile(values, 0.8))
    over = values[values > base] - base
    mean = float(over.mean()) if len(over) else 0.0
    return max(float(values.max()), base + mean * math.log(0.2 / rate))


def fit_language_models(rows: list[tuple[str, str]], order: int = 5, false_rejection: float = FALSE_REJECTION) -> LanguageModels | None:
    """Models from (language, text) rows; two fifths of each language's rows are counted, the rest calibrates rejection.

    A text's entropy is measured in deviations from its language's mean, given its length; texts beyond the deviation that
    calibration texts exceed at the rate `false_rejection` are rejected. None without a row that has a letter.
    """
    by: dict[str, list[list[str]]] = {}
    for lang, text in rows:
        if words := words_of(text):
            by.setdefault(lang, []).append(words)
    if not by:
        return None
    langs = sorted(by)
    alphabet = len({c for texts in by.values() for words in texts for w in words for c in w}) + 2
    counted = {k: [t for i, t in enumerate(v) if i % 5 < 2 or len(v) < 5] for k, v in by.items()}
    parts = [_one_language([w for words in counted[k] for w in words], order, alphabet) for k in langs]
    grams, probs, contexts, gammas = [], [], [], []
    for k in range(order):
        g, p = _merge([x[0][k] for x in parts], 0.0)
        c, w = _merge([x[1][k] for x in parts], 1.0)
        grams.append(g), probs.append(p), contexts.append(c), gammas.append(w)
    models = LanguageModels(langs, order, alphabet, grams, probs, contexts, gammas, np.zeros((len(langs), 4)))
    for j, lang in enumerate(langs):
        aside = [t for i, t in enumerate(by[lang]) if not (i % 5 < 2 or len(by[lang]) < 5)] or by[lang]
        words = sorted({w for t in aside for w in t})
        place = {w: i for i, w in enumerate(words)}
        logs, sizes = _score_in_parts(models, words)
        rows_of = [np.array([place[w] for w in t]) for t in aside]
        means = np.array([-logs[r, j].sum() / sizes[r].sum() for r in rows_of])
        weights = np.array([sizes[r].sum() for r in rows_of], float)
        mean = float(np.average(means, weights=weights))
        every = np.concatenate(rows_of)
        per_symbol = (-logs[every, j] - mean * sizes[every]) / np.sqrt(sizes[every])
        between, within = max(0.05, float(np.median(np.abs(means - mean)) * 1.5)), max(0.5, float(per_symbol.std()))
        z = (means - mean) / np.sqrt(between**2 + within**2 / weights)
        models.usual[j] = mean, between, within, max(3.0, _tail_quantile(z, false_rejection))
    return models


def score_words(models: LanguageModels, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, language) natural log probability, and symbols per word (its letters and the blank after it)."""
    codes, reach = _symbols(words)
    hashes = _hashes(codes, models.order)
    n = len(codes)
    prob = np.full((n, len(models.langs)), 1.0 / models.alphabet)
    for k in range(1, models.order + 1):
        valid = reach >= k - 1
        valid[0] = False
        at = np.flatnonzero(valid)
        before = hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
        prob[at] = models.probs[k - 1][_row(models.grams[k - 1], hashes[k][at])] + models.gammas[k - 1][_row(models.contexts[k - 1], before)] * prob[at]
    ends = np.cumsum([len(w) + 1 for w in words])
    sums = np.cumsum(np.log(prob[1:]), axis=0)
    total = sums[ends - 1]
    return np.diff(total, axis=0, prepend=0.0), np.diff(ends, prepend=0)


def _score_in_parts(models: LanguageModels, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """score_words() of about 60,000 symbols at a time, so that its tables stay small."""
    parts, start = [(np.zeros((0, len(models.langs))), np.zeros(0, np.int64))], 0
    while start < len(words):
        some, size = start, 0
        while some < len(words) and size < 60_000:
            size += len(words[some])
            some += 1
        parts.append(score_words(models, words[start:some]))
        start = some
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


class _Scorer(dict):
    """word -> place in `table`; forgets everything once it holds too many."""

    def __init__(self, models: LanguageModels):
        super().__init__()
        self.models = models
        self.new: list[str] = []
        self.table = np.zeros((0, len(models.langs) + 1), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """By text: log probability by language, then symbols."""
        if len(self) > _MAX_WORDS:
            self.clear()
            self.table = self.table[:0]
        ids = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        if self.new:
            scores, symbols = _score_in_parts(self.models, self.new)
            self.table = np.concatenate([self.table, np.column_stack([scores, symbols]).astype(np.float32)])
            self.new.clear()
        return np.array([self.table[i].sum(axis=0, dtype=np.float64) for i in ids]) if ids else np.zeros((0, self.table.shape[1]))


class _Judge:
    """Predictions of texts; one for each task."""

    def __init__(self, models: LanguageModels | None):
        self.models = models
        self.scorer = _Scorer(models) if models is not None else None

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        models = self.models
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            for row in self.scorer.sums(part) if self.scorer is not None else np.zeros((len(part), 1)):
                symbols = row[-1]
                if symbols == 0:
                    yield "und", 0.0, None, True
                    continue
                cross = -row[:-1] / symbols
                j = int(cross.argmin())
                share = np.exp(-(cross - cross[j]) * min(symbols, 40.0))
                mean, between, within, most = models.usual[j]
                z = (cross[j] - mean) / math.sqrt(between**2 + within**2 / symbols)
                yield models.langs[j], float(1 / share.sum()), float(cross[j]), bool(z > most)


def _predict(models: LanguageModels | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(models)
        for batch in small(batches):
            cols = list(zip(*judge.judge(batch.column("text").to_pylist()), strict=True)) or [[]] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def keep_identified(docs: DataFrame, models: LanguageModels | None, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose language is not rejected; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(models)
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([not x[3] for x in judge.judge(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sample_rows(labelled: DataFrame, per_language: int = 800, max_chars: int = 3_000_000) -> list[tuple[str, str]]:
    """A fixed, hash-chosen sample of (lang, text): at most per_language texts and max_chars characters a language.

    labelled: doc_id, lang, text. Rows without a language and texts longer than max_chars are left out. Whole texts are
    taken, in hash order, as long as they fit; only places and lengths reach the driver before that, then the texts chosen.
    """
    known = labelled.filter("lang is not null and text is not null").withColumn("size", F.char_length("text")).filter(F.col("size") <= max_chars)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * per_language / n)))])
    drawn = known.withColumn("place", F.xxhash64("doc_id", "text", F.lit(7))).filter(F.col("place").bitwiseAND(F.lit((1 << 40) - 1)) < share[F.col("lang")] * float(1 << 40))
    chosen, held = set(), {}
    for r in drawn.select("lang", "place", "size").distinct().orderBy("lang", "place", "size").collect():
        texts, chars = held.get(r["lang"], (0, 0))
        if texts < per_language and chars + r["size"] <= max_chars:
            held[r["lang"]] = (texts + 1, chars + r["size"])
            chosen.add((r["lang"], r["place"]))
    places = sorted({p for _, p in chosen})
    rows = drawn.filter(F.col("place").isin(places)).select("lang", "place", "text").distinct().collect() if places else []
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["place"])) if (r["lang"], r["place"]) in chosen]


def identify_language(docs: DataFrame, models: LanguageModels | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row.

    A text without a letter, or null, is `und` with score 0 and rejected; so is everything where no model could be
    learnt. Otherwise the language of least length-normalised cross-entropy over all its words; rejected when that entropy
    is further above the language's mean than calibration texts of this length get. Rows are judged one by one: repeated
    rows get equal results, null ids stay null.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(models), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id) -> Column:
    """Rows kept out of learning: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, **sample) -> LanguageModels | None:
    """Models learnt from the text and non-null lang of the rows of docs that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit_language_models(sample_rows(rows, **sample))


def learn_and_identify(docs: DataFrame, **sample) -> DataFrame:
    """identify_language() with models learnt from the rows of docs that are not held out; adds held_out."""
    found = identify_language(docs, learn(docs, **sample))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
