"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A window with similarity of 0.8 to an item shares shingles with it, so fingerprints are made only for the item-sized
windows over a shingle of some item; this loses nothing. Their 128-bit fingerprints are looked up in a multi-index: of
eight blocks of 16 bits one at least differs in radius/8 bits or fewer, so probing each block's neighbours finds every
fingerprint within the radius. The exact weighted Jaccard similarity of shingle counts decides. Benchmark items are taken
in blocks of bounded size, each sent to all tasks; documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PUNCTUATION, mix, shingles, word_hashes
from .batches import small

BITS = 128
_BLOCK = 16  # bits
_SHIFTS = np.arange(64, dtype=np.uint64)


def _words(texts: list[str | None]) -> Iterator[np.ndarray]:
    return word_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], PUNCTUATION)


def _votes(tokens: np.ndarray) -> np.ndarray:
    """(token, bit): +1 or -1."""
    both = np.column_stack([tokens, mix(tokens + np.uint64(0x51AF))])
    return ((both[:, :, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32).reshape(len(tokens), BITS) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of eight 16-bit blocks."""
    return np.packbits(sums > 0, axis=-1).reshape(-1, BITS // 8).view(">u2").astype(np.uint16)


def simhash(tokens: np.ndarray) -> np.ndarray:
    """Fingerprint of a bag of tokens, as blocks; each occurrence votes once."""
    return _prints(_votes(tokens).sum(axis=0)[None])[0]


@lru_cache(maxsize=8)
def _neighbours(errors: int) -> np.ndarray:
    """All 16-bit masks of up to `errors` bits."""
    every = np.arange(1 << _BLOCK, dtype=np.uint16)
    return every[np.bitwise_count(every) <= errors]


class HammingIndex:
    """All fingerprints within `radius`: of the blocks of 16 bits one at least differs in radius // 8 bits or fewer."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.radius, self.prints = radius, np.asarray(prints, np.uint16).reshape(-1, BITS // _BLOCK)
        self.errors = radius // (BITS // _BLOCK)
        self.tables = []
        for block in self.prints.T:
            order = np.argsort(block, kind="stable")
            values, first = np.unique(block[order], return_index=True)
            self.tables.append((values, np.append(first, len(block)), order))

    def _met(self, queries: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place among values) of block values that are neighbours: by probing, or by comparing where that is less."""
        masks = _neighbours(self.errors)
        if len(values) <= len(masks):
            return np.nonzero(np.bitwise_count(queries[:, None] ^ values) <= self.errors)
        wanted = queries[:, None] ^ masks
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        q, m = np.nonzero(values[at] == wanted)
        return q, at[q, m]

    def search(self, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, print, distance) for every pair within the radius."""
        out: list[tuple[int, int, int]] = []
        for start in range(0, len(queries), 256):
            part, pairs = queries[start : start + 256], []
            for k, (values, first, order) in enumerate(self.tables):
                distinct, back = np.unique(part[:, k], return_inverse=True)
                d, v = self._met(distinct, values)
                for one, place in zip(d.tolist(), v.tolist(), strict=True):
                    owners, asked = order[first[place] : first[place + 1]], np.flatnonzero(back == one)
                    pairs.append(np.repeat(asked, len(owners)) * len(self.prints) + np.tile(owners, len(asked)))
            if pairs:
                q, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
                distance = np.bitwise_count(part[q] ^ self.prints[i]).sum(axis=1)
                ok = distance <= self.radius
                out += zip((q[ok] + start).tolist(), i[ok].tolist(), distance[ok].tolist(), strict=True)
        return out


class ItemIndex:
    """Items of one block: shingles, fingerprints and one Hamming index per item length."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, radius: int):
        self.ids, self.words, self.bags = [], [], []
        for (item, _), words in zip(items, _words([t for _, t in items]), strict=True):
            if len(words):
                self.ids.append(item)
                self.words.append(len(words))
                self.bags.append(shingles(words, width))
        owner = np.repeat(np.arange(len(self.ids)), [len(b) for b in self.bags])
        token = np.concatenate(self.bags) if self.bags else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.vocabulary, first = np.unique(token[order], return_index=True)
        self.owners = np.split(owner[order], first[1:]) if len(token) else []
        self.by_length: dict[int, list[int]] = {}
        for i, n in enumerate(self.words):
            self.by_length.setdefault(n, []).append(i)
        self.index = {n: HammingIndex(np.array([simhash(self.bags[i]) for i in group]), radius) for n, group in self.by_length.items()}
        self.counts = [Counter(b.tolist()) for b in self.bags]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _window_prints(tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of `size` tokens at sorted starts."""
    low, high = int(starts[0]), int(min(starts[-1] + size, len(tokens)))
    if high - low > 8 * len(starts) + 4 * size:  # far apart in a long text
        return np.array([simhash(tokens[s : s + size]) for s in starts])
    sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_votes(tokens[low:high]), axis=0)))
    return _prints(sums[np.minimum(starts + size, high) - low] - sums[starts - low])


def _matches(index: ItemIndex, words: np.ndarray, tokens: np.ndarray, hits: np.ndarray, width: int, least: float) -> list[tuple[int, float, int, int]]:
    """(item number, similarity, first word, distance): the most similar window of each item, the first among equals."""
    at = np.searchsorted(index.vocabulary, tokens[hits])
    by_length: dict[int, list[np.ndarray]] = {}
    for p, v in zip(hits.tolist(), at.tolist(), strict=True):
        for n in {index.words[i] for i in index.owners[v]}:
            by_length.setdefault(n, []).append(np.arange(max(0, p - max(0, n - width)), p + 1))
    best: dict[int, tuple[float, int, int]] = {}
    for n, parts in by_length.items():
        size = max(1, n - width + 1)  # shingles of an item-sized window
        starts = np.unique(np.minimum(np.unique(np.concatenate(parts)), max(0, len(tokens) - size)))
        prints = np.concatenate([_window_prints(tokens, starts[k : k + 4096], size) for k in range(0, len(starts), 4096)])
        for q, k, distance in sorted(index.index[n].search(prints)):
            i, s = index.by_length[n][k], int(starts[q])
            like = weighted_jaccard(index.counts[i], Counter(tokens[s : s + size].tolist()))
            if like >= least and (i not in best or like > best[i][0]):
                best[i] = (like, s, distance)
    return [(i, *x) for i, x in best.items()]


class _Finder:
    """Items of one block, looked for in texts. Items of fewer words than the width have shingles of all their words."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, radius: int, least: float):
        self.least = least
        by_width: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in zip(items, _words([t for _, t in items]), strict=True):
            if len(words):
                by_width.setdefault(min(width, len(words)), []).append(item)
        self.parts = []
        for k, some in sorted(by_width.items()):
            index, bits = ItemIndex(some, k, radius), np.zeros(1 << 22, bool)
            bits[(index.vocabulary >> np.uint64(42)).astype(np.int64)] = True
            self.parts.append((k, index, bits))

    def find(self, texts: list[str | None]) -> Iterator[list[tuple[int, float, int, int]]]:
        """(item_id, similarity, start_word, hamming) rows of each text."""
        for words in _words(texts):
            out = []
            for width, index, bits in self.parts:
                tokens, vocabulary = shingles(words, width), index.vocabulary
                hits = np.flatnonzero(bits[(tokens >> np.uint64(42)).astype(np.int64)])
                if len(hits):
                    at = np.searchsorted(vocabulary, tokens[hits])
                    at[at == len(vocabulary)] = 0
                    hits = hits[vocabulary[at] == tokens[hits]]
                if len(hits):
                    out += [(index.ids[i], like, s, d) for i, like, s, d in _matches(index, words, tokens, hits, width, self.least)]
            yield out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Broadcasts of about block_bytes of items each; an item is never cut."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        block = sorted({(r["item_id"], r["text"]) for r in part.collect()}, key=lambda x: (x[0] is None, x))
        yield benchmark.sparkSession.sparkContext.broadcast(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, radius: int = 39, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, hamming): each item found in each document, at its best window.

    Words are runs of letters and digits, lower-cased. A window has as many words as the item (the whole text, if
    shorter). Null and blank texts and items match nothing; an item of fewer than `width` words is found where all its
    words stand in a row. Repeated document rows give a row each, null ids stay null; of repeated items one counts. At
    similarity 0.8 fingerprints differ in some 20 of 128 bits, and hardly ever in more than 39. Documents are read once for
    each block of items (block_bytes of benchmark text).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for sent in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = _Finder(sent.value, width, radius, least)
            for batch in small(batches):
                ids = batch.column("doc_id").to_pylist()
                out = [(doc, *row) for doc, rows in zip(ids, finder.find(batch.column("text").to_pylist()), strict=True) for row in rows]
                if out:
                    cols = list(zip(*out, strict=True))
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "hamming"])

        rows = texts.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, hamming int")
        found = rows if found is None else found.unionByName(rows)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, radius: int = 39, block_bytes: int = 16_000_000, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, in which no item is found: one pass for each block of items, without a shuffle."""
    schema = docs.schema
    for sent in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = _Finder(sent.value, width, radius, least)
            for batch in small(batches):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not rows for rows in finder.find(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
