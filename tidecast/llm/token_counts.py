"""Token counts under a unigram model: dynamic programming shared over a trie of distinct pre-tokens.

Each worker keeps a trie of the pre-tokens it has met. A node stands for a prefix and keeps the best forward score there,
its token count, and the pieces that may still go on from earlier prefixes; so a prefix is scored once however many
pre-tokens share it, and a pre-token's end keeps its count. Pieces are those of a public vocabulary; their probabilities
are estimated from all documents, as the frequencies of the vocabulary's own segmentation. Counting shuffles nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small, without_gc

MARK = "▁"
#: Bounds of what a worker remembers; beyond them it starts afresh, with equal results.
_MAX_NODES = 1_200_000
_MAX_STATES = 200_000
_MAX_TERMINALS = 600_000
#: Prefixes longer than this are scored, but not kept.
_MAX_DEPTH = 64


class _State:
    """Pieces that may go on after a prefix: (score before the piece, tokens before it, place in the piece trie), scores
    and tokens relative to the prefix's own; and what has been worked out about the next characters."""

    __slots__ = ("open", "after")

    def __init__(self, opened: tuple):
        self.open = opened
        self.after: dict[str, tuple[_State, int, int]] = {}


class UnigramCounter:
    """Counts of the best segmentation of '▁' + pre-token into pieces.

    scores: natural log probability by piece, kept as whole millionths. A character that no piece covers costs its UTF-8
    bytes, each half as likely as the least likely piece. Among equal scores the fewer tokens win.

    What a character adds to a prefix depends on the pieces still open there, relative to the prefix's own score, and few
    such states occur; so a step that was worked out once is looked up wherever the trie grows by it again.
    """

    def __init__(self, scores: dict[str, float]):
        whole = {p: round(x * 1e6) for p, x in scores.items()}
        self.byte = min(whole.values(), default=0) - round(math.log(2) * 1e6)
        self.pieces: dict = {}
        for piece, score in whole.items():
            at = self.pieces
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self.counts: dict[str, int] = {}
        self.nodes = 0
        self.clear()

    def clear(self) -> None:
        """A new trie; the states worked out stay, unless they are many."""
        if self.nodes == 0 or len(self.states) > _MAX_STATES:
            self.states: dict[tuple, _State] = {}
        self.nodes = 1
        state, best, count = self._after(_State(()), MARK)
        self.root = [None, state, best, count]  # children, state, forward score, tokens

    def _after(self, state: _State, c: str) -> tuple[_State, int, int]:
        """(state, score, tokens) that one more character leads to and adds."""
        size = len(c.encode("utf-8", "surrogatepass"))
        best, count, opened = self.byte * size, size, []
        for before, tokens, place in (*state.open, (0, 0, self.pieces)):
            place = place.get(c)
            if place is None:
                continue
            score = place.get("")
            if score is None or len(place) > 1:
                opened.append((before, tokens, place))
            if score is not None:
                score += before
                if score > best or score == best and tokens + 1 < count:
                    best, count = score, tokens + 1
        key = tuple((b - best, t - count, id(place)) for b, t, place in opened)
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = _State(tuple((b - best, t - count, place) for b, t, place in opened))
        state.after[c] = found = (following, best, count)
        return found

    def learn(self, words: set[str]) -> None:
        """Store the counts of new pre-tokens."""
        after = self._after
        for word in words:
            if self.nodes > _MAX_NODES or len(self.states) > _MAX_STATES:
                self.clear()
            node = self.root
            for depth, c in enumerate(word):
                kids = node[0]
                if kids is None:
                    kids = node[0] = {}
                child = kids.get(c)
                if child is None:
                    state, best, count = node[1].after.get(c) or after(node[1], c)
                    child = [None, state, node[2] + best, node[3] + count]
                    if depth < _MAX_DEPTH:
                        kids[c] = child
                        self.nodes += 1
                node = child
            self.counts[word] = node[3]

    def totals(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        split = [t.split() if t else [] for t in texts]
        words = set().union(*split) if split else set()
        if len(self.counts) + len(words) > _MAX_TERMINALS:
            self.counts.clear()
        self.learn(words - self.counts.keys())
        get = self.counts.__getitem__
        for w in split:
            yield sum(map(get, w)), len(w)
        for word in words:
            if len(word) > _MAX_DEPTH:
                del self.counts[word]


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _usable(model) -> list[int]:
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [i for i in range(model.vocab_size()) if not skip(i)]


def learn_piece_scores(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> dict[str, float]:
    """Natural log probability of each piece: its share, with one half added, of the vocabulary's own segmentation of all
    texts. What is shuffled and collected is bounded by the vocabulary (and, before combining, by the number of tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = _vocabulary(vocabulary_path), Counter()
        found = np.zeros(model.vocab_size(), np.int64)

        def count() -> None:
            ids = model.encode(list(words), num_threads=1)
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, ids), np.int64, len(ids)))
            np.add.at(found, np.fromiter(chain.from_iterable(ids), np.int64, len(times)), times)
            words.clear()

        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(text.split())
            if len(words) > _MAX_TERMINALS // 4:
                count()
        if words:
            count()
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], names=["piece", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {r["piece"]: r["n"] for r in texts.mapInArrow(lambda batches: without_gc(run(batches)), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    model = _vocabulary(vocabulary_path)
    usable = _usable(model)
    total = sum(counts.get(i, 0) + 0.5 for i in usable)
    scores: dict[str, float] = {}
    for i in usable:
        scores.setdefault(model.id_to_piece(i), math.log((counts.get(i, 0) + 0.5) / total))
    return scores


def count_tokens(docs: DataFrame, vocabulary_path: str, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_bytes) for every row; null and blank texts have no token.

    scores: by piece; learnt from docs where absent. Repeated rows give equal rows, null ids stay null.
    """
    scores = learn_piece_scores(docs, vocabulary_path, text_col) if scores is None else scores
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(sent.value)
        yield from without_gc(counted(counter, batches))

    def counted(counter: UnigramCounter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            found = list(counter.totals(texts))
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_bytes long")
