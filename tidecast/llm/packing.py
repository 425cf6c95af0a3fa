"""Best-fit sequence packing with Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most `capacity` rows) reaches the driver: the plan is made of bin patterns with a
multiplicity, so it is as small for a billion documents as for a thousand. Pieces then find their bin by their rank among
the pieces of the same length; ranks are counted per (length, salt), so a length shared by a third of all pieces is dealt
over many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialise
from .batches import small

# Letters and numbers of the Latin blocks up to U+017E, lower-cased, as the tokenizer's own splitting rule sees them.
_LETTER = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_NUMBER = "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_LATIN = re.compile(r"[\t-\r -~ -įı-ž]*\Z")
_MAX_WORDS = 200_000


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of a word-end BPE tokenizer file as little-endian uint32 bytes, with a bounded memory of words.

    Texts in the Latin blocks are cut into words by the file's rule and looked up; any other text, and any that spells a
    special token, goes through the tokenizer whole. Both ways give the same ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        ids = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
        if len(self.known) >= _MAX_WORDS:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _LATIN.match(text) and not any(s in text for s in self.specials):
            get, word = self.known.get, self._word
            return b"".join([get(w) or word(w) for w in _SPLIT.findall(text.lower())])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut only beyond capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = tok.ids(text or "") + tail
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, p, p * capacity, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction on a histogram: bins that some optimal packing has, and the lengths left.

    In decreasing length j: a full piece, or one that nothing fits beside, is fixed alone; j with k = capacity - j is
    fixed (no other partner set dominates a bin without room left); j with its largest fitting partner k is fixed where
    two pieces cannot fit beside j, or where three cannot and k is at least the largest fitting sum of two others.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[Pattern] = []
    sizes = sorted(left)

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for k in lengths:
            left[k] -= times
            if not left[k]:
                del left[k]
                sizes.remove(k)

    for j in sorted(left, reverse=True):
        if not left.get(j):
            continue
        if j == capacity:
            take((j,), left[j])
            continue
        partner = capacity - j
        times = left[j] // 2 if partner == j else min(left[j], left.get(partner, 0))
        if times:
            take((j, partner), times)
        while left.get(j):
            room = capacity - j
            others = {**left, j: left[j] - 1}
            usable = [k for k in sizes if k <= room and others[k] > 0]
            if not usable:
                take((j,), left[j])
                continue
            best = usable[-1]
            smallest = usable[0] + (usable[0] if others[usable[0]] > 1 else usable[1] if len(usable) > 1 else room + 1)
            if smallest <= room:  # two fit beside j: find their largest sum
                top, hi = 0, len(usable) - 1
                for lo, a in enumerate(usable):
                    while hi >= lo and (a + usable[hi] > room or hi == lo and others[a] < 2):
                        hi -= 1
                    if hi < lo:
                        break
                    top = max(top, a + usable[hi])
                least, short = 0, 3
                for a in usable:  # the three smallest
                    n = min(short, others[a])
                    least, short = least + n * a, short - n
                    if not short:
                        break
                if top > best or not short and least <= room:
                    break
            if best == j:
                take((j, j), left[j] // 2)
            else:
                take((j, best), min(left[j], left[best]))  # fewer other pieces only make it dominate more
    return fixed, left


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths, times) that hold every piece: dominance reduction, then best fit in decreasing length."""
    fixed, left = reduce_by_dominance(counts, capacity)
    done: list[Pattern] = list(fixed)
    rooms: list[int] = []
    open_bins: dict[int, list[list]] = {}

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        if room == 0:
            done.append((lengths, times))
            return
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append([lengths, times])

    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = open_bins[room][-1]
                times = min(count, group[1])
                group[1] -= times
                if not group[1]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.remove(room)
                put((*group[0], size), times)
                count -= times
                continue
            each = capacity // size
            if count >= each:
                put((size,) * each, count // each)
                count %= each
            else:
                put((size,) * count, 1)
                count = 0
    return done + [(lengths, times) for groups in open_bins.values() for lengths, times in groups]


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): ranks of a length in plan order."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for k in lengths:
            first = next_rank.get(k, 0)
            out.append((k, first, times, sequence, offset))
            next_rank[k] = first + times
            offset += k
        sequence += times
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null texts are empty and give one piece, end_id alone. Rows with equal ids are packed as they come.
    """
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "first", "times", "sequence", "at")])
    slots = spark.createDataFrame(_slots(plan_bins(counts, capacity)), schema)  # bounded by the number of distinct lengths
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("k")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))
