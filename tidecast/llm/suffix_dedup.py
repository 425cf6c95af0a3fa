"""Suffix-array deduplication over a run-length index: bytes covered by a `length`-byte string that occurs elsewhere go.

Plan. (1) Phrases: in every `length`-byte string the least hash of its k-grams is chosen as anchor (the last among
equals), so equal strings choose the same place. Maximal runs of strings with the same anchor are a phrase. (2) Dictionary:
anchors met once are dropped, equal phrases become one entry with its number of copies. (3) Entries are dealt by anchor.
Each shard sorts the suffixes of its entries, keeps the Burrows-Wheeler transform as runs (an entry's copies only lengthen
them) with suffix positions sampled at run ends, and streams matching statistics: inside a run the longest match shrinks
by one per step, so lengths are measured at samples only. Positions whose longest match with another suffix, or another
copy of their own, reaches `length` are marked. (4) An anchor with too many different phrases for one shard is dealt by
the bytes that follow as well: its phrases are cut into pieces whose strings share more bytes, down to single strings,
and the pieces get a dictionary and shards of their own. (5) Marks go from entries to their copies, are gathered by
document and applied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, prefix_sums, span_hashes
from .batches import small
from .store import materialise, release

#: Bytes of an anchor: long enough that few unrelated texts share one, short beside the strings.
_K = 40


def _sliding_last_min(values: np.ndarray, width: int) -> np.ndarray:
    """For every start i: place of the last least value among values[i : i + width]."""
    n = len(values) - width + 1
    # least by doubling; place kept so that among equal values the later wins
    best = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(values[b] <= values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] <= values[a], b, a)


def windows_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, window hash, first start, strings) of each run of strings with the same anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_sums(data)
    at = np.arange(len(data) - _K + 1)
    grams = span_hashes(sums, at, at + _K)
    chosen = _sliding_last_min(grams, length - _K + 1)
    cut = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(chosen) - 1]))
    place = chosen[first]
    whole = mix(span_hashes(sums, first, last + length) + (place - first).astype(np.uint64))
    return grams[place], whole, first, last - first + 1


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _frame(parts: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples of arrays, one tuple a part, as one batch."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": (np.int64, pa.int64()), "int": (np.int32, pa.int32())}
    columns = [np.concatenate(x).astype(kinds[t][0]) for x, (_, t) in zip(zip(*parts, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t][1]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


_PHRASES = "id long, sig int, anchor long, whole long, first int, strings int"


def _phrases(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts, size = [], 0
            for doc, sig, text in zip(*(batch.column(c).to_pylist() for c in ("id", "sig", "text")), strict=True):
                anchor, whole, first, strings = windows_of(np.frombuffer(_raw(text), np.uint8), length)
                if n := len(anchor):
                    parts.append((np.full(n, doc), np.full(n, sig), anchor.view(np.int64), whole.view(np.int64), first, strings))
                    size += n
                if size > 200_000:
                    yield _frame(parts, _PHRASES)
                    parts, size = [], 0
            if parts:
                yield _frame(parts, _PHRASES)

    return run


def _sorted_suffixes(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Suffix array of an integer text; and, for growing depths, a class of each position by that many symbols.

    left: by position, symbols up to the close of its entry, which is included and is a symbol found nowhere inside one.
    Suffixes are compared up to there, and ties go by position, as if every entry closed with a symbol of its own. The
    classes of two suffixes are equal if their first `depth` symbols are, up to a close. After the first sort, by as many
    symbols as 62 bits hold, only suffixes that still tie are sorted again, each tie within its own places, by as many
    ranks as 62 bits hold.
    """
    n = len(text)
    used = np.zeros(int(text.max()) + 1, bool)
    used[text] = True
    blocks = np.cumsum(used)[text]  # 0: beyond the close
    bits = int(used.sum()).bit_length()
    depth = 1
    while depth * 2 * bits <= 62 and depth < n:
        longer = blocks << (depth * bits)
        longer[: n - depth] |= blocks[depth:]
        blocks = longer
        depth *= 2
    over = np.flatnonzero(left < depth)
    beyond = (depth - left[over]) * bits
    blocks[over] = blocks[over] >> beyond << beyond
    classes = [(text, 1), (blocks, depth)]
    order = np.argsort(blocks)
    rank = np.empty(n, np.int64)
    bits = n.bit_length()
    parts = max(2, min(4, 62 // bits))
    places, suffixes, key = np.arange(n), order, blocks[order]
    while True:
        first = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, len(first)))
        rank[suffixes] = np.repeat(places[head], size)
        tied = np.repeat(size > 1, size)
        places, suffixes = places[tied], suffixes[tied]
        if not len(places):
            return order, classes
        if depth > classes[-1][1]:
            classes.append((rank.copy(), depth))
        key, inside = rank[suffixes], left[suffixes]
        for at in range(depth, depth * parts, depth):
            key = (key << bits) | np.where(inside > at, rank[np.minimum(suffixes + at, n - 1)], suffixes)
        turn = np.argsort(key)
        suffixes, key = suffixes[turn], key[turn]
        order[places] = suffixes
        depth *= parts


def _left(n: int, ends: np.ndarray) -> np.ndarray:
    return np.repeat(ends + 1, np.diff(ends, prepend=-1)) - np.arange(n)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a text whose last symbol is found nowhere else in it."""
    return _sorted_suffixes(text, _left(len(text), np.array([len(text) - 1])))[0]


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of a text, with suffix positions sampled at both ends of every run.

    ends: where the entries close, ascending, with symbols found only there; without it the text is one entry. Matches end
    with the entry, and as each close counts as a symbol of its own, what stands after one is a run of its own.
    copies: by position, how many equal copies of its entry the text stands for. Copies are neighbours in suffix order and
    have the same symbol before them, so they add to a run's length and to nothing else.
    """

    def __init__(self, text: np.ndarray, copies: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.n, self.copies = len(text), copies
        ends = np.array([self.n - 1]) if ends is None else ends
        self.left = _left(self.n, ends)
        order, self.classes = _sorted_suffixes(text, self.left)
        symbols = text.copy()
        symbols[ends] = -1 - np.arange(len(ends))
        before = symbols[order - 1]  # order 0 wraps to the closing symbol
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        tails = np.concatenate((heads[1:] - 1, [len(order) - 1]))
        self.run_symbols = text[order[heads] - 1]
        self.run_lengths = tails - heads + 1 if copies is None else np.add.reduceat(copies[order], heads)
        self.head_at, self.tail_at = order[heads], order[tails]
        self.above = order[heads[1:] - 1]  # the suffix just above each run but the first: the last of the run before
        self.below = order[tails[:-1] + 1]

    def matching_statistics(self, cap: int, least: int = 0) -> np.ndarray:
        """By position: length, up to about cap, of the longest match of its suffix with any other suffix; lengths below
        `least` may come out shorter.

        Neighbours in suffix order that stand in one run are preceded by the same symbol, so their match is one shorter
        than at the position before, and ends at the same place; matches never end before those of earlier positions.
        So only the samples at run ends are measured. A copy matches to the end of the entry.
        """
        reach = np.zeros(self.n, np.int64)
        for places, others in ((self.head_at[1:], self.above), (self.tail_at[:-1], self.below)):
            places, lengths = self._common(places, others, cap, least)
            reach[places] = np.maximum(reach[places], places + lengths)
        at = np.arange(self.n)
        if self.copies is not None:
            reach = np.where(self.copies > 1, at + self.left - 1, reach)
        return np.maximum(np.maximum.accumulate(reach) - at, 0)

    def _common(self, a: np.ndarray, b: np.ndarray, cap: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a, and common prefix lengths with b, up to about cap, of those that reach `least`: by classes of many
        symbols, then of fewer."""
        most = np.minimum(self.left[a], self.left[b]) - 1
        live = np.flatnonzero(most >= least)
        a, b, most = a[live], b[live], most[live]
        if least:
            symbols, step = next(x for x in reversed(self.classes) if x[1] <= least)
            for at in [*range(0, least - step, step), least - step]:
                same = symbols[a + at] == symbols[b + at]
                a, b, most = a[same], b[same], most[same]
        out = np.full(len(a), least)
        for symbols, step in reversed(self.classes):
            live = np.arange(len(a))
            while len(live):
                live = live[out[live] < np.minimum(most[live], cap)]
                live = live[symbols[a[live] + out[live]] == symbols[b[live] + out[live]]]
                out[live] += step
        return a, np.minimum(out, most)


def repeated_runs(content: np.ndarray, sizes: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(entry, first, last): runs of starts of `length`-byte strings that also start elsewhere in these entries.

    content: bytes of all entries, one after the other; sizes and copies by entry.
    """
    number = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(len(number), np.int64)
    inside = np.ones(len(number), bool)
    inside[ends] = False
    text[inside] = content.astype(np.int64) + 1
    index = RunLengthIndex(text, copies[number], ends)
    found = np.flatnonzero(index.matching_statistics(int(sizes.max(initial=0)), length) >= length)
    entry = number[found]
    new = np.concatenate(([True], (np.diff(found) > 1) | (np.diff(entry) > 0)))[: len(found)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(found))[: len(head)] - 1
    starts = ends - sizes
    return entry[head], found[head] - starts[entry[head]], found[tail] - starts[entry[tail]]


_MARKS = "level int, anchor long, whole long, lo int, hi int"


def _mark(length: int, symbols: int = 60_000):
    """Shards of entries -> runs of repeated starts in each, through one index for each `symbols` bytes of whole shards."""

    def marks(held: pa.Table) -> pa.RecordBatch:
        content = held.column("content").combine_chunks()
        content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
        sizes = np.diff(np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1]).astype(np.int64)
        whole = np.frombuffer(b"".join(content.to_pylist()), np.uint8)
        entry, lo, hi = repeated_runs(whole, sizes, held.column("times").to_numpy(), length)
        named = [held.column(c).to_numpy()[entry] for c in ("level", "anchor", "whole")]
        return _frame([(*named, lo, hi)], _MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in small(batches, 64):
            held.append(batch)
            size += batch.column("content").nbytes
            if size > symbols:  # whole shards only
                table = pa.Table.from_batches(held)
                turns = np.flatnonzero(np.diff(table.column("anchor").to_numpy()))
                if len(turns):
                    cut = int(turns[-1]) + 1
                    yield marks(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column("content").nbytes for x in held)
        if held:
            yield marks(pa.Table.from_batches(held))

    return run


def _cut_out(length: int):
    """(text, wanted entries) -> rows (level, anchor, whole, times, content): the bytes of each entry."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple] = []
            for text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "wanted")), strict=True):
                raw = _raw(text)
                out += [(w["level"], w["anchor"], w["whole"], w["times"], raw[w["first"] : w["first"] + w["strings"] - 1 + length]) for w in wanted]
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["level", "anchor", "whole", "times", "content"])

    return run


_PIECES = "id long, sig int, anchor long, whole long, first int, strings int, times long, of_anchor long, of_whole long, shift int"


def _pieces(length: int, width: int):
    """(text, wanted entries) -> pieces of up to `width` strings each, keyed by the bytes that all strings of a piece share.

    Strings are numbered by their distance to the anchor, so equal strings come into pieces of the same number and key.
    """

    def cut(sums: np.ndarray, w: dict) -> tuple[np.ndarray, ...]:
        first, last = w["first"], w["first"] + w["strings"] - 1
        if width == 1:
            at = np.arange(first, last + 1)
            string = span_hashes(sums, at, at + length)
            return string, string, at, np.ones(len(at), np.int64)
        at = np.arange(first, first + length - _K + 1)
        grams = span_hashes(sums, at, at + _K)
        place = int(at[np.flatnonzero(grams == grams.min())[-1]])
        cell = np.arange((place - last) // width, (place - first) // width + 1)
        low, high = np.maximum(first, place - cell * width - width + 1), np.minimum(last, place - cell * width)
        shared = span_hashes(sums, place - cell * width, place - cell * width - width + 1 + length)
        return mix(shared + cell.astype(np.uint64)), mix(span_hashes(sums, low, high + length) + (place - low).astype(np.uint64)), low, high - low + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            parts = []
            for doc, sig, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "sig", "text", "wanted")), strict=True):
                sums = prefix_sums(np.frombuffer(_raw(text), np.uint8))
                for w in wanted:
                    key, whole, first, strings = cut(sums, w)
                    same = lambda x, n=len(key): np.full(n, x)
                    parts.append((same(doc), same(sig), key.view(np.int64), whole.view(np.int64), first, strings, same(w["times"]), same(w["anchor"]), same(w["whole"]), first - w["first"]))
            if parts:
                yield _frame(parts, _PIECES)

    return run


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for doc, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                raw = _raw(text)
                spans: list[list[int]] = []
                for first, last in sorted((m["first"], m["last"]) for m in marks or ()):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, crowd: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): bytes in a repeated `length`-byte string are removed.

    Texts are UTF-8 bytes, null is empty; strings never cross documents, may overlap, and are judged on the input. Every
    row of docs is a document, rows with a null or repeated id too; repeated rows repeat each other's strings. `crowd`
    bounds the different entries of a shard, beyond which an anchor is dealt by more bytes; results do not depend on it.
    """
    if length < 2 * _K:
        raise ValueError(f"length must be at least {2 * _K}")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.hash(F.col("doc_id").isNull(), "text").alias("sig"), "text")
    spent: list[str] = []
    # Each side of a join by anchor is a table of its own, so that a crowded anchor's rows can be split between tasks;
    # joined by merging at every size.
    phrases = materialise(docs.select("id", "sig", "text").mapInArrow(_phrases(length), _PHRASES), spent)
    met = materialise(phrases.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), spent)
    again = materialise(phrases.join(met.hint("merge"), "anchor", "left_semi"))
    for path in spent:
        release(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dictionary(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "whole").agg(F.sum("times").alias("times"), F.min(F.struct("id", "sig", "first", "strings")).alias("one"))

    def with_fan(entries: DataFrame, level: int) -> DataFrame:
        fans = entries.groupBy("anchor").agg(F.count("*").alias("fan"), F.sum("times").alias("all")).filter("all > 1").select("anchor", "fan")
        return entries.join(fans.hint("merge"), "anchor").select(F.lit(level).alias("level"), "anchor", "whole", "times", "one.*", "fan")

    def with_text(rows: DataFrame, name: str, columns: list[str], how: str = "inner") -> DataFrame:
        """Texts beside the list of their rows; the texts are shuffled alike, so once, wherever this is used."""
        lists = rows.groupBy("id", "sig").agg(F.collect_list(F.struct(*columns)).alias(name))
        return docs.join(lists.hint("merge"), ["id", "sig"], how).select("doc_id", "id", "sig", "text", name)

    wanted = ["level", "anchor", "whole", "times", "first", "strings"]
    entries = with_fan(materialise(dictionary(again.withColumn("times", F.lit(1).cast("long")))), 0)
    sharded = entries.filter(F.col("fan") <= crowd)
    places = None  # of pieces in phrases of level 0
    for level, width in enumerate((max(2, length // 10), 1), 1):
        pieces = with_text(entries.filter(F.col("fan") > crowd), "wanted", wanted).mapInArrow(_pieces(length, width), _PIECES)
        entries = with_fan(dictionary(pieces), level)
        sharded = sharded.unionByName(entries.filter(F.col("fan") <= crowd) if width > 1 else entries)
        part = pieces.select(F.lit(level).alias("level"), "anchor", "whole", "of_anchor", "of_whole", "shift")
        if places is None:
            places = part
        else:
            above = pieces_above.select(F.col("anchor").alias("of_anchor"), F.col("whole").alias("of_whole"), F.col("of_anchor").alias("root_anchor"), F.col("of_whole").alias("root_whole"), F.col("shift").alias("more"))
            below = part.join(above.hint("merge"), ["of_anchor", "of_whole"]).select("level", "anchor", "whole", F.col("root_anchor").alias("of_anchor"), F.col("root_whole").alias("of_whole"), (F.col("shift") + F.col("more")).alias("shift"))
            places = places.unionByName(below)
        pieces_above = pieces
    contents = with_text(sharded, "wanted", wanted).mapInArrow(_cut_out(length), "level int, anchor long, whole long, times long, content binary")
    found = contents.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_mark(length), _MARKS)
    shift = F.coalesce("shift", F.lit(0))
    placed = found.join(places.hint("merge"), ["level", "anchor", "whole"], "left")
    placed = placed.select(F.coalesce("of_anchor", "anchor").alias("anchor"), F.coalesce("of_whole", "whole").alias("whole"), (shift + F.col("lo")).alias("lo"), (shift + F.col("hi")).alias("hi"))
    marks = again.join(placed.hint("merge"), ["anchor", "whole"]).select("id", "sig", (F.col("first") + F.col("lo")).alias("first"), (F.col("first") + F.col("hi")).alias("last"))
    return with_text(marks, "marks", ["first", "last"], "left").mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
