"""N-gram Jaccard join by T-occurrence search (DivideSkip): every pair of documents whose shingle sets reach a similarity.

Plan. (1) Equal shingle sets become one class, so copies cost one row. (2) Tokens are ordered rare first: tokens that
repeat inside a task are counted over all documents and the `hot_tokens` most frequent go last; the order never changes
the result, only the work. (3) Classes of like size that share any of their n-T+1 first tokens meet in the shard of the least class
sharing it, first as sketches of one byte for a few tokens, which rule out most partners for certain; those that may
have one meet again with their texts. Shards above `block` classes are dealt as pairs of blocks. (4) Inside a shard,
inverted lists are searched with DivideSkip: short lists are merged, long ones probed, and documents that reach the
required overlap T are linked. (5) Links are joined into components by DataFrame star contraction. Components need a
spanning forest of the links only; where links are asked for, every pair is searched and counted once, by class.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .batches import small
from .hashing import mix, shingles, word_hashes
from .store import materialise, release

_FLUSH = 1_000_000


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for words in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        yield np.unique(shingles(words, width))


def _needed(n: int, percent: int) -> int:
    """Least overlap T that a set of n tokens has with any partner: 100*i >= percent*u and u >= n."""
    return -(-percent * n // 100)


def _base(percent: int) -> float:
    """Ratio of size classes: no less than 100/percent, so that a set's smallest partner is at most one class below."""
    return max(2.5, 100 / percent)


def _size_class(n: int, percent: int) -> int:
    """Sets meet only within a class of sizes; one whose smallest partner may be a class below enters both."""
    return int(math.log(n) / math.log(_base(percent)) + 1e-9)


def _class_of(tokens: np.ndarray) -> int:
    return (int(mix(tokens + np.uint64(11)).sum(dtype=np.uint64)) if len(tokens) else 0) - (1 << 63)


def _sketch(tokens: np.ndarray, size: int, percent: int) -> bytes:
    """One byte for each cell of the token range, the number of cells set by the size class: 2.5 times the tokens in which
    linked sets of the largest size of the class may differ. Two sets differ in at least as many tokens as their sketches
    differ in cells."""
    cells = int(5 * (100 - percent) / (100 + percent) * _base(percent) ** (size + 1)) + 8
    edges = (np.arange(1, cells, dtype=np.float64) / cells * 2.0**64).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens))))
    cuts = np.concatenate(([0], np.searchsorted(tokens, edges), [len(tokens)]))
    return (mix(np.diff(sums[cuts])) >> np.uint64(56)).astype(np.uint8).tobytes()


_SCAN = ["doc_id", "id", "sig", "n", "c1", "token", "cnt", "own_sketch", "below_sketch"]


def _scan(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count >= 4], count[count >= 4]
            m = len(token)
            none, blank = pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(token.view(np.int64)), pa.array(count.astype(np.int64)), blank, blank], names=_SCAN)

        for batch in small(batches):
            ids, ns, c1, own, below = [batch.column(c) for c in ("doc_id", "id", "sig")], [], [], [], []
            for tokens in _sets(batch.column("text").to_pylist(), width):
                n = len(tokens)
                ns.append(n), c1.append(_class_of(tokens))
                size = _size_class(n, percent) if n else 0
                own.append(_sketch(tokens, size, percent) if n else None)
                below.append(_sketch(tokens, size - 1, percent) if n and _size_class(_needed(n, percent), percent) < size else None)
                held.append(tokens)
                total += n
                if total >= _FLUSH:
                    yield counted()
                    held, total = [], 0
            m = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([*ids, pa.array(ns, pa.int64()), pa.array(c1, pa.int64()), m, m, pa.array(own, pa.binary()), pa.array(below, pa.binary())], names=_SCAN)
        if held:
            yield counted()

    return run


def _ordered(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens rare first: by hash, then hot ones by how often they occur."""
    if not len(hot):
        return tokens
    at = np.searchsorted(hot, tokens)
    at[at == len(hot)] = 0
    weight = np.where(hot[at] == tokens, rank[at], 0)
    return tokens[np.argsort(weight, kind="stable")]


def _prefixes(width: int, percent: int, hot: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in a task are sent once
        for batch in small(batches):
            keys, classes, levels = [], [], []
            for tokens in _sets(batch.column("text").to_pylist(), width):
                n, own = len(tokens), _class_of(tokens)
                if n and own not in seen:
                    seen.add(own)
                    first = _ordered(tokens, hot, rank)[: n - _needed(n, percent) + 1]
                    for size in {_size_class(n, percent), _size_class(_needed(n, percent), percent)}:
                        keys.append(mix(first + np.uint64(size * 0xA24BAED4963EE407 % (1 << 64))))
                        classes.append(np.full(len(first), own, np.int64))
                        levels.append(np.full(len(first), size, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(levels))], names=["token", "c1", "size"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _probe(merged: list[tuple[int, int]], longs: list[array], n: int, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Candidates with their hits in all lists; those that cannot reach the overlap are left out."""
    at = np.array([d for d, _ in merged], np.int64)
    hits = np.array([h for _, h in merged], np.int64)
    overlap = -(-percent * (n + sizes[at]) // (100 + percent))
    for k, x in enumerate(longs):
        if k % 16 == 0:
            able = hits + (len(longs) - k) >= overlap
            at, hits, overlap = at[able], hits[able], overlap[able]
            if not len(at):
                break
        held = np.frombuffer(x, np.int64)
        p = np.searchsorted(held, at)
        p[p == len(held)] = 0
        hits += held[p] == at
    return list(zip(at.tolist(), hits.tolist(), strict=True))


def divide_skip(sets: list[np.ndarray], percent: int, forest: _Forest | None = None, cross: np.ndarray | None = None, sizes: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of sorted token arrays whose Jaccard similarity is at least percent/100.

    With a forest, pairs already connected are not probed again, so the pairs yielded are a spanning forest of the links.
    cross: labels; if given, only pairs with different labels are searched. sizes: full sizes, where tokens that no other
    set holds were left out of `sets`.
    """
    sizes = sizes or [len(x) for x in sets]
    order = sorted(range(len(sets)), key=lambda i: sizes[i])
    lists: dict[int, array] = {}
    ordered = np.array([sizes[i] for i in order], np.int64)
    for at, i in enumerate(order):
        mine, n = sets[i].tolist(), sizes[i]
        if not n:
            continue
        need = _needed(n, percent)
        # inverted lists so far hold sets no larger than this one, by position in `order`; too small ones cannot reach `need`
        least = bisect_left(order, need, key=lambda k: sizes[k])
        found = sorted((len(x), t) for t in mine if (x := lists.get(t)))
        if len(found) >= need:
            long_count = min(need - 1, len(found))
            short = [lists[t] for _, t in found[: len(found) - long_count]]
            longs = [lists[t] for _, t in found[len(found) - long_count :]]
            if sum(map(len, short)) <= 4000:
                merged = ((d, sum(1 for _ in g)) for d, g in groupby(heapq.merge(*short)))
            else:
                ids, counts = np.unique(np.concatenate([np.asarray(x) for x in short]), return_counts=True)
                merged = zip(ids.tolist(), counts.tolist(), strict=True)
            if forest is None:
                merged = _probe(list(merged), longs, n, ordered, percent)
                longs = []
            for d, hits in merged:
                j = order[d]
                if d < least or cross is not None and cross[i] == cross[j]:
                    continue
                if forest is not None and forest.find(i) == forest.find(j):
                    continue
                both, left = n + sizes[j], len(longs)
                # 100*o >= percent*(both-o)
                overlap = -(-percent * both // (100 + percent))
                for x in longs:
                    if hits + left < overlap:
                        break
                    left -= 1
                    p = bisect_left(x, d)
                    hits += p < len(x) and x[p] == d
                if hits >= overlap:
                    if forest is not None:
                        forest.join(i, j)
                    yield (i, j) if i < j else (j, i)
        for t in mine:
            lists.setdefault(t, array("q")).append(at)


def _shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns."""
    key, shard = None, []
    for batch in small(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:keys] != key:
                if shard:
                    yield shard
                key, shard = row[:keys], []
            shard.append(row)
    if shard:
        yield shard


def _pairs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(len(names))], names=names)


def _sift(percent: int):
    """Shards of sketches -> (leader, c1): members that may still have a partner, under the least one they hang with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for shard in _shards(batches, ("leader", "size", "bi", "bj", "own", "c1", "n", "sketch"), 4):
            known = {r[5]: r for r in shard if r[7] is not None}
            names = sorted(known)
            if len(names) < 2:
                continue
            cells = np.array([np.frombuffer(known[c][7], np.uint8) for c in names])
            sizes = np.array([known[c][6] for c in names])
            blocks = np.array([known[c][4] for c in names])
            cross = shard[0][2] != shard[0][3]
            forest, met = _Forest(len(names)), set()
            for i in range(len(names) - 1):
                differ = (cells[i + 1 :] != cells[i]).sum(axis=1)
                near = differ * (100 + percent) <= (sizes[i + 1 :] + sizes[i]) * (100 - percent)
                if cross:
                    near &= blocks[i + 1 :] != blocks[i]
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    forest.join(i, j)
                    met.update((i, j))
            out += [(names[forest.find(i)], names[i]) for i in met]
            if len(out) > 50_000:
                yield _pairs(out, ["leader", "c1"])
                out = []
        if out:
            yield _pairs(out, ["leader", "c1"])

    return run


def _search(width: int, percent: int, count: bool = False):
    """Shards of texts -> links (a, b) of a spanning forest, and with count (a, null, links): links of each class found here.

    Two classes that meet in several shards are counted in that of their least common leader.
    """

    def links(shard: list[tuple]) -> list[tuple]:
        leader, bi, bj = shard[0][:3]
        unique: dict[int, np.ndarray] = {}
        blocks: dict[int, int] = {}
        for row, tokens in zip(shard, _sets([x[5] for x in shard], width), strict=True):
            if _class_of(tokens) == row[4]:  # else another text under a repeated id
                unique[row[4]], blocks[row[4]] = tokens, row[3]
        # Only tokens that two sets share can count; sets without enough of them have no partner here.
        lengths = {c: len(x) for c, x in unique.items()}
        if len(unique) < 2:
            return []
        _, inverse, counts = np.unique(np.concatenate(list(unique.values())), return_inverse=True, return_counts=True)
        shared, at = counts[inverse] > 1, 0
        names, sets, sizes = [], [], []
        for c, n in lengths.items():
            mine = inverse[at : at + n][shared[at : at + n]]
            at += n
            if len(mine) >= _needed(n, percent):
                names.append(c), sets.append(mine), sizes.append(n)
        label = np.array([blocks[c] for c in names]) if bi != bj else None
        if not count:
            return [(names[i], names[j]) for i, j in divide_skip(sets, percent, _Forest(len(names)), label, sizes)]
        before = {x[4]: frozenset(k for k in x[6] if k < leader) for x in shard}
        earlier, total, forest, out = [before[c] for c in names], [0] * len(names), _Forest(len(names)), []
        for i, j in divide_skip(sets, percent, None, label, sizes):
            if forest.join(i, j):
                out.append((names[i], names[j], None))
            if earlier[i].isdisjoint(earlier[j]):
                total[i] += 1
                total[j] += 1
        return out + [(c, None, n) for c, n in zip(names, total, strict=True) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        columns = ["a", "b", "links"] if count else ["a", "b"]
        for shard in _shards(batches, ("leader", "bi", "bj", "own", "c1", "text", *(["leaders"] if count else [])), 3):
            out += links(shard)
            if len(out) > 50_000:
                yield _pairs(out, columns)
                out = []
        if out:
            yield _pairs(out, columns)

    return run


def _deal(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Each member once for every pair of blocks that its block is part of; a group of up to `block` members is one block."""
    blocks = members.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    own = F.pmod(F.xxhash64("c1"), F.col("nb").cast("long")).cast("int")
    every = members.join(blocks, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return every.select(*members.columns, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def _joined(docs: DataFrame, width: int, percent: int, hot_tokens: int, block: int, count_links: bool) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, id, sig, n, c1, label) by row of docs (doc_id, id, sig, text), equal labels for what hangs together; and
    (class_id, n_links) with count_links."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = materialise(docs.mapInArrow(_scan(width, percent), "doc_id long, id long, sig long, n long, c1 long, token long, cnt long, own_sketch binary, below_sketch binary"))
    rows = scan.filter("token is null").select("doc_id", "id", "sig", "n", "c1", "own_sketch", "below_sketch")
    top = (
        scan.filter("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(hot_tokens).collect()
    )  # at most hot_tokens rows
    hot = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    rank = np.array([r["cnt"] for r in top], np.int64)
    by = np.argsort(hot)
    spent: list[str] = []
    prefix = materialise(docs.mapInArrow(_prefixes(width, percent, hot[by], rank[by]), "token long, c1 long, size int"), spent)
    # Most tokens stand in one row only; they go by their count, combined before the shuffle. Tables of their own, so that
    # the join can split a token that very many classes share.
    often = materialise(prefix.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token"), spent)
    again = materialise(prefix.join(often.hint("merge"), "token", "left_semi"), spent)
    met = materialise(again.groupBy("token").agg(F.min("c1").alias("leader"), F.max("c1").alias("most")).filter("leader < most").select("token", "leader"), spent)
    members = materialise(again.join(met.hint("merge"), "token").select("leader", "size", "c1").distinct())
    for path in spent:
        release(spark, path)
    classes = rows.filter("n > 0").groupBy("c1").agg(F.min(F.struct("id", "sig")).alias("rep"), F.max("n").alias("n"), F.max("own_sketch").alias("own_sketch"), F.max("below_sketch").alias("below_sketch"))
    lower = F.col("size") < F.floor(F.log("n") / F.log(F.lit(_base(percent))) + 1e-9)
    sketched = _deal(members, ["leader", "size"], block).join(classes, "c1").select("leader", "size", "bi", "bj", "own", "c1", "n", F.when(lower, F.col("below_sketch")).otherwise(F.col("own_sketch")).alias("sketch"))
    close = sketched.repartition(parts, "leader", "size", "bi", "bj").sortWithinPartitions("leader", "size", "bi", "bj").mapInArrow(_sift(percent), "leader long, c1 long")
    close = materialise(close.distinct(), spent := [])
    chosen = _deal(close, ["leader"], block).join(classes.select("c1", "rep.*").hint("merge"), "c1").hint("merge")
    shards = docs.select("id", "sig", "text").join(chosen, ["id", "sig"]).select("leader", "bi", "bj", "own", "c1", "text")
    if count_links:
        shards = shards.join(close.groupBy("c1").agg(F.collect_set("leader").alias("leaders")), "c1")
    dealt = shards.repartition(parts, "leader", "bi", "bj").sortWithinPartitions("leader", "bi", "bj")
    links = materialise(dealt.mapInArrow(_search(width, percent, count_links), "a long, b long" + (", links long" if count_links else "")))
    parent = connected_components(links.filter("b is not null").select("a", "b"))
    for path in spent:
        release(spark, path)
    labelled = rows.join(parent, rows["c1"] == parent["node"], "left").select("doc_id", "id", "sig", "n", "c1", F.coalesce("component", "c1").alias("label"))
    if not count_links:
        return labelled, None
    return labelled, links.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("n_links"))


def _keyed(id_col: str, text_col: str) -> list:
    """id and sig tell rows apart unless both id and text are equal; doc_id keeps nulls."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.coalesce(doc, F.lit(0)).alias("id"), F.xxhash64(doc.isNull(), text).alias("sig")]


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, hot_tokens: int = 1 << 17, block: int = 512, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row of docs, and n_links with count_links.

    class_id: the class of equal sets; n_links: the classes that it links with, all of them. Without count_links only a
    spanning forest of the links is searched.

    A set is the distinct `width`-word shingles of a text lower-cased in A-Z; a text of fewer words gives its whole
    sequence; null and blank texts give the empty set, which links with nothing. Two texts link when
    100*|intersection| >= percent*|union|, for any percent from 1 to 100. component_id is the least id reachable by links.
    Rows with a null id link like others; component_id is null where they reach no id. Rows of a repeated id are told
    apart by their texts, repeated rows are copies. hot_tokens bounds the one broadcast (16 bytes each).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keyed(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    named, totals = _joined(texts, width, percent, hot_tokens, block, count_links)
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("c1").alias("class_id"))
    if totals is None:
        return found
    return found.join(totals, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hot_tokens: int = 1 << 17, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of linked rows: that of the smallest id, rows without an id last.

    Rows without words link with nothing and stay. Of repeated rows (equal id and text) one stays, with or without words.
    docs is read more than once, so it must give the same rows each time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keyed(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    named, _ = _joined(texts, width, percent, hot_tokens, block, False)
    first = named.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "id", "sig")).alias("one")).select("one.id", "one.sig")
    names = ["_id", "_sig"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [f"_{x}" for x in names]
    keys = [x.alias(n) for x, n in zip(_keyed(id_col, text_col), names, strict=True)]
    empty = named.filter("n = 0").select("id", "sig").distinct()
    chosen = materialise(first.unionByName(empty).toDF(*names))
    # Repeated rows are combined before the shuffle that the join then uses as well.
    single = docs.select("*", *keys).dropDuplicates(names)
    return single.join(chosen.hint("merge"), names, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
