"""Nearest neighbours by inner product: stable low-dimensional projections, kd-trees, chi-square stopping.

Vectors get one more component that makes all norms equal to the largest, so the largest inner product is the least
distance. A Gaussian projection to `dims` dimensions keeps squared distance times a chi-square variable with `dims`
degrees of freedom. Projected points lie in a kd-tree: its top is fitted on a bounded sample and deals all rows into
shards, each shard builds its own tree. A query takes projected neighbours in order of projected distance, verifies
their true products, and stops once a point nearer than its current k-th would, with probability `confidence`, already
have been met. Queries search their home shard first; that bound then rules out most other shards by the same test.

The index works on vectors scaled by a power of two so that the largest norm is near 1; scores are products of the
original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import small
from .store import materialise

_LEAF = 256
_VERIFY = 64  # projected neighbours verified before the first stopping test; twice as many before the next, up to 4,096
_SLACK = 1e-9


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square with an even number of degrees of freedom <= x) = p, by bisection on the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = math.exp(-x / 2)
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


def _projection(width: int, dims: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(20240229)).standard_normal((width + 1, dims))


def _norm_log(vectors: np.ndarray) -> np.ndarray:
    """Natural logarithm of each row's norm, whatever its exponent."""
    most = np.abs(vectors).max(axis=1)
    unit = vectors / most[:, None]
    return np.log(most) + 0.5 * np.log((unit * unit).sum(axis=1))


def _lift(vectors: np.ndarray, exponent: int, top: float) -> np.ndarray:
    scaled = np.ldexp(vectors, -exponent)
    return np.column_stack([scaled, np.sqrt(np.maximum(top * top - (scaled * scaled).sum(axis=1), 0))])


@dataclass
class Tree:
    """kd-tree: by node the cut (axis -1 in leaves), its two children, its half-spaces, and the leaf's number."""

    axis: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray

    def place(self, points: np.ndarray) -> np.ndarray:
        """Number of the leaf that each point falls into."""
        node = np.zeros(len(points), np.int64)
        live = np.flatnonzero(self.axis[node] >= 0)
        while len(live):
            at = node[live]
            right = points[live, self.axis[at]] >= self.cut[at]
            node[live] = self.kids[at, right.astype(np.int64)]
            live = live[self.axis[node[live]] >= 0]
        return self.leaf[node]

    def within(self, point: np.ndarray, far: float) -> np.ndarray:
        """Leaves whose box is nearer than far (squared), by descent."""
        front, out = np.zeros(1, np.int64), []
        while len(front):
            front = front[_gaps(point, self.low[front], self.high[front]) < far]
            ends = self.axis[front] < 0
            out.append(self.leaf[front[ends]])
            front = self.kids[front[~ends]].ravel()
        return np.sort(np.concatenate(out))


def build_tree(points: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree of leaves of up to `leaf` points (more, if they are equal), and the rows of each leaf."""
    dims = points.shape[1]
    axis, cuts, kids, lows, highs, number, leaves = [-1], [0.0], [(0, 0)], [np.full(dims, -np.inf)], [np.full(dims, np.inf)], [-1], []
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        part = points[rows]
        wide = np.ptp(part, axis=0) if len(rows) else np.zeros(dims)
        k = int(wide.argmax())
        if len(rows) <= leaf or wide[k] == 0:
            number[node] = len(leaves)
            leaves.append(rows)
            continue
        cut = float(np.median(part[:, k]))
        left = part[:, k] < cut
        if not left.any():  # many equal values at the median: cut just above them
            cut = float(np.min(part[:, k][part[:, k] > cut]))
            left = part[:, k] < cut
        axis[node], cuts[node], kids[node] = k, cut, (len(axis), len(axis) + 1)
        for side, inside in ((1, left), (0, ~left)):
            bound = (lows if side == 0 else highs)[node].copy()
            bound[k] = cut
            lows.append(bound if side == 0 else lows[node])
            highs.append(bound if side == 1 else highs[node])
            todo.append((len(axis), rows[inside]))
            axis.append(-1), cuts.append(0.0), kids.append((0, 0)), number.append(-1)
    return Tree(np.array(axis), np.array(cuts), np.array(kids), np.array(lows), np.array(highs), np.array(number)), leaves


def _gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance from a point to each box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


@dataclass
class Space:
    """What the index works in: projection, scale of the vectors and the largest norm at that scale."""

    matrix: np.ndarray
    exponent: int
    top: float

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return _lift(vectors, self.exponent, self.top) @ self.matrix

    def query(self, vector: np.ndarray) -> np.ndarray:
        """Projection of a query, stretched to the largest norm."""
        unit = vector / np.abs(vector).max()
        return np.append(unit * (self.top / math.sqrt(float((unit * unit).sum()))), 0.0) @ self.matrix

    def reach(self, vector: np.ndarray, score: float) -> float:
        """Squared distance from the stretched query of a vector with this product."""
        if score == -math.inf:
            return math.inf
        most = float(np.abs(vector).max())
        unit = vector / most
        along = math.ldexp(score / most / math.sqrt(float((unit * unit).sum())), -self.exponent)
        return max(0.0, 2 * self.top * self.top - 2 * self.top * along)


class Shard:
    """Rows of one shard under a kd-tree of their projections."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, space: Space):
        points = space.project(vectors)
        _, leaves = build_tree(points, _LEAF)
        turn = np.concatenate(leaves)
        self.rows, self.ids, self.vectors, self.points, self.space = rows[turn], ids[turn], vectors[turn], points[turn], space
        ends = np.cumsum([len(x) for x in leaves])
        self.spans = list(zip(ends - [len(x) for x in leaves], ends, strict=True))
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.spans])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.spans])

    def search(self, own: int, query: np.ndarray, k: int, quantile: float, bound: float) -> list[tuple[int, float]]:
        """(vec_id, score) of the k best found but row `own`; bound: a score already known for k others, -inf if none.

        Leaves are opened in order of their boxes; a point's turn comes once no unopened box is nearer than the point.
        """
        point = self.space.query(query)
        gaps = _gaps(point, self.low, self.high)
        turn = np.argsort(gaps, kind="stable")
        gaps = np.append(gaps[turn], math.inf)
        ids, scores, worst = np.zeros(0, np.int64), np.zeros(0), bound
        pool, far, product = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        at, step, verify, stop = 0, 1, _VERIFY, quantile * self.space.reach(query, bound)
        while True:
            ready = far <= gaps[at]
            if not ready.any():
                if at == len(turn) or gaps[at] >= stop:
                    break
                opened = [self.spans[i] for i in turn[at : at + step]]  # slices, so that nothing is copied
                at, step = min(at + step, len(turn)), min(2 * step, 16)
                with np.errstate(over="ignore", invalid="ignore"):
                    product = np.concatenate([product, *(self.vectors[a:b] @ query for a, b in opened)])
                pool = np.concatenate([pool, *(np.arange(a, b) for a, b in opened)])
                gaps_of = [self.points[a:b] - point for a, b in opened]
                far = np.concatenate([far, *(np.einsum("ij,ij->i", g, g) for g in gaps_of)])
                continue
            order = np.flatnonzero(ready)
            order = order[np.argsort(far[order], kind="stable")]
            rows, near, rough = pool[order], far[order], product[order]
            rest = ~ready
            pool, far, product = pool[rest], far[rest], product[rest]
            start = 0
            while start < len(rows) and near[start] < stop:
                part = slice(start, start + verify)
                start, verify = start + verify, min(2 * verify, 4096)
                part = rows[part][~(rough[part] < worst - _SLACK * max(1.0, abs(worst)))]
                part = part[self.rows[part] != own]
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (self.vectors[part] * query).sum(axis=1)
                exact[np.isnan(exact)] = -math.inf  # products that overflow on both sides
                keep = exact >= worst
                if not keep.any():
                    continue
                ids, scores = np.append(ids, self.ids[part[keep]]), np.append(scores, exact[keep])
                if len(ids) >= k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    worst = max(worst, float(scores[-1]))
                    stop = quantile * self.space.reach(query, worst)
            if start < len(rows):
                break
        best = np.lexsort((ids, -scores))
        return [(int(ids[i]), float(scores[i])) for i in best]


def _matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _norms():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            widths = np.array(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False), np.int64)
            logs = np.zeros(len(widths))
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                some = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                logs[at] = _norm_log(np.array(some, "<f8").reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array(logs), pa.array(widths.astype(np.int32))], names=["norm_log", "width"])

    return run


def _assign(width: int, space: Space, tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            vectors = np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(tree.place(space.project(vectors)))], names=["id", "v", "shard"])

    return run


def _route(width: int, space: Space, tree: Tree, quantile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, shards = [], []
            vectors = _matrix_of(batch.column("v"), width) if batch.num_rows else np.zeros((0, width))
            for i, (v, home, worst) in enumerate(zip(vectors, batch.column("shard").to_pylist(), batch.column("bound").to_pylist(), strict=True)):
                for s in tree.within(space.query(v), quantile * space.reach(v, worst)).tolist():
                    if s != home:
                        rows.append(i), shards.append(s)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("row"), taken.column("id"), taken.column("v"), pa.array(shards, pa.int64()), taken.column("bound")], names=["row", "id", "v", "shard", "bound"])

    return run


def _visit(width: int, space: Space, k: int, quantile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, ([], [], []), None
        for batch in small(batches):
            out: list[tuple[int, int, int, float]] = []
            vectors = _matrix_of(batch.column("v"), width) if batch.num_rows else np.zeros((0, width))
            columns = [batch.column(c).to_pylist() for c in ("shard", "sub", "qb", "kind", "row", "id", "bound")]
            for v, s, sub, qb, kind, row, own, bound in zip(vectors, *columns, strict=True):
                if (s, sub, qb) != key:
                    key, held, shard = (s, sub, qb), ([], [], []), None
                if kind == 0:
                    for x, y in zip(held, (row, own, v), strict=True):
                        x.append(y)
                    continue
                if shard is None and held[0]:
                    shard = Shard(np.array(held[0]), np.array(held[1]), np.array(held[2]), space)
                if shard is not None:
                    out += [(row, own, i, x) for i, x in shard.search(row, v, k, quantile, bound)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], names=["query_row", "query_id", "vec_id", "score"])

    return run


def nearest_by_product(vectors: DataFrame, queries: str, k: int = 20, dims: int = 8, confidence: float = 0.98, shard_rows: int = 16_384, query_block: int = 4096, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where the SQL condition `queries` (over `id`) holds, the k rows, other
    than their own, of largest inner product found; ties to the smaller id; all candidates if fewer than k.

    Vectors that are null, zero, or hold a null or non-finite component take no part; nor do rows with a null id and those
    whose length is not the most usual one. Every row is a vector of its own: repeated rows are each other's neighbours,
    and an asked row that is repeated gets a list for each of its rows. Tiny and huge components take part; a product
    that overflows is an infinity, or minus infinity if it overflows on both sides. The top of the tree is fitted on at
    most about `sample` hash-chosen rows; every row is indexed.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stats = valid.select("v").mapInArrow(_norms(), "norm_log double, width int").groupBy("width").agg(F.count("*").alias("n"), F.max("norm_log").alias("most")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not stats:
        return empty
    width, n, exponent = stats[0]["width"], stats[0]["n"], math.floor(stats[0]["most"] / math.log(2))
    valid = valid.filter(F.size("v") == width).select("id", "v")
    quantile = chi_square_quantile(confidence, dims)
    space = Space(_projection(width, dims), exponent, math.exp(stats[0]["most"] - exponent * math.log(2)) * (1 + _SLACK))
    shards = -(-n // shard_rows)
    tree, _ = build_tree(np.zeros((0, dims)), 1)
    if shards > 1:
        share = min(1.0, sample / n)
        drawn = valid.filter((F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1))) < int(share * (1 << 30))).select("v").collect()
        if drawn:
            tree, _ = build_tree(space.project(np.array([r["v"] for r in drawn], float)), max(1, -(-len(drawn) // shards)))
    # Rows get a key as they are written, so it stays the same in all that follows.
    rows = materialise(valid.mapInArrow(_assign(width, space, tree), "id long, v binary, shard long").withColumn("row", F.monotonically_increasing_id())).withColumn("is_query", F.expr(queries))

    def search(asked: DataFrame) -> DataFrame:
        wanted = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qbs"))
        held = rows.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
        plan = held.join(wanted, "shard")
        data = rows.join(plan, "shard").select("shard", F.pmod(F.xxhash64("row"), F.col("subs").cast("long")).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), F.lit(0).alias("kind"), "row", "id", "v", F.lit(float("-inf")).alias("bound"))
        ask = asked.join(plan, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("row"), F.col("qbs").cast("long")).cast("int").alias("qb"), F.lit(1).alias("kind"), "row", "id", "v", "bound")
        both = data.unionByName(ask).repartition(parts, "shard", "sub", "qb").sortWithinPartitions("shard", "sub", "qb", "kind")
        return both.mapInArrow(_visit(width, space, k, quantile), "query_row long, query_id long, vec_id long, score double")

    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    home = rows.filter("is_query").select("row", "id", "v", "shard", F.lit(float("-inf")).alias("bound"))
    found = search(home)
    if int(tree.leaf.max()) > 0:
        found = materialise(best(found).drop("rank"))
        bounds = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
        onward = home.drop("bound").join(bounds, F.col("row") == F.col("query_row"), "left").select("row", "id", "v", "shard", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        onward = materialise(onward.mapInArrow(_route(width, space, tree, quantile), "row long, id long, v binary, shard long, bound double"))
        found = found.unionByName(search(onward))
    return best(found).select("query_id", "rank", "vec_id", "score")
