import numpy as np

from tidecast.llm.nearest import chi_square_quantile, nearest_by_product


def brute(ids, vectors, queries, k=20):
    out = {}
    for q in queries:
        at = ids.index(q)
        scores = [(-float((vectors[j] * vectors[at]).sum()), ids[j]) for j in range(len(ids)) if j != at]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def recall(spark, vectors, **options):
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int")
    exact = np.array(vectors, np.float32).astype(float)
    want = brute(ids, exact, [i for i in ids if i % 20 == 0])
    got = {}
    for r in nearest_by_product(df, "id % 20 = 0", **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    for q in got:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_clusters_norms_and_shards(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((30, 32))
    vectors = centres[rnd.integers(0, 30, 3000)] + 0.4 * rnd.standard_normal((3000, 32))
    vectors[:900] = vectors[1]
    assert recall(spark, vectors * rnd.uniform(0.5, 2, (3000, 1)), shard_rows=400, query_block=16) >= 0.95
    assert recall(spark, vectors) >= 0.95
    assert recall(spark, vectors[:10]) == 1.0


def test_invalid_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (20, [0.0, 2.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_by_product(df, "id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert nearest_by_product(df.limit(0), "id % 20 = 0").count() == 0


def test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 0.01 and abs(chi_square_quantile(0.5, 2) - 1.386) < 0.01


def test_repeated_rows_are_vectors_of_their_own(spark):
    rnd = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rnd.standard_normal((60, 6))]
    rows = [(i, vectors[i]) for i in range(60)] + [(40, vectors[40]), (7, vectors[7]), (7, vectors[8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"shard_rows": 16}):
        got = {}
        for r in nearest_by_product(df, "id % 20 = 0", k=5, **options).collect():
            got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
        for own, (q, v) in enumerate(rows):
            if q % 20 == 0:
                scores = sorted((-float(np.dot(v, w)), i) for at, (i, w) in enumerate(rows) if at != own)[:5]
                for rank, (s, i) in enumerate(scores, 1):
                    assert any(x == i and abs(y + s) < 1e-12 for x, y in got[q, rank]), (q, rank)
        assert [len(got[40, r]) for r in range(1, 6)] == [2] * 5 and all(len(got[20, r]) == 1 for r in range(1, 6))


def test_tiny_and_huge_vectors_take_part(spark):
    rows = [(0, [1e-170, 0.0]), (1, [1e-170, 1e-170]), (2, [1e200, -1e200]), (3, [-1.0, 0.0]), (20, [1e200, 1e200]), (40, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_by_product(df, "id % 20 = 0", k=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    near = lambda q: [(i, float(f"{x:.6g}")) for i, x in got[q]]
    assert near(0) == [(2, 1e30), (20, 1e30)] and near(20) == [(1, 2e30), (0, 1e30)]  # row 2 overflows on both sides
    assert [i for i, _ in got[40]] == [2, 20] and len(got) == 3


def test_tree_descent_equals_boxes():
    from tidecast.llm.nearest import _gaps, build_tree

    points = np.random.default_rng(1).standard_normal((3000, 4))
    tree, leaves = build_tree(points, 50)
    where = tree.place(points)
    assert all((where[rows] == i).all() for i, rows in enumerate(leaves)) and sum(map(len, leaves)) == 3000
    ends = np.flatnonzero(tree.axis < 0)
    for far in (0.01, 1.0, np.inf):
        want = sorted(tree.leaf[ends[_gaps(points[0], tree.low[ends], tree.high[ends]) < far]])
        assert tree.within(points[0], far).tolist() == want
