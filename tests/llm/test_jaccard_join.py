import random

import pytest

from tidecast.llm.jaccard_join import drop_near_duplicates, jaccard_components


def brute(rows, width=3, percent=90):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append((i, {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=3, n=260):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    base = [rnd.choices(words, k=rnd.choice([1, 2, 3, 30, 90, 200])) for _ in range(40)]
    for i in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            t[rnd.randrange(len(t))] = rnd.choice(words) + ("x" if rnd.random() < 0.5 else "")
        rows.append((i, " ".join(t)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "ONE \v"), (1006, "é"), (1007, "É")]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, c1 int").repartition(3)
    for block in (512, 4):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, block=block).collect()}
        assert got == brute(rows)


def test_repeats_many_and_empty(spark):
    rows = [(i, "a b c d e f g") for i in range(3000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_link_is_counted(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = corpus(5, 150)
    for i in range(90):  # a group in which most pairs link, and some do not
        t = list(base)
        for p in rnd.sample(range(150), rnd.choice([0, 1, 2, 3])):
            t[p] = f"x{rnd.randrange(9)}"
        rows.append((2000 + i, " ".join(t)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(3, len(w))
        sets[i] = frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if w else frozenset()
    different = set(sets.values()) - {frozenset()}
    want = {s: sum(1 for o in different if o != s and 100 * len(s & o) >= 90 * len(s | o)) for s in different}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (512, 16):
        got = jaccard_components(df, block=block, count_links=True).collect()
        assert {r["doc_id"]: r["n_links"] for r in got} == {i: want.get(s, 0) for i, s in sets.items()}
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
        assert len({r["class_id"] for r in got if r["n_shingles"]}) == len(different)
    assert sum(want.values()) > 2 * len(different)  # more than any forest has


def test_low_thresholds_equal_brute_force(spark):
    rows = corpus(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (100, 60, 40, 15):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, percent=percent).collect()}
        assert got == brute(rows, percent=percent)
    for percent in (0, 101):
        with pytest.raises(ValueError):
            jaccard_components(df, percent=percent)


def test_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v"
    df = spark.createDataFrame([(None, a), (None, b), (5, a), (5, b), (7, b), (7, b), (None, None), (None, "lone text of its own")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(0, 6, 5), (0, 5, 5), (5, 6, 5), (5, 5, 5), (7, 5, 5), (7, 5, 5), (0, 0, None), (0, 3, None)], key=str)


def test_very_long_texts(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    other = list(words)
    for p in range(0, 200_000, 5000):
        other[p] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:1000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_dropping_keeps_all_columns(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(2, a, "x", 1, 1), (1, a + " more", "y", 2, 2), (3, b, "z", 3, 3), (4, None, "n", 4, 4), (4, None, "n", 4, 4), (5, "", "e", 5, 5), (None, "alone in the end", "w", 6, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, _id int, _sig int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["_id"]) for r in got.collect()) == [(0, 6), (1, 2), (3, 3), (4, 4), (5, 5)]
    assert drop_near_duplicates(df.limit(0)).count() == 0
