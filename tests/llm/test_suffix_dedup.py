import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tidecast.llm.suffix_dedup import RunLengthIndex, _mark, remove_repeats, repeated_runs, suffix_array


def brute(rows, length=200):
    blobs = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[s : s + length] for b in blobs.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in blobs.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def test_index_equals_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        text = np.append(rnd.integers(1, rnd.integers(2, 5) + 1, rnd.integers(1, 90)), 0)
        n = len(text)
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == order
        index = RunLengthIndex(text)
        assert index.run_lengths.sum() == n

        def common(a, b):
            k = 0
            while a + k < n and b + k < n and text[a + k] == text[b + k]:
                k += 1
            return k

        want = [max([common(i, j) for j in range(n) if j != i], default=0) for i in range(n)]
        assert index.matching_statistics(10**6).tolist() == want


def corpus(seed=2):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdefgh é\n", k=n))
    passages = [text(rnd.choice([150, 199, 200, 201, 260, 700])) for _ in range(12)]
    rows = []
    for i in range(160):
        bits = [text(rnd.choice([0, 5, 120, 400]))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "Z"
            bits += ["".join(p), text(rnd.choice([0, 3, 150]))]
        rows.append((i, "".join(bits)))
    rows += [(500, None), (501, ""), (502, "a" * 900), (503, "ab" * 300), (504, "x" * 200), (505, text(50) + "x" * 199), (506, rows[0][1]), (507, rows[0][1]), (508, "q" * 201)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, first int").repartition(3)
    want = brute(rows)
    for crowd in (256, 6, 1):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, crowd=crowd).collect()}
        assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}
    assert remove_repeats(df.limit(0)).count() == 0


def removed(df, **options):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"]) for r in remove_repeats(df, **options).collect())


def test_rows_with_null_and_repeated_ids(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    passage, a, b = text(300), text(400), text(500)
    df = spark.createDataFrame([(None, passage), (None, a), (5, a + passage), (5, b), (0, b[:230]), (None, None)], "doc_id long, text string")
    for crowd in (8192, 1):
        assert removed(df, crowd=crowd) == [(-1, 0, 0), (-1, 300, 300), (-1, 400, 400), (0, 230, 230), (5, 500, 230), (5, 700, 700)]
    twice = spark.createDataFrame([(1, a), (1, a), (2, b)], "doc_id long, text string")
    assert removed(twice) == [(1, 400, 400), (1, 400, 400), (2, 500, 0)]


def test_very_long_text(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choices("abcdefghijklmnop ", k=3_000_000))
    df = spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_500])], "doc_id long, text string")
    assert removed(df) == [(1, 3_000_000, 500), (2, 500, 500)]


def test_crowded_anchor_with_different_surroundings(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    core = text(230)
    rows = [(i, text(150) + core + text(150)) for i in range(60)] + [(100 + i, text(120) + core[:40 + i] + text(200)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for crowd in (8192, 16, 1):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, crowd=crowd).collect()}
        assert got == want


def test_index_is_small_and_sorted_in_few_rounds(monkeypatch):
    rnd = np.random.default_rng(7)
    core = bytes(rnd.integers(97, 123, 160, np.uint8))
    entries = [core + bytes(rnd.integers(97, 123, 40, np.uint8)) + core for _ in range(60)]
    rows = {"level": [0] * 1200, "anchor": [i // 20 for i in range(1200)], "whole": list(range(1200)), "times": [1 + i % 2 for i in range(1200)], "content": [entries[i % 60] for i in range(1200)]}
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))
    sizes, sorts, built, argsort = [], [], RunLengthIndex.__init__, np.argsort

    def build(self, text, *args, **options):
        sizes.append(len(text))
        built(self, text, *args, **options)

    monkeypatch.setattr(RunLengthIndex, "__init__", build)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(0) or argsort(*a, **k))
    found = [r for b in _mark(200)(iter([batch])) for r in b.to_pylist()]
    assert sum(sizes) >= 1200 * 361 and max(sizes) < 90_000
    assert len(sorts) <= 6 * len(sizes)
    assert [(r["whole"], r["lo"], r["hi"]) for r in found if r["whole"] % 2] == [(i, 0, 160) for i in range(1, 1200, 2)]


def test_repeated_runs_equal_brute_force():
    rnd = np.random.default_rng(8)
    for _ in range(400):
        length, symbols = int(rnd.integers(1, 14)), int(rnd.integers(1, 4))
        some = lambda n: bytes(rnd.integers(97, 97 + symbols, n, np.uint8))  # noqa: E731, B023
        pool = [some(int(rnd.integers(length, 30))) for _ in range(3)]
        entries = sorted({pool[rnd.integers(3)] + some(int(rnd.integers(0, 20))) for _ in range(rnd.integers(1, 9))})
        copies = rnd.choice([1, 1, 1, 3], len(entries))
        times = Counter()
        for e, t in zip(entries, copies, strict=True):
            for s in range(len(e) - length + 1):
                times[e[s : s + length]] += int(t)
        want = [(i, s) for i, e in enumerate(entries) for s in range(len(e) - length + 1) if times[e[s : s + length]] > 1]
        runs = repeated_runs(np.frombuffer(b"".join(entries), np.uint8), np.array([len(e) for e in entries]), copies, length)
        assert [(i, s) for i, lo, hi in zip(*runs, strict=True) for s in range(lo, hi + 1)] == want
