import random
import re
from collections import Counter

import numpy as np

from tidecast.llm.decontaminate import HammingIndex, drop_contaminated, find_contamination


def bag(words, width=5):
    k = min(width, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(docs, items, least=0.8):
    out = {}
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for i, t in items:
            v = re.findall(r"\w+", (t or "").lower())
            if not w or not v:
                continue
            width = min(5, len(v))
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s : s + len(v)], width), bag(v, width)
                both = sum((a & b).values())
                like = both / (sum(a.values()) + sum(b.values()) - both)
                if like >= least and like > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (like, s)
    return out


def test_radius_is_complete():
    rnd = random.Random(1)
    blocks = lambda x: [(x >> (16 * k)) & 0xFFFF for k in range(8)]
    for count in (50, 900):  # comparing, and probing
        prints = [rnd.getrandbits(128) for _ in range(count)]
        queries = [p ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(0, 45))) for p in prints[:50] for _ in range(10)]
        index = HammingIndex(np.array([blocks(p) for p in prints], np.uint16), 31)
        got = index.search(np.array([blocks(q) for q in queries], np.uint16))
        want = {(q, i, (x ^ p).bit_count()) for q, x in enumerate(queries) for i, p in enumerate(prints) if (x ^ p).bit_count() <= 31}
        assert set(got) == want and len(got) == len(want)


def test_few_fingerprints_are_candidates():
    rnd = np.random.default_rng(2)
    prints = rnd.integers(0, 1 << 16, (2000, 8)).astype(np.uint16)
    index = HammingIndex(prints, 31)
    met = np.mean([sum(len(index._met(q[k : k + 1], index.tables[k][0])[1]) for k in range(8)) / 2000 for q in rnd.integers(0, 1 << 16, (50, 8)).astype(np.uint16)])
    assert met < 0.12


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(12, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "only three words"), (93, "Éa b c d e"), (94, "a a a a a a a a a b")]
    docs = []
    for d in range(300):
        text = rnd.choices(vocabulary, k=rnd.choice([0, 3, 80, 400]))
        for _ in range(rnd.choice([0, 1, 2])):
            passage = rnd.choice(items[:60])[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randint(0, len(text))
            text[at:at] = passage
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (902, "Only, three words!"), (903, "x éa B c d e y"), (904, "a " * 30 + "b"), (905, "now only three words here in it")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (16_000_000, 4_000):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in find_contamination(df, bench, block_bytes=size).collect()}
        assert got == want
    assert find_contamination(df, bench.limit(0)).count() == 0 and find_contamination(df.limit(0), bench).count() == 0


def test_long_texts_repeats_and_nulls(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    item = " ".join(words(30))
    long = " ".join([*words(150_000), item, *words(150_000), item])
    df = spark.createDataFrame([(1, long), (1, long), (None, "x " + item), (2, item[: len(item) // 2]), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "yes sir"), (9, None)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["start_word"]) for r in find_contamination(df, bench).collect())
    assert got == [(0, 0, 1), (0, 7, 1), (1, 0, 150_000), (1, 0, 150_000), (1, 7, 150_000), (1, 7, 150_000)]
    assert sorted((r["doc_id"] or 0) for r in drop_contaminated(df, bench).collect()) == [2, 3]
