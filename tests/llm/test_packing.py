import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from tidecast.llm.packing import WordTokenizer, pack_documents, plan_bins, reduce_by_dominance

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_words_give_the_tokenizers_ids():
    tok = WordTokenizer(PATH)
    rnd = random.Random(2)
    bits = ["The", "they're", "it's", "'S", "I'll", "ÉTÉ", "straße", "12³", "½", "…", "***", " ", "\x85", "\x1c", "\n\n", "İ", "ſ", "ŉ", "ΣΑΣ", "é", "中文", "<|endoftext|>", "a_b", "¿qué?", "ª", "x" * 90, "µ", "ǅ", "👍", "ÿ", "Ÿ", " "]
    for _ in range(3000):
        text = "".join(rnd.choices(bits, k=rnd.randrange(12)))
        assert tok.ids(text) == np.array(tok.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def bins_needed(items, capacity):
    best = len(items)
    for order in permutations(items):
        bins = []
        for x in order:
            for i, b in enumerate(bins):
                if b + x <= capacity:
                    bins[i] += x
                    break
            else:
                bins.append(x)
        best = min(best, len(bins))
    return best


def test_plan_holds_every_piece_and_reduction_is_optimal():
    rnd = random.Random(5)
    for trial in range(400):
        capacity = rnd.choice([10, 13, 20])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 6))]
        counts = {x: items.count(x) for x in items}
        plan = plan_bins(counts, capacity)
        held = {}
        for lengths, times in plan:
            assert sum(lengths) <= capacity
            for k in lengths:
                held[k] = held.get(k, 0) + times
        assert held == counts
        fixed, left = reduce_by_dominance(counts, capacity)
        rest = [k for k, v in left.items() for _ in range(v)]
        assert sum(t for _, t in fixed) + bins_needed(rest, capacity) == bins_needed(items, capacity)
    counts = {k: random.Random(k).randint(0, 10**9) for k in range(1, 2049)}
    plan = plan_bins(counts, 2048)
    assert sum(t for _, t in plan) < 1.02 * sum(k * v for k, v in counts.items()) / 2048 and len(plan) < 20000


def test_pack_round_trip(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["the", "cat", "Straße", "x1"], k=rnd.choice([0, 1, 30, 30, 500, 5000])))) for i in range(120)] + [(500, None), (501, ""), (502, "a"), (502, "a")]
    got = pack_documents(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, piece int"), PATH, capacity=256).collect()
    tok = WordTokenizer(PATH)
    want = []
    for i, t in rows:
        ids = np.frombuffer(tok.ids(t or ""), "<u4").tolist() + [0]
        want += [(i, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.05 * sum(x[3] for x in want) / 256 + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def fewest(items, capacity):
    """Least bins, by trying every place of each piece in decreasing order."""

    def go(i, rooms, most):
        if i == len(order):
            return len(rooms)
        best = most
        for room in {r for r in rooms if r >= order[i]}:
            rest = list(rooms)
            rest.remove(room)
            best = min(best, go(i + 1, (*rest, room - order[i]), best))
        return min(best, go(i + 1, (*rooms, capacity - order[i]), best)) if len(rooms) + 1 < best else best

    order = sorted(items, reverse=True)
    return go(0, (), len(items) + 1)


def test_reduction_leaves_pieces_that_three_may_join():
    counts, capacity = {10: 1, 8: 1, 4: 3, 3: 3}, 20
    items = [k for k, n in counts.items() for _ in range(n)]
    fixed, left = reduce_by_dominance(counts, capacity)
    rest = [k for k, n in left.items() for _ in range(n)]
    assert ((10, 8), 1) not in fixed
    assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity) == 2
