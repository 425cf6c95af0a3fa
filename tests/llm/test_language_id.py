import random
import zlib

import numpy as np

from tidecast.llm.language_id import fit_language_models, learn_and_identify, score_words

LETTERS = {"aa": "abcde", "bb": "abxyz", "cc": "éñüßo"}


def word(rnd, lang):
    return "".join(rnd.choices(LETTERS[lang], weights=[5, 3, 2, 2, 1], k=rnd.randint(1, 7)))


def rows(n=400, seed=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(["aa", "aa", "aa", "bb", "cc"])
        out.append((i, " ".join(word(rnd, lang) for _ in range(rnd.choice([3, 20, 200]))), lang))
    return out


def test_probabilities_sum_to_one():
    data = [(lang, text) for _, text, lang in rows(60)]
    m = fit_language_models(data, order=3)
    alphabet = sorted({c for _, t in data for c in t if c != " "})
    # every context's next symbols, the word end included and one symbol for all unseen, share probability one
    for stem in ("a", "ab", "x"):
        total = np.zeros(len(m.langs))
        base = score_words(m, [stem + "b"])[0]
        for c in alphabet + ["ж"]:
            # log p(stem + c, prefix only): remove the end-of-word factor by comparing with the pair's own continuation
            both = score_words(m, [stem + c])[0][0]
            ends = _end(m, stem + c)
            total += np.exp(both - ends - _prefix(m, stem))
        total += np.exp(_end(m, stem))
        assert np.allclose(total, 1, atol=0.02), (stem, total, base)


def _end(m, word):
    """log p(end | word), from the two scores that share every other factor."""
    return score_words(m, [word])[0][0] - _prefix(m, word)


def _prefix(m, word):
    import tidecast.llm.language_id as L

    codes, reach = L._symbols([word])
    hashes = L._hashes(codes, m.order)
    prob = np.full((len(codes), len(m.langs)), 1.0 / m.alphabet)
    for k in range(1, m.order + 1):
        for i in range(1, len(codes)):
            if reach[i] >= k - 1:
                before = hashes[k - 1][i - 1] if k > 1 else np.uint64(0)
                g = np.searchsorted(m.grams[k - 1], hashes[k][i])
                g = g if g < len(m.grams[k - 1]) and m.grams[k - 1][g] == hashes[k][i] else len(m.grams[k - 1])
                c = np.searchsorted(m.contexts[k - 1], before)
                c = c if c < len(m.contexts[k - 1]) and m.contexts[k - 1][c] == before else len(m.contexts[k - 1])
                prob[i] = m.probs[k - 1][g] + m.gammas[k - 1][c] * prob[i]
    return np.log(prob[1 : len(word) + 1]).sum(axis=0)


def test_held_out_accuracy_and_edges(spark):
    data = rows() + [(9000, None, "aa"), (9001, "", None), (9002, "123 --", "bb"), (9003, "abcab " * 20000, "aa"), (9005, "abcab" * 20000, None), (9004, "ЖЩЫЭЮ " * 50, None)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in learn_and_identify(df).collect()}
    assert len(got) == len(data)
    for i in (9000, 9001, 9002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[9003]["lang_pred"] == "aa" == got[9005]["lang_pred"] and got[9004]["rejected"]
    tested = [r for r in data if r[0] < 9000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] for r in tested)
    right = sum(got[r[0]]["lang_pred"] == r[2] for r in tested)
    assert right / len(tested) > 0.95
    assert sum(got[r[0]]["rejected"] for r in data if r[0] < 9000) <= 2
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in learn_and_identify(df).collect()] == [("und", 0.0)]
    assert learn_and_identify(df.limit(0)).count() == 0
