import math
import random

import pytest

from tidecast.llm import token_counts
from tidecast.llm.token_counts import MARK, UnigramCounter, count_tokens, learn_piece_scores

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def brute(scores, word):
    scores = {p: round(x * 1e6) for p, x in scores.items()}
    path, byte = MARK + word, min(scores.values()) - round(math.log(2) * 1e6)
    best = [(0.0, 0)] + [None] * len(path)
    for j in range(1, len(path) + 1):
        size = len(path[j - 1].encode())
        options = [(best[j - 1][0] + byte * size, best[j - 1][1] + size)]
        options += [(best[i][0] + scores[path[i:j]], best[i][1] + 1) for i in range(j) if path[i:j] in scores]
        best[j] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


@pytest.mark.parametrize("nodes", [600_000, 50])
def test_shared_prefixes_equal_single_words(monkeypatch, nodes):
    monkeypatch.setattr(token_counts, "_MAX_NODES", nodes)
    monkeypatch.setattr(token_counts, "_MAX_DEPTH", 8)
    rnd = random.Random(6)
    pieces = [MARK, "▁a", "a", "b", "ab", "ba", "abba", "é", "▁ab", "bb", "aab"]
    scores = {p: -rnd.choice([1.0, 1.5, 2.0, 4.0]) for p in pieces}
    counter = UnigramCounter(scores)
    words = {"".join(rnd.choices("abéж", k=rnd.randint(0, 12))) for _ in range(800)} - {""}
    counter.learn(words)
    assert all(counter.counts[w] == brute(scores, w) for w in words)


def test_a_prefix_is_scored_once():
    counter = UnigramCounter({"a": -1.0, "ab": -1.5, MARK: -1.0})
    counter.learn({"abab", "ababa", "abb"})
    counter.learn({"abab" + c for c in "abc"})
    assert counter.nodes == 1 + len({w[:k] for w in ["abab", "ababa", "abb", "ababb", "ababc"] for k in range(1, len(w) + 1)})


def test_scores_are_shares_over_all_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["the cat sat", "the the dog", None, "", "sat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    scores = learn_piece_scores(df, PATH)
    ids = [i for t in texts if t for w in t.split() for i in model.encode(w)]
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-3
    ratio = math.exp(scores[model.id_to_piece(model.encode("the")[0])] - scores[model.id_to_piece(model.encode("dog")[0])])
    assert abs(ratio - (ids.count(model.encode("the")[0]) + 0.5) / (ids.count(model.encode("dog")[0]) + 0.5)) < 1e-9


def test_table(spark):
    texts = [(1, "the cat sat"), (2, None), (3, ""), (4, " \n\t "), (5, "the cat sat"), (5, "the cat sat"), (None, "the cat sat"), (6, "x" * 30000), (7, "日本語 " * 3)]
    got = {}
    for r in count_tokens(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n_tokens int"), PATH).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[5]) == 2 and got[5][0] == got[5][1] and len(got[None]) == 1
    one = {k: v[0] for k, v in got.items()}
    assert one[2]["n_tokens"] == one[3]["n_tokens"] == one[4]["n_tokens"] == 0
    assert one[1]["n_tokens"] == one[5]["n_tokens"] == one[None]["n_tokens"] == 3 and one[1]["n_pretokens"] == 3
    assert 1000 < one[6]["n_tokens"] <= 30000 and one[7]["n_tokens"] % 3 == 0
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = learn_piece_scores(docs, PATH)
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    memo = {}
    want = {r["doc_id"]: sum(memo.setdefault(w, 0) or memo.__setitem__(w, brute(scores, w)) or memo[w] for w in (r["text"] or "").split()) for r in rows}
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, PATH, scores).collect()}
    assert {k: got[k] for k in want} == want
