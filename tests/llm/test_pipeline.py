"""The pipeline against a brute-force version of each stage's decision."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as near
from tidecast.llm.packing import WordTokenizer
from tidecast.llm.queries import tokenizer_file
from tidecast.llm.secrets import WordRanks, all_spans


def rows(seed=5):
    rnd = random.Random(seed)
    words = {lang: ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(200)] for lang, letters in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    items = [(i, " ".join(rnd.choices(words["en"], k=25))) for i in range(5)]
    out = []
    for i in range(60):
        lang = rnd.choice(["en", "en", "de"])
        text = rnd.choices(words[lang], k=rnd.choice([5, 60, 200]))
        if i % 9 == 0:
            text[2:2] = rnd.choice(items)[1].split()
        if i % 7 == 0:
            text += ["token=abcdefghijkl" + str(i)]
        out.append((i, " ".join(text), lang, "s", 0))
    out += [(100 + i, out[i][1], out[i][2], "s", 0) for i in range(8)]
    out += [(200, None, "en", "s", 0), (201, "123 456", "en", "s", 0), (202, "", None, "s", 0)]
    return out, items


def test_run_equals_brute_force(spark, tmp_path):
    data, items = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t, *_ in data if t and any(c.isalpha() for c in t)]
    groups = near(kept, 5, 80)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    found = {d for d, _ in leaks(kept, items)}
    assert found
    kept = [(i, t) for i, t in kept if i not in found]
    tok = WordTokenizer(tokenizer_file())
    counts = Counter(w for _, t in kept for w in re.findall(r"[^\W\d_]+", t.lower()) if 3 <= len(w) <= 20)
    ranks = WordRanks([w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1])
    want, masked = [], 0
    for i, t in kept:
        spans = all_spans(t, words=ranks)[1]
        masked += len(spans)
        for s, _, e in sorted(spans, reverse=True):
            t = t[:s] + "[SECRET]" + t[e:]
        ids = np.append(np.frombuffer(tok.ids(t), "<u4"), 0).astype("<u4")
        want += [(i, p, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert masked
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len(cp.STAGES) == 5


def test_near_duplicates_are_rows(spark, tmp_path):
    rnd = random.Random(6)
    text = lambda n: [f"v{rnd.randrange(4000)}" for _ in range(n)]
    base = text(200)
    near_copy = [f"other{i}" if i % 50 == 25 else w for i, w in enumerate(base)]  # one word in 50: 0.82 of five words, under 0.9 of three
    lone, twice = " ".join(text(80)), " ".join(text(80))
    data = [(2, " ".join(near_copy)), (1, " ".join(base)), (3, twice), (3, twice), (3, lone), (None, " ".join(text(80))), (None, " ".join(text(80))), (None, twice)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    got = cp.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, data[1][1]), (3, twice), (3, lone), (0, data[5][1]), (0, data[6][1])])
