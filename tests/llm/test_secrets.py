import hashlib
import random
import itertools
import math
import re

from tidecast.llm.secrets import WORDS, WordRanks, all_spans, guess_cost, learn_words, redact_secrets, scan_secrets

A = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
RULES = [("assign", A, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def brute(text):
    out = []
    for k, (kind, rx, group, least) in enumerate(RULES):
        out += [(m.start(), k, m.end(), kind) for m in rx.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_base_equals_patterns(spark):
    rnd = random.Random(1)
    bits = ["password", "PASSWD", "secret", "token", "api_key", "ApiKey", "ſecret", " ", '"', "'", ":", "=", "  ", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "é", "hunter2hunter2", "x", "\n", "-", "Zz9/"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(40)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "token=secret:abcdefghijklmnop" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS spans")
    texts = dict(rows)
    got = scan_secrets(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k) for k in ("assign:", "access:", "hex:"))
    assert scan_secrets(df.limit(0)).count() == 0


def test_guess_cost_orders_values():
    assert guess_cost("") == 0
    assert guess_cost("password1") < guess_cost("aaaaaaaaaaaa") + 2 < guess_cost("x7Qm!9tz")
    assert guess_cost("qwertyuiop") < 4 and guess_cost("2024-11-03") < 6 and guess_cost("abcabcabcabc") < 5
    assert guess_cost("x" * 50000 + "9") < 12


def test_every_context_value_is_scored_and_masked_whole(spark):
    for value in ("QxZkVbnTrPlw", "QxZkVbnTr", "928461750384", "вЙкъыЭфщзц"):
        for word in ("pwd=", "credentials: ", "password="):
            spans = all_spans(word + value)[1]
            assert max(e for _, _, e in spans) == len(word + value), (word, value)
    for prose in ("password: something", "pwd: authentication", "secret: Undefined", "credentials: administrator", "pwd=aaaaaaaaaa", "token=12345678"):
        assert all_spans(prose, words=PROSE)[1] == [], prose
    texts = ["a password=Abcdefghijkl!Xy9$kkk b", "pwd=QxZkVbnTrPlw", "x token=abcdefghijklmnop y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()} == {0: "a [SECRET] b", 1: "pwd=[SECRET]", 2: "x [SECRET] y"}
    assert [r["n_guess"] for r in scan_secrets(df).orderBy("doc_id").collect()] == [1, 1, 0]


PROSE = WordRanks("something anything authentication undefined administrator else".split())


def test_added_spans_and_redaction(spark):
    assert [k for _, k, _ in all_spans("pwd = x7Qm!9tz, done")[1]] == [3]
    assert all_spans("the password: something else", words=PROSE)[1] == []
    assert all_spans("password: changeme1")[1] == []
    df = spark.createDataFrame([(1, "a token=abcdefghijklmnop b", 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, extra int")
    assert {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()} == {1: "a [SECRET] b", 2: None, 3: "clean"}


ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = dict(zip("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./"))


def direction(a, b):
    where = [next(((r, row.index(k)) for r, row in enumerate(ROWS) if k in row), None) for k in (SHIFTED.get(a, a), SHIFTED.get(b, b))]
    if None in where:
        return None
    d = (where[1][0] - where[0][0], where[1][1] - where[0][1])
    return d if d in [(0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)] else None


def span_cost(value, i, j, ranks):
    """Least cost of one span, by the definitions and nothing shared with the program."""
    low, part = value.lower(), value.lower()[i:j]
    costs = [1.0] if j - i == 1 else []
    one = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "l", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}
    two = {**one, "1": "i", "!": "l", "7": "l"}
    case = 0.3 if value[i:j] != part else 0.0
    if j - i >= 3:
        for table, extra in (({}, 0.0), (one, 1.0), (two, 1.0)):
            read = "".join(table.get(c, c) for c in part)
            for word, more in ((read, 0.0), (read[::-1], math.log10(2))):
                if word in ranks:
                    costs.append(math.log10(ranks[word]) + extra + case + more)
    year, month, day = r"(19|20)[0-9]{2}", r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12][0-9]|3[01])"
    for order, cost in (([year], 2.1), ([year, month, day], 4.6), ([day, month, f"({year}|[0-9]{{2}})"], 4.6), ([month, day, f"({year}|[0-9]{{2}})"], 4.6)):
        for sep in ["", "-", "/", "\\.", "_"]:
            m = re.match(sep.join(order), low[i:])
            if m and m.end() == j - i:
                costs.append(cost)
    for size in (1, 2, 3, 4):
        alike = lambda k: size <= k < len(low) and low[k] == low[k - size]  # noqa: E731, B023
        if j - i >= max(3, 2 * size) and all(alike(k) for k in range(i + size, j)) and not alike(j) and not alike(i + size - 1):
            costs.append((math.log10(12) if size == 1 else size) + math.log10((j - i) / size))
    ways = [direction(low[k], low[k + 1]) for k in range(len(low) - 1)]
    if j - i >= 3 and all(ways[i : j - 1]) and (j == len(low) or not ways[j - 1]) and (i == 0 or not ways[i - 1]):
        costs.append(math.log10(47 * (j - i)) + math.log10(5) * sum(a != b for a, b in itertools.pairwise(ways[i : j - 1])))
    for step in (1, -1):
        next_to = lambda k: 0 < k < len(low) and ord(low[k]) - ord(low[k - 1]) == step and low[k].isalnum() and low[k - 1].isalnum()  # noqa: E731, B023
        if j - i >= 3 and all(next_to(k) for k in range(i + 1, j)) and not next_to(j) and not next_to(i):
            costs.append(math.log10(52 * (j - i)))
    return min(costs, default=math.inf)


def test_guess_cost_equals_every_segmentation():
    rnd = random.Random(5)
    corpus = ["jennifer", "troubador", "abc", "sa", "cat"]
    words = WordRanks(corpus)
    ranks = {w: i for i, w in reversed(list(enumerate(dict.fromkeys(WORDS + corpus), 1)))}
    bits = ["qaz", "1q", "cat", "tac", "C4t", "19", "99", "0", "12", "aa", "abab", "xyz", "Sa", "!", "p@ss", "key", "-", "é", "2024", "mn"]
    values = ["1qaz2wsx", "zaq1xsw2", "c@t19991", "20240131", "yekABCab"] + ["".join(rnd.choices(bits, k=rnd.randint(1, 4)))[:9] for _ in range(150)]
    for v in values:
        n, least = len(v), math.inf
        table = {(i, j): span_cost(v, i, j, ranks) for i in range(n) for j in range(i + 1, n + 1)}
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
            edges = [0, *cuts, n]
            cost = sum(table[a, b] + (math.log10(2) if a and (b - a > 1) else 0.0) for a, b in itertools.pairwise(edges))
            least = min(least, cost)
        assert abs(guess_cost(v, words) - least) < 1e-9, v


def test_known_weak_values_are_no_secrets():
    words = WordRanks(["jennifer", "troubador"])
    for v in ("1qaz2wsx3edc", "zaq1xsw2", "jennifer1987", "Tr0ub4dor", "drowssap123", "31-12-1999abc"):
        assert guess_cost(v, words) < 8, v
    for v in ("QxZkVbnTrPlw", "x7Qm!9tzK", "928461750384"):
        assert guess_cost(v, words) >= 8, v


def test_words_are_learnt_from_all_texts_and_repeats_kept(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha gamma42 x"), (1, "alpha beta alpha gamma42 x"), (None, "Beta pwd=QxZkVbnTrPlw"), (3, None), (4, "")], "doc_id long, text string")
    assert learn_words(df) == ["alpha", "beta", "gamma"]
    got = scan_secrets(df, learn_words(df)).collect()
    assert sorted((r["doc_id"] or 0, r["n_guess"]) for r in got) == [(0, 1), (1, 0), (1, 0), (3, 0), (4, 0)]
    assert learn_words(df.limit(0)) == []
