import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotlake.llm.leak import align, bit_table, leaks, word_hashes
from spotlake.llm.mixture import mix, rates
from spotlake.llm.spans import factor, shared_spans
from spotlake.llm.suffixes import Suffixes

DOC = "doc_id bigint, text string, item_id string, score string"


def _shared(docs, least):
    first, out = {}, {}
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            first.setdefault(t[k : k + least], set()).add(i)
    for i, t in docs:
        spots = sorted({k for k in range(len(t or "") - least + 1) if len(first[t[k : k + least]]) > 1})
        for k in spots:
            runs = out.setdefault(i, [])
            if runs and k <= runs[-1][1]:
                runs[-1][1] = k + least
            else:
                runs.append([k, k + least])
    return {(i, a, b) for i, v in out.items() for a, b in v}


def _corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh \néß😀") for _ in range(n))
    common = [text(rng.choice([120, 99, 110, 125, 150, 400])) for _ in range(8)]
    docs = []
    for i in range(70):
        parts = [text(rng.randrange(0, 150)) if rng.random() < 0.5 else rng.choice(common)[rng.randrange(0, 20) :] for _ in range(rng.randrange(1, 6))]
        docs.append((i, "".join(parts)))
    return docs + [(90, "-" * 900), (91, "x" + "-" * 300 + "y"), (92, "ab" * 260), (93, "b" + "ab" * 200), (94, common[5]), (94, common[5]), (95, None), (96, ""), (97, text(5000) + common[0] * 4)]


@pytest.mark.parametrize("seed,hot,windows", [(0, 8000, 1_500_000), (1, 1, 1_500_000), (2, 8000, 300)])
def test_spans_equal_brute_force(spark, seed, hot, windows):
    docs = _corpus(seed)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs] + [(None, docs[0][1], "c", "c")], DOC)
    got = {(r.doc_id, r.start, r.end) for r in shared_spans(df, least=100, hot=hot, windows_each=windows).collect()}
    assert got == _shared(docs, 100) and len(got) > 20


@pytest.mark.parametrize("hot", [8000, 1])
def test_clashing_digests_are_told_apart_by_text(spark, hot):
    """Every digest is 0: equal keys clash in all levels of seeds, only the text at the boundaries and the parse decide."""
    docs = _corpus(5)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOC)
    got = {(r.doc_id, r.start, r.end) for r in shared_spans(df, least=100, hot=hot, digest_bits=0).collect()}
    assert got == _shared(docs, 100) and len(got) > 20


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(6)
    for _ in range(60):
        codes = rng.integers(0, int(rng.choice([1, 2, 3, 300])), int(rng.integers(2, 60)))
        s = Suffixes(codes, 100)
        tails = [tuple(codes[i:]) for i in s.order]
        assert tails == sorted(tails)
        a = rng.permutation(len(codes))
        b = np.roll(a, 1)
        for x, y, n in zip(a, b, s.common(a, b, 1), strict=True):
            assert n == next((k for k in range(len(codes)) if max(x, y) + k >= len(codes) or codes[x + k] != codes[y + k]), len(codes))


def test_spans_across_pieces(spark, monkeypatch):
    import spotlake.llm.spans as s

    docs = _corpus(3)
    long = "".join(t or "" for _, t in docs)
    whole = list(s.blocks_of(long, 100))
    parts = list(s.blocks_of(long, 100, piece=500))
    assert sum(int(b[3].sum()) for b in whole) == sum(int(b[3].sum()) for b in parts) == len(long) - 99
    assert shared_spans(spark.createDataFrame([], DOC)).count() == 0


def test_factor_checks_text():
    assert not len(factor(pd.DataFrame(columns=["key", "id", "start", "windows", "whole", "text"]), 5))
    rows = pd.DataFrame({"key": [1, 1], "id": [7, 8], "start": [10, 0], "windows": [4, 3], "whole": [False, False], "text": ["abcdefgh", "zbcdefg"]})
    got = {tuple(r) for r in factor(rows, 5).itertuples(index=False)}
    assert got == {(7, 11, 17), (8, 1, 7)}


def _words(t):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", t or "")]


def test_word_hashes_follow_the_definition():
    a, b = word_hashes("Ab_c 12é9\n\nZ"), word_hashes("aB C 12 9 z")
    assert len(a) == 5 and (a == b).all() and len(word_hashes("")) == 0 and len(word_hashes("İK")) == 1


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of"] * 10
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 50)))) for k in range(25)] + [(50, None), (51, ""), (52, "one two three")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 300))]
        if rng.random() < 0.7:
            piece = _words(rng.choice(items)[1])
            n = rng.choice([11, 12, 13, 30])
            at = rng.randrange(0, max(1, len(piece) - n + 1))
            w[len(w) // 2 : len(w) // 2] = piece[at : at + n]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w).replace(" ", " -\t")))
    docs += [(500, None), (501, ""), (502, "w1 " * 20000 + (items[0][1] or ""))]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs] * 2, DOC)
    table = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    want = set()
    for k, t in items:
        w = _words(t)
        grams = {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
        for i, x in docs:
            v = _words(x)
            if any(tuple(v[j : j + 12]) in grams for j in range(len(v) - 11)):
                want.add((k, i))
    for each in (1000, 2):
        found = leaks(df, table, places_each=each).collect()
        assert {(r.item_id, r.doc_id) for r in found if r.run >= 12 and r.score >= 24} == want and len(want) > 20
        assert len({(r.item_id, r.doc_id) for r in found}) == len(found)
    assert leaks(spark.createDataFrame([], DOC), table).count() == 0
    assert leaks(df, table.where("item_id < 0")).count() == 0


def test_edited_copies_are_scored(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    copy = "start alpha beta gamma delta epsilon zeta CHANGED theta iota extra kappa lambda nu xi omicron pi end"
    r = leaks(spark.createDataFrame([(1, copy, "", "")], DOC), spark.createDataFrame([(1, item)], "item_id bigint, text string")).first()
    assert r.run == 6 and 0.7 < r.coverage < 1


def test_a_whole_copy_does_not_hide_an_edited_one(spark):
    item = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i in (12, 24, 36) else w for i, w in enumerate(item)]
    docs = [(1, " ".join(item), "", ""), (2, " ".join(edited), "", ""), (3, " ".join(item[:6] + ["y"] * 9), "", ""), (4, "y " * 30, "", "")]
    found = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    got = {r.doc_id: (r.run, r.coverage) for r in found.collect()}
    assert got == {1: (40, 1.0), 2: (12, pytest.approx(71 / 80)), 3: (6, pytest.approx(12 / 80))}


def test_the_bit_table_loses_no_gram(spark):
    marks = spark.range(5000).select(F.xxhash64("id").alias("gram"))
    for most in (12, 29):
        table, bits = bit_table(marks, most)
        place = np.array([r.gram for r in marks.collect()], np.int64).view(np.uint64) >> np.uint64(64 - bits)
        assert ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).all() and bits <= most and len(table) == 1 << (bits - 6)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2, 0.25])
def test_recall_of_edited_copies(spark, rate):
    """Copies of items with words replaced, dropped and doubled at a rate, in other text; brute alignment of all pairs is the truth."""
    rng = random.Random(int(rate * 100))
    vocab = [f"w{i}" for i in range(3000)]
    items = [(k, [rng.choice(vocab) for _ in range(rng.randrange(30, 60))]) for k in range(12)]
    docs = []
    for i in range(60):
        words_ = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        for w in rng.choice(items)[1]:
            u = rng.random()
            words_ += [rng.choice(vocab)] if u < rate / 2 else [] if u < rate * 3 / 4 else [w, w] if u < rate else [w]
        docs.append((i, " ".join(words_ + [rng.choice(vocab) for _ in range(30)])))
    truth = {(k, i) for k, w in items for i, t in docs if align(word_hashes(" ".join(w)), word_hashes(t))[0] >= len(w)}
    found = leaks(spark.createDataFrame([(i, t, "", "") for i, t in docs], DOC), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"))
    got = {(r.item_id, r.doc_id) for r in found.where("coverage >= 0.5").collect()}
    print(f"rate {rate}: {len(got & truth)} of {len(truth)}")
    assert got <= truth and len(got) >= 0.9 * len(truth) and len(truth) > 40


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(0, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


TARGETS = [("A", 0.6, 2), ("b-c", 0.3, 4), ("gone", 0.1, 4), ("zero", 0.0, 4)]


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["int", "value", "return", "x1"]) for _ in range(rng.randrange(5, 120)))
    docs = [(i, text(), rng.choice(["a", " A", "A\n"]), "") for i in range(1500)] + [(5000 + i, text(), rng.choice(["B_C", "b c"]), "") for i in range(60)]
    docs += [(9000, text(), None, ""), (9001, text(), "other", ""), (9002, "", "a", ""), (9003, None, "a", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, report = mix(df, targets)
    rows = {r.doc_id: r for r in mixture.collect()}
    by = {r.source: r for r in report.collect()}
    assert not {9000, 9001} & set(rows) and all(1 <= r.copies <= 4 for r in rows.values())
    assert by["a"].reached_share == pytest.approx(2 / 3, abs=0.02) and by["b_c"].reached_share == pytest.approx(1 / 3, abs=0.02)
    assert by["b_c"].most_copies == 4 and by["b_c"].used_documents == 60 and by["gone"].reached_share == 0
    assert sorted(map(str, mix(df, targets)[0].collect())) == sorted(map(str, rows.values()))
    large = {r.source: r for r in mix(df, targets, total=1e9)[1].collect()}
    assert large["a"].most_copies == 2 and large["b_c"].most_copies == 4
    assert mix(df.limit(0), targets)[0].count() == 0 and mix(df, targets.limit(0))[0].count() == 0


def test_rates(spark):
    def got(sizes, targets):
        frames = spark.createDataFrame(sizes, "source string, tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
        return {r.source: r.rate for r in rates(*frames).collect()}

    assert got([("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 3)]) == {"a": 0.3, "b": 3.0}
    assert got([("a", 0)], [("a", 1.0, 2)]) == {} and got([], []) == {}
