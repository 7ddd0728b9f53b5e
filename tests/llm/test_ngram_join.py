import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm.components import connected_components
from cloakwork.llm.ngram_join import Schemes, keep_one, ngram_components, signatures


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) * den >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted((d, len(s), find(d)) for d, s in sets)


def near(words, base, edits):
    out = list(base)
    for _ in range(edits):
        out[words.r.randrange(len(out))] = words.word()
    return " ".join(out)


def test_against_brute_force(spark, words):
    texts = [None, "", " \t", "One two", "one  TWO", "x", "same same same same"]
    for size in (8, 12, 30, 90, 200):
        base = words.text(size).split()
        texts += [near(words, base, e) for e in (0, 0, 0, 1, 1, 2, 3, 5, 9)]
    texts += [words.text(n) for n in range(1, 25)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, sig long")
    for k, num in ((3, 90), (5, 80), (1, 50)):
        got = ngram_components(df, words=k, num=num, den=100)
        assert sorted(map(tuple, got.collect())) == brute(rows, k, num, 100)


def test_long_sets(spark, words):
    """Sets with wide sketches of one and of two lengths, around the threshold."""
    texts = []
    for size in (700, 1020, 1500):
        base = words.text(size).split()
        texts += [near(words, base, e) for e in (0, 5, 20, 30, 35, 40, 60, 200)] + [" ".join(base[: size - size // 6])]
    rows = list(enumerate(texts))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80, den=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 80, 100)


def test_groups_and_repeats(spark, words):
    base = words.text(120).split()
    rows = [(i, near(words, base, i % 4)) for i in range(60)] + [(i + 100, " ".join(base)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, " ".join(base))], "doc_id long, text string")
    got = ngram_components(df).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == sorted(brute(rows, 3, 90, 100) + brute(rows, 3, 90, 100)[:5])
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80)
    assert kept.columns == ["doc_id", "text"] and kept.count() == len({c for _, _, c in brute(rows, 5, 80, 100)})


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(9, 120), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32))
def test_no_pair_is_lost(n, add, drop, seed):
    """Sets at the threshold share a signature."""
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    y = np.unique(np.concatenate([x[min(drop, len(x)) :], r.integers(0, 2**64, add, dtype=np.uint64)]))
    both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
    for num in (80, 90):
        if len(y) and both * 100 >= num * either and both < either:
            with np.errstate(over="ignore"):
                s = Schemes(num, 100)
                assert set(signatures(x, s).tolist()) & set(signatures(y, s).tolist())


def test_schemes():
    """A document of n n-grams has enough fragments for every partner's differences."""
    for num in (80, 90):
        s = Schemes(num, 100)
        for n in range(1, 400):
            k = s.size_class(n)
            assert s.bounds[k] <= n < s.bounds[k + 1]
            assert s.fragments(k) > n * (100 - num) // num
            assert s.size_class(n * 100 // num) <= k + 1
