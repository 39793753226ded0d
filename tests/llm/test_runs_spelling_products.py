"""Periodic runs, spelling variants and exact inner products against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import products, runs, spelling

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs ------------------------------------------------------------

def brute_runs(words):
    """All (start, length, smallest period) read off the definition."""
    seen = {}
    for p in range(1, len(words) // 3 + 1):
        start = 0
        while start + p < len(words):
            end = start
            while end + p < len(words) and words[end] == words[end + p]:
                end += 1
            if end + p - start >= max(24, 3 * p):
                seen.setdefault((start, end + p), p)
            start = max(end, start + 1) if end > start else start + 1
    return sorted((a, b - a, p) for (a, b), p in seen.items())


repeats = st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=20), st.integers(1, 9), st.integers(0, 6)), max_size=4)


@settings(max_examples=80, deadline=None)
@given(st.lists(repeats, min_size=1, max_size=4), st.sampled_from([0x9E3779B97F4A7C15, 1]))
def test_runs_are_those_of_the_definition(texts, multiplier):
    words = [[w for base, n, rest in t for w in base * n + base[:rest]] for t in texts]
    found = runs.find_runs([np.array(w, np.int64) for w in words], multiplier)  # with a multiplier of 1 sums clash
    assert found == [brute_runs(w) for w in words]


def test_long_texts_and_sums_that_clash():
    for period in (1, 2, 7, 4000):
        words = np.array([1 + k % period for k in range(20_000)], np.int64)
        assert runs.find_runs([words]) == [[(0, 20_000, period)]]
    clash = [1]
    while len(clash) < 4096:  # two halves whose polynomial sums modulo 2 ** 64 agree
        clash += [3 - w for w in clash]
    texts = [np.array(clash, np.int64), np.array(clash * 3, np.int64)]
    none, cube = runs.find_runs(texts)
    assert none == [] and (0, 3 * 4096, 4096) in cube


@pytest.mark.parametrize("size", [8, 16, 64])
def test_transforms_give_the_zero_differences(size):
    random_ = np.random.default_rng(size)
    flat = np.concatenate([random_.integers(1, 3, 6 * size), np.zeros(2 * size, np.int64)])
    flat[3 * size + 1:4 * size + 1] = flat[size:2 * size]
    for after in (0, 1):
        got = set(zip(*(x.tolist() for x in runs.block_matches(flat, size, after))))
        want = {(b, d) for b in range(6) for d in range(after * size, (after + 1) * size) if (flat[b * size:(b + 1) * size] == flat[b * size + d:(b + 1) * size + d]).all()}
        assert got == want
    x = random_.integers(0, runs.PRIME, (2 * size, 3)).astype(np.uint64)
    assert (runs.back(runs.transform(x)) == x.astype(object) * 2 * size % runs.PRIME).all()


EDGE = [None, "", " \n\t", "one", "a b " * 3000, "Ünï cödé x " * 30, "z " * 23, "z " * 24, "z " * 24, "x" * 50_000 + " y" * 30, "no run here at all"]


def digests(doc_id, text):
    words = SOLID.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {k for a, n, p in found for k in range(a + p, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_run_digests(spark):
    random.seed(3)
    some = [" ".join(random.choice("ab") * random.randint(1, 2) for _ in range(random.randint(0, 300))) for _ in range(60)]
    rows = [(k, t, 1, "x") for k, t in enumerate(EDGE + some)] + [(None, "q " * 30, 1, "x"), (3, "again " * 40, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string").repartition(3)
    got = runs.run_digests(runs.periodic_runs(docs, text=runs.with_planted_runs(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(r[0], r[1]) for r in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    only = runs.periodic_runs(docs.select("text"), keep=("doc_id", "text")).where("text = ''").first()
    assert only["doc_id"] is None and only["n_words"] == 0 and only["runs"] == [] and only["collapsed"] == ""


# -- spelling variants --------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["ab", "abcdé", "".join(chr(0x4E00 + k) for k in range(90))]).flatmap(
    lambda a: st.sets(st.text(alphabet=a, min_size=4, max_size=5), max_size=60)))
def test_near_pairs(words):
    by = {n: sorted(w for w in words if len(w) == n) for n in (4, 5)}
    arrays = {n: spelling._letters(w, n) for n, w in by.items()}
    for n in (4, 5):
        if by[n]:
            got = [frozenset((by[n][i], by[n][j])) for x in spelling.near_pairs(arrays[n], arrays[n]) for i, j in zip(*x)]
            assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in by[n] for b in by[n] if near(a, b)}
    if by[4] and by[5]:
        got = [(by[4][i], by[5][j]) for x in spelling.near_pairs(arrays[4], arrays[5]) for i, j in zip(*x)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in by[4] for b in by[5] if near(a, b)}


def groups(counts):
    close = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in close.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(close[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


@pytest.mark.parametrize("cell", [4096, 12])
def test_spelling_groups(spark, cell):
    random.seed(cell)
    words = {"".join(random.choice("abcé") for _ in range(random.randint(3, 6))) for _ in range(400)}
    chain = {"x" * 5 + "y" * k: 3 * 2 ** k for k in range(1, 12)}  # each is the form of the one before
    counts = {w: random.choice([3, 3, 5, 6, 12, 40]) for w in sorted(words)} | chain | {"q" * 40_000: 3, "q" * 39_999 + "r": 7}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.spelling_groups(rows, sample_words=200, cell=cell)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == groups(counts)
    assert spelling.spelling_groups(rows.limit(0)).count() == 0


def test_variants_of_documents(spark):
    texts = [None, "", "Hello hello HELLO Äpfel äpfel ÄPFEL", "hello hellp hellp hellp helo× helo× helo×", "world " * 5, "worlds " * 2, "abc " * 9, "hello hello"]
    rows = [(k, t, "x") for k, t in enumerate(texts * 2)] + [(None, "worlds worldss", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts[spelling.planted_slips(doc_id, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run))] += 1
    want = groups({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = spelling.variants(docs, spelling.planted_slips).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == want
    assert spelling.variants(docs.limit(0)).count() == 0
    k = next(k for k in range(10_000) if zlib.crc32(f"{k}:hello".encode()) % 97 == 0)
    at = zlib.crc32(f"{k}:hello".encode()) % 5
    assert spelling.planted_slips(k, "hello") == "hello"[:at] + "hello"[at + 1:]


# -- largest inner products ---------------------------------------------------

def brute_products(rows, every, k):
    taken = [(a, [int(np.floor(256 * x)) for x in v]) for a, v in rows if v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    out = []
    for i, (a, v) in enumerate(taken):
        if a is None or a % every:
            continue
        scores = [(-max(min(sum(x * y for x, y in zip(v, w)), 2 ** 63 - 1), -2 ** 63), b is None, b or 0, b) for j, (b, w) in enumerate(taken) if j != i and len(v) == len(w)]
        out += [(a, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("values", [1 << 18, 200])
def test_largest_products(spark, values):
    random.seed(values)
    rows = []
    for i in range(300):
        v = [random.gauss(0, 1) * random.choice([0.1, 1, 5]) for _ in range(random.choice([8, 8, 8, 3, 1, 0]))]
        if i % 29 == 0 and v:
            v[0] = random.choice([None, float("nan"), float("inf"), 1e306])
        if i % 37 == 0:
            v = [x * 1e17 if x else x for x in v]
        rows.append((None if i % 41 == 0 else random.randint(0, 200), None if i % 31 == 0 else v))
    rows += rows[:50] + [(1000 + i, [0.5] * 8) for i in range(100)] + [(7, [0.0] * 8)]
    df = spark.createDataFrame([(a, v, 1, 2) for a, v in rows], "vec_id long, embedding array<double>, row int, level int").repartition(3)
    got = products.largest_products(df, 7, 5, values=values)
    assert sorted(map(tuple, got.collect()), key=str) == brute_products(rows, 7, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert products.largest_products(df.limit(0)).count() == 0


def test_products_of_structured_vectors_are_pruned(monkeypatch):
    random_ = np.random.default_rng(1)
    x = (random_.normal(size=(4000, 32)) * 0.7 ** np.arange(32)) @ np.linalg.qr(random_.normal(size=(32, 32)))[0]
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 1000)  # lengths tell nothing: the partial sums have to prune
    x = x[np.argsort(-(x ** 2).sum(axis=1))]
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    counted, exact = [], products._exact
    monkeypatch.setattr(products, "_exact", lambda q, v, qi, vi, d: counted.append(len(qi)) or exact(q, v, qi, vi, d))
    rows = np.arange(4000)
    qi, vi, score = products.search(x[:200], rows[:200], np.full(200, -np.inf), x, rows, rows, rotation, 5)
    dense = x @ x[:200].T
    dense[rows[:200], rows[:200]] = -np.inf
    for q in range(200):
        assert list(vi[qi == q]) == list(np.lexsort((rows, -dense[:, q]))[:5])
    assert counted and sum(counted) < 0.1 * 200 * 4000
