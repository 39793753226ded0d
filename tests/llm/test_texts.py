"""Operators on documents against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import backoff, decontaminate, kneser_ney, licenses, packing, simhash, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [None, "", " \n\t", "word", "Ünï cödé\u00a0Wörds", "x" * 30_000, "a b " * 6_000, "same text here", "same text here"]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", 0) for k, t in enumerate(texts)], DOCS)


def prose(n, seed, vocabulary=60):
    random.seed(seed)
    some = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(vocabulary)]
    return [" ".join(random.choice(some) for _ in range(random.randint(1, 60))) for _ in range(n)]


# -- words --------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 \n\t.,é\u00a0日-", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for mask, pattern in ((words.ALNUM, ALNUM), (words.SOLID, SOLID)):
        got = []
        for low, high, data, offsets in words.text_blocks(pa.array(texts, pa.string())):
            data = words.LOWER[data]
            starts, ends, doc = words.word_spans(data, offsets, mask)
            got += [(low + int(d), data[s:e].tobytes().decode()) for s, e, d in zip(starts, ends, doc)]
            codes = words.word_codes(data, starts, ends)
            assert codes.tolist() == [words.code_of(w) for _, w in got[len(got) - len(codes):]]
        assert got == [(k, w) for k, t in enumerate(texts) for w in pattern.findall((t or "").translate(LOWER))]


def test_blocks_never_cut_a_text(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 10)
    texts = ["a" * 25, "b", None, "c" * 9, "d"]
    blocks = [(low, high, bytes(data)) for low, high, data, _ in words.text_blocks(pa.array(texts).slice(0))]
    assert [b[:2] for b in blocks] == [(0, 1), (1, 4), (4, 5)] and b"".join(b[2] for b in blocks).decode() == "".join(t or "" for t in texts)
    assert [bytes(b[2]) for b in words.text_blocks(pa.array(texts).slice(3))] == [b"ccccccccc" + b"d"]


# -- SimHash ------------------------------------------------------------------

def fingerprint(text, n=3):
    ws = SOLID.findall((text or "").translate(LOWER))
    shingles = [" ".join(ws[k:k + n]) for k in range(max(1, len(ws) - n + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(spark):
    base = prose(60, 1)
    texts = EDGE + base + base[:10] + [t + " more" for t in base[:20]] + [t.upper() for t in base[:5]]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = {k: fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r["fp"] % 2 ** 64 for k, r in got.items()} == fps
    roots = linked(set(fps.values()), 3)
    least = defaultdict(lambda: 10 ** 9)
    for k, f in fps.items():
        least[roots[f]] = min(least[roots[f]], k)
    assert {k: r["component_id"] for k, r in got.items()} == {k: least[roots[f]] for k, f in fps.items()}


@pytest.mark.parametrize("distance", [1, 3, 6])
@pytest.mark.parametrize("group_rows", [16, 8192])
def test_links_lose_no_pair(spark, distance, group_rows):
    random.seed(distance)
    fps = {random.getrandbits(64) for _ in range(150)}
    centre = random.getrandbits(64)
    for _ in range(250):  # a crowd around one value, and pairs just inside and outside the distance
        fps.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))))
    for f in list(fps)[:80]:
        fps.add(f ^ sum(1 << b for b in random.sample(range(64), distance + random.randint(0, 1))))
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    nodes = spark.createDataFrame([(f, f) for f, in signed], "node long, fp long")
    from twinfold.llm.tables import components
    edges = simhash.links(nodes, distance, group_rows)
    got = {r["node"] % 2 ** 64: r["root"] % 2 ** 64 for r in components(edges).collect()}
    expected = linked(fps, distance)
    same = lambda roots: {frozenset(f for f in fps if roots.get(f, f) == r) for r in {roots.get(f, f) for f in fps}}
    assert same(got) == same(expected)


@pytest.mark.parametrize("group_rows", [16, 8192])
def test_links_of_several_fingerprints(spark, group_rows):
    random.seed(group_rows)
    flipped = lambda f, most: f ^ sum(1 << b for b in random.sample(range(64), random.randint(0, most)))
    centre = [random.getrandbits(64) for _ in range(3)]
    texts = [[flipped(f, 6) for f in centre] for _ in range(120)]  # a crowd in which only some are near
    for _ in range(60):
        one = [random.getrandbits(64) for _ in range(3)]
        texts += [one, [flipped(f, 14) for f in one], [flipped(f, 7) for f in one]]
    names = ("x", "y", "z")
    signed = [(k, *(f - 2 ** 64 if f >= 2 ** 63 else f for f in t)) for k, t in enumerate(texts)]
    from twinfold.llm.tables import components
    edges = simhash.links(spark.createDataFrame(signed, "node long, x long, y long, z long"), 3, group_rows, names, 15)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            apart = [(x ^ y).bit_count() for x, y in zip(texts[a], texts[b])]
            if min(apart) <= 3 and sum(apart) <= 15 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) < len(texts) and [got.get(k, k) for k in range(len(texts))] == root


def test_mixed_fingerprints(spark):
    texts = EDGE + prose(20, 8)
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in simhash.fingerprints(docs, names=("p", "q")).collect()}
    assert {k: r["p"] % 2 ** 64 for k, r in got.items()} == {k: fingerprint(t) for k, t in enumerate(texts)}
    apart = [((r["p"] ^ r["q"]) % 2 ** 64).bit_count() for k, r in got.items() if texts[k] and texts[k].strip()]
    assert min(apart) > 10 and {r["q"] for k, r in got.items() if not (texts[k] or "").strip()} == {0}


def test_near_copies_go_and_others_stay(spark):
    random.seed(11)
    some = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(3000)]
    texts, copies = [], set()
    for k in range(60):
        words_ = random.choices(some, k=random.randint(200, 500))
        texts.append(" ".join(words_))
        other = list(words_)
        for at in range(len(words_) // 120):  # about 1 word in 120: similarity about 0.92
            other[at * 120 + random.randrange(100)] = random.choice(some)
        copies.add(len(texts))
        texts.append(" ".join(other))
        texts.append(" ".join(words_[:len(words_) // 2] + random.choices(some, k=len(words_) // 2)))  # half of it: similarity about 1 in 3
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, texts)).collect()}
    assert set(range(len(texts))) - copies <= kept and len(copies & kept) <= 2


def shingles(text, n=5):
    some = text.translate(LOWER).split()
    return {tuple(some[k:k + n]) for k in range(max(1, len(some) - n + 1))}


def jaccard(x, y):
    return len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))


def test_near_copies_are_those_of_the_shingles(spark):
    random.seed(12)
    some = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(2000)]
    texts = []
    for length in [20, 25, 30, 40, 60, 100, 200, 400] * 12:
        words_ = random.choices(some, k=length)
        texts.append(" ".join(words_))
        for changed in (1, 2, 4, 8):  # similarities on both sides of 0.8
            other = list(words_)
            for at in random.sample(range(length), min(changed, length // 20)):
                other[at] = random.choice(some)
            texts.append(" ".join(other))
        texts.append(" ".join([*words_, *random.choices(some, k=length // 5)]))
    root = list(range(len(texts)))
    for low in range(0, len(texts), 6):
        for _ in range(6):
            for i in range(low, low + 6):
                for j in range(low, low + 6):
                    if jaccard(texts[i], texts[j]) >= 0.8:
                        root[i] = root[j] = min(root[i], root[j])
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, texts)).collect()}
    assert kept == {k for k in range(len(texts)) if root[k] == k}


def test_pairs_across_the_components_of_a_band_are_verified(spark):
    some = [f"w{k}" for k in range(400)]
    # One band value holds all four; only the last two are near, and the smallest is near to none.
    texts = [" ".join(some[:100]), " ".join(some[100:200]), " ".join(some[200:300]), " ".join([*some[200:299], "other"])]
    rows = frame(spark, texts).withColumn("_row", simhash.F.col("doc_id"))
    nodes = spark.createDataFrame([(k, 7) for k in range(4)], "node long, band0 long")
    got = simhash.copy_roots(rows, nodes, ["band0"], 5, 0.8).collect()
    assert {(r["node"], r["root"]) for r in got} == {(2, 2), (3, 2)}


@pytest.mark.parametrize("nodes_", [3, 256])
def test_large_band_values_are_compared_in_blocks(spark, monkeypatch, nodes_):
    """One band value holds all texts: the components are those of all pairs of 0.8 or more, however the blocks fall."""
    monkeypatch.setattr(simhash, "BLOCK_NODES", nodes_)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 50)
    random.seed(nodes_)
    texts = []
    for _ in range(6):
        base = [random.choice("abcdefghij") + str(random.randint(0, 50)) for _ in range(60)]
        for _ in range(8):
            base = list(base)
            for _ in range(random.randint(0, 2)):
                base[random.randint(0, 59)] = f"new{random.randint(0, 999)}"
            texts.append(" ".join(base))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(56)} for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    rows = frame(spark, texts).withColumn("_row", simhash.F.col("doc_id"))
    nodes = spark.createDataFrame([(k, 7) for k in range(len(texts))], "node long, band0 long")
    got = {r["node"]: r["root"] for r in simhash.copy_roots(rows, nodes, ["band0"], 5, 0.8).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == root and len(set(root)) < len(texts)
    ones, others = pa.array(texts[:5] + [None, ""]), pa.array(texts[3:9])
    whole = simhash.block_similarities(ones, others)
    assert np.allclose(whole, [simhash.similarities(pa.array([x.as_py()] * 6, pa.string()), others) for x in ones])


def test_a_column_named_like_the_row_number_stays(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k}", 70 + k, 5) for k in (1, 2, 2)], "doc_id long, text string, _row long, row_of_input long")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "some words of text number 1", 71, 5), (2, "some words of text number 2", 72, 5)]


def test_thresholds_cover_every_pair():
    random.seed(3)
    fps = np.array([random.getrandbits(64) for _ in range(200)], np.uint64)
    for distance in (1, 3, 6):
        parts = simhash.plan(fps, 10_000, distance)
        assert sorted(b for group, _ in parts for b in group) == list(range(64))
        assert sum(t for _, t in parts) == distance - len(parts) + 1


def test_one_row_of_each_component_stays(spark):
    base = prose(20, 4)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(base + base[:7])] + [(None, base[0], "en", "s", 0), (3, base[3], "en", "s", 0), (None, "alone and without id", "en", "s", 0)]
    got = simhash.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["text"] for r in got) == sorted({r[1] for r in rows})
    assert {r["doc_id"] for r in got} == {*range(20), None}
    empty = spark.createDataFrame([], DOCS)
    assert simhash.deduplicated(empty).columns == empty.columns and simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, fp long")).columns == ["doc_id", "fp", "component_id"]


# -- packing ------------------------------------------------------------------

def test_packing_round_trip(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = EDGE + prose(80, 5) + ["a<|endoftext|>b", "It's WE'LL café\u0301 x.", "日本語 ﬁ ẞ ½.", "end. <|STARTOFTEXT|> x"]
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    got = packing.pack(frame(spark, texts), capacity=64, group_pieces=50, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[r["doc_id"]][r["start"]] = r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, i in enumerate(ids):
        assert sum(by_doc[k].values()) == len(i) and sorted(by_doc[k]) == list(range(0, len(i), 64))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    plain = packing.pack(spark.createDataFrame([(1, "a", 9)], "doc_id long, text string, length long")).first()
    assert plain["length"] == 2 and plain["sequence_id"] is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 20)
    room, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(20)
        expected[i] = (k, 20 - room[k])
        room[k] -= sizes[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [expected[i] for i in range(len(sizes))]


# -- decontamination ----------------------------------------------------------

def test_search_finds_all_above_the_threshold():
    items = [(k, *decontaminate.question_and_answer(t)) for k, t in enumerate(prose(150, 6, 40) + ["", "one"])]
    index = decontaminate.Index(items, 0.3)
    random.seed(1)
    for _ in range(40):
        terms = sorted(random.sample(range(len(index.codes)), 12))
        score = Counter()
        for t in terms:
            for k, x in zip(*index.postings[t]):
                score[k] += x
        expected = {k: s for k, s in score.items() if s >= 0.3 - 1e-9}
        got = dict(index.search(terms))
        assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)
        if expected:
            passage = np.full((1, 64), len(index.codes))
            passage[0, :12] = terms
            assert index.may_match(passage).tolist() == [0]


def test_planted_items_are_found(spark):
    random.seed(2)
    items = [(k, f"{t}. {u} yes indeed.") for k, (t, u) in enumerate(zip(prose(30, 7, 400), prose(30, 8, 400))) if len(t.split()) > 6]
    items.append((99, " ".join(prose(4, 9, 500)) + " " + " ".join(prose(4, 10, 500)) + ". And the answer."))
    noise = prose(40, 11, 900)
    texts = list(noise) + EDGE
    expected = set()
    for k, (item, text) in enumerate(items):
        expected.add((len(texts), item))
        texts.append(noise[k % 40] + " " + (text.upper() if k % 2 else text.replace(" ", "\n")) + " " + noise[(k + 1) % 40])
        texts.append(text.split(".")[0])  # the question alone
    docs = frame(spark, texts)
    table = spark.createDataFrame([*items, (None, None), (7777, "")], "item_id long, text string")
    for shard_items in (20_000, 9):
        got = decontaminate.matches(docs, table, shard_items=shard_items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expected
        clean = decontaminate.decontaminated(docs, table, shard_items=shard_items)
        assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.decontaminated(docs, none).count() == len(texts)
    assert decontaminate.matches(spark.createDataFrame([], DOCS), table).count() == 0
    given_ = spark.createDataFrame([(1, "alpha beta gamma delta", "epsilon zeta eta")], "item_id long, question string, answer string")
    found = decontaminate.matches(frame(spark, ["x alpha beta gamma delta epsilon zeta eta y", "alpha beta gamma delta"]), given_).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(0, 1)]


# -- licences -----------------------------------------------------------------

def test_scores_do_not_depend_on_the_shards(spark):
    random.seed(31)
    words_ = [f"w{k}" for k in range(150)]
    items = [(k, " ".join(random.choice(words_) for _ in range(random.choice([8, 20, 70]))) + ". " + " ".join(random.choice(words_) for _ in range(5)) + ".") for k in range(40)]
    items += [(40, None), (41, ""), (42, "one"), (None, items[0][1]), (3, items[3][1])]
    texts = [" ".join([*(random.choice(words_) for _ in range(30)), random.choice(items[:40])[1], random.choice(items[:40])[1][:90]]) for _ in range(40)] + [None, "", "one two " * 3000]
    docs, table = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(tuple, decontaminate.matches(docs, table, threshold=0.3, shard_items=n).collect()), key=str) for n in (20_000, 7))
    assert len(whole) > 40 and whole == parts


def test_an_item_is_found_behind_its_question_alone(spark):
    question, answer = [f"q{k}" for k in range(64)], [f"a{k}" for k in range(20)]
    noise = [f"n{k}" for k in range(640)]
    item = spark.createDataFrame([(1, " ".join(question), " ".join(answer))], "item_id long, question string, answer string")
    texts = [[*question, *noise, *question, *answer], [*question, *noise, *noise, *answer], [*noise, *question, *noise, *question, *noise, *question, *answer]]
    docs = frame(spark, [" ".join(t) for t in texts])
    got = {r["doc_id"]: r for r in decontaminate.matches(docs, item).collect()}
    assert got.keys() == {0, 2} and got[0]["first_word"] >= 640 and got[2]["first_word"] >= 1984 - 64
    assert all(r["question_overlap"] == r["answer_overlap"] == 1 for r in got.values())
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, item).collect()] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=20))
def test_matching_statistics(texts, stream):
    automaton = licenses.Automaton(texts)
    state = length = 0
    for k, w in enumerate(stream):
        state, length = automaton.step(state, length, automaton.word[w]) if w in automaton.word else (0, 0)
        runs = [n for n in range(k + 2) if any(t[i:i + n] == stream[k + 1 - n:k + 1] for t in texts for i in range(len(t) - n + 1))]
        assert length == max(runs)
        if length:
            run = stream[k + 1 - length:k + 1]
            ends = {(i, j + length) for i, t in enumerate(texts) for j in range(len(t) - length + 1) if t[j:j + length] == run}
            assert set(automaton.ends[state]) == ends


def test_license_scan(spark):
    apache = next(t for label, t in licenses.NOTICES if label == "apache" and "compliance" in t)
    bsd = next(t for label, t in licenses.NOTICES if label == "bsd")
    cut = bsd.split()
    texts = EDGE + [
        "Released under the MIT License. the mit license MIT  license", "cc by cc-by CC BY", "a gnu general public licence", f"head {apache} tail",
        "GNU General Public License" * 3, " ".join(cut[:20] + ["inserted", "words"] + cut[20:]), "the of and to the license of the software",
        "mit", "license mit", "Apache\x00License",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        ws = ALNUM.findall((text or "").translate(LOWER))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
        r, at = got[k], [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    base = len(EDGE)
    assert got[base + 3]["labels"] == "apache" and got[base + 3]["score"] == 1
    span = max(got[base + 3]["spans"], key=lambda s: s["last_word"])
    assert (span["first_word"], span["last_word"]) == (1, len(ALNUM.findall(apache.translate(LOWER))))
    assert got[base + 5]["labels"] == "bsd" and got[base + 5]["score"] > 0.9
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


# -- stupid backoff -----------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, monkeypatch, order):
    monkeypatch.setattr(backoff, "CHUNK_CHARS", 2_000)
    monkeypatch.setattr(backoff, "TABLE_CHARS", 3_000)
    texts = EDGE[:5] + prose(120, 12) + ["same text here"] * 5
    ws = [ALNUM.findall((t or "").translate(LOWER)) for t in texts]
    counts = Counter(tuple(w[i:i + n]) for w in ws for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, ws))

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * score(gram[1:])

    got = {r["doc_id"]: r for r in backoff.score(frame(spark, texts), order=order).collect()}
    for k, w in enumerate(ws):
        expected = sum(math.log(score(tuple(w[max(0, i - order + 1):i + 1]))) for i in range(len(w)))
        assert got[k]["n_words"] == len(w) and math.isclose(got[k]["log_score"], expected, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[k]["word_score"] is None) == (not w)
    assert backoff.score(spark.createDataFrame([], DOCS)).count() == 0


# -- Kneser-Ney ---------------------------------------------------------------

def brute_kneser_ney(training, least):
    """Probability function of the interpolated modified Kneser-Ney trigram model of token lists."""
    seen = Counter(t for d in training for t in d)
    mapped = lambda t: t if seen[t] >= least else "<" + kind(t) + ">"
    three = Counter()
    for d in training:
        p = ["<s>", "<s>", *map(mapped, d)]
        three.update(zip(p, p[1:], p[2:]))
    two, one = Counter(k[1:] for k in three), Counter()
    one.update(k[1] for k in two)

    def discount(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        return [max(0.1, min(k - 0.1, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5)) for k in (1, 2, 3)]

    d = [discount(c) for c in (one, two, three)]
    off = lambda ds, n: ds[min(n, 3) - 1]
    total = sum(one.values())
    floor = sum(off(d[0], n) for n in one.values()) / total / (len(one) + 1)
    p1 = lambda c: (one[c] - off(d[0], one[c])) / total + floor if c in one else floor

    def level(counts, ds, lower, gram):
        rest = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not rest:
            return lower
        own = (counts[gram] - off(ds, counts[gram])) / sum(rest) if gram in counts else 0.0
        return own + sum(off(ds, n) for n in rest) / sum(rest) * lower

    return lambda a, b, c: level(three, d[2], level(two, d[1], p1(c), (b, c)), (a, b, c)), mapped


def kind(token):
    if token[0].isdigit():
        return "digits"
    if not (token[0].isalpha() or ord(token[0]) > 127):
        return "marks"
    upper = [("A" <= x <= "Z") for x in token]
    return "upper" if all(upper) and len(token) > 1 else "capital" if upper[0] else "lower"


def tokens(text):
    return re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-~]+", text or "")


@pytest.mark.parametrize("shard_tokens, held_bytes", [(1 << 18, 1 << 27), (20, 0)])
def test_perplexity_is_that_of_the_model(spark, shard_tokens, held_bytes):
    training = [t.capitalize() + "." for t in prose(40, 13, 25)] + ["THE END 12 34!!", "Über den Fluss."]
    sample = spark.createDataFrame([(k, t, "en") for k, t in enumerate(training)], "doc_id long, text string, lang string")
    model = kneser_ney.train(sample, least_count=2, shard_tokens=shard_tokens, held_bytes=held_bytes)
    probability, mapped = brute_kneser_ney([tokens(t) for t in training], 2)
    texts = EDGE[:5] + training[:5] + prose(10, 14, 50) + ["ALL CAPS!! 99 %%%", "??"]
    docs = frame(spark, texts)
    for r in kneser_ney.perplexities(docs, model, held_bytes).collect():
        p = ["<s>", "<s>", *map(mapped, tokens(r["text"]))]
        assert r["n_tokens"] == len(p) - 2
        if len(p) == 2:
            assert r["perplexity"] is None
            continue
        expected = math.exp(-sum(math.log(probability(*p[i:i + 3])) for i in range(len(p) - 2)) / (len(p) - 2))
        assert math.isclose(r["perplexity"], expected, rel_tol=1e-6)


def test_sample_holds_all_trusted_documents_up_to_its_bound(spark):
    docs = spark.range(1300).selectExpr("id AS doc_id", "'a b c' AS text", "'en' AS lang")
    assert kneser_ney.training_sample(docs, docs.select("doc_id")).count() == 1300


def test_every_language_has_a_threshold(spark):
    clean = prose(12, 16, 20)
    rows = [(100 * k + i, t, f"l{k}", "s", 0) for k in range(40) for i, t in enumerate(clean)]
    rows += [(100 * k + 50, "QX$ #ZZ 9&& " * 40, f"l{k}", "s", 0) for k in range(40)] + [(9999, "QX$ " * 40, None, "s", 0)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] % 100 < 12], "doc_id long, quality int, toxic int")
    got = kneser_ney.judged(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if not r["kept"]} == {100 * k + 50 for k in range(40)}
    assert all((r["threshold"] is None) == (r["lang"] is None) for r in got)
    by_place = defaultdict(set)
    for r in got:
        by_place[r["doc_id"] % 100].add(None if r["perplexity"] is None else round(r["perplexity"], 3))
    assert all(len(by_place[i]) == 1 for i in range(12))  # the same text in every language


def test_quantiles_are_exact(spark):
    random.seed(8)
    values = {lang: [random.choice([1.0, 2.5, random.uniform(1, 900)]) for _ in range(n)] for lang, n in (("en", 700), ("de", 1), ("fr", 50))}
    rows = spark.createDataFrame([(lang, v) for lang, vs in values.items() for v in vs], "lang string, value double").repartition(3)
    for share in (0.0, 0.5, 0.98, 0.999, 1.0):
        got = dict(map(tuple, kneser_ney._quantile(rows, share).collect()))
        assert got == {lang: sorted(vs)[max(math.ceil(share * len(vs)), 1) - 1] for lang, vs in values.items()}


def test_thresholds_and_clashing_columns(spark):
    """Figures of judged() from its own perplexities, with columns of every name that it uses itself."""
    random.seed(6)
    texts = prose(90, 21)
    names = "_row _lang _text _known _usual lang_as_text text_as_text usual value seen cell number rank kept sub n".split()
    rows = [(k, t, random.choice(["en", "de"]), *range(k, k + len(names))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    labels = spark.createDataFrame([(k, k % 3 and 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = kneser_ney.judged(docs, labels, quantile=0.8, sample_docs=8).collect()
    assert len(got) == 90 and all([r[n] for n in names if n != "kept"] == [r["doc_id"] + k for k, n in enumerate(names) if n != "kept"] for r in got)
    seen = {(r["doc_id"], r["lang"]) for r in kneser_ney.training_sample(docs, labels.where("quality = 1").select("doc_id"), 8).collect()}
    for lang in ("en", "de"):
        own = [r for r in got if r["lang"] == lang]
        trusted = [r for r in own if r["doc_id"] < 60 and r["doc_id"] % 3]
        usual = sorted(r["perplexity"] for r in trusted)[math.ceil(len(trusted) / 2) - 1]
        drawn = lambda r: math.exp((r["n_tokens"] * math.log(r["perplexity"]) + 10 * math.log(usual)) / (r["n_tokens"] + 10))  # noqa: E731, B023
        unseen = sorted(drawn(r) for r in trusted if (r["doc_id"], lang) not in seen)
        limit = unseen[math.ceil(0.8 * len(unseen)) - 1]
        for r in own:
            assert math.isclose(r["judged_perplexity"], drawn(r), rel_tol=1e-9) and math.isclose(r["threshold"], limit, rel_tol=1e-9)
            assert r["kept"] == (r["judged_perplexity"] <= r["threshold"])


def test_quality_keeps_the_clean(spark):
    clean = prose(200, 15)
    random.seed(5)
    junk = ["".join(random.choice("QZX#$%&@") for _ in range(6)) + " " + "".join(random.choice("QZX#$%&@ ") for _ in range(200)) for _ in range(20)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(clean + junk)]
    rows += [(500, "anything", "xx", "s", 0), (501, "anything", None, "s", 0), (502, None, "en", "s", 0), (None, clean[0], "en", "s", 0), (0, clean[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(200, 0, 0), (None, 1, 0), (1, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = kneser_ney.judged(docs, labels, sample_docs=60).collect()
    kept = Counter((r["doc_id"] if r["doc_id"] is not None else -1) for r in got if r["kept"])
    assert len(got) == len(rows) and sum(kept[k] > 0 for k in range(200)) >= 196
    assert not any(kept[k] for k in range(200, 220)) and kept[500] and kept[501] and kept[502] and kept[-1] and kept[0] == 2
    assert kneser_ney.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("not kept").count() == 0
    assert kneser_ney.judged(spark.createDataFrame([], DOCS), labels).count() == 0


def test_model_is_trained_on_all_trusted_documents(spark, monkeypatch):
    rows = spark.range(3300).selectExpr("id AS doc_id", "concat('a b c w', id % 1700) AS text", "if(id % 3 = 0, 'de', 'en') AS lang")
    taught = []
    train = kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda texts, *more: taught.extend(r["text"] for r in texts.collect()) or train(texts, *more))
    got = kneser_ney.judged(rows, rows.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert got.where("perplexity is not null and threshold is not null").count() == 3300
    assert Counter(taught) == Counter(f"a b c w{k % 1700}" for k in range(3300))


def test_texts_are_judged_by_the_other_fold(spark):
    texts = [t.capitalize() + "." for t in prose(30, 17, 20)]
    texts += texts[:5] + ["junk JUNK 99 !!", ""]
    docs = frame(spark, texts)
    fold = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", kneser_ney._fold(docs).alias("fold")).collect()}
    labels = spark.createDataFrame([(k, 1, 0) for k in range(35)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(docs, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    models = [brute_kneser_ney([tokens(text[k]) for k in range(35) if fold[k] == 1 - f], 3) for f in (0, 1)]
    assert len(got) == len(texts) and {fold[k] for k in range(35)} == {0, 1}
    for k, r in got.items():
        probability, mapped = models[fold[k]]
        p = ["<s>", "<s>", *map(mapped, tokens(text[k]))]
        expected = math.exp(-sum(math.log(probability(*p[i:i + 3])) for i in range(len(p) - 2)) / (len(p) - 2)) if len(p) > 2 else None
        assert r["perplexity"] is None if expected is None else math.isclose(r["perplexity"], expected, rel_tol=1e-6)


def test_words_have_shards_by_their_own_number(spark):
    """Every task reads all words of a language, so their files may not be as many as those of its trigrams."""
    texts = prose(60, 19, 40)
    model = kneser_ney.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), shard_tokens=300)
    files = lambda folder: len(spark.read.parquet(folder).inputFiles())
    assert files(model.grams) >= 4 and files(model.words) == 1


def test_packed_trigrams_go_many_at_a_time():
    schema = pa.schema([("lang", pa.int64()), ("code", pa.binary())])
    got = list(kneser_ney._sent(((k, b"x" * k) for k in range(1200)), schema))
    assert [b.num_rows for b in got] == [500, 500, 200] and pa.Table.from_batches(got).to_pylist() == [{"lang": k, "code": b"x" * k} for k in range(1200)]


@pytest.mark.parametrize("n", [5, 10_000])
def test_places_among_the_values_in_use(n):
    columns = [np.array([4, 1, 1]), np.array([0, 4, 3]), np.array([1, 1, 4])]
    used, places = kneser_ney._places(n, *columns)
    assert used.tolist() == [0, 1, 3, 4] and all((used[p] == x).all() for p, x in zip(places, columns))


def test_texts_are_shuffled_once(spark):
    docs = frame(spark, prose(20, 18, 20))
    model = kneser_ney.train(docs.select("lang", "text"))
    scored = kneser_ney.perplexities(docs, model, keep=("doc_id", "lang"), chunk_bytes=500)
    assert sorted(r["doc_id"] for r in scored.collect()) == list(range(20))
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [0, 3])
def test_chunk_asks_by_document(bits):
    texts = ["a b a b.", "", "b a b a b a", None, "a b a b.", "x" * 300 + " a b"]
    languages = ["en", "en", "de", "en", "en", None]
    salts = kneser_ney._salts(languages)
    marks = np.append(kneser_ney.SHAPES, kneser_ney.START)
    every = np.array([words.code_of(w) for w in ("a", "b", ".")], np.uint64)

    class Known:
        def get(self, folder, language, shard, kinds):
            found = np.sort(words.mix(every ^ np.array(language).view(np.uint64)))
            return {"code": found[kneser_ney.shard_of(found, bits) == shard]}

        def vocabulary(self, folder, language, kinds, bits):
            return np.sort(words.mix(np.concatenate([marks, every]) ^ np.array(language).view(np.uint64)))

    asked, held_by = Counter(), Counter()
    for lang, sub, (code, ac, b, doc) in kneser_ney._asked(Known(), kneser_ney.Model("w", "g", "f", bits), pa.array(texts, pa.string()), pa.array(languages, pa.string())):
        used = Known().vocabulary("w", lang, None, bits)[kneser_ney._codes_in(kneser_ney._unpressed(code))]
        a, c = kneser_ney._from_planes(ac).reshape(2, -1)
        b = kneser_ney._from_planes(b)
        which, held = kneser_ney._texts_of(doc)
        assert len(set(which)) == len(which) and (kneser_ney.shard_of(used[b], bits) == sub).all()
        held_by.update(dict(zip(which.tolist(), held.tolist())))
        asked.update(zip(np.repeat(which, held).tolist(), used[a].tolist(), used[b].tolist(), used[c].tolist()))
    expected = Counter()
    for k, text in enumerate(texts):
        code = lambda w: int(words.mix(np.array([w], np.uint64) ^ salts[k])[0])
        row = [words.code_of(w) if w in ("a", "b", ".") else int(kneser_ney.SHAPES[0]) for w in tokens(text)]
        row = [code(w) for w in [int(kneser_ney.START)] * 2 + row]
        expected.update((k, *row[i:i + 3]) for i in range(len(row) - 2))
    assert asked == expected
    assert held_by == Counter({k: len(tokens(t)) for k, t in enumerate(texts) if t})


def test_only_trusted_texts_are_shuffled_for_training(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "'en' AS lang", "repeat(concat('w', id, ' '), 20) AS text").write.parquet(f"{tmp_path}/docs")
    spark.range(40).selectExpr("id * 10 AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels")
    most, plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = kneser_ney.stored

    def watched(df, name):
        if name == "training-text":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            assert sorted(int(r["text"].split()[0][1:]) for r in df.collect()) == list(range(0, 400, 10))
        return store(df, name)

    kneser_ney.stored = watched
    try:
        assert kneser_ney.judged(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels"), keep=("doc_id", "lang")).count() == 400
    finally:
        kneser_ney.stored = store
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(plans) == 1 and "might_contain" in plans[0]
