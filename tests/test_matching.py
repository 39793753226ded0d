import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.operators import heavy, match, partners, review
from twinfold.operators.dedupe import dedupe_best
from twinfold.operators.resolve import greedy_one_to_one, resolve_one_to_one

FIELDS = ("worker_id", "recon_id", "full_name_norm", "dob", "last4_ssn", "last_name_norm", "hire_date", "location_state")


def snapshot(spark, rows):
    schema = "src_ord bigint, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([(i, *[r.get(f) for f in FIELDS]) for i, r in enumerate(rows)], schema)


def person(i, **changes):
    base = dict(worker_id=f"w{i}", recon_id="", full_name_norm=f"first{i} last{i}", dob=f"19{50 + i % 50}-01-01",
                last4_ssn=f"{1000 + i}", last_name_norm=f"last{i}", hire_date=f"2010-01-{1 + i % 28:02d}", location_state="TX")
    return {**base, **changes}


def links(spark, old, new, **options):
    result = match.tiered_match(snapshot(spark, old), snapshot(spark, new), **options)
    return sorted((r["old_row"], r["new_row"], r["match_source"]) for r in result.links.collect()), result


def test_tiers_in_order(spark):
    old = [person(i) for i in range(6)]
    old[1]["recon_id"] = "R1"
    new = [
        person(0, worker_id=" W0 "),                                   # id, case-blind and trimmed
        person(1, worker_id="x1", recon_id="r1", dob="2000-01-01"),    # recon id
        person(2, worker_id="x2"),                                     # name + birth date + digits
        person(3, worker_id="x3", full_name_norm="other name"),        # digits + birth date
        person(4, worker_id="x4", last4_ssn="9999"),                   # birth date + name
        person(5, worker_id="x5", last4_ssn="9998", dob="2001-02-03"), # last name + hire date
    ]
    found, result = links(spark, old, new)
    assert found == [(0, 0, "worker_id"), (1, 1, "recon_id"), (2, 2, "pk"), (3, 3, "last4_dob"),
                     (4, 4, "dob_name"), (5, 5, "name_hire_date")]
    report = match.match_report(result).first()
    assert report["matched_total"] == 6 and report["unmatched_old"] == 0


def test_ambiguous_keys_are_discarded_on_either_side(spark):
    old = [person(0), person(1, worker_id="w0", full_name_norm="z", last4_ssn="1", last_name_norm="z")]
    new = [person(0)]
    found, result = links(spark, old, new)
    # The shared id is ambiguous, the next tiers still link the right person.
    assert found == [(0, 0, "pk")]
    reasons = [(r["src_ord"], r["unmatched_reason"]) for r in result.unmatched_old.collect()]
    assert reasons == [(1, "no_match_found")]


def test_blank_ids_leave_before_the_first_tier(spark):
    old, new = [person(0)], [person(0, worker_id=" ")]
    found, result = links(spark, old, new)
    assert found == []
    assert [r["unmatched_reason"] for r in result.unmatched_new.collect()] == ["no_id"]
    found, _ = links(spark, old, new, allow_blank_id=True)
    assert found == [(0, 0, "pk")]


def test_composite_of_blanks_is_a_key(spark):
    blank = dict(recon_id="", full_name_norm="", dob="", last4_ssn="", last_name_norm="", hire_date="")
    old, new = [person(0, worker_id="a", **blank)], [person(0, worker_id="b", **blank)]
    assert links(spark, old, new)[0] == [(0, 0, "pk")]
    assert links(spark, old, new, require_all_parts=True)[0] == []


def test_hot_key_does_not_disturb_the_rest(spark):
    """A third of the rows share every weaker key."""
    n = 3000
    hot = dict(full_name_norm="same name", dob="1990-01-01", last4_ssn="0000", last_name_norm="same", hire_date="2020-01-01")
    old = [person(i, **(hot if i % 3 == 0 else {}), ) for i in range(n)]
    new = [person(i, worker_id=f"n{i}", **(hot if i % 3 == 0 else {})) for i in range(n)]
    found, result = links(spark, old, new)
    assert all(a == b for a, b, _ in found)
    assert {a for a, _, _ in found} == {i for i in range(n) if i % 3}
    assert result.unmatched_old.count() == n // 3


@pytest.mark.parametrize("old_name, new_name, source", [
    ("jos garca", "jose garcia", "last4_dob"),            # accents
    ("nancy roman smith", "nancy smith", "last4_dob"),    # middle name
    ("john smith", "john smith jr", "last4_dob"),         # suffix
    ("mary o'neil", "mary oneil", "last4_dob"),           # apostrophe
])
def test_name_variants_link_by_digits(spark, old_name, new_name, source):
    old = [person(0, full_name_norm=old_name)]
    new = [person(0, worker_id="other", full_name_norm=new_name)]
    assert links(spark, old, new)[0] == [(0, 0, source)]


def test_confidence_and_name_change(spark):
    old = snapshot(spark, [person(0), person(1, last_name_norm="garcía"), person(2, last_name_norm="smith")])
    new = snapshot(spark, [person(0), person(1, worker_id="x", last_name_norm="Garcia", location_state="CA"),
                           person(2, worker_id="y", last_name_norm="jones")])
    result = match.tiered_match(old, new)
    rows = {r["old_worker_id"]: r for r in match.pair_rows(result, old, new).collect()}
    assert rows["w0"]["confidence"] == 1.0
    assert rows["w1"]["confidence"] == pytest.approx(0.9) and not rows["w1"]["name_change_detected"]
    assert rows["w2"]["confidence"] == 1.0 and rows["w2"]["name_change_detected"]


def sequential(edges):
    used_old, used_new, kept = set(), set(), set()
    for rank, order, o, n in sorted(edges, key=lambda e: (-e[0], e[1])):
        if o not in used_old and n not in used_new:
            used_old.add(o)
            used_new.add(n)
            kept.add(order)
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 3), i, f"o{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for i in range(150)]
    # One key holds a third of the edges.
    edges += [(rng.randint(0, 3), 1000 + i, "hot", f"n{rng.randint(0, 60)}") for i in range(75)]
    df = spark.createDataFrame(edges, "r int, ord bigint, o string, n string")
    kept = greedy_one_to_one(df, "o", "n", F.col("r"), "ord")
    assert {r["ord"] for r in kept.collect()} == sequential(edges)


def test_resolution_reports_conflicts(spark):
    rows = [("a", "x", "pk", 0), ("a", "y", "worker_id", 1), ("b", "x", "dob_name", 2), ("", "z", "pk", 3), ("a", "y", "pk", 4)]
    df = spark.createDataFrame(rows, "old_worker_id string, new_worker_id string, match_source string, cand_ord bigint")
    done = resolve_one_to_one(df)
    pairs = lambda d: sorted((r["old_worker_id"], r["new_worker_id"]) for r in d.collect())
    assert pairs(done.pairs) == [("a", "y"), ("b", "x")]
    # The repeat of the kept pair is neither kept nor a conflict.
    assert pairs(done.conflicts_old) == [("a", "x")] and pairs(done.conflicts_new) == [("a", "x")]
    assert pairs(done.skipped_missing) == [("", "z")]


def test_dedupe_keeps_the_best_row_and_all_blanks(spark):
    rows = [
        (0, "w1", "", "active", "2020-01-01", "100", ""), (1, "W1 ", "", "active", "2021-01-01", "50", ""),
        (2, "w1", "", "left", "2022-01-01", "900", ""), (3, "", "", "active", "", "", ""), (4, " ", "", "active", "", "", ""),
        (5, "w2", "R", "active", "2020-01-01", "1", ""), (6, "w3", "r", "active", "2020-01-01", "2", ""),
        (7, "w4", "", "active", "2020-01-01", "7", ""), (8, "w4", "", "active", "2020-01-01", "7", "")]
    df = spark.createDataFrame(
        rows, "src_ord bigint, worker_id string, recon_id string, worker_status string, hire_date string, salary string, payrate string")
    assert sorted(r["src_ord"] for r in dedupe_best(df).collect()) == [1, 3, 4, 6, 7]


def brute_pairs(old, new):
    sim = lambda a, b: __import__("difflib").SequenceMatcher(None, a, b).ratio()
    found = set()
    for i, o in enumerate(old):
        for j, n in enumerate(new):
            if o["last4_ssn"] != n["last4_ssn"]:
                continue
            score = (o["dob"] == n["dob"]) + (o["dob"][:4] == n["dob"][:4]) + (o["last_name_norm"][:3] == n["last_name_norm"][:3])
            score += (o["location_state"] == n["location_state"]) + (sim(o["full_name_norm"], n["full_name_norm"]) >= 0.9)
            if score >= 3:
                found.add((i, j, score))
    return found


def test_uncapped_review_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    people = lambda n: [person(i, last4_ssn=rng.choice(["1", "2"]), dob=f"19{rng.randint(70, 72)}-0{rng.randint(1, 2)}-01",
                               last_name_norm=rng.choice(["smith", "smythe", "jones"]), location_state=rng.choice(["TX", "CA"]),
                               full_name_norm=rng.choice(["ann smith", "ann smyth", "bob jones"])) for i in range(n)]
    old, new = people(40), people(40)
    o, n = snapshot(spark, old), snapshot(spark, new)
    got = {(r["old_row"], r["new_row"], r["score"]) for r in review.review_pairs_last4(o, n).collect()}
    members = {}
    for r in review.grouped_evidence(o, n).collect():
        members.setdefault((r["evidence"], r["key"]), {"old": [], "new": []})[r["side"]].append(r["row"])
    assert all(len(m["old"]) > 1 and len(m["new"]) > 1 for m in members.values())
    listed = {(a, b) for m in members.values() for a in m["old"] for b in m["new"]}
    expected = brute_pairs(old, new)
    assert got <= expected and {p for p in expected if p[:2] not in listed} <= got


def test_weighted_pairs_and_groups_are_whole(spark):
    rng = random.Random(6)
    people = lambda n: [person(i, last4_ssn=rng.choice(["1", "2"]), dob=f"19{rng.randint(50, 80)}-0{rng.randint(1, 9)}-01",
                               last_name_norm=rng.choice(["smith", "smythe", "jones", "poe", "ray"]), location_state=rng.choice(["TX", "CA"]),
                               full_name_norm=rng.choice(["ann smith", "ann smyth", "bob jones"])) for i in range(n)]
    o, n = snapshot(spark, people(40)), snapshot(spark, people(40))
    key = lambda r: (r["old_row"], r["new_row"], r["score"], r["confidence"])
    every = {key(r) for r in review.review_pairs_last4(o, n, "weighted", per_side=1000).where("confidence <> 'LOW'").collect()}
    got = {key(r) for r in review.review_pairs_last4(o, n, "weighted").collect()}
    members = {}
    for r in review.grouped_evidence(o, n, "weighted").collect():
        members.setdefault((r["evidence"], r["key"]), {"old": [], "new": []})[r["side"]].append(r["row"])
    listed = {(a, b) for m in members.values() for a in m["old"] for b in m["new"]}
    assert got <= every and {p for p in every if p[:2] not in listed} <= got


def test_groups_and_pairs_together_are_whole(spark):
    hot = dict(full_name_norm="a b", dob="1990-01-01", recon_id="r")
    old = [person(i, **(hot if i < 20 else {}), ) for i in range(40)]
    new = [person(i, worker_id=f"n{i}", **(hot if i < 20 else {})) for i in range(40)]
    o, n = snapshot(spark, old), snapshot(spark, new)
    some = review.review_candidates_tiered(o, n).where("confidence = 'HIGH'")
    members = review.grouped_candidates(o, n).where("confidence = 'HIGH'")
    sides = {s: {r["row"] for r in members.where(F.col("side") == s).collect()} for s in ("old", "new")}
    pairs = lambda d: {(r["old_row"], r["new_row"]) for r in d.collect()}
    same = {(a, b) for a, x in enumerate(old) for b, y in enumerate(new) if all(x[f] == y[f] for f in ("full_name_norm", "dob"))}
    assert same == pairs(some) | {(a, b) for a in sides["old"] for b in sides["new"]}


def _close(a, b, method):
    if not a or not b:
        return 0.0
    if method == "sequence":
        return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def _points(o, n, score, method):
    both = {f: o[f] != "" and o[f] == n[f] for f in ("dob", "birth_year", "last_name_prefix3", "location_state")}
    names = [o["full_name_norm"], n["full_name_norm"]]
    if score == "signals":
        return sum(both.values()) + (_close(*names, method) >= 0.9)
    near = _close(*(" ".join(sorted(x.split())) for x in names), method) >= 0.9
    return (3 if both["dob"] else 2 if both["birth_year"] else 0) + 2 * both["last_name_prefix3"] + both["location_state"] + 2 * near


@pytest.mark.parametrize("score, method, split", [("signals", "edit", 3), ("weighted", "sequence", 50_000)])
def test_every_member_has_its_best_partner(spark, monkeypatch, score, method, split):
    monkeypatch.setattr(partners, "SPLIT_ROWS", split)
    monkeypatch.setattr(heavy, "HEAVY_ROWS", 5 if split == 3 else 100_000)
    rng = random.Random(len(score) + len(method))
    names = ["jonathan smithson", "jonathan smithsen", "smithson jonathan", "jonathon smithsen", "ann li", "an li", "", "bob jones"]
    people = lambda n: [person(i, last4_ssn=rng.choice(["1", "2"]), dob=rng.choice(["", "1970-01-01", "1970-01-02", "1971-01-01"]),
                               last_name_norm=rng.choice(["smith", "smythe", "jones", ""]), location_state=rng.choice(["TX", "CA", ""]),
                               full_name_norm=rng.choice(names)) for i in range(n)]
    o, n = snapshot(spark, people(35)), snapshot(spark, people(30))
    rows = {s: {r["row"]: r.asDict() for r in review.review_side(d).collect()} for s, d in (("old", o), ("new", n))}
    got = review.grouped_evidence(o, n, score, method=method).collect()
    assert len(got) > 50 and len({(r["side"], r["evidence"], r["key"], r["row"]) for r in got}) == len(got)
    members = {}
    for r in got:
        members.setdefault((r["evidence"], r["key"]), {"old": [], "new": []})[r["side"]].append(r["row"])
    for r in got:
        group = members[r["evidence"], r["key"]]
        side, other = (r["side"], "new" if r["side"] == "old" else "old")
        points = lambda p: _points(*((rows["old"][r["row"]], rows["new"][p]) if side == "old" else (rows["old"][p], rows["new"][r["row"]])), score, method)  # noqa: E731, B023
        best = min(group[other], key=lambda p: (-points(p), p))  # noqa: B023
        assert (r["partner_row"], r["score"]) == (best, points(best)) and (r["n_old"], r["n_new"]) == (len(group["old"]), len(group["new"]))


def _evidence_people(rng, n):
    names = ["jonathan smithson", "jonathan smithsen", "smithson jonathan", "jonathon smithsen", "ann li", "an li", "", "bob jones", "bob  jones"]
    return [person(i, last4_ssn=rng.choice(["1", "2", ""]), dob=rng.choice(["", "1970-01-01", "1971-01-01"]), full_name_norm=rng.choice(names),
                   last_name_norm=rng.choice(["smith", "jones", ""]), location_state=rng.choice(["TX", "CA", ""])) for i in range(n)]


def test_groups_are_dealt_whole_to_tasks(spark, monkeypatch):
    """No member is exploded and joined, and names are paired, as long as groups fit a task; in batches of any size."""
    rng = random.Random(21)
    o, n = snapshot(spark, _evidence_people(rng, 40)), snapshot(spark, _evidence_people(rng, 35))
    rows = {s: {r["row"]: r.asDict() for r in review.review_side(d).collect()} for s, d in (("old", o), ("new", n))}

    def never(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(partners, "near_texts", never)
    for batch in (1, 100_000):
        monkeypatch.setattr(partners, "BATCH_ROWS", batch)
        got = review.grouped_evidence(o, n, "signals", method="edit").collect()
        members = {}
        for r in got:
            members.setdefault((r["evidence"], r["key"]), {"old": [], "new": []})[r["side"]].append(r["row"])
        assert len(got) > 50 and all(len(m["old"]) > 1 and len(m["new"]) > 1 for m in members.values())
        for r in got:
            side, other = (r["side"], "new" if r["side"] == "old" else "old")
            points = lambda p: _points(*((rows["old"][r["row"]], rows["new"][p]) if side == "old" else (rows["old"][p], rows["new"][r["row"]])), "signals", "edit")  # noqa: E731, B023
            best = min(members[r["evidence"], r["key"]][other], key=lambda p: (-points(p), p))  # noqa: B023
            assert (r["partner_row"], r["score"]) == (best, points(best))


def test_crowded_groups_have_the_same_partners(spark, monkeypatch):
    """Groups of any size by joins, and dealt ones whose names meet by their q-grams; row numbers repeat, one is null."""
    rng = random.Random(22)
    sides = []
    for people in (_evidence_people(rng, 70), _evidence_people(rng, 70)):
        number = F.when(F.col("src_ord") == 3, F.lit(None).cast("long")).otherwise(F.expr("src_ord - if(src_ord % 7 = 1, 1, 0)"))
        sides.append(snapshot(spark, people).withColumn("src_ord", number))
    rows = lambda: Counter(tuple(r) for r in review.grouped_evidence(*sides, "weighted", method="edit").collect())
    plain = rows()
    monkeypatch.setattr(partners, "PAIRS_PER_NAME", 0)
    monkeypatch.setattr(partners, "GROUP_ROWS", 12)
    assert rows() == plain and len(plain) > 50


def test_preferences_inside_groups(spark):
    def two(i, name, **more):
        return person(i, full_name_norm=name, dob="1990-01-01", **more)

    old = [two(0, "a b", recon_id="r1"), two(1, "a b", recon_id="r2"), two(2, "a b", recon_id="", worker_id=""), two(3, "c d", recon_id="r3"),
           two(4, "c d", recon_id="r3"), two(5, "e f", recon_id="r5"), two(6, "e f", recon_id="r6")]
    new = [two(0, "a b", worker_id="x"), two(1, "a b", worker_id="wdX7"), two(2, "c d", worker_id="wdX1"), two(3, "c d", worker_id="wdX2"),
           two(4, "e f", worker_id="y"), two(5, "e f", worker_id="z")]
    got = {(r["side"], r["row"]): (r["partner_row"], r["notes"]) for r in review.grouped_candidates(snapshot(spark, old), snapshot(spark, new)).where("confidence = 'HIGH'").collect()}
    auto, many = "auto_preferred_wdX_id", "multiple_wdX_candidates"
    assert got == {("old", 0): (1, auto), ("old", 1): (1, auto), ("old", 2): (0, None), ("old", 3): (2, many), ("old", 4): (2, many), ("old", 5): (4, None), ("old", 6): (4, None),
                   ("new", 0): (2, None), ("new", 1): (0, None), ("new", 2): (3, None), ("new", 3): (3, None), ("new", 4): (5, None), ("new", 5): (5, None)}


def test_candidates_without_an_owner_are_independent(spark):
    old = [person(i, full_name_norm=f"n{i}", dob="1990-01-01", recon_id="", worker_id="") for i in range(3)]
    new = [person(i, full_name_norm=f"n{i}", dob="1990-01-01", worker_id="wdX1" if i == 0 else f"v{i}") for i in range(3)]
    pairs = review.review_candidates_tiered(snapshot(spark, old), snapshot(spark, new)).where("confidence = 'HIGH'").collect()
    assert sorted((r["old_row"], r["notes"]) for r in pairs) == [(0, ""), (1, ""), (2, "")]


def test_heavy_keys_are_joined_without_moving_them(spark):
    """A third of the rows under one key: these stay in the partitions that they come from."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 9000)) AS key", "id").repartition(8)
    figures = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = heavy.join_figures(rows, figures, ["key"], "n", heavy_rows=1000)
    hot = [r["count"] for r in joined.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert joined.count() == 60_000 and sum(hot) == 20_000 and max(hot) < 4 * sum(hot) / 8
    wrong = joined.join(figures.withColumnsRenamed({"n": "n2", "first": "first2"}), "key").where("n <> n2 or first <> first2")
    assert wrong.count() == 0 and heavy.join_figures(rows, figures.where("n > 10"), ["key"], "n", 1000, "left_semi").columns == ["key", "id"]


def test_finalize_keeps_rows_without_an_id(spark):
    rows = [(None, "x", "match", "high", "1"), (None, "y", "match", "high", "1"), ("a", None, "match", "high", "1"), ("b", "y", "match", "high", "1")]
    df = spark.createDataFrame(rows, "old_worker_id string, new_worker_id string, decision string, confidence string, score string")
    done, unclear = review.finalize(df)
    assert sorted(str(r["new_worker_id"]) for r in done.collect()) == ["None", "x"] and unclear.count() == 2


def test_candidate_order_of_very_large_row_numbers(spark):
    df = spark.createDataFrame([(0, 2**62), (1, 0), (1, 2**62), (2, 10**15 + 1), (2, 10**15 + 2)], "tier int, old_row long")
    rows = df.select("tier", "old_row", match.candidate_order(F.col("tier"), F.col("old_row")).alias("o")).orderBy("o").collect()
    assert [(r["tier"], r["old_row"]) for r in rows] == [(0, 2**62), (1, 0), (1, 2**62), (2, 10**15 + 1), (2, 10**15 + 2)] and len({r["o"] for r in rows}) == 5


def test_finalize_splits_ambiguous_ids(spark):
    rows = [("a", "x", "match", "high", "1"), ("a", "y", "yes", "med", "1"), ("b", "z", "match", "high", "0"),
            ("c", "w", "TRUE", "medium", "2"), ("d", "v", "no", "high", "5"), ("e", "u", "match", "low", "5")]
    df = spark.createDataFrame(rows, "old_worker_id string, new_worker_id string, decision string, confidence string, score string")
    done, unclear = review.finalize(df)
    assert [r["old_worker_id"] for r in done.collect()] == ["c"]
    assert sorted(r["new_worker_id"] for r in unclear.collect()) == ["x", "y"]


def test_apply_decisions_refuses_repeated_ids(spark):
    matched = spark.createDataFrame([("a", "x")], "old_worker_id string, new_worker_id string")
    reviewed = spark.createDataFrame([("a", "y", "match")], "old_worker_id string, new_worker_id string, decision string")
    with pytest.raises(ValueError):
        review.apply_decisions(matched, reviewed)


def test_crowded_keys_are_read_from_the_stored_sides(spark, tmp_path):
    for name in ("old", "new"):
        spark.createDataFrame([(k, f"{name}{k}", f"R{k}", "ann lee", "lee", "1990-01-01", "TX") for k in range(3)],
                              "src_ord long, worker_id string, recon_id string, full_name_norm string, last_name_norm string, dob string, location_state string"
                              ).write.parquet(f"{tmp_path}/{name}")
    old, new = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new"))
    members = review.grouped_candidates(old, new)
    assert members.where("confidence = 'HIGH'").count() == 6
    assert not [f for f in members.inputFiles() if str(tmp_path) in f]


def test_salary_anomalies_are_banded_after_the_salaries_are_parsed(spark):
    from twinfold.operators.pair_audits import salary_anomalies_by

    rows = [("A", "100", "300"), ("A", "100", "101"), ("B", "100", "101"), ("C", "0", "5"), ("C", "0", "0"), ("C", "x", "5"), (None, "100", "900")]
    found = salary_anomalies_by(spark.createDataFrame(rows, "new_district string, old_salary string, new_salary string"), "new_district")
    assert {r["new_district"]: r["anomaly_count"] for r in found.collect()} == {"A": 1, "C": 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "0.15" not in plan.rsplit("Filter", 1)[1]
