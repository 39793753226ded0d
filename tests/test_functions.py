import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from twinfold.functions import dates, labels, numbers, text
from twinfold.operators import match
from twinfold.operators.diff import field_severity


def plain(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_ascii_fold_equals_the_unicode_rule(spark):
    chars = [chr(c) for c in list(range(0x20, 0x250)) + list(range(0x1E00, 0x1F00)) + [0xFB01, 0x2460, 0x3042, 0x1F600]]
    rows = spark.createDataFrame([(f"a{c}b",) for c in chars], "c string")
    got = rows.select("c", text.ascii_fold("c").alias("v")).collect()
    assert [(r["c"], r["v"]) for r in got if r["v"] != plain(r["c"])] == []
    decomposed = spark.createDataFrame([("José",)], "c string")
    assert decomposed.select(text.ascii_fold("c")).first()[0] == "Jose"


@pytest.mark.parametrize("raw, expected", [
    ("  A   b\t\nc ", "A b c"), ("", ""), (None, ""), ("　x ", "x")])
def test_norm_str(one, raw, expected):
    assert one(text.norm_str, raw) == expected


@pytest.mark.parametrize("raw, first, middle", [
    ("Nancy", "nancy", None), ("Nancy R", "nancy", "r"), ("Nancy Roman", "nancy", "roman"),
    ("Mary Jo", "mary jo", None), ("Mary Ann Louise", "mary", "ann louise"), ("José", "jose", None), ("", "", None)])
def test_split_first_middle(one, raw, first, middle):
    got = one(text.split_first_middle, raw)
    assert (got["first"], got["middle"]) == (first, middle)


@pytest.mark.parametrize("raw, last, suffix", [
    ("Smith Jr.", "smith", "Jr."), ("Williams", "williams", None), ("O'Brien III", "o'brien", "III"),
    ("Smith, Jr.", "smith", "Jr."), ("Jr", "jr", None), ("Lee 2nd", "lee nd", None), ("Young PhD", "young", "PhD")])
def test_strip_suffix(one, raw, last, suffix):
    got = one(text.strip_suffix, raw)
    assert (got["last"], got["suffix"]) == (last, suffix)


def test_full_name_drops_accented_letters(one):
    assert one(text.full_name_norm, "José", "García") == "jos garca"
    assert one(text.full_name_norm, " ", "") is None


@pytest.mark.parametrize("raw, state", [
    ("Houston, TX", "TX"), ("Austin TX 78701", "TX"), ("St Louis MO", "ST"), ("Texas", ""), ("", "")])
def test_extract_state(one, raw, state):
    assert one(text.extract_state, raw) == state


@pytest.mark.parametrize("raw, expected", [
    ("2020-01-15", "2020-01-15"), ("1/5/2019", "2019-01-05"), ("20210704", "2021-07-04"), ("44197", "2021-01-01"),
    ("99999", ""), ("15-Mar-2018", "2018-03-15"), ("junk", ""), ("2020-02-30", ""), ("2020-01-01 10:30:00", "2020-01-01")])
def test_parse_date_flexible(one, raw, expected):
    assert one(dates.parse_date_flexible, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("07/08/2021 2:30 PM", "2021-07-08"), ("25/12/2020", "2020-12-25"), ("Jan 5 2020", "2020-01-05"),
    ("January 5, 2020", "2020-01-05"), ("null", ""), ("13-13-2020", "")])
def test_clean_dob(one, raw, expected):
    assert one(dates.clean_dob, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("$50,000", 50000.0), ("1e3", 1000.0), ("1d", None), ("abc", None), ("", None), (" -7 ", -7.0), (".5", 0.5)])
def test_parse_money(one, raw, expected):
    assert one(numbers.parse_money, raw) == expected


@pytest.mark.parametrize("old_salary, new_salary, old_rate, new_rate, expected", [
    ("52000", "52000", "10", "25", "annual_to_hourly"), ("1", "52000", "25", "26", "hourly_to_annual"),
    ("1", "52000", "2000", "1", "biweekly_to_annual"), ("52000", "1", "1", "2000", "annual_to_biweekly"),
    ("52000", "52000", "0", "0", None), ("", "", "1", "2", None)])
def test_payrate_conversion(one, old_salary, new_salary, old_rate, new_rate, expected):
    assert one(numbers.payrate_conversion, old_salary, new_salary, old_rate, new_rate) == expected


def test_sequence_ratio_is_the_matching_block_ratio(spark):
    words = ["john smith", "jon smyth", "maria lopez", "lopez maria", "", "anna", "annabel lee", "zoe"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = rows.select("a", "b", match.name_similarity(F.col("a"), F.col("b")).alias("v")).collect()
    for r in got:
        expected = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0
        assert r["v"] == pytest.approx(expected)


def test_token_sort(spark):
    rows = spark.createDataFrame([(" Smith  John", "john smith")], "a string, b string")
    assert rows.select(match.token_sort_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0


@pytest.mark.parametrize("field, old, new, expected", [
    ("salary", "100", "100.005", "green"), ("salary", "100", "100.5", "yellow"), ("salary", "100", "102", "red"),
    ("salary", "", "5", "red"), ("salary", "a", "b", "yellow"), ("hire_date", "2020", "", "red"),
    ("position", "A", "B", "yellow"), ("position", " a  b", "A B", "green"), ("other", "x", "y", "yellow")])
def test_field_severity(one, field, old, new, expected):
    assert one(lambda a, b: field_severity(field, F.col(a), F.col(b)), old, new) == expected


@pytest.mark.parametrize("raw, expected", [
    ("", "No reason recorded"), ("custom_code", "Custom code"),
    ("salary:salary_ratio_extreme (0.9000 outside [0.85, 1.15])", "Salary changed significantly between systems - needs human review"),
    ("hire_date_wave|status:active_to_terminated (a->b)",
     "Start date matches a bulk import date shared by many other employees - needs human review; "
     "Status changed from active to terminated - needs human review")])
def test_reason_label(one, raw, expected):
    assert one(labels.reason_label, raw) == expected


def test_slug_and_plan_tokens(one):
    assert one(text.slug, " R&D / Ops! ") == "r_d_ops"
    assert one(text.slug, "***") == "unknown"
    assert one(text.plan_tokens, "Gold; silver|GOLD, waived") == ["gold", "silver"]
    assert re.fullmatch("[0-9a-f]{12}", one(text.pair_id, "a", "b"))


def test_source_label(one):
    assert one(labels.source_label, " PK ") == "Matched on name, date of birth, and last-4"
    assert one(labels.source_label, "other") == "other"


@pytest.mark.parametrize("raw, expected", [("0x1p3", None), ("NaN", None), ("Infinity", None), ("5.", 5.0), ("-", None), ("1e5", 1e5)])
def test_number_takes_plain_numbers_only(one, raw, expected):
    assert one(numbers.number, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("2020-01-15", "2020-01-15"), ("2020-1-5", None), ("+020-01-01", None), ("2020-13-01", None), (" 2020-01-15 ", "2020-01-15")])
def test_iso_date(one, raw, expected):
    assert one(lambda c: dates.date_text(dates.iso_date(c)), raw) == expected


def test_every_character_folds_as_its_compatibility_form(one):
    import unicodedata

    from twinfold.functions import text as tx

    for value in ("Henry Ⅳ ㎏", "ﬁn ½ Ĳ 🄐 x", "Ångström №5 ㋿", "plain", "日本"):
        assert one(tx.ascii_fold, value) == unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()


def test_numbers_as_text_have_no_exponent(spark):
    from pyspark.sql import functions as F

    from twinfold.functions.numbers import plain_text

    cases = {12345678.0: "12345678.0", 0.0001: "0.0001", 2.0: "2.0", 1500.5: "1500.5", 1e9 + 0.25: "1000000000.25", -3.0: "-3.0", 0.0: "0.0",
             1e-12: "0.000000000001", 0.1234567890123: "0.1234567890123", 1e30: "1" + "0" * 30 + ".0", -1.25e-7: "-0.000000125", 123456789.125: "123456789.125",
             1.7976931348623157e308: "17976931348623157" + "0" * 292 + ".0", 5e-324: "0." + "0" * 323 + "49", float("inf"): "Infinity"}
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", plain_text(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == cases


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _ratio(a, b):
    both = len(a) + len(b)
    return 1.0 if not both else 1 - (both - 2 * _common(a, b)) / both


def test_common_subsequences_of_any_length(spark):
    import random

    from twinfold.functions.similarity import indel_ratio

    random.seed(1)
    sizes = (0, 1, 3, 20, 61, 62, 63, 124, 125, 150)
    rows = [tuple("".join(random.choice(letters) for _ in range(random.choice(sizes))) for _ in "ab") for letters in ("ab", "abcdefgh ", "aé日😀z") for _ in range(80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == _ratio(r["a"], r["b"]) for r in got) and len(got) == len(rows)


def test_no_similar_title_is_lost(spark):
    import random

    from twinfold.operators.bands import similar_titles

    random.seed(2)
    base = [" ".join("".join(random.choice("abcde") for _ in range(random.randint(1, 7))) for _ in range(random.randint(1, 4))) for _ in range(50)]
    base = sorted({*base, "a", "ab", "abc", "aaaaaaa", "aaaaaaaa", "ababababab", "senior sales engineer"})

    def changed(t):
        t = list(t)
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(t))
            t[k:k + 1] = random.choice([[], ["a"], list(t[k:k + 1]) + ["c"], [" "]])
        return " ".join("".join(t).split())

    keys = sorted({changed(random.choice(base)) for _ in range(400)} - {""})
    joined = similar_titles(spark.createDataFrame([(k,) for k in keys], "title_key string"), spark.createDataFrame([(b,) for b in base], "title_key string"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["title_key"], r["band_title"]): r["score"] for r in joined.collect()}
    words = lambda t: " ".join(sorted(t.split()))
    assert got == {(k, b): _ratio(words(k), words(b)) for k in keys for b in base if _ratio(words(k), words(b)) >= 0.85}
    assert sum(k != b for k, b in got) > 50


def test_titles_are_compared_in_a_few_seconds_whatever_their_number(spark):
    import time

    from twinfold.operators.match import title_ratio

    rows = spark.range(100_000).selectExpr("concat('senior engineer ', id % 977) as a", "concat('engineer level ', id % 991, ' north') as b")
    start = time.time()
    assert rows.select(title_ratio(F.col("a"), F.col("b")).alias("r")).where("r >= 0").count() == 100_000
    assert time.time() - start < 40
    odd = spark.createDataFrame([(None, "a"), ("a", None), ("", ""), ("", "b"), ("b c", "c b")], "a string, b string")
    assert [r["r"] for r in odd.select(title_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [0.0, 0.0, 1.0, 0.0, 1.0]
