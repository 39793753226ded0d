"""Registered queries of the scalar functions, over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blanks, dates, labels, numbers, text
from ..operators import match
from .samples import spread, table, with_sql

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


# Raw values picked by customer key; the same lists in both engines.
FIRST = ["José", "  Mary  Ann Louise", "Nancy R", "Mary Jo", "Zoë Marie", "O'Neil", "Jean-Luc", "", "Müller 3rd", "ana\tlucia"]
LAST = ["García", "Smith Jr.", "O'Brien III", "Williams", "Nuñez, PhD", "de la Cruz", "Young Esq", "  ", "Brontë-Hall", "King IV"]
NICK = ["Jon Smith", "mike o'hara", "Liz-Beth Jones", "Kate", "BOB  Stone", "Ann Lee", "", "rob. Hall"]
PLACE = ["Houston, TX", "Austin TX 78701", "St Louis MO", "texas", "New York NY", "", "Miami, Florida", "LA"]
STREET = ["12 Main Street Suite 4", "9 Park Ave. Apartment 2", "1 Ocean Drive", "77 Hill Road", "", "5 Sunset Boulevard Lane 3"]
TYPE = ["Full-Time", "part time", "Temp", "CONTRACTOR", "", "Regular", "contract"]
SSN = ["123-45-6789", "6789", "12", "", "abc", "987 65 4321"]
DATE = ["2020-01-15", "1/5/2019", "20210704", "44197", "15-Mar-2018", "not a date", "", "2020-02-30", "2019/7/4", "12-31-2020",
        "2020-01-01 00:00:00", "07/08/2021 2:30 PM", "25/12/2020"]
MONEY = ["$50,000", "1234.5", "", "abc", "-7", "1e3", "$1,2a", " 42 "]
PLANS = ["Gold; Silver", "waived", "Gold, gold|GOLD", "", "None", "Bronze|Dental;Vision"]
PAY = ["Hourly", "salaried-exempt", "ANNUAL", "weekly", "", "non-exempt"]
COVER = ["Employee Only", "family", "employee/spouse", "ee-only", "weird", "", "Self"]
ELIG = ["Yes", "no", "Eligible", "not eligible", "maybe", ""]
EMP = ["Contractor", "part-time", "PT", "full time", "", "temp"]
UNSAFE = ["=1+1", "+5", "@cmd", "-2", "plain", "\tTab", ""]
BLANKS = ["", "  ", "nan", "None", "N/A", "value", "null"]
REASONS = [
    "salary:salary_ratio_extreme (3.0000 outside [0.85, 1.15])", "status:active_to_terminated (active->terminated)|hire_date_wave",
    "reject_match:dob_name_low_confidence (0.600<0.75)", "reject_match:fuzzy_extreme_salary_ratio (3.1234>2.5)",
    "job_org:below_threshold (0.900<0.950)", "salary:low_confidence (0.474<0.80)", "name_change_detected (smith -> jones)",
    "hire_date:hire_date:year_shift_with_other_mismatches", "", "salary:salary_ratio_extreme (0.3000 outside [0.85, 1.15])",
    "payrate:payrate_conversion:annual_to_hourly", "salary:missing_confidence",
]
FIXES = ["salary|payrate|status", "hire_date|job_org", "", "identity", "other_thing"]
SOURCES = dict(first=FIRST, last=LAST, nick=NICK, place=PLACE, street=STREET, kind=TYPE, ssn=SSN, day=DATE, money=MONEY,
               plans=PLANS, pay=PAY, cover=COVER, elig=ELIG, emp=EMP, unsafe=UNSAFE, blank=BLANKS, reason=REASONS, fixes=FIXES)


def _sql_text(v: str) -> str:
    quoted = "'" + v.replace("'", "''") + "'"
    return quoted if "\t" not in v else "replace(" + quoted.replace("\t", "<tab>") + ", '<tab>', chr(9))"


def raw(spark, sf_dir):
    k = F.col("c_custkey")
    picks = [
        F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int")).alias(name)
        for name, values in SOURCES.items()
    ]
    return table(spark, sf_dir, "customer").select(k.alias("k"), "c_name", "c_mktsegment", "c_acctbal", *picks)


_RAW = [("raw", "select c_custkey as k, c_name, c_mktsegment, c_acctbal, " + ", ".join(
    f"[{', '.join(_sql_text(v) for v in values)}][(c_custkey % {len(values)})::integer + 1] as {name}"
    for name, values in SOURCES.items()) + " from customer")]
SPACE = r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_trim = lambda e: f"regexp_replace(regexp_replace({e}, '^{SPACE}+', ''), '{SPACE}+$', '')"
_norm = lambda e: f"regexp_replace({_trim(e)}, '{SPACE}+', ' ', 'g')"
_name = lambda e: _norm(f"regexp_replace(lower({e}), '[^a-z''\\-' || chr(32) || chr(9) || ']', '', 'g')")
_fold = lambda e: f"regexp_replace(strip_accents({e}), '[^\\x00-\\x7F]', '', 'g')"
_basic = lambda e: f"trim(regexp_replace(lower({_trim(e)}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _scalar(name, source, exprs, sql_exprs):
    """One query that applies expressions to a raw column."""
    _add(name, lambda s, d: raw(s, d).select("k", *[e().alias(n) for n, e in exprs.items()]),
         with_sql(_RAW, "select k, " + ", ".join(f"{e} as {n}" for n, e in sql_exprs.items()) + " from raw"))


_add("norm_str", lambda s, d: table(s, d, "documents").select(
        "doc_id", F.length(text.norm_str("text")).alias("n"), F.md5(text.norm_str("text")).alias("digest")),
     f"select doc_id, length({_norm('text')})::integer as n, md5({_norm('text')}) as digest from documents")
_add("ascii_fold", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.ascii_fold("text")).alias("digest")),
     f"select doc_id, md5({_fold('text')}) as digest from documents")
_scalar("norm_id", "first", {"norm_id": lambda: text.norm_id("first")}, {"norm_id": f"lower({_trim('first')})"})
_scalar("norm_name", "last", {"plain": lambda: text.norm_name("last"), "folded": lambda: text.norm_name("last", True)},
        {"plain": _name("last"), "folded": _name(_fold(_norm("last")))})
_scalar("full_name_norm", "first", {"full_name": lambda: text.full_name_norm("first", "last")},
        {"full_name": f"nullif(trim({_name('first')} || ' ' || {_name('last')}), '')"})
_given = f"string_split({_name(_fold(_norm('first')))}, ' ')"
_scalar("split_first_middle", "first",
        {"first_norm": lambda: text.split_first_middle("first")["first"], "middle_norm": lambda: text.split_first_middle("first")["middle"]},
        {"first_norm": f"case when len({_given}) = 1 or (len({_given}) = 2 and length({_given}[2]) = 2) then array_to_string({_given}, ' ') else {_given}[1] end",
         "middle_norm": f"case when len({_given}) = 1 or (len({_given}) = 2 and length({_given}[2]) = 2) then null else array_to_string({_given}[2:], ' ') end"})
_family = f"string_split({_name(_fold(_norm('last')))}, ' ')"
_suffix = (f"case when len({_family}) >= 2 then case {_family}[-1] when 'jr' then 'Jr.' when 'sr' then 'Sr.' when 'ii' then 'II' "
           "when 'iii' then 'III' when 'iv' then 'IV' when 'v' then 'V' when 'esq' then 'Esq.' when 'phd' then 'PhD' when 'md' then 'MD' end end")
_scalar("strip_suffix", "last",
        {"last_norm": lambda: text.strip_suffix("last")["last"], "suffix": lambda: text.strip_suffix("last")["suffix"]},
        {"last_norm": f"case when {_suffix} is not null then array_to_string({_family}[:-2], ' ') else array_to_string({_family}, ' ') end",
         "suffix": _suffix})
_nick = f"string_split({_basic('nick')}, ' ')"
_formal = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in text.NICKNAMES.items()) + "}"
_scalar("nickname_name", "nick", {"formal": lambda: text.nickname_name("nick"), "last": lambda: text.last_token("nick"),
                                 "prefix": lambda: text.name_prefix("nick")},
        {"formal": f"array_to_string(list_concat([coalesce(map_extract({_formal}, {_nick}[1])[1], {_nick}[1])], {_nick}[2:]), ' ')",
         "last": f"string_split({_norm('nick')}, ' ')[-1]", "prefix": f"substr({_basic('nick')}, 1, 3)"})
_digits = "regexp_replace(ssn, '[^0-9]', '', 'g')"
_scalar("extract_last4", "ssn", {"last4": lambda: text.extract_last4("ssn"), "strict": lambda: text.extract_last4_strict("ssn")},
        {"last4": f"right({_digits}, 4)", "strict": f"case when length({_digits}) >= 4 then right({_digits}, 4) else '' end"})
_parts = f"string_split({_norm(chr(114) + 'eplace(place, ' + repr(',') + ', ' + repr(' ') + ')')}, ' ')"
_abbr = lambda e: (f"case {e} when 'texas' then 'tx' when 'florida' then 'fl' when 'california' then 'ca' when 'new york' then 'ny' else {e} end")
_scalar("split_location", "place",
        {"state": lambda: text.extract_state("place"), "city_part": lambda: text.split_location("place")["city"],
         "state_part": lambda: text.split_location("place")["state"], "state_norm": lambda: text.norm_state("place")},
        {"state": "regexp_extract(upper(place), '\\b([A-Z]{2})\\b', 1)",
         "city_part": f"case when len({_parts}) >= 2 then {_basic(f'array_to_string({_parts}[:-2], chr(32))')} else {_basic(f'array_to_string({_parts}, chr(32))')} end",
         "state_part": f"case when len({_parts}) >= 2 then {_abbr(_basic(_parts + '[-1]'))} else '' end",
         "state_norm": _abbr(_basic("place"))})
_addr = f"' ' || {_basic('street')} || ' '"
for _word, _short in text.STREET_WORDS:
    _addr = f"replace({_addr}, ' {_word} ', ' {_short} ')"
_scalar("norm_address", "street", {"address": lambda: text.norm_address("street"), "kind_norm": lambda: text.norm_worker_type("kind")},
        {"address": f"trim({_addr})",
         "kind_norm": f"case {_basic('kind')} when 'full time' then 'regular' when 'part time' then 'regular' when 'temp' then 'contingent' "
                      f"when 'temporary' then 'contingent' when 'contractor' then 'contingent' when 'contract' then 'contingent' else {_basic('kind')} end"})
_scalar("identity_hashes", "first",
        {"recon": lambda: text.recon_hash("c_name", "day", "ssn"), "pair": lambda: text.pair_id("c_name", "ssn"),
         "prefix": lambda: text.id_prefix("c_name"), "slug": lambda: text.slug("place")},
        {"recon": "substr(sha1(c_name || '|' || day || '|' || ssn), 1, 12)", "pair": "substr(sha256(c_name || '|' || ssn), 1, 12)",
         "prefix": "substr(lower(trim(c_name)), 1, 5)",
         "slug": "coalesce(nullif(substr(trim(regexp_replace(lower(trim(place)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40), ''), 'unknown')"})
_scalar("formula_safe", "unsafe", {"safe": lambda: text.formula_safe("unsafe")},
        {"safe": "case when regexp_matches(unsafe, '^[=+\\-@\\t]') then '''' || unsafe else unsafe end"})
_scalar("plan_tokens", "plans", {"tokens": lambda: F.array_join(text.plan_tokens("plans"), ",")},
        {"tokens": "array_to_string(list_filter(list_transform(string_split_regex(plans, '[;,|]'), lambda x: lower(trim(x))), lambda x, i: x not in "
                   "('', 'none', 'no plan', 'not enrolled', 'waived', 'waive', 'declined', 'decline') and list_position(list_transform("
                   "string_split_regex(plans, '[;,|]'), lambda y: lower(trim(y))), x) = i), ',')"})
_scalar("value_classifiers", "pay",
        {"pay_class": lambda: labels.classify_pay_type("pay"), "coverage": lambda: labels.classify_coverage_level("cover"),
         "eligible": lambda: labels.classify_benefits_eligible("elig"), "employment": lambda: labels.classify_employment_type("emp"),
         "has_plan": lambda: labels.benefit_plan_present("plans")},
        {"pay_class": "case lower(pay) when '' then '' when 'hourly' then 'hourly' when 'non-exempt' then 'hourly' when 'salaried-exempt' then 'salaried' "
                      "when 'annual' then 'salaried' else 'invalid' end",
         "coverage": "case lower(cover) when '' then '' when 'employee only' then 'employee_only' when 'ee-only' then 'employee_only' when 'self' then "
                     "'employee_only' when 'family' then 'includes_dependents' when 'employee/spouse' then 'includes_dependents' else 'invalid' end",
         "eligible": "case lower(elig) when 'yes' then 'eligible' when 'eligible' then 'eligible' when 'no' then 'not_eligible' when 'not eligible' then 'not_eligible' else '' end",
         "employment": "case lower(emp) when 'contractor' then 'contractor' when 'part-time' then 'part_time' when 'pt' then 'part_time' when 'temp' then 'temporary' else '' end",
         "has_plan": "lower(plans) not in ('', 'none', 'waived')"})
_scalar("friendly_issue_types", "fixes", {"labels": lambda: labels.friendly_issue_types(F.split("fixes", r"\|"))},
        {"labels": "case fixes when 'salary|payrate|status' then 'Salary, Employee Status' when 'hire_date|job_org' then 'Hire Date, Job and Organization' "
                   "when 'identity' then 'Identity' when 'other_thing' then 'Other Thing' else '' end"})
_words = dict(zip(REASONS, [
    "Salary more than doubled between systems - needs human review",
    "Status changed from active to terminated - needs human review; Start date matches a bulk import date shared by many other employees - needs human review",
    "Matched on name and date of birth only - confidence score of 60% fell below the 75% minimum required to trust the match.",
    "Salary is 3.1x different between systems on a fuzzy match - flagged as possible wrong-person pairing",
    "Confidence score of 90% fell below the 95% minimum required for this field - needs human review",
    "Confidence score too low (47%) - needs human review",
    "Last name changed (smith -> jones) - needs human review to confirm same employee",
    "Start date changed by a full year, plus other fields also changed", "No reason recorded",
    "Salary dropped by more than half between systems - needs human review",
    "Payrate auto-approved - old system stored annual salary; new system stores hourly rate (divided by 2,080 hours)",
    "Missing confidence",
]))
_scalar("reason_label", "reason", {"words": lambda: labels.reason_label("reason")},
        {"words": "case " + " ".join(f"when reason = {_sql_text(a)} then {_sql_text(b)}" for a, b in _words.items()) + " end"})
_scalar("blank_rules", "blank",
        {"strict": lambda: blanks.blank_strict("blank"), "null_words": lambda: blanks.blank_null_words("blank"), "audit": lambda: blanks.blank_audit("blank")},
        {"strict": "trim(blank) = ''", "null_words": "lower(trim(blank)) in ('', 'nan', 'none', 'null')",
         "audit": "lower(trim(blank)) in ('', 'nan', 'none', 'null', 'n/a', 'na')"})
_scalar("change_rules", "first",
        {"folded": lambda: blanks.changed("first", "last"), "both": lambda: blanks.changed_both_present("ssn", "money"),
         "trimmed": lambda: blanks.changed_trimmed("blank", "ssn")},
        {"folded": f"lower({_trim('first')}) <> lower({_trim('last')})", "both": "ssn <> '' and money <> '' and ssn <> money",
         "trimmed": "trim(blank) <> trim(ssn)"})
_clean_day = "regexp_replace(day, '[ T]+\\d{1,2}:\\d{2}(:\\d{2})?.*$', '')"
_len = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%m-%d-%Y', '%d-%b-%Y', '%b %d %Y']"
_parsed = f"try_strptime(nullif({_clean_day}, ''), {_len})::date"
_dob_fmt = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%m-%d-%Y', '%d/%m/%Y', '%d-%m-%Y', '%Y%m%d', '%d-%b-%Y']"
_scalar("date_parsing", "day",
        {"parsed": lambda: dates.date_text(dates.parse_date("day")), "flexible": lambda: dates.parse_date_flexible("day"),
         "dob": lambda: dates.clean_dob("day"), "iso": lambda: dates.date_text(dates.iso_date("day"))},
        {"parsed": f"{_parsed}::varchar",
         "flexible": f"coalesce((case when regexp_matches(day, '^\\d{{8}}$') then try_strptime(day, '%Y%m%d')::date when regexp_matches(day, '^\\d{{4,6}}$') "
                     f"and try_cast(day as integer) between 20000 and 60000 then date '1899-12-30' + try_cast(day as integer) else {_parsed} end)::varchar, '')",
         "dob": f"coalesce(try_strptime(nullif(regexp_replace({_clean_day}, ' ?PM$', ''), ''), {_dob_fmt})::date::varchar, '')",
         "iso": "case when regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}$') then try_cast(day as date)::varchar end"})
_m = "replace(replace(trim(money), '$', ''), ',', '')"
_num = f"case when regexp_matches({_m}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') then {_m}::double end"
_scalar("money_parsing", "money",
        {"money_value": lambda: numbers.parse_money("money"), "confidence": lambda: numbers.parse_confidence("money"),
         "loose": lambda: numbers.parse_money_loose("money")},
        {"money_value": _num, "confidence": f"case when {_num} between 0 and 1 then {_num} end",
         "loose": "try_cast(nullif(regexp_replace(money, '[^0-9.\\-]', '', 'g'), '') as double)"})
_scalar("money_change", "money",
        {"delta": lambda: numbers.money_delta("money", "ssn"), "ratio": lambda: F.round(numbers.money_ratio("money", "ssn"), 6)},
        {"delta": f"(case when regexp_matches(ssn, '^\\d+$') then ssn::double end) - {_num}",
         "ratio": f"round((case when regexp_matches(ssn, '^\\d+$') then ssn::double end) / nullif({_num}, 0), 6)"})
_steps = lambda v, steps, last: "case " + " ".join(f"when {v} >= {a} then '{b}'" for a, b in steps) + f" else '{last}' end"
_scalar("bands", "money",
        {"anomaly": lambda: numbers.anomaly_band(F.col("c_acctbal") / 5000 - 0.2), "rate": lambda: numbers.rate_band(F.col("c_acctbal") / 10000),
         "review": lambda: numbers.review_severity(F.col("c_acctbal") / 100), "report": lambda: numbers.report_severity(F.col("c_acctbal") / 100),
         "complete": lambda: numbers.completeness_status(F.col("c_acctbal") / 100), "confidence": lambda: numbers.confidence_band(F.col("c_acctbal") / 10000),
         "delta_bucket": lambda: numbers.bucket_salary_delta(F.abs("c_acctbal") * 3), "day_bucket": lambda: numbers.bucket_day_gap(F.floor(F.abs(F.col("c_acctbal")) / 8)),
         "salary_bucket": lambda: numbers.salary_range(F.abs("c_acctbal") * 25)},
        {"anomaly": "case when c_acctbal / 5000 - 0.2 < 0 then 'negative' when c_acctbal / 5000 - 0.2 = 0 then 'no_change' else "
                    + _steps("c_acctbal / 5000 - 0.2", [(1, "over_100_percent"), (0.5, "over_50_percent"), (0.25, "over_25_percent"), (0.15, "over_15_percent")], "normal") + " end",
         "rate": _steps("c_acctbal / 10000", [(0.4, "critical"), (0.25, "high"), (0.1, "medium")], "low"),
         "review": _steps("c_acctbal / 100", [(90, "Critical"), (60, "High"), (30, "Medium")], "Low"),
         "report": _steps("c_acctbal / 100", [(70, "CRITICAL"), (40, "HIGH"), (20, "MEDIUM")], "LOW"),
         "complete": _steps("c_acctbal / 100", [(99, "Complete"), (95, "Acceptable"), (80, "Needs Attention")], "Critical Gap"),
         "confidence": "case when c_acctbal / 10000 = 1 then 'exact' when c_acctbal / 10000 > 1 then null else " + _steps("c_acctbal / 10000", [(0.97, "high"), (0.8, "medium")], "low") + " end",
         "delta_bucket": _steps("abs(c_acctbal) * 3", [(20000, "20,000+"), (5000, "5,000-20,000"), (1000, "1,000-5,000"), (100, "100-1,000")], "0-100"),
         "day_bucket": "case when floor(abs(c_acctbal) / 8) < 1 then null else " + _steps("floor(abs(c_acctbal) / 8)", [
             (1096, "1096+ (3yr+)"), (366, "366-1095 (1-3yr)"), (181, "181-365"), (31, "31-180"), (8, "8-30")], "1-7") + " end",
         "salary_bucket": _steps("abs(c_acctbal) * 25", [(200000, "$200k+"), (150000, "$150k-$200k"), (100000, "$100k-$150k"), (60000, "$60k-$100k"), (30000, "$30k-$60k")], "Under $30k")})
_add("conversion_and_patterns",
     lambda s, d: table(s, d, "orders").select(
         "o_orderkey",
         numbers.payrate_conversion(F.lit("52000"), F.lit("65000"), (F.col("o_orderkey") % 40).cast("string"), (F.col("o_orderkey") % 33).cast("string")).alias("conversion"),
         F.coalesce(dates.hire_date_pattern(
             F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 367).cast("int")), "yyyy-MM-dd"),
             F.lit("pk"), F.col("o_orderkey") % 2 == 0)["reason"], F.lit("")).alias("pattern"),
         numbers.readiness_score((F.col("o_orderkey") % 101).cast("double"), F.col("o_orderkey") % 300, F.col("o_orderkey") % 3).alias("ready")),
     "select o_orderkey, case when n > 0 and abs(52000 / n - 2080) / 2080 <= 0.02 then 'annual_to_hourly' when o > 0 and abs(65000 / o - 2080) / 2080 <= 0.02 then "
     "'hourly_to_annual' when o > 0 and abs(65000 / o - 26) / 26 <= 0.02 then 'biweekly_to_annual' when n > 0 and abs(52000 / n - 26) / 26 <= 0.02 then 'annual_to_biweekly' end "
     "as conversion, case g when 1 then 'hire_date:off_by_one_day_pattern' when 365 then case when e then 'hire_date:year_shift_with_other_mismatches' else "
     "'hire_date:systematic_year_shift_pattern' end when 366 then case when e then 'hire_date:year_shift_with_other_mismatches' else 'hire_date:systematic_year_shift_pattern' end "
     "else '' end as pattern, greatest(0, least(100, round_even(p - least(r * 10.0 + least(z * 0.1, 15.0) + case when p < 80 then 2.0 else 0.0 end, 45.0), 0)))::integer as ready "
     "from (select o_orderkey, (o_orderkey % 33)::double as n, (o_orderkey % 40)::double as o, o_orderkey % 367 as g, o_orderkey % 2 = 0 as e, "
     "(o_orderkey % 101)::double as p, o_orderkey % 300 as z, o_orderkey % 3 as r from orders)")
_add("title_similarity",
     lambda s, d: table(s, d, "part").select(
         "p_partkey", F.round(match.title_similarity(F.lower("p_type"), F.lower(F.concat_ws(" ", "p_brand", "p_type"))), 6).alias("share"),
         match.token_sort("p_type").alias("sorted")),
     "select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as share, array_to_string(list_sort(a), ' ') as sorted "
     "from (select p_partkey, string_split(lower(p_type), ' ') as a, string_split(lower(p_brand || ' ' || p_type), ' ') as b from part)")
# The longest common subsequence by a row of bits in one wide number: x character by character, y as places.
LCS_SQL = ("length({y}) - bit_count(list_reduce(list_prepend((1::hugeint << length({y})::hugeint) - 1, list_transform(string_split({x}, ''), "
           "lambda c: list_aggregate(list_prepend(0::hugeint, list_transform(range(length({y})), "
           "lambda k: case when substr({y}, (k + 1)::int, 1) = c then 1::hugeint << k::hugeint else 0::hugeint end)), 'sum')::hugeint)), "
           "lambda v, u: ((v + (v & u)) | (v - (v & u))) & ((1::hugeint << length({y})::hugeint) - 1)))")
SORTED_SQL = "array_to_string(list_sort(list_filter(string_split(lower(trim({t})), ' '), lambda w: w <> '')), ' ')"
_add("title_ratio",
     lambda s, d: spread(table(s, d, "part"), "p_partkey").select(
         "p_partkey", F.round(match.title_ratio(F.col("p_type"), F.col("p_name")), 6).alias("ratio"),
         F.round(match.title_ratio(F.concat_ws(" ", "p_type", "p_brand"), F.col("p_type")), 6).alias("longer")),
     "with t as (select p_partkey, " + ", ".join(SORTED_SQL.format(t=t) + f" as {n}" for n, t in (("a", "p_type"), ("b", "p_name"), ("c", "p_type || ' ' || p_brand")))
     + " from part), lcs as (select *, " + LCS_SQL.format(x="a", y="b") + " as ab, " + LCS_SQL.format(x="c", y="a") + " as ca from t) "
     "select p_partkey, round(1 - (length(a) + length(b) - 2 * ab) / (length(a) + length(b)), 6) as ratio, "
     "round(1 - (length(c) + length(a) - 2 * ca) / (length(c) + length(a)), 6) as longer from lcs")
_add("edit_name_similarity",
     lambda s, d: table(s, d, "part").select(
         "p_partkey", F.round(match.name_similarity(F.col("p_name"), F.col("p_type"), "edit"), 6).alias("similarity")),
     "select p_partkey, round(1 - levenshtein(trim(p_name), trim(p_type)) / greatest(length(trim(p_name)), length(trim(p_type))), 6) as similarity from part")
QUERIES["sequence_name_similarity"] = lambda s, d: table(s, d, "part").select(
    "p_partkey", match.name_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"),
    match.token_sort_similarity(F.col("p_name"), F.col("p_type")).alias("token_similarity"))
