"""The registered queries of this folder: each applies one operator to its whole table. SQL twins where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import backoff, decontaminate, html, kneser_ney, licenses, neighbours, packing, products, runs, simhash, spelling, urls, warc
from twinfold.llm.tables import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.judged(docs, labels, keep=("doc_id", "lang"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("word_score", 6).alias("word_score"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    records = warc.read_records(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.outcomes_by_document(pages, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.planted_slips)


def op12_largest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.largest_products(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.run_digests(runs.periodic_runs(docs, text=runs.with_planted_runs(docs)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_decontamination, op3_license_scan, op4_simhash, op5_hilbert_neighbours, op6_html_extraction,
        op7_stupid_backoff, op8_packing, op9_warc, op10_url_filter, op11_spelling_variants,
        op12_largest_products, op13_periodic_runs,
    )
}

_TOKENS = r"""
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
"""

SQL = {
    "op7_stupid_backoff": rf"""
with docs as ({_TOKENS}),
words as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from docs),
pairs as (select b.r, a.w as v, b.w from words b join words a on a.r = b.r and a.i = b.i - 1),
one as (select w, count(*)::double as n from words group by w),
two as (select v, w, count(*)::double as n from pairs group by v, w having count(*) >= {backoff.LEAST_COUNT}),
total as (select count(*)::double as n from words),
first_words as (select w.r, ln(o.n / t.n) as s from words w join one o using (w), total t where w.i = 1),
next_words as (
  select p.r, case when two.n is not null then ln(two.n / c.n) else ln(o.n / t.n) + ln({backoff.ALPHA}) end as s
  from pairs p join one o on o.w = p.w join one c on c.w = p.v left join two on two.v = p.v and two.w = p.w, total t),
sums as (select r, sum(s) as s from (select * from first_words union all select * from next_words) group by r)
select doc_id, len(ws)::bigint as n_words, round(coalesce(s, 0.0), 4) as log_score,
  case when len(ws) > 0 then round(s / len(ws), 6) end as word_score
from docs left join sums using (r)
""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as h from p),
b as (select page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 10 * (k // 8))::int, 10))::ubigint >> (35 - 5 * (k % 8))) & 31)::int, 1)),
    lambda a, x: a || x) as payload_digest from d),
w as (select payload_digest, max(page_id) as first_id, count(*) as n from b group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id and first_id is not null then first_id end as refers_to
from b join w using (payload_digest)
""",
    "op10_url_filter": r"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) as path
  from pages),
two as (select *, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') as last2,
  list_aggregate(list_slice(string_split(host, '.'), -3, -1), 'string_agg', '.') as last3 from parts),
p as (select page_id, host, path,
  case when last2 in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in') then last3 else last2 end as domain,
  case when last2 in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in') then last2
    else string_split(host, '.')[-1] end as suffix from two),
marks as (select doc_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
seen as (select host, domain, suffix, bad from p join marks on doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1) as bigint) where host <> ''),
h as (select host, domain, suffix, count(*)::double as n, sum(bad)::double as k from seen group by all),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k from d group by all),
moments as (
  select 'h' as lvl, sum(n) as n, sum(k) / sum(n) as m, count(*) as u, sum(k * k / n) as kk from h
  union all select 'd', sum(n), sum(k) / sum(n), count(*), sum(k * k / n) from d
  union all select 's', sum(n), sum(k) / sum(n), count(*), sum(k * k / n) from s),
prior as (select lvl, m, case when kk / n - m * m - m * (1 - m) * u / n > 0
  then least(greatest(m * (1 - m) / (kk / n - m * m - m * (1 - m) * u / n) - 1, 1.0), 10000.0) else 10000.0 end as w from moments),
s2 as (select suffix, n, (k + w * m) / (n + w) as q, n + w as a from s, prior where lvl = 's'),
d2 as (select domain, d.suffix, d.n, (k + w * s2.q) / (d.n + w) as q, d.n + w as a from d join s2 using (suffix), prior where lvl = 'd'),
h2 as (select host, h.n, h.k, (k + w * d2.q) / (h.n + w) as q, h.n + w as a from h join d2 using (domain, suffix), prior where lvl = 'h'),
judged as (
  select page_id, p.host, path, h2.n as hn, h2.k as hk,
    coalesce(h2.q - 1.645 * sqrt(h2.q * (1 - h2.q) / (h2.a + 1)), d2.q - 1.645 * sqrt(d2.q * (1 - d2.q) / (d2.a + 1)),
      s2.q - 1.645 * sqrt(s2.q * (1 - s2.q) / (s2.a + 1)), 0) as bound,
    case when (p.host = 'example.net' or p.host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
      when (p.host = 'example.com' or p.host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
      when (p.host = 'org' or p.host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
      when (p.host = 'net' or p.host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from p left join h2 on h2.host = p.host left join d2 on d2.domain = p.domain left join s2 on s2.suffix = p.suffix)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when bound > 0.5 then 'block' else 'allow' end as verdict,
  coalesce(hn, 0)::bigint as host_labelled, coalesce(hk, 0)::bigint as host_bad
from judged
""",
    "op11_spelling_variants": r"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
found as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
once as (select doc_id, run, count(*) as n, hex(concat(doc_id::varchar, ':', run)) as b from found group by doc_id, run),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(b) // 2), lambda k: ('0x' || substr(b, (2 * k + 1)::int, 2))::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from once, crc),
slipped as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from slipped group by word having length(word) >= 5 and sum(n) >= 3),
cuts as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on w.word = c.rest
  union select w.word, c.word, c.n from cuts c join words w on w.word = c.rest),
best as (
  select word, count(*) as n_near, (array_agg(near order by near_n desc, encode(near)))[1] as near, max(near_n) as near_n from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n
  from words w left join best using (word)),
steps as (
  select word, word as at from forms
  union all select s.word, f.form from steps s join forms f on f.word = s.at where f.form is not null),
ends as (select s.word, s.at from steps s join forms f on f.word = s.at where f.form is null)
select f.word, f.form, e.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from forms f join ends e using (word)
""",
    "op12_largest_products": """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(256 * x::double))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, c.r as other, case when len(c.x) = 0 then 0 else list_dot_product(q.x, c.x) end::bigint as score
  from v q join v c on c.r <> q.r and len(c.x) = len(q.x) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last, other)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
}
