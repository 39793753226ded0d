"""Operators on pages and vectors against brute force, and their edge cases; the queries and the pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from twinfold.llm import decontaminate, html, neighbours, queries, urls, warc
from twinfold.llm.html import Page

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"


def taken(text):
    page = Page(text)
    return page.text([page.best()[0]])


@pytest.mark.parametrize(("text", "expected"), [
    ("", ""), ("plain  text", "plain text"), ("<p>a<b>b</b>c<br>d<p>e &amp;lt; f&nbsp;g", "abc d e &lt; f g"),
    ("<nav><p>menu</p></nav><article><h1>T</h1><p>One.<p>Two <i>x</i>y.</article><footer>f</footer>", "T One. Two xy."),
    ("<div class='menu'><a href=x>home</a></div><div id=content><p>One two.</p><div class='comments'><p>a long comment of a reader</p></div></div>", "One two."),
    ("<main><article><header><h1>H</h1></header><section><p>a</section><section><p>b</section><aside>no</aside></article></main>", "H a b"),
    ("<article>x <table><tr><td>1<td>2</table><ul><li>a<li>b</ul><form>q<input></form></article>", "x 1 2 a b"),
    ("<script>if (a<b) { t = '</p>' }</script><style>p{}</style><!-- c --><p>text", "text"), ("<body class='with ad'><p>kept</p></body>", "kept"),
    ("<p hidden>no</p><p style='display:none'>no</p><p>yes", "yes"), ('<div class="a><p>broken</p></div>', "broken"), ("<p>1 < 2 <3 &copy; &#233;", "1 < 2 <3 © é"),
])
def test_main_text(text, expected):
    assert taken(text) == expected


def test_long_and_deep_pages_end():
    assert taken("<div>" * 3000 + "deep") == "deep" and taken("<" * 20_000 + "a").endswith("a")
    assert len(taken("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    taken('<a x="' * 5_000)


def test_hosts_agree_on_a_path(spark):
    page = "<div class='wrap'><div class='post-{k}'><p>{body}</p></div><div class='box'><p>{box}</p></div></div>"
    rows = [(k, "http://A.example.com/p", page.format(k=k, body="main text " * 9, box="box " * 3)) for k in range(8)]
    # Here the box is longer, but the host's other pages say where the text is.
    rows += [(8, "http://a.example.com/q", page.format(k=8, body="short main", box="box " * 30)), (9, "http://b.example.com/", "<p>own</p>"),
             (10, None, None), (None, "x", "<article>y</article>"), (9, "http://b.example.com/", "<p>own</p>")]
    pages = spark.createDataFrame(rows, PAGES)
    for broadcast_hosts in (1000, 0):
        got = html.extract(pages, broadcast_hosts).collect()
        texts = Counter((r["page_id"], r["text"]) for r in got)
        assert texts[8, "short main"] == 1 and texts[9, "own"] == 2 and texts[10, ""] == 1 and texts[None, "y"] == 1 and len(got) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_archives(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    random.seed(1)
    texts = ["", None, "<p>é\r\n\r\n日", "x" * 50_000] + ["".join(random.choice("abc <>\r\n") for _ in range(random.randint(0, 400))) for _ in range(60)]
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(texts + texts[:20] + texts[4:6] * 3)]
    rows += [(None, None, "no id"), (None, "u\r\nv", "no id"), (2, "again", texts[2]), (500, "a", "twice"), (500, "a", "twice"), (7, "z", "twice")]
    index, folder = warc.archive(spark.createDataFrame(rows, PAGES))
    payloads = defaultdict(list)
    for page_id, _, t in rows:
        payloads[t or ""].append(page_id)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows) and index.select("archive").distinct().count() > 3
    expected = Counter()
    for t, ids in payloads.items():
        most = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = most is not None and i != most
            raw = t.encode()
            expected[i, "" if again else t, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", most if again else None] += 1
    assert Counter((r["page_id"], r["payload"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
    some = index.where("page_id in (3, 7, 40)")
    assert {r["page_id"] for r in warc.read_records(some, folder, with_payload=False).collect()} == {3, 7, 40}
    index, folder = warc.archive(spark.createDataFrame([], PAGES))
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_least_bytes_keeps_small_responses(spark):
    index, folder = warc.archive(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], PAGES), least_bytes=4)
    assert {r["page_id"]: r["record_type"] for r in warc.read_records(index, folder).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_rules(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?q#f"), (2, "http://example.net/en"), (3, "http://x.net/"), (4, "http://x.net"), (5, "http://example.com/de/1"),
        (6, "http://notexample.com/de/1"), (7, "http://a.org/fr/"), (8, None), (9, "no scheme"), (10, "http://org/fr/x"), (11, "a://b://c/d"), (12, "http://h?x/en/"),
        (12, "http://h?x/en/"), (None, "http://net/a"), (13, "://y.net/\nz"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, domain string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = Counter(tuple(r)[:5] for r in urls.filter_urls(pages, outcomes).collect())
    assert got == Counter([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/en", "net/", "block"), (3, "x.net", "/", "net/", "block"),
        (4, "x.net", "", None, "allow"), (5, "example.com", "/de/1", "example.com/de/", "block"), (6, "notexample.com", "/de/1", None, "allow"),
        (7, "a.org", "/fr/", "org/fr/", "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "org", "/fr/x", "org/fr/", "allow"),
        (11, "b:", "//c/d", None, "allow"), (12, "h", "", None, "allow"), (12, "h", "", None, "allow"), (None, "net", "/a", "net/", "block"),
        (13, "y.net", "/\nz", "net/", "block"),
    ])
    assert urls.filter_urls(spark.createDataFrame([], PAGES), outcomes).count() == 0


def test_bad_hosts_are_blocked(spark):
    outcomes = [("spam.site.com", 1)] * 60 + [("ok.site.com", 0)] * 60 + [("other.org", 0)] * 200 + [("few.org", 1)] + [("bad.co.uk", 1)] * 80 + [("", 1)] * 9
    pages = [(k, f"http://{h}/p") for k, h in enumerate(["spam.site.com", "ok.site.com", "other.org", "few.org", "new.org", "x.bad.co.uk", "y.elsewhere.com"])]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, bad int")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(side, 3)
    path = side[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_vectors(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(1500, 16))
    x[700:900] = x[5]  # a vector that many share
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0, None] + [1.0] * 14), (None, x[0].tolist()), (2400, [1.0]), (100, x[100].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    assert set(by_query) == set(range(0, 1500, 100))
    for q, found in by_query.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(1500), d)) if k != q][:10]
        assert len(found) == 10 and all(np.isclose(s, d[v], rtol=1e-12) for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        hits += len({v for v, _ in found} & set(best))
        if q in (700, 800):
            assert [v for v, _ in found] == best
    assert hits >= 0.9 * 150
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        expected = con.execute(sql).to_arrow_table()
        got = queries.QUERIES[name](spark, SF).toArrow().select(expected.column_names)
        rows = lambda t: sorted(repr(tuple(r.values())) for r in t.to_pylist())
        assert rows(got) == rows(expected), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 4
    cleaned = stages["decontamination"](spark, docs, SF)
    items = [(i, *decontaminate.question_and_answer(t)) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    runs = [{tuple(q[k:k + 4]) for q in (question,) for k in range(len(q) - 3)} for _, question, _ in items]
    for r in cleaned.collect():
        ws = decontaminate.item_words(r["text"])
        there = {tuple(ws[k:k + 4]) for k in range(len(ws) - 3)}
        assert not any(len(run) > 3 and run <= there for run in runs)
    assert cleaned.columns == docs.columns
    single = stages["simhash_near_dedup"](spark, docs, SF)
    assert single.columns == docs.columns and single.count() == single.select("text").distinct().count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert 0 < packed.select("doc_id").distinct().count() <= docs.count()


def test_long_paths_that_differ_in_the_middle_stay_apart(spark):
    def page(middle, tag="div"):
        long = lambda k: " ".join(f"utility-{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
        return (f'<body><div class="{long(0)}"><div class="{middle}"><{tag} class="{long(1)}"><p>{"Main words of the article stand here. " * 8}</p></{tag}></div>'
                f'<div class="other"><{tag} class="{long(1)}"><p>Short aside.</p></{tag}></div></div></body>')

    for tag in ("div", "section"):
        own = html.Page(page("text", tag))
        node, _ = own.best()
        path = own.path(node)
        assert len(path) < 300 and own.on_path(path) == [node] and html.Page(page("elsewhere", tag)).on_path(path) == []
    rows = [(k, "http://h.org/x", page("text")) for k in range(3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {("Main words of the article stand here. " * 8).strip()}
