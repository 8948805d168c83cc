"""Near-duplicate removal against a plain walk; washing, runs and their early ends; streams."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from serpflow import ads, dom, neardup, pipeline, sources, streams, text
from serpflow.ranking import DEFAULT, UNSPACED, is_result_like, post_filter
from serpflow.selectors import Strategy

S = Strategy(".r", ("h3",), ("h3 a",), ("p",))


def walk(rows, near):
    """rows: (item, cls, len) in order."""
    gone = set()
    for i, (a, ca, la) in enumerate(rows):
        if a in gone:
            continue
        for b, cb, lb in rows[i + 1 :]:
            if b in gone or not (ca == cb or (ca, cb) in near or (cb, ca) in near):
                continue
            if la >= lb:
                gone.add(b)
            else:
                gone.add(a)
                break
    return gone


def test_removal_equals_a_plain_walk_on_random_graphs(spark):
    rnd = random.Random(5)
    rows, pairs, want = [], [], set()
    for g in range(150):
        classes, base = rnd.randint(2, 7), 1000 * g
        size = {c: rnd.randint(1, 4) for c in range(classes)}
        near = {(a, b) for a in range(classes) for b in range(a + 1, classes) if rnd.random() < rnd.choice([0.2, 0.6])}
        own = [(base + i, base + c, size[c]) for i, c in enumerate(rnd.choices(range(classes), k=rnd.randint(1, 30)))]
        want |= walk(own, {(base + a, base + b) for a, b in near})
        rows += [(i, (i,), n, c) for i, c, n in own]
        pairs += [(base + a, base + b) for a, b in near]
    df = spark.createDataFrame(rows, "item long, o struct<pos:long>, len int, cls long").repartition(5)
    got = neardup.removed_by_walk(df, spark.createDataFrame(pairs, "a long, b long"))
    assert {r["item"] for r in got.collect()} == want and got.count() == len(want)


def test_copies_go_and_texts_without_terms_stay(spark):
    rows = [(0, 1, "green tea leaves"), (0, 2, "green tea leaves"), (0, 3, "- -"), (0, 4, "- -"), (1, 5, "green tea leaves"), (0, 6, "something else entirely"), (0, 7, "")]
    items = spark.createDataFrame(rows, "query_id long, item long, text string")
    kept = neardup.drop_near_duplicates(items, ["item"], ["query_id"])
    assert sorted(r["item"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7] and kept.columns == items.columns
    assert neardup.drop_near_duplicates(items.limit(0), ["item"], ["query_id"]).count() == 0


def test_copies_are_found_where_a_groups_texts_lie(spark):
    items = spark.createDataFrame([(0, 1, "green tea"), (0, 2, "green tea"), (1, 3, "black tea"), (None, 4, "tea")], "query_id long, item long, text string")
    plan = neardup._vectors(items, 0.85, neardup.WORDS, ["query_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    rows = [(0, 1, None), (0, 2, None), (None, 3, "green tea"), (None, 4, "green tea"), (0, 5, "Green tea"), (0, 6, "green tea"), (0, 7, "green tea")]
    items = spark.createDataFrame(rows, "query_id long, item long, text string")
    assert sorted(r["item"] for r in neardup.near_duplicates(items, ["item"], ["query_id"]).collect()) == [6, 7]


ROWS = [
    (0, "e1", 0, "Green tea", "https://a.example/1", "how leaves are dried"), (0, "e1", 1, "Sale now here", "https://site3.example/2", "offer"), (0, "e2", 0, "Green tea", "https://b.example/1", "how leaves are dried"),
    (0, "e1", 2, "Other matter", "https://a.example/3", "nothing of that kind"), (0, "e1", 3, "About tea", "https://a.example/4", "green leaves and more"), (0, "e3", 0, "Only sale here now", "https://site3.example/", ""),
]


def test_wash_counts_and_keeps_emptied_engines(spark):
    rows = spark.createDataFrame(ROWS, pipeline.ROWS)
    engines = rows.select("query_id", "engine").distinct()
    asked = spark.createDataFrame([(0, "green tea leaves")], "query_id long, query string")
    w = pipeline.wash(rows, engines, asked)
    assert (w.after_ads, w.after_duplicates, w.removed) == (4, 3, 1)
    assert [(r["engine"], r["title"], r["rank"]) for r in w.rows.orderBy("engine", "rank").collect()][1:] == [("e1", "About tea", 2), ("e1", "Other matter", 3)]
    assert {r["engine"]: len(r["results"]) for r in w.bundles().collect()} == {"e1": 3, "e2": 0, "e3": 0}
    none = pipeline.wash(rows.limit(0), engines, asked)
    assert none.removed == 0 and none.rows.count() == 0 and none.bundles().count() == 3


@pytest.fixture(scope="module")
def world(spark):
    registry = spark.createDataFrame([(0, "e1", "https://e1.example/", 9), (1, "e2", "https://e2.example/?q={query}", 3), (2, "e3", "https://e3.example", 6)], "ord int, name string, url string, speed int")
    queries = spark.createDataFrame([(0, " green tea "), (1, "  ")], "query_id long, query string")
    page = "<div class='r'><h3><a href='https://o.example/1'>Green tea</a></h3><p>leaves of green tea, dried</p></div>"
    crawl = spark.createDataFrame([(0, 0, "e1", "https://e1.example/s", page, "success", ""), (1, 0, "e2", "https://e2.example/s", page, "success", ""), (2, 0, "e3", "https://e3.example/s", "", "timeout", "too slow")], "page_id long, query_id long, engine string, url string, html string, status string, error string")
    return registry, queries, crawl


def test_run_from_registry_to_washed_rows(spark, world):
    registry, queries, crawl = world
    r = pipeline.run(registry, queries, crawl, {"e1": S})
    assert r.ended == "washed" and {(x["name"], x["request"]) for x in r.requests.collect()} == {("e1", "https://e1.example/search?q=green%20tea"), ("e3", "https://e3.example/search?q=green%20tea")}
    assert [(x["engine"], x["title"]) for x in r.washed.rows.collect()] == [("e1", "Green tea")] and [x["detail"] for x in r.failures.collect()] == ["too slow"]
    handed = pipeline.run(registry, queries, lambda asked: crawl.join(asked.select("query_id", "engine"), ["query_id", "engine"]), {"e1": S}, do_wash=False)
    assert handed.ended == "not washed" and handed.washed is None and handed.rows.count() == 1


def test_run_ends_early_with_typed_empty_output(spark, world):
    registry, queries, crawl = world
    ends = {
        "no source": pipeline.run(registry.limit(0), queries, crawl, {}), "no query": pipeline.run(registry, queries.filter("query_id = 1"), crawl, {}),
        "no usable page": pipeline.run(registry, queries, crawl.filter("engine = 'e3'"), {}),
    }
    for why, r in ends.items():
        assert r.ended == why and r.rows.count() == 0 and r.rows.columns == ["query_id", "engine", "pos", "title", "url", "snippet"] and r.bundles().count() == 0
    off = pipeline.run(registry, queries, crawl, {"e1": S}, do_extract=False)
    assert {x["engine"]: len(x["results"]) for x in off.bundles().collect()} == {"e1": 0}


def test_speed_order_and_blocks_of_sources(spark, world):
    registry, queries, _ = world
    assert [r["name"] for r in sources.by_speed(registry).orderBy("ord").collect()] == ["e1", "e3", "e2"]
    few, many = (sorted(map(tuple, sources.build_requests(queries, registry, {}, block=b).collect())) for b in (10, 1))
    assert few == many and len(few) == 6


def test_two_profiles_and_redirects(spark):
    rows = spark.createDataFrame([(0, "e", 0, "Ad: abc123456", "https://go.example/link?url=" + b"https://t.example/\"x".hex(), "some snippet"), (0, "e", 1, "abc", "https://go.example/other?url=" + b"https://t.example/x".hex(), "some snippet")], pipeline.ROWS)
    like = {n: [r[0] for r in rows.orderBy("pos").select(is_result_like(F.col("title"), F.col("url"), F.col("snippet"), F.lit(1.0), p)).collect()] for n, p in (("default", DEFAULT), ("unspaced", UNSPACED))}
    assert like == {"default": [True, True], "unspaced": [False, True]}
    got = [(r["title"], r["url"]) for r in post_filter(rows, UNSPACED).orderBy("pos").collect()]
    assert got[0] == ("Ad: abc123456", "https://t.example/") and got[1][1].startswith("https://go.example/other")
    titles = ["A &amp; B &raquo; docs", "site.comhttps://host.example/x", "SITE.COMhttps://h/x", "Sponsored - x", " › a", "q &lt; r"]
    clean = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(text.clean_title(F.col("t"), ("sponsored",))).collect()]
    assert clean == ["A & B", "host.example", "SITE.COMhttps://h/x", "x", "› a", "q < r"]


def record(k, at, html, status="success", query=0):
    return {"page_id": k, "query_id": query, "engine": f"e{k % 2}", "url": "https://s.example/q", "query": "q", "html": html, "status": status, "error": "", "fetched_at": f"2026-01-01T{at}:00Z"}


def link(n, title="Green tea leaves"):
    return f"<nav><a href='https://n.example/'>Not this</a></nav><div><a href='https://o.example/{n}'>{title} {n}</a><p>what is said about number {n}</p></div>"


def drain(df, path, **sink):
    q = df.writeStream.option("checkpointLocation", str(path / "ck")).trigger(availableNow=True)
    q = q.foreachBatch(sink["each"]) if "each" in sink else q.format("parquet").option("path", str(path / "out"))
    q.start().awaitTermination(200)


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(record(k, f"0{k}:00", link(k) + "<p>sale</p>", "error" if k == 3 else "success")) for k in range(5)))
    pairs = ads.labelled_union(spark.createDataFrame([("sale offer",), ("cheap sale",)], "text string"), spark.createDataFrame([("tea leaves",), ("green number",)], "text string"))
    ads.train_ad_model(pairs).save(str(tmp_path / "model"))
    model = ads.AdModel.load(str(tmp_path / "model"))
    drain(streams.page_rows(sources.stream_crawl(spark, str(tmp_path / "in")), model), tmp_path)
    batch = spark.read.schema(sources.STREAMED).json(str(tmp_path / "in"))
    key = lambda d: sorted(map(str, d.select("page_id", "pos", "title", "url", "snippet", "score", "ad").collect()))
    want = key(streams.page_rows(batch, model))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) == 4
    pages = batch.filter("status = 'success'").select("page_id", "url", "html")
    by_joins = sorted(tuple(r) for r in dom.link_candidates(pages).select("page_id", "title", "url", "snippet").collect())
    assert by_joins == sorted(tuple(r) for r in streams.page_rows(batch).select("page_id", "title", "url", "snippet").collect())


def test_first_per_url_drops_repeats_and_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [[record(0, "10:00", link(1)), record(1, "10:10", link(1)), record(2, "10:20", link(2))], [record(3, "15:00", link(3))], [record(4, "10:30", link(4)), record(5, "15:10", link(3)), record(6, "15:20", link(1))]]
    stream = streams.first_per_url(streams.page_rows(spark.readStream.schema(sources.STREAMED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))), "1 hour")
    for k, f in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, f)))
        drain(stream, tmp_path)
    got = Counter(r["url"][-1] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the URL of ten o'clock is forgotten by three; the row of half past ten comes too late
    assert got == {"1": 2, "2": 1, "3": 1}


def test_washed_batches_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, pipeline.ROWS)
    asked = spark.createDataFrame([(0, "green tea leaves")], "query_id long, query string")
    each = streams.wash_batches(str(tmp_path / "out"), asked)
    read = lambda: sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    each(rows, 0)
    once = read()
    each(rows, 0)  # the batch is run again after a failure
    assert read() == once and len(once) == 3
    each(rows.withColumn("query_id", F.lit(1).cast("long")), 1)
    assert len(read()) == 6  # no query of that number was asked: its rows stay as they came, with score 0
