"""Sinks, sources, streams and text functions on small inputs of our own."""

import json

from pyspark.sql import functions as F

from serpflow import neardup, sources, text, tfidf

ROWS = [(0, "e1", 0, "One", "https://a.example/1", 'say "hi"'), (0, "e1", 1, "Two", "https://a.example/2", "")]


def rows(spark):
    return spark.createDataFrame(ROWS, "query_id long, engine string, pos long, title string, url string, snippet string")


def test_json_keeps_empty_engines(spark, tmp_path):
    engines = spark.createDataFrame([(0, "e1"), (0, "e2")], "query_id long, engine string")
    sources.write_json(rows(spark), engines, str(tmp_path), "2026-01-01T00:00:00")
    manifest = spark.read.json(str(tmp_path / "manifest")).first()
    assert (manifest["total_engines"], manifest["total_results"]) == (2, 2)
    data = {r["engine"]: len(r["results"]) for r in spark.read.json(str(tmp_path / "data")).collect()}
    assert data == {"e1": 2, "e2": 0}


def test_csv_has_mark_and_doubled_quotes(spark, tmp_path):
    sources.write_csv(rows(spark), str(tmp_path / "csv"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert body.startswith("﻿Engine".encode()) and b'say ""hi""' in body and b"\r\n" in body


def test_registry_forms(spark, tmp_path):
    forms = {"dict": '{"a": {"url": "u", "speed": 9}, "b": {}}', "list": '[{"name": "a", "url": "u"}]', "bad": "nothing"}
    got = {}
    for name, body in forms.items():
        (tmp_path / name).write_text(body)
        got[name] = [tuple(r) for r in sources.read_sources(spark, str(tmp_path / name)).orderBy("ord").collect()]
    assert got == {"dict": [(0, "a", "u", 9), (1, "b", "", 5)], "list": [(0, "a", "u", None)], "bad": []}


def test_stream_counts_by_window(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    records = [{"engine": "e", "status": s, "fetched_at": f"2026-01-01T0{h}:10:00Z"} for h, s in ((0, "success"), (0, "timeout"), (5, "skipped"), (9, "success"))]
    (source / "a.json").write_text("\n".join(map(json.dumps, records)))
    counts = sources.status_per_window(sources.stream_crawl(spark, str(source)))
    q = counts.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["success"], r["failed"], r["skipped"]) for r in spark.read.parquet(str(out)).collect()}
    assert (1, 1, 0) in got


def test_text_functions(spark):
    r = spark.range(1).select(
        text.clean_text(F.lit("  a　 b\n")).alias("clean"), text.percent_quote(F.lit("a b/c~*é")).alias("quoted"),
        text.authority(F.lit("https://h.example:80/x y")).alias("host"), text.join_item(F.lit(""), F.lit("s")).alias("joined"),
        text.clean_title(F.lit("AD: Name › docs"), ("ad",)).alias("title"),
    ).first()
    assert tuple(r) == ("a b", "a%20b/c~%2A%C3%A9", "h.example:80", "s", "Name")


def test_prefix_filter_drops_no_pair(spark):
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(words[:i] + [words[i] + "x"] + words[i + 1 :]) for i in range(10)] + [" ".join(words)] * 3
    items = spark.createDataFrame(list(enumerate(texts)), "item long, text string")
    got = {(r["a"], r["b"]) for r in neardup.similar_pairs(items, 0.5).collect()}
    every = {(r["a"], r["b"]) for r in neardup.similar_pairs(items, 1e-6).filter("sim >= 0.5").collect()}
    assert got == every and got


def test_groups_score_alike_whether_they_come_whole_or_dealt_by_term(spark, monkeypatch):
    words = ["red", "blue", "green", "stone", "river", "cloud"]
    rows = [(g, i, " ".join(words[(g + i * k + k * k) % 6] for k in range(3 + (i * g) % 9))) for g in range(4) for i in range(6 + 10 * g)]
    items = spark.createDataFrame(rows + [(None, 1, "red"), (2, 3, "blue blue"), (9, 1, "")], "g long, item long, text string")
    asked = spark.createDataFrame([(g, "blue stone river") for g in range(4)] + [(9, "red")], "g long, text string")
    for a in (tfidf.WORDS, tfidf.Analyzer("char", 2, 3, cap=15, sublinear=True)):
        score = lambda: sorted(map(tuple, tfidf.cosine_to_query(items, asked, ["g"], a).collect()), key=repr)
        near = lambda: sorted(map(tuple, neardup.similar_pairs(items.filter("not (g = 2 and item = 3)"), 0.6, a, ["g"], digits=5).collect()))
        count = lambda: sorted(map(tuple, tfidf.frequencies(items, ["g"], a).collect()), key=repr)
        whole = score(), near(), count()
        monkeypatch.setattr(tfidf, "TASK_CHARS", 800)  # some groups are large
        assert (score(), near(), count()) == whole
        monkeypatch.undo()
        assert whole[0] and whole[1]


def test_terms_of_a_small_group_are_not_shuffled(spark):
    items = spark.createDataFrame([(g, i, "a red stone and a blue one") for g in range(3) for i in range(4)], "g long, item long, text string")
    plan = tfidf.norms(items, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan.split("Generate")[0]
    for chars, dealt_again in ((1000, False), (20, True)):
        counts = tfidf.totals(items, ["g"], text.word_tokens, chars)
        assert ("Exchange" in counts._jdf.queryExecution().executedPlan().toString().split("Generate")[0]) == dealt_again
        assert {tuple(r) for r in counts.collect()} == {(g, w, 4) for g in range(3) for w in ("red", "stone", "and", "blue", "one")}
