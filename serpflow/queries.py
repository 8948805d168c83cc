"""Registered queries of the engine, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import ads, dom, neardup, pipeline, ranking, selectors, sources, store, text, tfidf
from .fixtures import CRAWL_SQL, QUERIES_SQL, RESULTS_SQL, SOURCES_SQL
from .ranking import DEFAULT as P

GID = ["query_id", "engine"]
STOP = ("the", "of", "and", "de", "la", "der", "die", "und", "les", "que")
TEMPLATES = {"france": "https://fr.example/t?x={query}", "kenya": "https://ke.example/t?x={query}"}
SKIP = ("peru",)
ALIASES = {"china": "cn", "japan": "jp"}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def items_of(spark, sf_dir) -> DataFrame:
    return fx.results(spark, sf_dir).select(*GID, F.col("pos").alias("item"), F.concat("title", F.lit(" "), "snippet").alias("text"))


def texts_of(spark, sf_dir) -> DataFrame:
    return fx.results(spark, sf_dir).select("query_id", F.concat("title", F.lit(" "), "snippet").alias("text"))


def per_group_queries(spark, sf_dir) -> DataFrame:
    groups = fx.results(spark, sf_dir).select(*GID).distinct()
    return groups.join(fx.queries(spark, sf_dir), "query_id").select(*GID, F.col("query").alias("text"))


def scored(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """Result rows, or what is needed of them, with their scores."""
    s = tfidf.cosine_to_query(items_of(spark, sf_dir), per_group_queries(spark, sf_dir), GID).withColumnRenamed("item", "pos")
    return (fx.results(spark, sf_dir) if rows is None else rows).join(s, [*GID, "pos"])


ITEMS_SQL = f"""{RESULTS_SQL}, {QUERIES_SQL}, items AS (SELECT query_id, engine, pos AS item, title || ' ' || snippet AS text FROM results
  UNION ALL SELECT g.query_id, g.engine, -1, q.query FROM (SELECT DISTINCT query_id, engine FROM results) g JOIN queries q USING (query_id))"""
SCORED_SQL = f"{ITEMS_SQL}, {tfidf.tfidf_sql('items', 'query_id, engine')}, scored AS (SELECT r.*, s.score FROM results r JOIN scores s ON r.query_id = s.query_id AND r.engine = s.engine AND r.pos = s.item)"
_TOK = "regexp_extract_all(lower(title || ' ' || snippet), '[\\p{L}\\p{N}_]{2,}')"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def in_(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"WITH {RESULTS_SQL} SELECT pos, array_to_string({_TOK}, ' ') AS tokens FROM results")
def t1_word_tokens(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    return r.select("pos", F.array_join(text.word_tokens(F.concat("title", F.lit(" "), "snippet")), " ").alias("tokens"))


@query(f"""WITH {RESULTS_SQL}, t AS (SELECT query_id, lower(title || ' ' || snippet) AS t FROM results)
SELECT query_id, gram, count(*) AS n FROM (SELECT query_id, unnest(flatten(list_transform(range(2, 5), lambda n: list_transform(range(1, CAST(length(t) AS BIGINT) - n + 2), lambda i: substring(t, i, n))))) AS gram FROM t) GROUP BY ALL""")
def t2_char_ngrams(spark, sf_dir):
    return tfidf.char_totals(texts_of(spark, sf_dir), ["query_id"], 2, 4).withColumnRenamed("term", "gram")


@query(f"""WITH {RESULTS_SQL}, t AS (SELECT query_id, {_TOK} AS t FROM results)
SELECT query_id, gram, count(*) AS n FROM (SELECT query_id, unnest(flatten(list_transform(range(1, 4), lambda n: list_transform(range(1, CAST(len(t) AS BIGINT) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))))) AS gram FROM t) GROUP BY ALL""")
def t3_word_ngrams(spark, sf_dir):
    return tfidf.totals(texts_of(spark, sf_dir), ["query_id"], lambda t: text.word_ngrams(text.word_tokens(t), 1, 3)).withColumnRenamed("term", "gram")


@query(f"WITH {RESULTS_SQL} SELECT pos, array_to_string(list_filter({_TOK}, lambda x: x NOT IN {in_(STOP)}), ' ') AS tokens FROM results")
def t4_stop_filter(spark, sf_dir):
    t = text.word_tokens(F.concat("title", F.lit(" "), "snippet"))
    return fx.results(spark, sf_dir).select("pos", F.array_join(text.stop_filter(t, STOP), " ").alias("tokens"))


@query(f"""WITH {RESULTS_SQL}, c AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({_TOK}) AS term FROM results) GROUP BY ALL)
SELECT query_id, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS INT) AS rank FROM c) WHERE rank <= 800""")
def t5_vocab_cap(spark, sf_dir):
    from pyspark.sql import Window

    r = fx.results(spark, sf_dir).select("query_id", F.explode(text.word_tokens(F.concat("title", F.lit(" "), "snippet"))).alias("term"))
    c = r.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "term"))).filter("rank <= 800")


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, score FROM scored")
def t6_cosine_to_query(spark, sf_dir):
    return scored(spark, sf_dir).select(*GID, "pos", "score")


#: The settings of both built-in profiles: characters, and words with stop words.
CHARS_800 = tfidf.Analyzer("char", 2, 4, cap=800, sublinear=True)
WORDS_1000 = tfidf.Analyzer("word", 1, 3, stop=STOP, cap=1000, sublinear=True)


@query(f"WITH {ITEMS_SQL}, {tfidf.tfidf_sql('items', 'query_id, engine', CHARS_800)} SELECT query_id, engine, item AS pos, score FROM scores")
def t6_cosine_by_characters(spark, sf_dir):
    return tfidf.cosine_to_query(items_of(spark, sf_dir), per_group_queries(spark, sf_dir), GID, CHARS_800).withColumnRenamed("item", "pos")


@query(f"WITH {ITEMS_SQL}, {tfidf.tfidf_sql('items', 'query_id, engine', WORDS_1000)} SELECT query_id, engine, item AS pos, score FROM scores")
def t6_cosine_by_capped_words(spark, sf_dir):
    return tfidf.cosine_to_query(items_of(spark, sf_dir), per_group_queries(spark, sf_dir), GID, WORDS_1000).withColumnRenamed("item", "pos")


@query(f"""WITH {SCORED_SQL}, x AS (SELECT *, max(score) OVER (PARTITION BY query_id, engine) AS best, CASE WHEN engine IN {in_(P.major)} THEN {P.tiers[0]} WHEN engine IN {in_(P.middle)} THEN {P.tiers[1]} ELSE {P.tiers[2]} END AS least FROM scored)
SELECT query_id, engine, pos, url, score FROM x WHERE score >= least AND (least < {P.tiers[2]} OR best >= {P.least_group_max})""")
def t8_filter_by_relevance(spark, sf_dir):
    return ranking.filter_by_relevance(scored(spark, sf_dir)).select(*GID, "pos", "url", "score")


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, title, url, score, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY score DESC, pos) AS INT) AS rank FROM scored")
def t9_rank_by_relevance(spark, sf_dir):
    return ranking.rank_by_relevance(scored(spark, sf_dir)).select(*GID, "pos", "title", "url", "score", "rank")


@query("""WITH items AS (SELECT 0 AS g, min(doc_id) AS item, text, count(*) AS m FROM documents GROUP BY text), toks AS (SELECT item, m, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM items),
terms AS (SELECT item, m, term, count(*) AS tf FROM (SELECT item, m, unnest(t) AS term FROM toks UNION ALL SELECT item, m, unnest(list_transform(range(1, CAST(len(t) AS BIGINT)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks WHERE len(t) >= 2) GROUP BY ALL),
dfs AS (SELECT term, sum(m) AS df FROM terms GROUP BY term), w AS (SELECT item, a.term, d.df, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + d.df)) + 1) AS w FROM terms a JOIN dfs d ON a.term = d.term),
u AS (SELECT item, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS u FROM w)
SELECT a.item AS a, b.item AS b, round(sum(a.u * b.u), 6) AS sim FROM u a JOIN u b ON a.term = b.term AND a.item < b.item WHERE a.df > 1 OR b.df > 1 GROUP BY ALL HAVING sum(a.u * b.u) >= 0.85""")
def t12_similar_pairs(spark, sf_dir):
    return neardup.similar_pairs(fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"))


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS text_id, doc_id AS item FROM documents")
def t12_copies(spark, sf_dir):
    return neardup.copies(fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"))


def walk_sql(rows: str) -> str:
    """CTEs over a CTE of result rows, the last of them stays (query_id, engine, pos): the rows a walk over each query
    leaves.  The walk's state is the next row and the list of rows gone."""
    return f"""joined AS (SELECT query_id, engine, pos, concat_ws(' ', nullif(title, ''), nullif(snippet, '')) AS text FROM {rows}),
ranked AS (SELECT query_id, engine, pos, text, length(text) AS len, row_number() OVER (PARTITION BY query_id ORDER BY engine, pos) AS k FROM joined),
rtok AS (SELECT query_id, k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM ranked),
rterm AS (SELECT query_id, k, term, count(*) AS tf FROM (SELECT query_id, k, unnest(t) AS term FROM rtok UNION ALL SELECT query_id, k, unnest(list_transform(range(1, CAST(len(t) AS BIGINT)), lambda i: t[i] || ' ' || t[i + 1])) FROM rtok WHERE len(t) >= 2) GROUP BY ALL),
rdf AS (SELECT query_id, term, count(*) AS df FROM rterm GROUP BY ALL), rn AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY ALL),
rw AS (SELECT a.query_id, a.k, a.term, d.df, a.tf * (ln((1 + n.n) / (1 + d.df)) + 1) AS w FROM rterm a JOIN rdf d ON a.query_id = d.query_id AND a.term = d.term JOIN rn n ON a.query_id = n.query_id),
ru AS (SELECT query_id, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, k)) AS u FROM rw),
close AS (SELECT a.query_id, a.k AS i, b.k AS j FROM ru a JOIN ru b ON a.query_id = b.query_id AND a.term = b.term AND a.k < b.k GROUP BY ALL HAVING sum(a.u * b.u) >= 0.85),
near AS (SELECT r.query_id, r.k, r.len, list({{'j': c.j, 'len': s.len}}) FILTER (c.j IS NOT NULL) AS nb FROM ranked r LEFT JOIN close c ON c.query_id = r.query_id AND c.i = r.k LEFT JOIN ranked s ON s.query_id = r.query_id AND s.k = c.j GROUP BY ALL),
live AS (SELECT * FROM near WHERE nb IS NOT NULL), turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS turn FROM live),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS gone FROM ranked
  UNION ALL SELECT query_id, turn, CASE WHEN list_contains(gone, k) THEN gone WHEN stop IS NULL THEN list_concat(gone, list_transform(near, lambda x: x.j))
    ELSE list_concat(list_append(gone, k), list_transform(list_filter(near, lambda x: x.j < stop), lambda x: x.j)) END
  FROM (SELECT query_id, turn, gone, k, list_filter(rest, lambda x: x.len <= own) AS near, list_min(list_transform(list_filter(rest, lambda x: x.len > own), lambda x: x.j)) AS stop
    FROM (SELECT t.query_id, t.turn, w.gone, t.k, t.len AS own, list_filter(t.nb, lambda x: NOT list_contains(w.gone, x.j)) AS rest FROM walk w JOIN turns t ON t.query_id = w.query_id AND t.turn = w.turn + 1))),
ended AS (SELECT query_id, gone FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY turn DESC) = 1),
stays AS (SELECT r.query_id, r.engine, r.pos FROM ranked r JOIN ended e ON e.query_id = r.query_id WHERE NOT list_contains(e.gone, r.k))"""


def unique_items(spark, sf_dir) -> DataFrame:
    return fx.results(spark, sf_dir).withColumn("item", F.col("pos")).withColumn("text", text.join_item(F.col("title"), F.col("snippet")))


@query(f"WITH RECURSIVE {RESULTS_SQL}, {walk_sql('results')} SELECT r.query_id, r.engine, r.pos, r.title, r.url FROM results r JOIN stays s ON r.query_id = s.query_id AND r.pos = s.pos")
def t13_j4_drop_near_duplicates(spark, sf_dir):
    return neardup.drop_near_duplicates(unique_items(spark, sf_dir), ["engine", "pos"], ["query_id"]).select(*GID, "pos", "title", "url")


_ADTEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(snippet, '')))"
_URGENT = "(" + " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in P.urgency) + ")"
_RULES_SQL = f"CASE WHEN {any_of(_ADTEXT, P.ad_words)} THEN 3 ELSE 0 END + CASE WHEN {any_of('lower(url)', P.ad_urls)} THEN 2 ELSE 0 END + CASE WHEN {_URGENT} >= 2 THEN 1 ELSE 0 END"


def washed_sql(rows: str) -> str:
    """CTEs over a CTE of result rows: noads (the rules alone), the walk's, and washed, ranked by the query."""
    return f"""noads AS (SELECT * FROM {rows} WHERE {_RULES_SQL} < 4), {walk_sql('noads')},
left_over AS (SELECT n.* FROM noads n JOIN stays s ON n.query_id = s.query_id AND n.engine = s.engine AND n.pos = s.pos),
items AS (SELECT query_id, engine, pos AS item, concat_ws(' ', nullif(title, ''), nullif(snippet, '')) AS text FROM left_over
  UNION ALL SELECT g.query_id, g.engine, -1, q.query FROM (SELECT DISTINCT query_id, engine FROM left_over) g JOIN queries q ON q.query_id = g.query_id), {tfidf.tfidf_sql('items', 'query_id, engine')},
washed AS (SELECT l.*, s.score, CAST(row_number() OVER (PARTITION BY l.query_id, l.engine ORDER BY s.score DESC, l.pos) AS INT) AS rank FROM left_over l JOIN scores s ON s.query_id = l.query_id AND s.engine = l.engine AND s.item = l.pos)"""


def washed(spark, sf_dir) -> pipeline.Washed:
    """The fixture's rows washed by the rules alone: SQL can't train a model."""
    r = fx.results(spark, sf_dir)
    return pipeline.wash(r, r.select(*GID).distinct(), fx.queries(spark, sf_dir))


@query(f"WITH RECURSIVE {RESULTS_SQL}, {QUERIES_SQL}, {washed_sql('results')} SELECT query_id, engine, pos, title, url, snippet, score, rank FROM washed")
def m2_wash(spark, sf_dir):
    return washed(spark, sf_dir).rows


@query(f"""WITH RECURSIVE {RESULTS_SQL}, {QUERIES_SQL}, {washed_sql('results')} SELECT q.query_id, (SELECT count(*) FROM noads n WHERE n.query_id = q.query_id) AS after_ads,
  (SELECT count(*) FROM washed w WHERE w.query_id = q.query_id) AS kept, (SELECT count(*) FROM noads n WHERE n.query_id = q.query_id) - (SELECT count(*) FROM washed w WHERE w.query_id = q.query_id) AS removed FROM (SELECT DISTINCT query_id FROM results) q""")
def g5_removed_by_dedup(spark, sf_dir):
    return washed(spark, sf_dir).removed_by_query()


@query(f"""WITH RECURSIVE {RESULTS_SQL}, {QUERIES_SQL}, {washed_sql('results')} SELECT r.query_id, r.engine, (SELECT count(*) FROM washed w WHERE w.query_id = r.query_id AND w.engine = r.engine) AS n,
  coalesce((SELECT string_agg(w.url, '|' ORDER BY w.rank) FROM washed w WHERE w.query_id = r.query_id AND w.engine = r.engine), '') AS urls FROM (SELECT DISTINCT query_id, engine FROM results) r""")
def m2_washed_bundles(spark, sf_dir):
    b = washed(spark, sf_dir).bundles()
    return b.select(*GID, F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda x: x["url"]), "|").alias("urls"))


@query(f"WITH {SOURCES_SQL} SELECT CAST(row_number() OVER (ORDER BY coalesce(speed, 0) DESC, ord) - 1 AS INT) AS ord, name, url, speed FROM sources")
def i1_by_speed(spark, sf_dir):
    return sources.by_speed(fx.sources(spark, sf_dir))


@query(f"WITH {ITEMS_SQL}, {tfidf.tfidf_sql('items', 'query_id, engine')} SELECT query_id, engine, term, df FROM dfs")
def g7_document_frequency(spark, sf_dir):
    both = tfidf.with_queries(items_of(spark, sf_dir), per_group_queries(spark, sf_dir), GID)
    return tfidf.frequencies(both, GID)


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, max(score) AS best, count(*) AS n FROM scored GROUP BY ALL")
def g8_group_maximum(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*GID).agg(F.max("score").alias("best"), F.count("*").alias("n"))


@query(f"WITH {ITEMS_SQL}, {tfidf.tfidf_sql('items', 'query_id, engine')} SELECT query_id, engine, item, round(norm, 6) AS norm FROM norms")
def w7_item_norms(spark, sf_dir):
    both = tfidf.with_queries(items_of(spark, sf_dir), per_group_queries(spark, sf_dir), GID)
    return tfidf.norms(both, GID).withColumn("norm", F.round("norm", 6))


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY score DESC, pos) AS INT) AS rank FROM scored) WHERE rank <= 5")
def w4_top_k(spark, sf_dir):
    return ranking.top_k(scored(spark, sf_dir), 5).select(*GID, "pos", "score", "rank")


@query(f"WITH {RESULTS_SQL} SELECT query_id, engine, pos, url, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY pos) AS INT) AS index FROM results")
def w3_engine_index(spark, sf_dir):
    return sources.numbered(fx.results(spark, sf_dir), ["pos"]).select(*GID, "pos", "url", "index")


_LIKE = f"""NOT coalesce(length(title) < 3 OR ({any_of('lower(url)', P.bad_urls)} AND {any_of('lower(url)', P.inner_urls)}) OR {any_of("lower(title || ' ' || snippet)", P.noise_phrases)}
 OR lower(trim(title)) IN {in_(P.noise_titles)} OR regexp_matches(lower(title), '{P.page_title}') OR (length(snippet) < 8 AND score < 0.1), true)"""


def judged(spark, sf_dir) -> DataFrame:
    """Scored rows with what their texts say of them in the texts' place: no text is shuffled for its verdict."""
    found = ranking.furniture(F.col("title"), F.col("url"), F.col("snippet"))
    return scored(spark, sf_dir, fx.results(spark, sf_dir).select(*GID, "pos", "url", found.alias("found")))


def _like() -> F.Column:
    return ranking.is_like(F.col("found"), F.col("score"))


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, {_LIKE} AS result_like FROM scored")
def b6_is_result_like(spark, sf_dir):
    return judged(spark, sf_dir).select(*GID, "pos", _like().alias("result_like"))


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id, engine, url ORDER BY pos) AS k FROM scored) WHERE k = 1 AND {_LIKE}")
def w1_first_then_filter(spark, sf_dir):
    return ranking.first_then_filter(judged(spark, sf_dir), _like()).select(*GID, "pos", "url")


@query(f"WITH {SCORED_SQL} SELECT query_id, engine, pos, url, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, engine, url ORDER BY score DESC, pos) AS k FROM scored WHERE {_LIKE}) WHERE k = 1")
def w2_filter_then_best(spark, sf_dir):
    return ranking.filter_then_best(judged(spark, sf_dir), _like()).select(*GID, "pos", "url", "score")


@query(f"""WITH {RESULTS_SQL} SELECT query_id, engine, pos, title, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id, engine, url ORDER BY pos) AS k FROM results) WHERE k = 1 AND length(title) >= 3
 AND NOT {any_of('lower(url)', P.redirect_ads)} AND regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT IN {in_(P.blocked_hosts)}""")
def b7_post_filter(spark, sf_dir):
    return ranking.post_filter(fx.results(spark, sf_dir)).select(*GID, "pos", "title", "url")


@query(f"WITH {RESULTS_SQL} SELECT query_id, engine, pos, {any_of(_ADTEXT, P.ad_words)} AS rule_hit, {any_of('lower(url)', P.ad_urls)} AS url_hit, {_URGENT} AS urgency_hits FROM results")
def b8_b9_b10_ad_parts(spark, sf_dir):
    parts = ranking.ad_rule_score(F.col("title"), F.col("snippet"), F.col("url"))
    return fx.results(spark, sf_dir).select(*GID, "pos", (parts["rule"] > 0).alias("rule_hit"), (parts["link"] > 0).alias("url_hit"), parts["urgency_hits"].cast("int").alias("urgency_hits"))


@query(f"WITH {RESULTS_SQL}, s AS (SELECT *, CASE WHEN {any_of(_ADTEXT, P.ad_words)} THEN 3 ELSE 0 END + CASE WHEN {any_of('lower(url)', P.ad_urls)} THEN 2 ELSE 0 END + CASE WHEN {_URGENT} >= 2 THEN 1 ELSE 0 END AS score FROM results) SELECT query_id, count(*) FILTER (score >= 4) AS removed, count(*) FILTER (score < 4) AS kept FROM s GROUP BY ALL")
def g6_removed_by_ad_rules(spark, sf_dir):
    parts = ranking.ad_rule_score(F.col("title"), F.col("snippet"), F.col("url"))
    s = fx.results(spark, sf_dir).withColumn("score", parts["rule"] + parts["link"] + parts["urgency"])
    return s.groupBy("query_id").agg(F.count_if(F.col("score") >= 4).alias("removed"), F.count_if(F.col("score") < 4).alias("kept"))


@query(f"WITH {RESULTS_SQL} SELECT pos, concat_ws(' ', nullif(title, ''), nullif(snippet, '')) AS text FROM results")
def b12_join_item(spark, sf_dir):
    return fx.results(spark, sf_dir).select("pos", text.join_item(F.col("title"), F.col("snippet")).alias("text"))


@query(f"WITH {RESULTS_SQL} SELECT query_id, engine, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY pos) AS INT) AS index, coalesce(title, 'untitled') AS title, CASE WHEN length(snippet) > 800 THEN substring(snippet, 1, 800) || '...' ELSE snippet END AS snippet FROM results")
def b13_preview(spark, sf_dir):
    r = sources.numbered(fx.results(spark, sf_dir), ["pos"])
    return r.select(*GID, "index", F.coalesce("title", F.lit("untitled")).alias("title"), F.when(F.length("snippet") > 800, F.concat(F.substring("snippet", 1, 800), F.lit("..."))).otherwise(F.col("snippet")).alias("snippet"))


@query("SELECT page_id, trim(regexp_replace(html, '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM pages")
def d1_clean_text(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query(f"WITH {RESULTS_SQL} SELECT pos, CASE WHEN pos % 4 = 3 THEN 'https://go.example/other?url=' || lower(hex(url)) ELSE url END AS target FROM results")
def d3_resolve_redirect(spark, sf_dir):
    """Wraps every url as a redirect, in hex with a quote behind it or base64 by turns, and takes it out again; another
    script of the same host redirects nothing."""
    r = fx.results(spark, sf_dir)
    k, hexed = F.col("pos") % 4, lambda c: F.lower(F.hex(F.encode(c, "UTF-8")))
    packed = F.when(k == 0, F.concat(F.lit("https://go.example/r?url="), hexed(F.concat("url", F.lit("\"x"))))).when(k == 1, F.concat(F.lit("https://go.example/r?a=1&url="), F.rtrim(F.base64(F.encode("url", "UTF-8")), F.lit("=")))).when(k == 3, F.concat(F.lit("https://go.example/other?url="), hexed(F.col("url")))).otherwise(F.col("url"))
    return r.select("pos", text.resolve_redirect(packed, "go.example", path="/r").alias("target"))


#: RE2 has no possessive runs; greedy ones give the same here.
_CRUMBS_SQL = "trim(regexp_replace({}, '\\s*([›»>][\\p{{L}}\\p{{N}}_\\s\\-.#@&?=%!+]+)+$', ''))"


@query(f"""WITH {RESULTS_SQL}, t AS (SELECT pos, url, title, {_CRUMBS_SQL.format('title')} AS plain FROM results)
SELECT pos, CASE WHEN pos % 4 = 0 THEN regexp_extract(url, '//([^/]*)', 1) WHEN title = '' THEN CASE pos % 4 WHEN 1 THEN '' WHEN 2 THEN '› docs › page 1' ELSE '' END WHEN plain <> '' THEN plain ELSE trim(title) END AS title FROM t""")
def d4_d5_clean_title(spark, sf_dir):
    """Puts labels, glued domains, breadcrumbs and character references around and into titles and takes them off again."""
    r = fx.results(spark, sf_dir)
    k = F.col("pos") % 4
    escaped = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit("»"), F.lit("&raquo;"))
    dressed = F.when(k == 0, F.concat(F.lit("shop.example"), "url")).when(k == 1, F.concat(F.lit("Sponsored: "), escaped)).when(k == 2, F.concat(escaped, F.lit(" &rsaquo; docs › page 1"))).otherwise(escaped)
    return r.select("pos", text.clean_title(dressed, P.ad_labels).alias("title"))


@query(f"WITH {RESULTS_SQL} SELECT pos, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM results")
def d7_authority(spark, sf_dir):
    return fx.results(spark, sf_dir).select("pos", text.authority(F.col("url")).alias("host"))


@query("SELECT item_id, replace(url_encode(text), '%2F', '/') AS quoted FROM benchmark")
def d8_percent_quote(spark, sf_dir):
    return fx.read(spark, sf_dir, "benchmark").select("item_id", text.percent_quote(F.col("text")).alias("quoted"))


@query(f"""WITH {RESULTS_SQL}, {QUERIES_SQL}, {SOURCES_SQL}, x AS (SELECT query_id, ord, name, url, replace(url_encode(query), '%2F', '/') AS q, CASE name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TEMPLATES.items())} END AS template FROM queries, sources)
SELECT query_id, ord, name, CASE WHEN name IN {in_(SKIP)} THEN NULL WHEN contains(url, '{{query}}') THEN replace(url, '{{query}}', q) WHEN template IS NOT NULL THEN replace(template, '{{query}}', q) ELSE rtrim(url, '/') || '/search?q=' || q END AS request FROM x""")
def b1_a6_build_requests(spark, sf_dir):
    return sources.build_requests(fx.queries(spark, sf_dir), fx.sources(spark, sf_dir), TEMPLATES, SKIP)


@query(f"WITH {SOURCES_SQL} SELECT * FROM sources WHERE coalesce(speed, 0) >= 5")
def b2_filter_speed(spark, sf_dir):
    return sources.filter_speed(fx.sources(spark, sf_dir), 5)


@query(f"WITH {SOURCES_SQL} SELECT ord, CASE name WHEN 'china' THEN 'cn' WHEN 'japan' THEN 'jp' ELSE name END AS name, url, speed FROM sources")
def b3_normalize_name(spark, sf_dir):
    return sources.normalize_name(fx.sources(spark, sf_dir), ALIASES)


@query(f"WITH {SOURCES_SQL} SELECT ord, name, coalesce(url, '') AS url, coalesce(speed, 5) AS speed FROM sources")
def a1_registry(spark, sf_dir):
    """The registry as one JSON dict, parsed again."""
    entry = F.struct("ord", "name", F.struct("url", "speed").alias("v"))
    one = fx.sources(spark, sf_dir).agg(F.sort_array(F.collect_list(entry)).alias("e")).select(F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["name"], x["v"])))).alias("value"))
    return sources.parse_registry(one)


@query(f"WITH {CRAWL_SQL} SELECT engine, url, query, html FROM crawl WHERE status = 'success' AND html <> ''")
def b4_b5_b15_usable_pages(spark, sf_dir):
    return sources.usable_pages(fx.crawl(spark, sf_dir))


@query("SELECT item_id, trim(text) AS query, coalesce(TRY_CAST(CASE WHEN item_id % 3 = 0 THEN 'fast' ELSE CAST(item_id % 10 AS VARCHAR) END AS INT), 5) AS speed FROM benchmark WHERE item_id % 4 <> 1 AND trim(text) <> ''")
def b16_clean_queries(spark, sf_dir):
    q = fx.read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 1, "   ").otherwise(F.concat(F.lit("  "), "text")).alias("query"), F.when(F.col("item_id") % 3 == 0, "fast").otherwise((F.col("item_id") % 10).cast("string")).alias("speed"))
    return sources.clean_queries(q)


def _written(spark, write) -> str:
    """A new folder of the store with what write(path) puts there."""
    path = f"{store.shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    write(path)
    return path


@query(f"WITH {CRAWL_SQL} SELECT engine, url, query, html, status, error FROM crawl")
def a2_read_crawl(spark, sf_dir):
    """Crawl records written as a fetcher leaves them, and read."""
    return sources.read_crawl(spark, _written(spark, lambda path: fx.crawl(spark, sf_dir).drop("page_id").write.json(path)))


@query(f"WITH {RESULTS_SQL} SELECT query_id, engine, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY pos) AS VARCHAR) AS index, title, url, snippet FROM results")
def a4_write_csv(spark, sf_dir):
    """Rows written as CSV, and read with the options a spreadsheet program goes by."""
    path = _written(spark, lambda path: sources.write_csv(fx.results(spark, sf_dir), path))
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path).toDF("engine", "index", "title", "url", "snippet")
    # the file has no query; the given rows tell it by their URL's number and engine
    pos = fx.results(spark, sf_dir)
    numbered = sources.numbered(pos, ["pos"]).select("query_id", "engine", F.col("index").cast("string").alias("index"), "url")
    return back.join(numbered, ["engine", "index", "url"]).select("query_id", "engine", "index", F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("snippet", F.lit("")).alias("snippet"))


@query("SELECT event_id, 'results_' || strftime(ts, '%Y%m%d_%H%M%S') AS name FROM events")
def a5_export_name(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("results_"), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("name"))


@query(f"WITH {CRAWL_SQL} SELECT engine, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status NOT IN ('success', 'skipped')) AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM crawl GROUP BY engine")
def g1_status_counts(spark, sf_dir):
    return sources.status_counts(fx.crawl(spark, sf_dir), ["engine"])


@query(f"WITH {CRAWL_SQL} SELECT page_id, status, CASE WHEN error = '' THEN '-' ELSE substring(error, 1, 100) END AS detail FROM crawl WHERE status NOT IN ('success', 'skipped')")
def g2_failures(spark, sf_dir):
    return sources.failures(fx.crawl(spark, sf_dir)).select("page_id", "status", "detail")


@query(f"WITH {RESULTS_SQL}, {QUERIES_SQL}, {SOURCES_SQL} SELECT query_id, count(*) FILTER (name NOT IN {in_(SKIP)}) AS searchable, count(*) FILTER (name IN {in_(SKIP)}) AS skipped FROM queries, sources GROUP BY query_id")
def g3_searchable(spark, sf_dir):
    r = sources.build_requests(fx.queries(spark, sf_dir), fx.sources(spark, sf_dir), TEMPLATES, SKIP)
    return r.groupBy("query_id").agg(F.count_if(F.col("request").isNotNull()).alias("searchable"), F.count_if(F.col("request").isNull()).alias("skipped"))


@query(f"WITH {RESULTS_SQL}, kept AS (SELECT * FROM results WHERE engine NOT IN {in_(P.middle)}), e AS (SELECT DISTINCT query_id, engine FROM results) SELECT query_id, count(DISTINCT engine) AS total_engines, (SELECT count(*) FROM kept k WHERE k.query_id = e.query_id) AS total_results FROM e GROUP BY query_id")
def g4_a3_totals(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    b = sources.bundles(r.filter(~F.col("engine").isin(*P.middle)), r.select(*GID).distinct())
    return b.groupBy("query_id").agg(F.count("*").alias("total_engines"), F.sum(F.size("results")).cast("long").alias("total_results"))


@query(f"WITH {RESULTS_SQL}, kept AS (SELECT * FROM results WHERE engine NOT IN {in_(P.middle)}), e AS (SELECT DISTINCT query_id, engine FROM results) SELECT e.query_id, e.engine, count(k.pos) AS n, coalesce(string_agg(k.url || ' ' || k.title, '|' ORDER BY k.pos), '') AS joined FROM e LEFT JOIN kept k ON e.query_id = k.query_id AND e.engine = k.engine GROUP BY ALL")
def g9_bundles(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    b = sources.bundles(r.filter(~F.col("engine").isin(*P.middle)), r.select(*GID).distinct())
    return b.select(*GID, F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda x: F.concat(x["url"], F.lit(" "), x["title"])), "|").alias("joined"))


@query(f"WITH {RESULTS_SQL} SELECT query_id, engine, url, min(pos) AS pos FROM results GROUP BY ALL")
def g10_distinct_url(spark, sf_dir):
    return ranking.first_then_filter(fx.results(spark, sf_dir), F.lit(True)).select(*GID, "url", "pos")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS failed, count(*) FILTER (event_type = 'view') AS skipped FROM events GROUP BY 1")
def k2_status_per_window(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "skipped").otherwise("error")
    return sources.status_per_window(e.select(F.col("ts").alias("fetched_at"), status.alias("status")))


_DECODE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


@query(f"SELECT page_id, {_DECODE.format('html')} AS html FROM pages")
def d6_html_unescape(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", text.html_unescape(F.col("html")).alias("html"))


def ad_model(spark, sf_dir) -> ads.AdModel:
    """Learned from all labelled documents."""
    labels = fx.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return ads.train_ad_model(fx.read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"), tfidf.Analyzer(cap=1000))


@query("")
def t10_t11_score_ads(spark, sf_dir):
    """Without SQL: the weights are learned; tests hold them against a plain solver."""
    rows = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    return ads.score_ads(rows, ad_model(spark, sf_dir)).select("doc_id", F.round("probability", 6).alias("probability"))


@query("")
def b11_ad_score(spark, sf_dir):
    return ads.ad_score(fx.results(spark, sf_dir), ad_model(spark, sf_dir)).select(*GID, "pos", "score", "ad")


def decoded(c: str) -> str:
    return f"trim(regexp_replace({_DECODE.format(c)}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


#: The links of every page in order; in the given pages each fills a list item and is relative to the root.
_LINKS_SQL = f"""links AS (SELECT page_id, i AS n, regexp_extract(url, '^(https?://[^/?#]*)', 1) || {_DECODE.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS url, {decoded("regexp_extract(a, '>([^<]*)</a>', 1)")} AS title
  FROM (SELECT page_id, url, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS x FROM pages)))"""


def _in_order(df: DataFrame, by: str) -> DataFrame:
    """Number the rows of each page."""
    from pyspark.sql import Window

    return df.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(by)).cast("long"))


@query(f"""SELECT page_id, {decoded("regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', '', 'gs'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')")} AS text FROM pages""")
def c1_c2_c3_extract_text(spark, sf_dir):
    return dom.extract_text(fx.read(spark, sf_dir, "pages"))


@query(f"WITH {_LINKS_SQL} SELECT page_id, n, url FROM links")
def c4_extract_links(spark, sf_dir):
    return _in_order(dom.extract_links(fx.read(spark, sf_dir, "pages")), "pre").select("page_id", "n", "url")


@query(f"""SELECT page_id, i AS n, {decoded("regexp_replace(h, '<[^>]*>', '', 'g')")} AS title
FROM (SELECT page_id, unnest(x) AS h, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h[1-4][^>]*>.*?</h[1-4]>', 0, 's') AS x FROM pages)) WHERE title <> ''""")
def c5_i4_extract_titles(spark, sf_dir):
    return _in_order(dom.extract_titles(fx.read(spark, sf_dir, "pages")), "pre").select("page_id", "n", "title")


@query("")
def c6_extract_snippets(spark, sf_dir):
    """Without SQL: paragraphs left open hold the paragraphs after them."""
    return dom.extract_snippets(fx.read(spark, sf_dir, "pages"))


@query(f"""WITH {_LINKS_SQL} SELECT page_id, title, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS BIGINT) AS n, '' AS snippet
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS k FROM links) WHERE k = 1 AND length(title) >= 3""")
def c9_extract_generic(spark, sf_dir):
    return _in_order(dom.extract_generic(fx.read(spark, sf_dir, "pages")), "pos").select("page_id", "title", "url", "n", "snippet")


def serp(spark, sf_dir, tail: str = "") -> DataFrame:
    """page_id, query_id, engine, url, html: a result page for every query and engine, of at most twenty rows;
    tail ends every snippet."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<div class='r'><h3><a href='"), "url", F.lit("'>"), esc("title"), F.lit("</a></h3><p>"), esc("snippet"), F.lit(tail + "</p></div>"))
    r = fx.results(spark, sf_dir).groupBy(*GID).agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("h")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["h"]), "\n")
    return r.select(F.get("rows", F.lit(0))["pos"].alias("page_id"), *GID, F.lit("https://find.example/q").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


@query("""SELECT page_id, i AS n, lead(i) OVER (PARTITION BY page_id ORDER BY i) AS next_n FROM (SELECT page_id, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>') AS x FROM pages))""")
def w5_next_sibling(spark, sf_dir):
    """Every list item with the one that follows; each list of the given pages is the page's only one."""
    n = _in_order(dom.next_siblings(dom.explode_dom(fx.read(spark, sf_dir, "pages"), (), ())).filter("tag = 'li'"), "pre")
    after = n.select("page_id", F.col("pre").alias("next"), F.col("n").alias("next_n"))
    return n.join(after, ["page_id", "next"], "left").select("page_id", "n", "next_n")


@query(f"""WITH {RESULTS_SQL}, x AS (SELECT pos, url, regexp_extract(url, '^(https://[^/]*)', 1) AS host FROM results)
SELECT pos, CASE pos % 5 WHEN 0 THEN host || '/root/' || pos WHEN 1 THEN host || '/x' || pos || '#f' WHEN 2 THEN url || '?q=' || pos WHEN 3 THEN 'https://other.example/' || pos ELSE host || '/d/' || pos END AS target FROM x""")
def d2_resolve_url(spark, sf_dir):
    k, pos = F.col("pos") % 5, F.col("pos").cast("string")
    href = F.when(k == 0, F.concat(F.lit("/root/"), pos)).when(k == 1, F.concat(F.lit("./../x"), pos, F.lit("#f"))).when(k == 2, F.concat(F.lit("?q="), pos)).when(k == 3, F.concat(F.lit("//other.example/"), pos)).otherwise(F.concat(F.lit("a/../"), pos))
    return fx.results(spark, sf_dir).select("pos", text.resolve_url(href, F.col("url")).alias("target"))


TAIL = " shown as a source listing"
STRATEGY = selectors.Strategy("body > .r", ("h3 em", "h3 a", "h3"), ("h3 > a[href]", "a"), ("p.lead, p", "div"))
_PAGED = f"paged AS (SELECT query_id, engine, min(pos) OVER (PARTITION BY query_id, engine) AS page_id, pos, title, url, trim(snippet || '{TAIL}') AS snippet FROM results)"
_SEL = "sel AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS k FROM paged QUALIFY k = 1)"
_PAT = f"""items AS (SELECT page_id, pos AS item, title || ' ' || snippet AS text FROM paged WHERE length(title) >= 3
  UNION ALL SELECT p.page_id, -1, q.query FROM (SELECT DISTINCT page_id, query_id FROM paged) p JOIN queries q USING (query_id)), {tfidf.tfidf_sql('items', 'page_id')},
pat AS (SELECT r.*, s.score FROM paged r JOIN scores s ON r.page_id = s.page_id AND r.pos = s.item WHERE {_LIKE} QUALIFY row_number() OVER (PARTITION BY r.page_id, r.url ORDER BY s.score DESC, r.pos) = 1)"""


@query(f"WITH {RESULTS_SQL}, {_PAGED} SELECT page_id, url, title, snippet FROM paged WHERE length(title) >= 3")
def c10_c11_link_candidates(spark, sf_dir):
    return dom.link_candidates(serp(spark, sf_dir, TAIL)).select("page_id", "url", "title", "snippet")


def asked(spark, sf_dir, pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "query_id").join(fx.queries(spark, sf_dir), "query_id").select("page_id", F.col("query").alias("text"))


@query("""SELECT page_id, i AS n, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(x) AS a, generate_subscripts(x, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(replace(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '&amp;', '&'), '<a href="[^"]*"') AS x FROM pages))""")
def c7_css_select(spark, sf_dir):
    n = dom.css_select(fx.read(spark, sf_dir, "pages"), "nav > ul a[href], nav a")
    return _in_order(n, "pre").select("page_id", "n", F.col("attrs")["href"].alias("href"))


@query(f"WITH {RESULTS_SQL}, {_PAGED}, {_SEL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, title, url, snippet FROM sel")
def c8_w6_extract_by_selectors(spark, sf_dir):
    return _in_order(selectors.extract_by_selectors(serp(spark, sf_dir, TAIL), STRATEGY), "pos").select("page_id", "n", "title", "url", "snippet")


@query(f"WITH {RESULTS_SQL}, {QUERIES_SQL}, {_PAGED}, {_PAT} SELECT page_id, title, url, snippet, score FROM pat")
def t7_extract_by_pattern(spark, sf_dir):
    pages = serp(spark, sf_dir, TAIL)
    return selectors.extract_by_pattern(pages, asked(spark, sf_dir, pages)).select("page_id", "title", "url", "snippet", "score")


@query(f"""WITH {RESULTS_SQL}, {_PAGED}, a AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos DESC) AS k FROM paged WHERE engine NOT IN {in_(P.middle)}),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(snippet) DESC, pos) AS k FROM (SELECT * REPLACE (CASE WHEN length(title) % 2 = 0 THEN snippet || ' again' ELSE substring(snippet, 1, 10) END AS snippet) FROM paged))
SELECT page_id, url, a.page_id IS NULL AS appended, CASE WHEN a.page_id IS NULL OR length(b.snippet) > length(a.snippet) THEN b.title ELSE a.title END AS title, CASE WHEN a.page_id IS NULL OR length(b.snippet) > length(a.snippet) THEN b.snippet ELSE a.snippet END AS snippet
FROM (SELECT * FROM a WHERE k = 1) a FULL JOIN (SELECT * FROM b WHERE k = 1) b USING (page_id, url)""")
def t14_j1_merge_routes(spark, sf_dir):
    """All rows as the pattern route, with longer or shorter snippets, and those of most engines as the selector route."""
    r = fx.results(spark, sf_dir)
    r = r.join(r.groupBy(*GID).agg(F.min("pos").alias("page_id")), GID).withColumn("snippet", F.trim(F.concat("snippet", F.lit(TAIL)))).select("engine", "page_id", "pos", "title", "url", "snippet")
    found = r.withColumn("snippet", F.when(F.length("title") % 2 == 0, F.concat("snippet", F.lit(" again"))).otherwise(F.substring("snippet", 1, 10)))
    merged = selectors.merge_routes(r.filter(~F.col("engine").isin(*P.middle)).drop("engine"), found.drop("engine"))
    return merged.select("page_id", "url", (F.col("route") == 1).alias("appended"), "title", "snippet")


@query(f"""WITH {RESULTS_SQL}, {QUERIES_SQL}, {_PAGED}, {_SEL}, {_PAT}
SELECT query_id, engine, url, CASE WHEN length(p.snippet) > length(s.snippet) THEN p.title ELSE s.title END AS title, CASE WHEN length(p.snippet) > length(s.snippet) THEN p.snippet ELSE s.snippet END AS snippet
FROM sel s LEFT JOIN (SELECT page_id, url, title, snippet FROM pat) p USING (page_id, url)
WHERE length(CASE WHEN length(p.snippet) > length(s.snippet) THEN p.title ELSE s.title END) >= 3 AND NOT {any_of('lower(url)', P.redirect_ads)} AND regexp_extract(url, '//([^/]*)', 1) NOT IN {in_(P.blocked_hosts)}""")
def m1_extract(spark, sf_dir):
    """Half of the engines by selectors, the others by generic rows; both merged with the pattern route."""
    pages = serp(spark, sf_dir, TAIL)
    return selectors.extract(pages, asked(spark, sf_dir, pages), {f"src{i}": STRATEGY for i in range(0, 20, 2)}).select(*GID, "url", "title", "snippet")


_NUMBER = "CAST(regexp_extract(engine, '[0-9]+') AS INT)"
_M1 = """SELECT query_id, engine, s.pos AS pos, url, CASE WHEN length(p.snippet) > length(s.snippet) THEN p.title ELSE s.title END AS title, CASE WHEN length(p.snippet) > length(s.snippet) THEN p.snippet ELSE s.snippet END AS snippet
  FROM sel s LEFT JOIN (SELECT page_id, url, title, snippet FROM pat) p USING (page_id, url)"""


def registry_of(spark, sf_dir) -> DataFrame:
    """ord, name, url, speed: the engines of the rows, each with a speed by its number."""
    number = F.regexp_extract("engine", "[0-9]+", 0).cast("int")
    return fx.results(spark, sf_dir).select("engine").distinct().select(number.alias("ord"), F.col("engine").alias("name"), F.concat(F.lit("https://"), "engine", F.lit(".example")).alias("url"), (number % 10).alias("speed"))


def fetched(spark, sf_dir) -> DataFrame:
    """The result pages as crawl records, a fifth of them failed."""
    late = F.col("page_id") % 5 == 0
    return serp(spark, sf_dir, TAIL).withColumn("status", F.when(late, "timeout").otherwise("success")).withColumn("error", F.when(late, "too slow").otherwise(""))


@query(f"""WITH RECURSIVE {RESULTS_SQL}, {QUERIES_SQL}, m1 AS (WITH {_PAGED}, {_SEL}, {_PAT} SELECT * FROM ({_M1} WHERE page_id % 5 <> 0 AND {_NUMBER} % 10 >= 5) x
  WHERE length(title) >= 3 AND NOT {any_of('lower(url)', P.redirect_ads)} AND regexp_extract(url, '//([^/]*)', 1) NOT IN {in_(P.blocked_hosts)}), {washed_sql('m1')}
SELECT query_id, engine, url, title, snippet, score, rank FROM washed""")
def m3_run(spark, sf_dir):
    """From a registry to washed rows: sources of speed 5 or more, pages that were fetched, both routes, the rules."""
    strategies = {f"src{i}": STRATEGY for i in range(0, 20, 2)}
    return pipeline.run(registry_of(spark, sf_dir), fx.queries(spark, sf_dir), fetched(spark, sf_dir), strategies).washed.rows.select(*GID, "url", "title", "snippet", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _SQL.items() if v}
