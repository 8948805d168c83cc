"""Grouped TF-IDF over long tables, and cosine of every item to its group's query.

Texts are dealt by group, and all that is counted, ranked and summed within a group is so where they lie: only
texts and scores are shuffled.  Groups too large for that have their terms counted where each item's row lies; the
counts are then dealt once by (group, term), where document frequencies, the vocabulary's limit and the query's own
counts are found, and the sums of every item are combined map-side.  No large group sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chargrams
from .text import char_ngrams, stop_filter, word_ngrams, word_tokens

#: Characters of text that a task takes apart into words, about, and that a group may have to stay in one task.
TASK_CHARS = 4_000_000


@dataclass(frozen=True)
class Analyzer:
    """How texts become weighted terms: words or characters, the lengths of runs, words left out before runs are
    made, how many of a group's most frequent terms count (all if None), 1 + ln(count) in place of counts."""

    kind: str = "word"
    lo: int = 1
    hi: int = 2
    stop: tuple[str, ...] = ()
    cap: int | None = None
    sublinear: bool = False

    def terms(self, text: Column) -> Column:
        """All terms of a text, repeats included."""
        if self.kind == "char":
            return char_ngrams(self.spaced(text), self.lo, self.hi)
        return word_ngrams(self.tokens(text), self.lo, self.hi)

    def tokens(self, text: Column) -> Column:
        tokens = word_tokens(text)
        return stop_filter(tokens, self.stop) if self.stop else tokens

    def spaced(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?U)\s\s+", " ")

    def parts(self, text: Column) -> Column:
        """A text as chargrams takes it: its characters, or its words between spaces."""
        return F.lower(self.spaced(text)) if self.kind == "char" else F.array_join(self.tokens(text), " ")

    def runs(self) -> chargrams.Runs:
        return chargrams.Runs(self.kind != "char", self.lo, self.hi, self.cap, self.sublinear)

    def count(self, tf: Column) -> Column:
        return 1 + F.log(tf) if self.sublinear else tf

    def task_chars(self) -> int:
        """Characters of text that one task takes: those of single characters have many more terms."""
        return TASK_CHARS // 2 if self.kind == "char" else TASK_CHARS


WORDS = Analyzer()


def grams(items: DataFrame, gid: list[str], a: Analyzer = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """gid, item, columns carried along, term, tf of items (gid, item, text)."""
    return items.select(*gid, "item", *carry, F.explode(a.terms(F.col("text"))).alias("term")).groupBy(*gid, "item", *carry, "term").agg(F.count("*").alias("tf"))


def by_size(items: DataFrame, gid: list[str], work: Callable[[DataFrame, int | None], DataFrame], chars: int = TASK_CHARS) -> DataFrame:
    """work(texts, parts) of items (gid, text).  Groups of up to so many characters come whole, each in one of many
    partitions, and parts is None: what is then grouped or ordered within a group needs no shuffle.  Larger
    groups come as they lie, with the number of partitions to deal them over.  Without gid all is one large group.

    Two numbers come to the driver."""
    sizes = items.groupBy(*gid).agg(F.sum(F.length("text")).alias("chars"))
    total, most = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("chars"), F.lit(0))).first()
    parts = max(items.sparkSession.sparkContext.defaultParallelism, total // chars + 1)
    if not gid:
        return work(items, parts)
    if most <= chars:
        return work(items.repartition(parts, *gid), None)
    # few groups are large: at most one for every so many characters
    mine = [F.col(c).alias(f"_{c}") for c in gid]
    large = F.broadcast(sizes.filter(F.col("chars") > chars).select(*mine))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in gid])
    small = work(items.join(large, same, "left_anti").repartition(parts, *gid), None)
    return work(items.join(large, same, "left_semi"), parts).unionByName(small)


def frequencies(items: DataFrame, gid: list[str], a: Analyzer = WORDS) -> DataFrame:
    """gid, term, df of items (gid, item, text): how many items of the group have the term."""
    def work(texts, parts):
        texts = texts if parts is None else texts.repartition(parts, *gid, "item")
        return grams(texts, gid, a).groupBy(*gid, "term").agg(F.count("*").alias("df"))

    return by_size(items, gid, work, a.task_chars())


def totals(texts: DataFrame, gid: list[str], terms: Callable[[Column], Column], chars: int = TASK_CHARS) -> DataFrame:
    """gid, term, n of texts (gid, text): how often each of terms(text) occurs in the group."""
    def work(texts, parts):
        return texts.select(*gid, F.explode(terms(F.col("text"))).alias("term")).groupBy(*gid, "term").agg(F.count("*").alias("n"))

    return by_size(texts, gid, work, chars)


def char_totals(texts: DataFrame, gid: list[str], lo: int, hi: int, chars: int = TASK_CHARS // 2) -> DataFrame:
    """gid, term, n of texts (gid, text): how often each run of lo to hi characters, lower-cased, occurs in the group.
    Small groups are counted as sorted numbers, large ones as totals() does."""
    def count(key, rows):
        terms, n = chargrams.counted(rows.column("text").to_pylist(), lo, hi)
        return pa.Table.from_arrays([*chargrams.repeated(key, len(terms)), pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=[*gid, "term", "n"])

    def work(texts, parts):
        if parts is None:
            return texts.select(*gid, F.lower("text").alias("text")).groupBy(*gid).applyInArrow(count, ddl(texts, *gid) + ", term string, n long")
        return texts.select(*gid, F.explode(char_ngrams(F.col("text"), lo, hi)).alias("term")).groupBy(*gid, "term").agg(F.count("*").alias("n"))

    return by_size(texts, gid, work, chars)


def ddl(df: DataFrame, *names: str) -> str:
    """Those columns of df, as a schema."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _sums(texts: DataFrame, gid: list[str], a: Analyzer) -> DataFrame:
    """gid, item, norm, dot, nq of the items of whole groups that have terms."""
    texts, runs = texts.dropna(subset=gid).select(*gid, "item", a.parts(F.col("text")).alias("text")), a.runs()

    def sums(key, rows):
        items, norm, dot, nq = runs.sums(rows.column("item").to_pylist(), rows.column("text").to_pylist())
        each = [*chargrams.repeated(key, len(items)), pa.array(items, rows.schema.field("item").type), pa.array(norm, pa.float64()), pa.array(dot, pa.float64()), pa.array([nq or None] * len(items), pa.float64())]
        return pa.Table.from_arrays(each, names=[*gid, "item", "norm", "dot", "nq"])

    return texts.groupBy(*gid).applyInArrow(sums, ddl(texts, *gid, "item") + ", norm double, dot double, nq double")


def vocabulary(tf: DataFrame, gid: list[str], cap: int | None, df: Column, more: dict[str, Column]) -> DataFrame:
    """gid, term, df and any more of the terms that count: the cap most frequent ones of each group, the first in
    order where several are equally frequent.  Each partition's best are found before a group's rows meet."""
    v = tf.groupBy(*gid, "term").agg(df.alias("df"), F.sum("tf").alias("total"), F.max("n").alias("n_all"), *[c.alias(k) for k, c in more.items()])
    if cap is not None:
        w = (Window.partitionBy(*gid) if gid else Window.partitionBy(F.lit(0))).orderBy(F.desc("total"), "term")
        v = v.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_k")
    return v.drop("total")


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def weigh(texts: DataFrame, gid: list[str], parts: int | None, a: Analyzer = WORDS, carry: tuple[str, ...] = (), n: Column | None = None, df: Column | None = None, **more: Column) -> DataFrame:
    """gid, item, term, tf, n (items of the group, those without terms included), df, w and more, aggregates of each
    term of a group, from what by_size() gives (gid, item, text).  Not yet of unit length."""
    texts = texts.dropna(subset=gid) if gid else texts
    n, df = F.count("*") if n is None else n, F.count("*") if df is None else df
    if parts is None:
        tf = grams(texts.withColumn("n", n.over(Window.partitionBy(*gid))), gid, a, ("n", *carry))
        of = Window.partitionBy(*gid, "term")
        x = tf.withColumns({"df": df.over(of), "_total": F.sum("tf").over(of), **{k: c.over(of) for k, c in more.items()}})
        if a.cap is not None:
            # rows of one term tie and have one rank
            w = Window.partitionBy(*gid).orderBy(F.desc("_total"), "term")
            x = x.withColumn("_k", F.dense_rank().over(w)).filter(F.col("_k") <= a.cap).drop("_k")
        x = x.drop("_total")
    else:
        sizes = F.broadcast(texts.groupBy(*gid).agg(n.alias("n")))  # few groups are large
        sized = texts.join(sizes, gid) if gid else texts.crossJoin(sizes)
        tf = grams(sized.repartition(parts, *gid, "item"), gid, a, ("n", *carry)).repartition(parts, *gid, "term")
        if a.cap is None:
            # where a term's rows lie, so that all that reads them reads one exchange
            of = Window.partitionBy(*gid, "term")
            x = tf.withColumns({"df": df.over(of), **{k: c.over(of) for k, c in more.items()}})
        else:
            v = vocabulary(tf, gid, a.cap, df, more)
            # both sides name n, so that they read the same columns of one exchange
            x = tf.join(v, [*gid, "term"]).withColumn("n", F.least("n", "n_all")).drop("n_all")
    return x.withColumn("w", a.count(F.col("tf")) * idf(F.col("n"), F.col("df")))


def norms(items: DataFrame, gid: list[str], a: Analyzer = WORDS) -> DataFrame:
    """gid, item, norm of the weights of items (gid, item, text)."""
    work = lambda texts, parts: weigh(texts, gid, parts, a).groupBy(*gid, "item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return by_size(items, gid, work, a.task_chars())


def with_queries(items: DataFrame, queries: DataFrame, gid: list[str]) -> DataFrame:
    """Items (gid, item, text) and each group's query as one item of it, -1."""
    return items.select(*gid, "item", "text").unionByName(queries.select(*gid, F.lit(-1).cast("long").alias("item"), "text"))


def cosine_to_query(items: DataFrame, queries: DataFrame, gid: list[str], a: Analyzer = WORDS, digits: int = 6) -> DataFrame:
    """gid, item, score for every item (gid, item, text); queries (gid, text) count as one item each."""
    def work(texts, parts):
        if parts is None:
            score = _sums(texts, gid, a).filter("item <> -1")
            return score.select(*gid, "item", F.round(F.col("dot") / F.col("norm") / F.col("nq"), digits).alias("score"))
        w = weigh(texts, gid, parts, a, asked=F.max(F.when(F.col("item") == -1, F.col("tf"))))
        asked = F.coalesce(a.count(F.col("asked")) * idf(F.col("n"), F.col("df")), F.lit(0.0))
        sums = w.groupBy(*gid, "item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * asked).alias("dot"))
        # the query's own row of a group meets the group's items: one small row each
        of = F.broadcast(sums.filter("item = -1").select(*gid, F.col("norm").alias("nq")))
        score = sums.filter("item <> -1").join(of, gid) if gid else sums.filter("item <> -1").crossJoin(of)
        return score.select(*gid, "item", F.round(F.col("dot") / F.col("norm") / F.col("nq"), digits).alias("score"))

    score = by_size(with_queries(items, queries, gid), gid, work, a.task_chars())
    return items.select(*gid, "item").join(score, [*gid, "item"], "left").fillna(0.0, ["score"])


def tfidf_sql(items: str, gid: str, a: Analyzer = WORDS) -> str:
    """CTEs terms, weights, norms, scores over a CTE of that name with gid, item (-1: the query), text."""
    if a.kind == "char":
        tokens = "regexp_replace(lower(text), '[\\s\\p{Z}]{2,}', ' ', 'g')"
        runs = " UNION ALL ".join(f"SELECT {gid}, item, unnest(list_transform(range(1, CAST(length(t) AS BIGINT) - {n} + 2), lambda i: substring(t, i, {n}))) AS term FROM toks WHERE length(t) >= {n}" for n in range(a.lo, a.hi + 1))
    else:
        tokens = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
        if a.stop:
            tokens = f"list_filter({tokens}, lambda x: x NOT IN ({', '.join(repr(s) for s in a.stop)}))"
        runs = " UNION ALL ".join(f"SELECT {gid}, item, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n} - 1], ' '))) AS term FROM toks WHERE len(t) >= {n}" for n in range(a.lo, a.hi + 1))
    g = [c.strip() for c in gid.split(",")]
    on = lambda a, b, more="": " AND ".join([f"{a}.{c} = {b}.{c}" for c in g] + ([more] if more else []))
    cols = lambda a: ", ".join(f"{a}.{c}" for c in g)
    counted = "(1 + ln(a.tf))" if a.sublinear else "a.tf"
    capped = f" QUALIFY row_number() OVER (PARTITION BY {gid} ORDER BY sum(tf) DESC, term) <= {a.cap}" if a.cap else ""
    return f"""toks AS (SELECT {gid}, item, {tokens} AS t FROM {items}),
terms AS (SELECT {gid}, item, term, count(*) AS tf FROM ({runs}) GROUP BY ALL),
dfs AS (SELECT {gid}, term, count(*) AS df FROM terms GROUP BY {gid}, term{capped}),
sizes AS (SELECT {gid}, count(*) AS n FROM {items} GROUP BY ALL),
weights AS (SELECT {cols('a')}, a.item, a.term, {counted} * (ln((1 + s.n) / (1 + d.df)) + 1) AS w FROM terms a JOIN dfs d ON {on('a', 'd', 'a.term = d.term')} JOIN sizes s ON {on('a', 's')}),
norms AS (SELECT {gid}, item, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL),
dots AS (SELECT {cols('a')}, a.item, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON {on('a', 'b', 'a.term = b.term AND a.item <> -1 AND b.item = -1')} GROUP BY ALL),
scores AS (SELECT {cols('i')}, i.item, coalesce(round(d.dot / n.norm / q.norm, 6), 0) AS score FROM {items} i LEFT JOIN dots d ON {on('i', 'd', 'i.item = d.item')}
  LEFT JOIN norms n ON {on('i', 'n', 'i.item = n.item')} LEFT JOIN norms q ON {on('i', 'q', 'q.item = -1')} WHERE i.item <> -1)"""
