"""Hard-negative mining by a secondary-sort shuffle.

Rows and anchors meet in cells of bounded size, a block of rows by a block of anchors, where one matrix
product gives all scores of the cell.  A cell passes on, for every anchor, only pairs that may be among the
results: its first positives, then, once an anchor's positives are known, its first negatives of every
positive's window.  What the cells pass on is packed into keys (anchor, falling score, id), dealt by anchor
with repartitionAndSortWithinPartitions, and read as a stream: a positive opens a window, negatives go to the
open windows until these are full.  The state is that of one anchor's windows, never its pairs.

Every cell leaves out only pairs that a better pair of the same cell rules out, so no limit here is a cap.

Defined results: rows with a null id, a null label, a null vector or any null or non-finite component take
no part; rows that share an id count once, as the one of the least (label, vector); a shorter vector counts
as filled up with zeros; an anchor without positives or a window without negatives gives no rows; an empty
table gives no rows; extra columns are left out.  A sum beyond 2^53 is worked out in whole numbers and held
to 62 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rows of a block, on average, and anchors of a block.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 4_096
PAIRS = "anchor_id long, id long, score long, same boolean"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_KEY = struct.Struct(">QQQ")
_SIGN = 1 << 63
_LIMIT = 1 << 62


def pack(anchor: int, score: int, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, vec_id + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int]:
    anchor, score, vec_id = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, vec_id - _SIGN


def usable(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """vec_id, label, v, anchor: rows that take part, their vectors in whole steps of 1 / scale."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    steps = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    # floor() gives a long; beyond its range a double is whole anyway
    steps = F.when(F.forall(x, lambda c: F.abs(c) < 2.0**52 / scale), steps).otherwise(F.transform(x, lambda c: c * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), steps.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _matrix(vs: list, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one id once: the least label, then the least vector."""
    if pdf["vec_id"].is_unique:
        return pdf
    order = sorted(range(len(pdf)), key=lambda i: (pdf["vec_id"].iat[i], pdf["label"].iat[i], tuple(pdf["v"].iat[i])))
    return pdf.iloc[order].drop_duplicates("vec_id")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, as longs."""
    top = (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    wa, wb = whole(a), whole(b)
    for i in range(len(a)):
        out[i] = [min(max(int(x), -_LIMIT), _LIMIT) for x in (wb @ wa[i] if wb.size else [0] * len(b))]
    return out


def cell_pairs(anchors: pd.DataFrame, rows: pd.DataFrame, n_pos: int, n_neg: int, low: int, high: int) -> pd.DataFrame:
    """Pairs of one cell that may be among the results.  anchors: vec_id, label, v and, in the second pass, the
    scores of their positives; rows: vec_id, label, v."""
    out = [[], [], [], []]
    rows = _once(rows).sort_values("vec_id")
    second = "positives" in anchors.columns
    if not second:
        anchors = _once(anchors)
    width = max([0, *map(len, anchors["v"]), *map(len, rows["v"])])
    ids, labels, vectors = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(list(rows["v"]), width)
    # a strip of scores holds four million numbers at most
    step = max(1, 4_000_000 // max(len(ids), 1))
    for at in range(0, len(anchors), step):
        part = anchors.iloc[at : at + step]
        strip = scores(_matrix(list(part["v"]), width), vectors)
        for k, (anchor, label) in enumerate(zip(part["vec_id"], part["label"])):
            s, same = strip[k], labels == label
            if not second:
                where = np.flatnonzero(same & (ids != anchor))
                where = where[np.argsort(-s[where], kind="stable")[:n_pos]]
            else:
                other, found = np.flatnonzero(~same), []
                so = s[other]
                for p in set(map(int, part["positives"].iat[k])):
                    fit = np.flatnonzero((so <= high * p // 100) & (so >= -(-low * p // 100)))
                    if len(fit) > 4 * n_neg:  # all that tie with the last wanted score stay in
                        fit = fit[so[fit] >= np.partition(so[fit], len(fit) - n_neg)[len(fit) - n_neg]]
                    found.append(fit[np.argsort(-so[fit], kind="stable")[:n_neg]])
                where = other[np.unique(np.concatenate(found))] if found else other[:0]
            out[0].append(np.full(len(where), anchor, dtype=np.int64))
            out[1].append(ids[where])
            out[2].append(s[where])
            out[3].append(same[where])
    if not out[0]:
        return pd.DataFrame({"anchor_id": [], "id": [], "score": [], "same": []}).astype({"anchor_id": "int64", "id": "int64", "score": "int64", "same": "bool"})
    return pd.DataFrame(dict(zip(("anchor_id", "id", "score", "same"), map(np.concatenate, out))))


class Windows:
    """Reads the pairs of one anchor in order of falling score, then id, and gives back its results."""

    def __init__(self, n_pos: int, n_neg: int, low: int, high: int):
        self.n_pos, self.n_neg, self.low, self.high = n_pos, n_neg, low, high
        self.opened = 0
        self.open: list[list] = []  # positive id, its score, negatives taken
        self.score, self.ties = None, []  # first negatives of the score at hand

    def feed(self, score: int, vec_id: int, same: bool):
        if score != self.score:
            self.score, self.ties = score, []
        if same:
            if self.opened == self.n_pos:
                return
            self.opened += 1
            window = [vec_id, score, 0]
            # negatives of equal score and smaller id came before their positive
            for n in self.ties:
                yield from self.give(window, score, n)
            self.open.append(window)
        else:
            if len(self.ties) < self.n_neg:
                self.ties.append(vec_id)
            for window in self.open:
                yield from self.give(window, score, vec_id)
            self.open = [w for w in self.open if w[2] < self.n_neg and 100 * score >= self.low * w[1]]

    def give(self, window: list, score: int, vec_id: int):
        positive, best, taken = window
        if taken < self.n_neg and self.low * best <= 100 * score <= self.high * best:
            window[2] = taken + 1
            yield positive, taken + 1, vec_id, best, score


def stream(pairs, n_pos: int, n_neg: int, low: int, high: int):
    """Results from (key, same) in order of the keys, one anchor after the other."""
    anchor, state = None, None
    for key, same in pairs:
        a, score, vec_id = unpack(key)
        if a != anchor:
            anchor, state = a, Windows(n_pos, n_neg, low, high)
        for found in state.feed(score, vec_id, same):
            yield (a, *found)


def sorted_by_anchor(pairs: DataFrame, partitions: int):
    """The secondary sort: (key, same) dealt by anchor and sorted by key within every partition."""
    keyed = pairs.rdd.map(lambda r: (pack(r[0], r[2], r[1]), r[3]))
    return keyed.repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:8]), True)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding,
    label): for each anchor and each of its first so many rows of its label, the first so many rows of other
    labels that score from low to high per cent of the positive's score."""
    given = vectors if label is None else vectors.withColumn("label", label)
    marked = table(usable(given, is_anchor, scale), "vectors")
    rows = marked.select("vec_id", "label", "v")
    spark = rows.sparkSession
    n = rows.count()
    width = spark.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // 256), max(-(-n // row_block), width)))
    asked = marked.filter("anchor").select("vec_id", "label", "v")
    groups = max(1, -(-asked.count() // anchor_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    grid = rows.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def cells(anchors: DataFrame) -> DataFrame:
        to = anchors.withColumn("group", group).withColumn("block", every)
        give = lambda a, b: cell_pairs(a, b, positives, negatives, low, high)
        return to.groupBy("group", "block").cogroup(grid.groupBy("group", "block")).applyInPandas(lambda a, b: give(a, b), PAIRS)

    partitions = max(width, min(blocks * groups, 100_000))
    # first pass: an anchor's positives, the first of the firsts of its cells
    firsts = sorted_by_anchor(cells(asked), partitions)

    def best(pairs):
        anchor, left = None, 0
        for key, _ in pairs:
            a, score, vec_id = unpack(key)
            if a != anchor:
                anchor, left = a, positives
            if left:
                left -= 1
                yield a, vec_id, score, True

    found = table(spark.createDataFrame(firsts.mapPartitions(best), PAIRS), "positives")
    # second pass: the negatives that fit a window, and the positives again, in one order
    wanted = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("positives"))
    once = asked.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    pairs = cells(table(once.join(wanted, "vec_id"), "anchors")).unionByName(found)
    done = sorted_by_anchor(pairs, partitions).mapPartitions(lambda it: stream(it, positives, negatives, low, high))
    return spark.createDataFrame(done, RESULT)
