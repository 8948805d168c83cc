"""Quality rules as a learned decision list, in DataFrame operations only.

Text statistics are Column expressions.  The list is learned by sequential covering: a rule grows by the
threshold condition that gains most on the growing part of the labelled rows, is pruned on the other part,
and the rows it covers are set aside before the next rule.  Every step is one grouped count over binned
statistics, so all labelled rows take part wherever they lie; only counts per bin reach the driver.  The
list is emitted as an ordered ``when(...).when(...).otherwise(...)`` expression.

Defined results: null and blank texts have statistics 0 and fail the base rule; repeated rows give repeated
rows; without labelled rows of both kinds the list is empty and only the base rule speaks; extra columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, table, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: What conditions are made of, each a ratio or a count of the statistics below.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "word_length", "distinct_share", "bang_share", "upper_share", "n_words")


def text_stats(docs: DataFrame) -> DataFrame:
    """Add the statistics of every whole text; expects doc_id, text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("w")
    joined = F.array_join("w", "")
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(joined).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length("t") - F.char_length(F.replace("t", F.lit("!")))).cast("long").alias("n_bangs"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", "[A-Z]", ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # one hash for each window of five words; a window found again marks its five words
    at = [F.col("h")] * WINDOW
    d = d.withColumn("win", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k, h in enumerate(at)]))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long"))
    d = d.withColumn("again", F.size("win") > F.size(F.array_distinct("win")))
    d = d.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("s")
    same = lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["x"] == e["x"]))
    d = d.withColumn("p", F.when(F.col("again"), F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"]))))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("long")).drop("h", "win", "s", "p", "again")


def features() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    made = (F.col("n_symbols") / n, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("word_chars") / n, F.col("n_distinct") / n, F.col("n_bangs") / n, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_words").cast("double"))
    return dict(zip(FEATURES, made))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c < self.threshold


@dataclass
class Rule:
    conditions: list[Condition]
    precision: float = 0.0
    covered: int = 0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects a text, and a text none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        out: Column | None = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        """Number of the rule that decides, null if none does."""
        whens = [F.when(r.column(), F.lit(i)) for i, r in enumerate(self.rules)]
        return F.coalesce(*whens) if whens else F.lit(None).cast("int")


def learn(labelled: DataFrame, bins: int = 24, max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> DecisionList:
    """Learn rules for quality = 0 from text statistics with columns doc_id and quality (0 or 1)."""
    feats = features()
    rows = labelled.filter("quality is not null").select("quality", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"), *[c.alias(k) for k, c in feats.items()])
    probs = [(i + 0.5) / bins for i in range(bins)]
    cuts = rows.groupBy("quality").agg(*[F.percentile_approx(k, probs, 2000).alias(k) for k in feats]).collect()
    if {r["quality"] for r in cuts} != {0, 1}:
        return DecisionList()
    steps = {k: sorted({float(x) for r in cuts for x in r[k]}) for k in feats}
    # a bin is the number of thresholds at or below the value
    def bin_of(k: str) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(k) >= t).cast("int") for t in steps[k]]).alias(k)

    binned = table(rows.select("quality", "part", *map(bin_of, feats)), "bins")

    def holds(c: Condition) -> Column:
        level = steps[c.feature].index(c.threshold) + 1
        return F.col(c.feature) >= level if c.above else F.col(c.feature) < level

    def all_of(conds: list[Condition]) -> Column:
        return reduce(lambda a, b: a & b, map(holds, conds), F.lit(True))

    def score(bad: int, good: int) -> float:
        return (bad + 1) / (bad + good + 2)

    left, found = binned, DecisionList()
    while len(found.rules) < max_rules:
        conds: list[Condition] = []
        best_now = 0.0
        for _ in range(max_conditions):
            grow = left.filter("part > 0").filter(all_of(conds))
            cells = grow.select("quality", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in feats])).alias("x")).groupBy("quality", "x.f", "x.b").count().collect()
            count: dict = {}
            for r in cells:
                count[r["f"], r["b"], r["quality"]] = r["count"]
            options = []
            for k in feats:
                total = [sum(count.get((k, b, q), 0) for b in range(len(steps[k]) + 1)) for q in (0, 1)]
                below = [0, 0]
                for level, cut in enumerate(steps[k], 1):
                    below = [below[q] + count.get((k, level - 1, q), 0) for q in (0, 1)]
                    for above in (True, False):
                        bad, good = [total[q] - below[q] if above else below[q] for q in (0, 1)]
                        if bad >= min_covered and bad + good < sum(total):
                            # precision first, and among equals the wider rule
                            options.append((score(bad, good) * bad**0.1, score(bad, good), bad, Condition(k, above, cut)))
            if not options:
                break
            gain, precision, bad, cond = max(options, key=lambda o: (o[0], o[2], o[3].feature, o[3].threshold))
            if precision <= best_now + 1e-3:
                break
            best_now = precision
            conds.append(cond)
            if precision >= 0.995:
                break
        if not conds:
            break
        # prune: of the rule and all its shorter heads and single drops, the best on the other part
        forms = [conds[:i] for i in range(1, len(conds) + 1)] + [conds[:i] + conds[i + 1 :] for i in range(len(conds)) if len(conds) > 1]
        held = left.filter("part = 0").agg(*[F.count_if(all_of(f) & (F.col("quality") == q)).alias(f"c{i}_{q}") for i, f in enumerate(forms) for q in (0, 1)]).first()
        i = max(range(len(forms)), key=lambda i: (score(held[f"c{i}_0"], held[f"c{i}_1"]), held[f"c{i}_0"], -len(forms[i])))
        bad, good = held[f"c{i}_0"], held[f"c{i}_1"]
        if score(bad, good) < min_precision and bad <= good * min_precision / (1 - min_precision):
            break
        found.rules.append(Rule(forms[i], score(bad, good), bad))
        left = left.filter(~all_of(forms[i]))
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, base_failed, the deciding rule and kept for every document.

    The list is learned from labels of documents whose crc32(doc_id as text) mod 3 is not 1.
    """
    stats = table(text_stats(docs), "stats")
    known = labels.select("doc_id", "quality").dropDuplicates(["doc_id"])
    train = stats.filter(fold_of(F.col("doc_id"), 3) != 1).dropDuplicates(["doc_id"]).join(known, "doc_id")
    rules = learn(train, **options)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.fired())
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict())
