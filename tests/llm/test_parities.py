"""The parities that part unlike sets before whole sets are read."""

import numpy as np
from pyspark.sql import functions as F

from serpflow.llm import op5_jaccard_join as op5


def test_parities_never_part_sets_that_reach_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, true = [], []
    for n in (1, 2, 19, 40, 200, 3000):
        for swapped in (0, 1, 2, max(1, n // 40), max(1, n // 19), n // 5, n // 2):
            base = rng.integers(0, 1 << 64, n, np.uint64)
            other = np.r_[base[min(swapped, n) :], rng.integers(0, 1 << 64, rng.integers(0, swapped + 1), np.uint64)]
            if len(other):
                a, b = np.unique(base), np.unique(other)
                both = len(np.intersect1d(a, b))
                rows.append((len(a), op5.parities(a).tolist(), len(b), op5.parities(b).tolist()))
                true.append(both * 100 >= (len(a) + len(b) - both) * 90)
    d = spark.createDataFrame(rows, "n_a int, sig_a array<long>, n_b int, sig_b array<long>").coalesce(1)
    got = [r[0] for r in d.select(op5.may_reach("n_a", "sig_a", "n_b", "sig_b", 90, 100)).collect()]
    assert all(g for g, t in zip(got, true) if t) and any(true)
    assert sum(got) < len(got) - 8


def test_posts_are_dealt_once_and_unlike_copies_make_few_pairs(spark, monkeypatch):
    """Texts of one group of which each has a few words of its own, too many to be linked."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(120):
        t = list(base)
        for at in rng.choice(200, 4, replace=False):
            t[at] = f"own{i}x{at}"
        docs.append((i, " ".join(t)))
    made = {}
    real = op5.table

    def counted(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(op5, "table", counted)
    got = {r["doc_id"]: r["component_id"] for r in op5.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(198)} for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert made["stars_pairs"] + made["across_pairs"] < 120 * 119 / 2 / 4


def test_sets_are_worked_out_from_one_document_of_a_class(spark, monkeypatch):
    """Ids that are null or repeat for other texts; the sets are those of the wanted classes only."""
    texts = {1: "a b c d", 2: "a b c d", 3: "e f g h", 4: "i j k l m"}
    docs = [(7, texts[1]), (9, texts[2]), (7, texts[3]), (None, texts[4]), (None, texts[3]), (11, None), (12, texts[4]), (13, "n o p q")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = op5.shingled(d, 3).filter("chunk is null").select("doc_id", "cls")
    known = op5.WordHash()
    want = {tuple(op5.shingle_set(t, 3, known).view(np.int64)) for t in texts.values()}
    wanted = rows.filter("cls is not null and doc_id is distinct from 13").select("cls").distinct()
    got = op5.sets_of(d, 3, wanted, rows).collect()
    assert len(got) == 3 and {tuple(r["set"]) for r in got} == want
