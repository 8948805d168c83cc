"""A large group of near copies, of which few link with any one: its pairs are not all formed."""

import itertools
import random

from serpflow.llm import op5_jaccard_join as op5


def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for chosen in rng.sample(list(itertools.product(range(9), repeat=3)), 700):
        words = base[:]
        for at, alt in zip((10, 30, 50), chosen):
            words[at] += f"x{alt}"
        texts.append(" ".join(words))
    monkeypatch.setattr(op5, "DEAL", 8, raising=False)
    made, plain = {}, op5.table

    def table(df, name):
        out = plain(df, name)
        if name.endswith("_pairs"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(op5, "table", table)
    got = {r["doc_id"]: r["component_id"] for r in op5.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    known = op5.WordHash()
    sets = [set(op5.shingle_set(t, 3, known).tolist()) for t in texts]
    component = list(range(len(texts)))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    while True:
        before = component[:]
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
        if component == before:
            break
    assert got == dict(enumerate(component))
    assert len(links) > 6000 and sum(made.values()) < 0.6 * len(links), (len(links), made)
