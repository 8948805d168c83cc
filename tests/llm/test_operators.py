"""Operators against brute force on small tables that hold nulls, empty texts, repeats, ties and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from serpflow.llm import op1_hnsw, op2_decision_list, op3_toxicity, op4_preference, op5_jaccard_join, op6_chat_format, op7_token_count, op8_mixing, op9_context_mixing, op10_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = [f"w{i}" for i in range(60)]
TEXTS = [
    None, "", " \n\t ", "One", "one two", "ONE two", "a b c\na b c\n\nx y z # $ |", "x y z w v " * 4, " ".join(BASE), " ".join(BASE).upper(), " ".join(LONG), " ".join(LONG),
    " ".join(LONG[:59] + ["other"]), " ".join(["head"] + LONG), " ".join(LONG[30:] + LONG[:30]), "café  naïve <|endoftext|> I'm here ١٢ 中文", "long " * 30000, "you idiot scum",
]
DOCS = [(i, t, "s%d" % (i % 3) if i % 5 else None) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS + DOCS[6:7], SCHEMA)  # one row twice
    return d.selectExpr("*", "'x' as score", "1 as n_tokens", "2 as cls").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_hnsw_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.05
    x[100:110] = x[100]
    vectors = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    got = {r["vec_id"]: r for r in op1_hnsw.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), shards=3, block=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i]["n_links"] for i in range(400)] == (near.sum(1) - 1).tolist()
    assert {got[i]["component_id"] for i in range(100, 110)} == {100} and got[100]["kept"] and not got[101]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))
    assert op1_hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hnsw_without_audit_finds_planted_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = np.vstack([rng.normal(size=(900, 32)), np.repeat(centres, 20, axis=0) + rng.normal(size=(600, 32)) * 0.18])
    frame = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(7, None, "y"), (None, None, "z")], "vec_id long, embedding array<double>, component string")
    got = op1_hnsw.near_duplicates(frame, shards=2, block=400, audit=0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int((u @ u.T >= 0.95).sum()) - len(x)
    assert links > 5000 and 0.99 * links <= sum(r["n_links"] for r in got) <= links
    assert len(got) == len(x) + 2 and [r["n_links"] for r in got if r["vec_id"] is None] == [0]


def test_decision_list_statistics_and_rules(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(op2_decision_list.apply_rules(docs, labels))
    for i, t in enumerate(TEXTS):
        w = WORD(t or "")
        lines = [x for x in (t or "").split("\n") if WORD(x)]
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(runs)
        covered = {k + j for k, r in enumerate(runs) if n[r] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r["kept"] == (not r["base_failed"])
    assert op2_decision_list.apply_rules(none, labels).count() == 0
    rows = [(i, "word%d some good text here with more and other things %d" % (i, i) if i % 3 else "bad$$ text%% of##  " + "&& junk " * 9 + str(i), i % 3 and 1) for i in range(300)]
    stats = op2_decision_list.text_stats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    rules = op2_decision_list.learn(stats.join(spark.createDataFrame([(r[0], 1 if r[2] else 0) for r in rows], "doc_id long, quality int"), "doc_id"))
    verdict = {r[0]: r[1] for r in stats.select("doc_id", rules.verdict()).collect()}
    assert rules.rules and sum(verdict[i] == bool(q) for i, _, q in rows) >= 297


def test_jaccard_keeps_every_link_between_parts_of_a_near_copy_group(spark, monkeypatch):
    """One text, altered at different places and strengths, so that many pairs are just below the threshold."""
    monkeypatch.setattr(op5_jaccard_join, "FREE", 2.0)
    rng = np.random.default_rng(5)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(160):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 5), replace=False):
            w[at] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(148)} for _, t in rows]
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) and own[i] != own[j]:
                lo, hi = sorted((own[i], own[j]))
                own = [lo if c == hi else c for c in own]
    got = by_id(op5_jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len(set(own)) > 5 and [got[i]["component_id"] for i, _ in rows] == own


def labelled(n, poor, good):
    return [(i, (poor if i % 4 == 0 else good) % tuple([i] * (poor if i % 4 == 0 else good).count("%d"))) for i in range(n)]


def test_toxicity_learns_a_lexicon(spark, none):
    rows = [(i, f"a{i % 7} b{i % 11} {'vile' if i % 4 == 0 else 'mild'} c{i % 13} d{i % 5} plain words here") for i in range(400)]
    d = spark.createDataFrame(rows + [(1000, "so V1LE, really"), (1001, "no such word"), (1002, None), (1003, "vilest"), (1004, "vіle")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = by_id(op3_toxicity.score_documents(d, y))
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i, _ in rows)
    assert [got[i]["predicted"] for i in range(1000, 1005)] == [1, 0, 0, 0, 1]
    assert op3_toxicity.score_documents(none, y).count() == 0
    assert {r["score"] < 0.01 for r in op3_toxicity.score_documents(d, y.limit(0)).collect()} == {True}


def test_exception_phrases_cancel_hits():
    auto = op3_toxicity.Lexicon({"trash": 5.0, "idio*": 4.0}, ["trash can"]).automaton()
    assert op3_toxicity.hit_weight(auto, "the trash can and trash, idiotic untrash") == (9.0, 2)


def test_preference_ranks_held_out_pairs(spark, none):
    rows = [(i, "Fine words make a sentence number %d that goes on quietly." % i if i % 4 else "BUY!! NOW!! %d $$$ ### !!" % i) for i in range(400)]
    d = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    got = by_id(op4_preference.score_documents(d, y))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and all(got[i]["predicted"] == int(i % 4 != 0) for i in held)
    assert 0 <= got[1000]["score"] <= 1 and op4_preference.score_documents(none, y).count() == 0


def test_jaccard_classes_equal_brute_force(docs, none):
    def shingles(t):
        w = WORD((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [shingles(t) for t in TEXTS]
    parent = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    got = op5_jaccard_join.jaccard_classes(docs)
    assert got.count() == len(TEXTS) + 1
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(got).items()} == {i: (len(s), parent[i]) for i, s in enumerate(sets)}
    assert op5_jaccard_join.jaccard_classes(none).count() == 0


def test_chat_round_trip(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile), (1, 1, None, "a\\"), (1, 0, "we[ird\\", " x [/TURN] \\["), (1, 2, "assistant", None), (1, 2, "assistant", "tie"), (1, 3, "system", "<</SYS>> \\\\ <")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in op6_chat_format.format_conversations(c.withColumn("piece", c.turn)).collect()}
    for cid in (-7, 1):
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == cid))
        r, answers = got[cid], "".join(x for _, role, x in turns if role == "assistant")
        assert r["round_trip"] and r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(answers), hashlib.sha256(answers.encode()).hexdigest())
    assert op6_chat_format.format_conversations(c.limit(0)).count() == 0
    for role, t in [("user", "".join(p)) for p in __import__("itertools").product(["\\", " [/INST]", "<s>", "x"], repeat=4)]:
        assert op6_chat_format.parse(op6_chat_format.render(role, t)) == [(role, t)]


def test_token_counts_equal_the_library(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(op7_token_count.count_tokens(docs))
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), n, n > 512), i
    assert op7_token_count.count_tokens(none).count() == 0


def test_mixing_meets_its_targets(spark, docs, none):
    got = op8_mixing.mix(docs, bucket=4).collect()
    total = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        total[r["source"]] += r["size"]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = dict(zip(names, [5.0, 2.0, 1.0] * len(names)))
    goal, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3.0 * total[s]
            left -= goal[s]
        open_ -= over
    for r in got:
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == total[r["source"]]
    assert sorted(map(str, got)) == sorted(map(str, op8_mixing.mix(docs.repartition(5), bucket=4).collect()))
    assert op8_mixing.mix(none).count() == 0


def test_context_mixing_base_and_probability(docs, none):
    got = op9_context_mixing.score_documents(docs, hot=4).collect()
    train, words = collections.Counter(), {i: op9_context_mixing.tokens(t) for i, t in enumerate(TEXTS)}
    for i, _, _ in DOCS + DOCS[6:7]:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words[i])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(DOCS) + 1
    for r in got:
        w = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert op9_context_mixing.score_documents(none).count() == 0


def test_prefix_code_and_mix_sum_to_one():
    code = op9_context_mixing.Code.of(np.zeros(256, int))
    assert math.isclose(sum(2.0 ** -code.length), 1.0)
    empty = np.zeros((op9_context_mixing.INPUTS, 1 << op9_context_mixing.SLOT_BITS), np.float32)
    model = op9_context_mixing.Model(code, empty, empty, op9_context_mixing.Mixer.new())
    assert np.allclose(model.log10([b"", b"ab"]), [-8 * math.log10(2), -24 * math.log10(2)])


def test_packing_is_whole_and_tight(docs, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op10_packing.pack_documents(docs, size=64, shard=8).collect()
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in TEXTS]
    want = collections.Counter((i, k, 64 * k, len(x[64 * k : 64 * k + 64]), zlib.crc32(np.array(x[64 * k : 64 * k + 64], "<u4").tobytes())) for i, _, _ in DOCS + DOCS[6:7] for x in [ids[i]] for k in range(-(-len(x) // 64)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 3
    assert op10_packing.pack_documents(none).count() == 0


def test_crossover_keeps_every_piece():
    import random

    rnd = random.Random(0)
    lengths = sorted((rnd.randint(1, 100) for _ in range(200)), reverse=True)
    a, b = op10_packing.best_fit(range(200), lengths, 100), op10_packing.best_fit(rnd.sample(range(200), 200), lengths, 100)
    for child in (op10_packing.crossover(a, b, lengths, 100, rnd), op10_packing.mutate(a, lengths, 100, rnd)):
        assert sorted(i for _, items in child for i in items) == list(range(200))
        assert all(room == 100 - sum(lengths[i] for i in items) >= 0 for room, items in child)
