"""Extraction, alignment and hard negatives against brute force on small tables."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from serpflow.llm import op3_toxicity, op11_extraction, op12_alignment, op13_hard_negatives

LINE = "A sentence of the article that goes on for a while, with commas and with words to read."
PAGES = {
    1: (f"<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>three\n four<p>{LINE}</article><footer>{LINE}</footer>", f"T & U one twothree four {LINE}"),
    2: (f"<header>Site</header><main><article><p>{LINE}</p><div class='ad-slot'>{LINE}</div><form>{LINE}</form><aside>{LINE}</aside><p>Short.</p><article>{LINE}</article></article><section id=comments>{LINE * 9}</section></main>", f"{LINE} Short."),
    3: (f"<body><div id=top><a href=x>Home</a> <a href=y>News</a></div><div class=wrap><h1>Title</h1><p>{LINE * 3}<p>short.<p>{LINE * 2}</div><div class=sideBar><p>{LINE}</div><div class='cookie-notice'>{LINE}</div>", f"Title {LINE * 3} short. {LINE * 2}"),
    4: (None, ""), 5: ("", ""), 6: ("<nav>menu</nav><script>var x = '<p>text</p>'</script>", ""), 7: ("plain  text", "plain text"),
    8: (f"<article><p>{LINE}<br>next&nbsp;line<!-- no --></p>" + "<p>word</p>" * 3000 + "</article>", f"{LINE} next line" + " word" * 3000),
}


def test_extraction_keeps_the_article_only(spark):
    rows = [(k, "u", h, "x") for k, (h, _) in PAGES.items()] + [(1, "u", PAGES[1][0], "x")]
    got = op11_extraction.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_chars"]) == (PAGES[r["page_id"]][1], len(PAGES[r["page_id"]][1])), r["page_id"]
    assert op11_extraction.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_deep_and_broken_markup():
    assert op11_extraction.main_text("<div>" * 20000 + "x") == "x"
    assert op11_extraction.main_text("<b>" * 3000 + "<p>x</i>" * 3000).split() == ["x"] * 3000
    values = op11_extraction.smooth(np.array([0.0, 10.0, 0.0, 0.0, 0.0]), 1.0)
    assert values.argmax() == 1 and values[0] > values[3] > values[4] >= 0


TEXTS = [None, "", " ", "  two  spaces ", "plain words, and more of them: naïve café 中文 عربى 🎉", "a▁b", "</s><|endoftext|> <0x0A> <unk>", "x\n\n\ty", "word " * 900, "a" * 5000, " " * 5000 + "x", "plain words, and more of them", "plain words, and more of them"]


@pytest.fixture(scope="module")
def encoded():
    """Ids and spans of every text by the libraries alone."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = op12_alignment.byte_alphabet()
    out = []
    for t in TEXTS:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + (t or "")).encode()
        out.append((x, y, bx, by) if b"".join(bx) == whole == b"".join(by) else ([], [], [], []))
    return out


def spans(pieces):
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return [(e - len(p), e) for e, p in zip(ends, pieces)]


def test_alignment_equals_brute_force(spark, encoded):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(11, TEXTS[11], 1), (None, "word", 2)], "doc_id long, text string, batch int").repartition(3)
    linked = []
    for x, y, bx, by in encoded:
        sa, sb, pairs, k = spans(bx), spans(by), Counter(), 0
        for i, (p, q) in enumerate(sa):
            while k and sb[k - 1][1] > p:
                k -= 1
            while k < len(sb) and sb[k][0] < q:
                if sb[k][1] > p:
                    pairs[x[i], y[k]] += 1
                k += 1
        linked.append(pairs)
    extra = op12_alignment.align(["word"], op12_alignment.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))[0]
    count = Counter(p for pairs in (*linked, linked[11], {divmod(int(p), op12_alignment.PAIR): 1 for p in extra[6]}) for p in pairs)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    rows = op12_alignment.align_documents(docs, batch_tokens=500).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_a"] == 1
            continue
        (x, y, bx, by), pairs = encoded[r["doc_id"]], linked[r["doc_id"]]
        ends_a, ends_b = [e for _, e in spans(bx)], [e for _, e in spans(by)]
        cuts, groups, at = sorted(set(ends_a) & set(ends_b)), [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(x, ends_a) if at < e <= c) + "|" + ",".join(str(i) for i, e in zip(y, ends_b) if at < e <= c)) if len(cuts) < 200 else None
            at = c
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(x), len(y), len(cuts), sum(pairs.values())), r
        assert r["n_best"] == sum(n for p, n in pairs.items() if count[p] == top[p[0]]) and r["count_sum"] == sum(n * count[p] for p, n in pairs.items())
        if len(groups) == len(cuts) and None not in groups:
            assert r["groups_sha256"] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
    assert op12_alignment.align_documents(docs.limit(0)).count() == 0


def test_entries_start_at_shared_ends():
    rng = np.random.default_rng(1)
    ends = [np.append(np.sort(rng.choice(9999, n, replace=False)) + 1, 10000) for n in (5000, 4000)]
    starts = op12_alignment.entries(*ends)
    assert len(starts) > 5 and all(i == j == 0 or ends[0][i - 1] == ends[1][j - 1] for i, j in starts)


def brute_negatives(rows, n=5):
    """rows: id -> (label, whole numbers)."""
    out = []
    for a in (i for i in rows if i % 100 == 0):
        ranked = sorted(((-int(np.dot(rows[a][1], v)), i, l) for i, (l, v) in rows.items() if i != a))
        for s, p, l in [x for x in ranked if x[2] == rows[a][0]][:n]:
            fit = [(i, -t) for t, i, m in ranked if m != rows[a][0] and 80 * -s <= 100 * -t <= 100 * -s][:n]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("row_block,anchor_block", [(16384, 4096), (40, 2)])
def test_hard_negatives_equal_brute_force(spark, row_block, anchor_block):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(700, 6)))
    x[100:400] = x[100]  # many ties
    x[500:520] *= -1
    vectors = [(i, [float(v) for v in r], int(i % 4)) for i, r in enumerate(x)]
    odd = [(800, None, 1), (801, [1.0, None], 1), (802, [float("nan")], 1), (803, [float("inf")], 1), (804, [1.0], None), (None, [1.0], 1), (900, [1.0], 99), vectors[200]]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as score", "1 as block")
    got = op13_hard_negatives.mine(df, df.vec_id % 100 == 0, row_block=row_block, anchor_block=anchor_block)
    rows = {i: (l, [int(np.floor(256 * c)) for c in v]) for i, v, l in vectors} | {900: (99, [256, 0, 0, 0, 0, 0])}
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert op13_hard_negatives.mine(df.limit(0), df.vec_id % 100 == 0).count() == 0


def test_keys_sort_by_anchor_then_falling_score_then_id():
    keys = [(a, s, i) for a in (-2, 0, 7) for s in (-(1 << 62), -1, 0, 5, 1 << 62) for i in (-1, 3)]
    assert [op13_hard_negatives.unpack(op13_hard_negatives.pack(*k)) for k in keys] == keys
    assert sorted(keys, key=lambda k: op13_hard_negatives.pack(*k)) == sorted(keys, key=lambda k: (k[0], -k[1], k[2]))
    big = np.array([[2.0**40, 1.0]])
    assert op13_hard_negatives.scores(big, np.array([[2.0**20, 3.0]]))[0, 0] == 2**60 + 3


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = op3_toxicity.score_documents(docs, labels).filter("held_out").join(labels.filter("toxic is not null"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    hit, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + wrong) and n[0, 0] > 1000


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"a{i % 7} b{i % 11} {'vile cruel' if i % 4 == 0 else 'mild'} c{i % 13} number {i}") for i in range(300)]
    odd = [(4, rows[4][1]), (1, "another text of one id"), (900, "x " * 200_000 + "vile, cruel"), (901, "Vile ＣＲＵＥＬ cr\u00aduel"), (902, ""), (903, None), (None, "vile cruel")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'x' as score", "3 as y", "1 as half")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(5, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    got = op3_toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    verdict = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] != 1}
    assert [verdict[k] for k in (901, 902, 903, None)] == [1, 0, 0, 1] and all(verdict[i] == int(i % 4 == 0) for i, _ in rows if i != 1)


def plain_toxicity(text, lexicon):
    """The score by looking every word up, without an automaton; for a lexicon without exception phrases."""
    folded, said = op3_toxicity.fold(text or ""), {}
    word = ""
    for c in folded + " ":
        if c.isalnum():
            word += c
            continue
        best = max(((lexicon.weights[e], -len(e.rstrip("*")), e.rstrip("*")) for e in [word, *(word[:k] + "*" for k in range(1, len(word) + 1))] if e in lexicon.weights), default=None)
        if best:
            said[best[2]] = best[0]
        word = ""
    w = sum(said.values())
    x = [1.0, len(said) > 0, len(said) > 1, np.log1p(w), np.log1p(w * 600 / (len(folded) + 100)) if folded else 0.0]
    return 1 / (1 + np.exp(-np.dot(x, lexicon.curve)))


def test_toxicity_stage_drops_what_a_plain_matcher_finds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(5_000_001, None, "x"), (5_000_002, "", "x"), (5_000_003, "scum " * 100_000 + "trash", "x"), (5_000_003, "scum " * 100_000 + "trash", "x"), (None, "SCUM, tr@sh", None)], "doc_id long, text string, source string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    lexicon = op3_toxicity.learn(op3_toxicity.train_rows(docs), labels)
    assert lexicon.weights and not lexicon.exceptions
    got = corpus_pipeline.toxicity(spark, docs, sf)
    assert got.columns == docs.columns
    kept = sorted(map(str, got.select("doc_id", "text").collect()))
    want = sorted(str(r) for r in docs.select("doc_id", "text").collect() if plain_toxicity(r["text"], lexicon) < 0.7)
    assert kept == want and 0 < len(want) < docs.count()
    assert not any(r["doc_id"] in (5_000_003, None) for r in got.collect())
