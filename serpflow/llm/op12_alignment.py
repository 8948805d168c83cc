"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B).  Ends of tokens are byte offsets.
The merge holds one NumPy state vector: a pointer into A and one into B for every document of a batch.  Each
step links the two tokens at the pointers, notes a cut where both end together, moves the pointer whose token
ends first (both at a cut), and now and then squeezes finished entries out of the vector.  A long
document enters the vector as several entries, parted where a token of A and one of B are known to end together,
so that it doesn't hold the batch up.

Whole texts are aligned in batches of bounded size.  What a batch links is written once; id pairs are counted over all
documents by grouped sums, and the counts go back to the batches that hold the pair, each pair of a batch
once, so that the pairs of a frequent token don't travel once for each document.

Defined results: null and empty texts, and texts whose tokens' bytes differ from space + text, have no tokens:
zeros, and '' for the hash; repeated rows are rows of their own and count as documents of their own; rows
without an id are aligned like others; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tokens and documents of a batch, about; tokens of A in an entry of the state vector, about, and how many are
#: looked through for an end that B shares.
BATCH_TOKENS, BATCH_DOCS, ENTRY, LOOK = 600_000, 4096, 384, 64
#: No id of B reaches this, so a pair of ids is one number.
PAIR = 1 << 20
#: Texts with a longer word or gap go through the library of the vocabulary file itself.
RUN = 2048
BATCH = "doc_id long, batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes
    in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both encoders, and the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        import re

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        letter = byte_alphabet()
        special = {t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letter[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if i not in special}
        self.a_bytes: list[bytes] = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        # the same merges by rank, several times faster; both are held against each other in tests
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        self.long_gap = re.compile(r"\s{%d}" % RUN).search
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        lengths = lambda pieces: np.array([len(p) for p in pieces], dtype=np.int64)
        self.a_len, self.b_len = lengths(self.a_bytes), lengths(self.b_bytes)
        # decimal ids with the sign that may follow them, as text of the digest
        self.n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.words = [str(i) + sign for sign in (",", "|", ";") for i in range(self.n_ids)]

    def long_run(self, text: str) -> bool:
        return len(text) >= RUN and (max(map(len, text.split()), default=RUN) >= RUN or self.long_gap(text) is not None)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B, or None if either's bytes differ from space + text."""
        whole = " " + text
        raw = whole.encode()
        a = self.slow.encode(whole, add_special_tokens=False).ids if self.long_run(text) else self.fast.encode_ordinary(whole)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return None
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def digest(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """sha256 of ``a1,a2|b1;a3|b2,b3``; cuts are how many tokens of either lie before them."""
        in_a, in_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        n = len(a) + len(b)
        ids, sign = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # tokens of A stand after the tokens of B of earlier groups, those of B after the tokens of A of their own
        at_a = np.arange(len(a)) + np.repeat(cut_b - in_b, in_a)
        at_b = np.arange(len(b)) + np.repeat(cut_a, in_b)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[cut_a - 1]], sign[at_b[cut_b - 1]] = 1, 2
        words = self.words
        return hashlib.sha256("".join([words[k] for k in (ids + sign * self.n_ids).tolist()])[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def entries(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int]]:
    """Where entries of one document start in A and B: at 0, and after shared ends found by looking up a few
    ends of A in B every ENTRY tokens."""
    out = [(0, 0)]
    for t in range(ENTRY, len(ends_a) - 1, ENTRY):
        near = ends_a[t : min(t + LOOK, len(ends_a) - 1)]
        at = np.searchsorted(ends_b, near)
        hit = np.flatnonzero(ends_b[at] == near)
        if len(hit) and t + hit[0] + 1 > out[-1][0]:
            out.append((t + int(hit[0]) + 1, int(at[hit[0]]) + 1))
    return out


def lockstep(ends: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Links (doc, i, j) and cuts (doc, i, j: tokens of either before the cut) of documents given by the ends of
    their tokens in A and B; not in order."""
    # all documents' ends lie in one array; an entry's pointers are places there
    off_a = np.cumsum([0] + [len(a) for a, _ in ends])
    off_b = np.cumsum([0] + [len(b) for _, b in ends])
    all_a, all_b = np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])
    doc, i, j, stop = [], [], [], []
    for d, (a, b) in enumerate(ends):
        starts = entries(a, b)
        for k, (x, y) in enumerate(starts):
            doc.append(d)
            i.append(off_a[d] + x)
            j.append(off_b[d] + y)
            stop.append(off_a[d] + (starts[k + 1][0] if k + 1 < len(starts) else len(a)))
    doc, i, j, stop = (np.array(x, dtype=np.int64) for x in (doc, i, j, stop))
    links, cuts, idle = [], [], 0
    while len(doc):
        links.append((doc, i, j))
        ea, eb = all_a[i], all_b[j]
        next_i, next_j = i + (ea <= eb), j + (eb <= ea)
        cut = np.flatnonzero(ea == eb)
        cuts.append((doc[cut], next_i[cut], next_j[cut]))
        i, j = next_i, next_j
        left = i < stop
        if not left.all():
            doc, i, j, stop = doc[left], i[left], j[left], stop[left]
    flat = [np.concatenate(x) for x in (*zip(*links), *zip(*cuts))]
    for d, a, b in (flat[:3], flat[3:]):
        a -= off_a[d]
        b -= off_b[d]
    return tuple(flat)


def align(texts: list[str | None], v: Vocabularies, number: int = 0) -> list[tuple]:
    """What BATCH holds after doc_id, for a batch of texts."""
    ids = [v.encode(t) if t else None for t in texts]
    return _aligned(ids, v, number)


def _aligned(ids: list, v: Vocabularies, number: int) -> list[tuple]:
    none = (number, 0, 0, 0, 0, "", [], [])
    out = [none] * len(ids)
    full = [k for k, x in enumerate(ids) if x is not None]
    if not full:
        return out
    ends = [(np.cumsum(v.a_len[ids[k][0]]), np.cumsum(v.b_len[ids[k][1]])) for k in full]
    doc, i, j, cut_doc, cut_a, cut_b = lockstep(ends)
    flat_a, flat_b = np.concatenate([ids[k][0] for k in full]), np.concatenate([ids[k][1] for k in full])
    off_a = np.cumsum([0] + [len(ids[k][0]) for k in full])
    off_b = np.cumsum([0] + [len(ids[k][1]) for k in full])
    pair = flat_a[off_a[doc] + i] * PAIR + flat_b[off_b[doc] + j]
    n_links = np.bincount(doc, minlength=len(full))
    # links by document, then pair, as one number: a pair takes less than 2^40
    key = np.sort(doc << 40 | pair)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)]).astype(np.int32)
    key = key[first]
    bounds = np.searchsorted(key, np.arange(len(full) + 1) << 40)
    pairs = key & ((1 << 40) - 1)
    # cuts by document, then place: both sides rise together
    cut_bounds = np.cumsum(np.r_[0, np.bincount(cut_doc, minlength=len(full))])
    cut_a, cut_b = (np.sort(cut_doc << 40 | x) & ((1 << 40) - 1) for x in (cut_a, cut_b))
    for d, k in enumerate(full):
        a, b = ids[k]
        x, y = slice(bounds[d], bounds[d + 1]), slice(cut_bounds[d], cut_bounds[d + 1])
        digest = v.digest(a, b, cut_a[y], cut_b[y])
        out[k] = (number, len(a), len(b), int(y.stop - y.start), int(n_links[d]), digest, pairs[x], times[x])
    return out


def _arrow(doc_ids: list, rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    columns = [pa.array(doc_ids, pa.int64()), *(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], pa.string()), pa.array(c[6], pa.list_(pa.int64())), pa.array(c[7], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "batch", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned_batches(docs: DataFrame, a_path: str, b_path: str, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Documents aligned, each with its batch and the distinct id pairs linked in it."""

    def run(batches):
        v, part, made = vocabularies(a_path, b_path), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                x = v.encode(text) if text else None
                doc_ids.append(doc_id)
                ids.append(x)
                size += len(x[0]) + len(x[1]) if x else 0
                if size >= batch_tokens or len(ids) >= BATCH_DOCS:
                    yield _arrow(doc_ids, _aligned(ids, v, part << 32 | made))
                    made += 1
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield _arrow(doc_ids, _aligned(ids, v, part << 32 | made))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BATCH)


def _sums(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Best links and summed counts of a batch's documents."""
    counts = counts.sort_values("pair")
    pair, count, best = counts["pair"].to_numpy(), counts["count"].to_numpy(), counts["best"].to_numpy()
    n_best, total = [], []
    for pairs, times in zip(rows["pairs"], rows["times"]):
        at, k = np.searchsorted(pair, pairs), np.asarray(times, dtype=np.int64)
        n_best.append(int(k[best[at]].sum()) if len(k) else 0)
        total.append(int((k * count[at]).sum()) if len(k) else 0)
    out = rows[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
    out["n_best"], out["count_sum"], out["groups_sha256"] = n_best, total, rows["groups_sha256"]
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    done = table(aligned_batches(docs, a_path, b_path, batch_tokens), "aligned")
    # an id of A has at most as many pairs as B has ids, so no group grows with the corpus
    counted = done.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counted = table(counted, "pair_counts")
    top = counted.groupBy(F.shiftright("pair", PAIR.bit_length() - 1).alias("a")).agg(F.max("count").alias("top"))
    marked = counted.withColumn("a", F.shiftright("pair", PAIR.bit_length() - 1)).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    held = done.select(F.col("batch").alias("of"), F.explode("pairs").alias("pair")).distinct().join(marked, "pair")
    return done.groupBy("batch").cogroup(held.groupBy("of")).applyInPandas(_sums, RESULT)
