"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol per byte.  A heap holds the adjacent pairs by (rank, place); the
lowest is popped, its two symbols are joined in a linked list, and the new pairs on either side are
pushed.  The count is the initial symbols minus the merges; no identifiers are made.

Defined results: null and empty texts count 0 bytes and 0 tokens; repeated rows give repeated rows;
texts of any length are counted whole, one pre-token at a time; extra columns are left alone.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import islice

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks and pre-tokens whose counts a worker keeps; when full, the half met first stays, the frequent ones among it.
CACHE = 600_000
#: Pre-tokens longer than this are counted but not kept.
CACHE_LEN = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters for themselves, the others from U+0100 up in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """Values of a function by short keys; longer keys are worked out each time."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> int:
        got = self.of(key)
        if len(key) <= CACHE_LEN:
            self[key] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHE:
            keep = dict(islice(self.items(), CACHE // 2))
            self.clear()
            self.update(keep)


class MergeCounter:
    """Counts the tokens of texts by the merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        #: Rank of a pair of symbols a, b under the key a << 32 | b; at each rank, the symbol it makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.symbols = [number.setdefault(c, len(number)) for c in byte_symbols()]
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[number.setdefault(a, len(number)) << 32 | number.setdefault(b, len(number))] = i
            self.made.append(number.setdefault(a + b, len(number)))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: A space next to more white space: only there can a pre-token reach over a single space or line end.
        self.wide = regex.compile(r"[ \n]\s|\s[ \n]").search
        self.known = Memo(self.merge)
        self.chunks = Memo(lambda c: sum(map(self.known.__getitem__, self.split(c if c[:1] == "\n" else " " + c))))

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token.  The heap holds rank * n + place of the left symbol; an entry is stale
        when the pair now at that place has another rank."""
        symbols, rank, made = self.symbols, self.ranks.get, self.made
        sym = [symbols[b] for b in piece.encode("utf-8")]
        n = len(sym)
        heap = [r * n + i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = nxt[i]
            if j >= n or rank(sym[i] << 32 | sym[j]) != r:
                continue
            merges += 1
            sym[i] = joined = made[r]
            sym[j] = -1 << 40  # no pair with it has a rank
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := rank(joined << 32 | sym[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            p = prev[i]
            if p >= 0 and (r := rank(sym[p] << 32 | joined)) is not None:
                heapq.heappush(heap, r * n + p)
        return n - merges

    def pieces(self, text: str) -> int:
        """Tokens of a text without special tokens.  Where every space and line end stands alone, the text
        falls into independent chunks, one before each of them, and a chunk met before is looked up."""
        if self.wide(text):
            return sum(map(self.known.__getitem__, self.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        total = sum(map(self.known.__getitem__, self.split(first))) + sum(map(self.chunks.__getitem__, rest))
        self.chunks.trim()
        self.known.trim()
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.pieces(p) for p in parts if p)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Token count of a text column by the vocabulary file at path (on every executor)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        one = counter(path).count
        return pd.Series([one(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens(F.col("text"), path).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
