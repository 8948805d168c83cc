"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts are tokenized where the scan put them and cut only where they exceed a sequence.  The pieces go to
shards of bounded size by a hash.  Every shard is searched by several islands, each a population of
packings: a crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold the same pieces a second time, and best-fits what was displaced.  After each round the islands of a
shard pass their elites on to the next island in a ring.  The best packing of any island is taken; the
first member of every population is best-fit decreasing, so the result is never worse than that.

Defined results: a null text is empty and gives one piece, the end id alone; a piece of full length is a
sequence of its own; repeated rows are packed as rows of their own; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Chunks and parts whose ids a worker keeps, none longer than CACHE_LEN.
CACHE, CACHE_LEN = 600_000, 64
#: Pieces of a shard, on average.
SHARD = 8192


class ChunkIds:
    """Little-endian ids of texts, looked up by chunk: no token of this vocabulary crosses a space or a line
    end, and inside a chunk none crosses the parts of the vocabulary's own pattern.

    A part of printable Latin-1 text is encoded once; what else may occur (other scripts, marks that
    compose, the special strings) is left to the tokenizer chunk by chunk.
    """

    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]*\Z").match

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def encode(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: set[str]) -> dict[str, bytes]:
        split = {c: self.PARTS(c.lower()) for c in new if self.PLAIN(c) and "<|" not in c}
        fresh = list({p for parts in split.values() for p in parts}.difference(self.parts))
        for k in range(0, len(fresh), 2000):
            group = fresh[k : k + 2000]
            got = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            owner = np.array(got.word_ids)
            ids, ends = np.array(got.ids, dtype="<u4"), np.searchsorted(owner, np.arange(len(group) + 1))
            for p, x, y in zip(group, ends.tolist(), ends[1:].tolist()):
                self.parts[p] = ids[x:y].tobytes()
        known = self.parts
        return {c: b"".join([known[p] for p in split[c]]) if c in split else self.encode(c) for c in new}

    def ids(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        if new := set(chunks).difference(self.chunks):
            got = self.learn(new)
            self.chunks.update((c, v) for c, v in got.items() if len(c) <= CACHE_LEN)
            long = {c: v for c, v in got.items() if len(c) > CACHE_LEN}
            out = b"".join([long[c] if c in long else self.chunks[c] for c in chunks] if long else map(self.chunks.__getitem__, chunks))
            self.chunks, self.parts = trimmed(self.chunks), trimmed(self.parts)
            return out
        return b"".join(map(self.chunks.__getitem__, chunks))


def trimmed(cache: dict) -> dict:
    """The half met first, if a cache is full: frequent keys are among those."""
    return cache if len(cache) <= CACHE else dict(islice(cache.items(), CACHE // 2))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def tokenized_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    end = int(end_id).to_bytes(4, "little")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        tok = chunk_ids(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for col, v in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
                    if with_ids:
                        rows[5].append(np.frombuffer(part, dtype="<i4"))
            cols = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                cols.append(pa.array(rows[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


class Bins:
    """Open bins by free room: a bit mask of the rooms that occur finds the tightest fit at once."""

    def __init__(self, size: int):
        self.size, self.mask = size, 0
        self.at: list[list[list[int]]] = [[] for _ in range(size + 1)]

    def add(self, room: int, items: list[int]) -> None:
        self.at[room].append(items)
        self.mask |= 1 << room

    def fit(self, item: int, length: int) -> None:
        rest = self.mask >> length
        if rest:
            room = length + (rest & -rest).bit_length() - 1
            items = self.at[room].pop()
            if not self.at[room]:
                self.mask &= ~(1 << room)
            items.append(item)
            self.add(room - length, items)
        else:
            self.add(self.size - length, [item])

    def bins(self) -> list[tuple[int, list[int]]]:
        return [(room, b) for room, group in enumerate(self.at) for b in group]


def best_fit(order, lengths: list[int], size: int, start=()) -> list[tuple[int, list[int]]]:
    open_ = Bins(size)
    for room, items in start:
        open_.add(room, list(items))
    for i in order:
        open_.fit(i, lengths[i])
    return open_.bins()


def fitness(bins: list[tuple[int, list[int]]], size: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: (bins, minus the mean squared fill)."""
    return len(bins), -sum((1 - room / size) ** 2 for room, _ in bins) / max(len(bins), 1)


def crossover(a, b, lengths: list[int], size: int, rnd: random.Random):
    """Inject a run of b's fullest bins into a."""
    full = sorted(b, key=lambda x: x[0])[: max(1, len(b) // 2)]
    cut = sorted(rnd.sample(range(len(full) + 1), 2)) if len(full) > 1 else [0, 1]
    inject = full[cut[0] : cut[1]]
    placed = {i for _, items in inject for i in items}
    keep, displaced = [], []
    for room, items in a:
        if placed.isdisjoint(items):
            keep.append((room, items))
        else:
            displaced += [i for i in items if i not in placed]
    displaced.sort(key=lengths.__getitem__, reverse=True)
    return best_fit(displaced, lengths, size, keep + inject)


def mutate(a, lengths: list[int], size: int, rnd: random.Random):
    """Dissolve the emptiest bin and a few others, and best-fit their pieces."""
    ordered = sorted(a, key=lambda x: -x[0])
    gone = ordered[:1] + [ordered[i] for i in rnd.sample(range(1, len(ordered)), min(len(ordered) - 1, 8))]
    loose = sorted((i for _, items in gone for i in items), key=lengths.__getitem__, reverse=True)
    drop = {id(x) for x in gone}
    return best_fit(loose, lengths, size, [x for x in a if id(x) not in drop])


def encode(bins, n: int) -> bytes:
    out = np.zeros(n, dtype="<i4")
    for k, (_, items) in enumerate(bins):
        out[items] = k
    return out.tobytes()


def decode(blob: bytes, lengths: list[int], size: int):
    by: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(blob, dtype="<i4").tolist()):
        by.setdefault(k, []).append(i)
    return [(size - sum(lengths[i] for i in items), items) for items in by.values()]


def evolve(lengths: list[int], size: int, elites: list, rnd: random.Random, population: int, offspring: int):
    """One round of an island; lengths fall, so their order is best-fit decreasing."""
    pop = list(elites)
    while len(pop) < population:
        order = list(range(len(lengths)))
        if pop:
            noise = [x * (1 + 0.2 * rnd.random()) for x in lengths]
            order.sort(key=noise.__getitem__, reverse=True)
        pop.append(best_fit(order, lengths, size))
    floor = -(-sum(lengths) // size)
    pop.sort(key=lambda x: fitness(x, size))
    for _ in range(offspring):
        if len(pop[0]) <= floor:
            break
        a, b = rnd.sample(pop, 2)
        child = mutate(crossover(a, b, lengths, size, rnd), lengths, size, rnd)
        if fitness(child, size) < fitness(pop[-1], size):
            pop[-1] = child
            pop.sort(key=lambda x: fitness(x, size))
    return pop


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a shard as every round sees them; equal rows may change places."""
    return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)


def pack(pieces: DataFrame, size: int = 2048, islands: int = 2, rounds: int = 2, population: int = 4, offspring: int = 8, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    if islands < 1 or rounds < 1 or population < 2:
        raise ValueError("islands and rounds must be at least 1, population at least 2")
    pieces = table(pieces, "pieces")
    n = pieces.filter(F.col("length") < size).count()
    shards = max(1, -(-n // shard))
    home = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), F.lit(shards)).alias("shard")
    items = pieces.select("*", home)
    short = items.filter(F.col("length") < size).select("shard", "doc_id", "piece", "length", "ids_crc32")
    crowd = short.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = "shard bigint, island int, rank int, bins int, fit double, blob binary"

    def one_round(number: int):
        def run(key, pdf: pd.DataFrame, elite: pd.DataFrame | None = None) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame(columns=[c.split()[0] for c in state.split(", ")])
            lengths = in_order(pdf)["length"].tolist()
            rnd = random.Random(f"{seed}/{key[0]}/{key[1]}/{number}")
            known = [] if elite is None else [decode(b, lengths, size) for b in elite.sort_values(["island", "rank"])["blob"]]
            pop = evolve(lengths, size, known, rnd, population, offspring)[:2]
            return pd.DataFrame([(key[0], key[1], r, *fitness(p, size), encode(p, len(lengths))) for r, p in enumerate(pop)], columns=[c.split()[0] for c in state.split(", ")])

        return run

    def later_round(number: int):
        run = one_round(number)
        return lambda key, pdf, elite: run(key, pdf, elite)

    first = one_round(0)
    best = crowd.groupBy("shard", "island").applyInPandas(lambda key, pdf: first(key, pdf), state)
    for number in range(1, rounds):
        best = table(best, "elites")
        moved = best.filter("rank = 0").withColumn("island", (F.col("island") + 1) % islands)
        both = best.union(moved) if islands > 1 else best
        best = crowd.groupBy("shard", "island").cogroup(both.groupBy("shard", "island")).applyInPandas(later_round(number), state)
    best = best.groupBy("shard").agg(F.min_by("blob", F.struct("bins", "fit", "island", "rank")).alias("blob"))
    result = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def lay_out(key, pdf: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in result.split(", ")])
        pdf = in_order(pdf)
        whole = int((pdf["length"] >= size).sum())  # they come first
        bins = np.concatenate([np.arange(whole), whole + np.frombuffer(won["blob"].iloc[0] if len(won) else b"", dtype="<i4").astype("int64")])
        pdf["sequence_id"] = (int(key[0]) << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[[c.split()[0] for c in result.split(", ")]]

    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(lay_out, result)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Tokenize and pack documents (doc_id, text)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenized_pieces(docs, path, size, end_id), size, **options)
