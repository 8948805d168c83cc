"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of 64-bit hashes of its word 3-shingles.  All sets are put in one order, rare
shingles first by a sketch of counts over the whole corpus.  If two sets reach Jaccard t, the first
``n - ceil(t * n) + l`` shingles of each share at least l (for the smaller l of the two).  l grows with the
estimated number of candidates of a document's prefix, so a document whose shingles are common needs more
shared prefix shingles before its whole set is looked at.  A set also has 256 parities, of how many of its
shingles hash to each of 256 bins: two sets differ in at least as many shingles as their parities do, so
pairs whose parities differ too much go before anything larger is read.  Pairs that pass are verified on whole sets.

No group meets itself in one task.  Equal sets are one class.  Candidates of a prefix shingle are first
paired with one pivot each, which is linear; what the pivots link becomes components.  Lists that would still make
many pairs are dealt out at random, about DEAL classes together, which is linear too, and again as long as what
links so leaves fewer pairs.  Only lists that then hold several components are joined, and only across components, since a further link inside one changes
nothing.  So no link between components is lost, however many there are.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; a text of fewer words than a shingle is one shingle, the whole sequence; copies share a
component; a null doc_id links nothing of its own accord (ids are taken by minimum); an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_table, table

#: Counters of the sketch; the estimate of a shingle is the count of all shingles that share its counter.
SKETCH = 1 << 19
CHUNKS = 64
#: Bins of a set's shingles of which the parity is kept.
PARITIES = 256
#: Size of a Bloom filter of classes.
BLOOM_BITS = 24
#: Estimated candidates that a document's prefix may have before it is lengthened.
FREE = 64.0
#: Classes of a list, about, that are dealt together; lists are dealt out when whole ones would make more pairs for a class.
DEAL = 32
#: One more shared prefix shingle is asked for with every so many shingles of a set, whatever the estimate.
STEP = 20
MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)]


class WordHash(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < 250_000 and len(word) <= 64:
            self[word] = got
        return got


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word k-shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=k)], np.uint64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * MULT[0] + h[i : i + n] * MULT[i % len(MULT)] + np.uint64(i)
    return np.unique(mixed(s))


def text_sets(batches, k: int):
    """For slices of 256 rows of (doc_id, text): the ids, the sets and their signatures (None if empty)."""
    known = WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = [shingle_set(t.as_py(), k, known) for t in batch.column(1)[at : at + 256]]
            yield batch.column(0)[at : at + 256], part, [xxhash.xxh64_intdigest(s.tobytes(), seed=1) - (1 << 63) if len(s) else None for s in part]


def parities(s: np.ndarray) -> np.ndarray:
    """PARITIES bits, as longs: whether an odd number of the shingles of a set is in each bin."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_reach(n_a: str, sig_a: str, n_b: str, sig_b: str, num: int, den: int) -> Column:
    """Whether the parities of two sets let them reach Jaccard num / den: at least as many shingles are in one set only
    as parities differ, and those may be (den - num) / (num + den) of both sizes together."""
    differ = sum((F.bit_count(F.col(sig_a)[k].bitwiseXOR(F.col(sig_b)[k])) for k in range(PARITIES // 64)), F.lit(0))
    return differ * (num + den) <= (F.col(n_a) + F.col(n_b)) * (den - num)


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def chunk_rows(counts: np.ndarray) -> list[bytes]:
    return [c.tobytes() for c in np.split(counts, CHUNKS)]


def merged_chunks(rows: DataFrame, dtype, merge) -> np.ndarray | None:
    """Merge the arrays that tasks sent as rows (chunk, v): of fixed size, whatever the input."""

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"chunk": [key[0]], "v": [merge.reduce([np.frombuffer(b, dtype) for b in pdf["v"]]).tobytes()]})

    got = rows.groupBy("chunk").applyInPandas(run, "chunk long, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"], dtype) for r in sorted(got, key=lambda r: r["chunk"])]) if got else None


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """Rows with chunk null: doc_id, cls (signature of the set), n.  Others: a chunk v of the sketch of a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("chunk", pa.int64()), ("v", pa.binary())])

    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for ids, part, cls in text_sets(batches, k):
            counts += np.bincount((np.concatenate(part) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cls, pa.int64()), pa.array(map(len, part), pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())], schema=schema)
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(CHUNKS), pa.int64()), pa.array(chunk_rows(counts), pa.binary())], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, cls long, n long, chunk long, v binary")


def bloom_places(cls: np.ndarray) -> list[np.ndarray]:
    h = cls.astype(np.int64).view(np.uint64)
    return [((h * m) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for m in MULT[:3]]


def bloom(classes: DataFrame) -> np.ndarray:
    """Bloom filter of the classes (cls): 2^BLOOM_BITS bits, whatever their number; when it fills up it lets
    more pass, and the join behind it still decides."""

    def run(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int64()), pa.array(chunk_rows(np.packbits(bits)), pa.binary())], names=["chunk", "v"])

    got = merged_chunks(classes.select("cls").mapInArrow(run, "chunk long, v binary"), np.uint8, np.bitwise_or)
    return np.zeros(1 << BLOOM_BITS >> 3, np.uint8) if got is None else got


def rows_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (cls, …) of the wanted classes; what the Bloom filter stops is not shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(bloom(classes))

    def run(batches):
        bits = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(np.logical_and.reduce([bits[at] for at in bloom_places(batch.column(0).to_numpy())])))

    return rows.mapInArrow(run, rows.schema).join(classes, "cls", "left_semi")


def sets_of(docs: DataFrame, k: int, classes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """cls, set of the wanted classes, worked out again from the texts of one document each, the one of smallest id
    in rows (doc_id, cls), which is made if not given; a task gives each once.  Texts without an id are all looked at."""
    context = docs.sparkSession.sparkContext
    rows = shingled(docs, k).filter("chunk is null").select("doc_id", "cls") if rows is None else rows
    sent = context.broadcast(bloom(classes))
    ids = rows.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("id")).filter("id is not null")
    asked = context.broadcast(bloom(ids.select(F.col("id").alias("cls"))))

    def chosen(batches):
        bits = np.unpackbits(asked.value).view(bool)
        for batch in batches:
            id_, none = batch.column(0), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            found = np.logical_and.reduce([bits[at] for at in bloom_places(id_.fill_null(0).to_numpy())])
            yield batch.filter(pa.array(none | found))

    def run(batches):
        bits, seen = np.unpackbits(sent.value).view(bool), set()
        for _, part, cls in text_sets(chosen(batches), k):
            have = [(c, s) for c, s in zip(cls, part) if c is not None and c not in seen]
            seen.update(c for c, _ in have)
            keep = np.logical_and.reduce([bits[at] for at in bloom_places(np.array([c for c, _ in have], np.int64))])
            out = [x for x, ok in zip(have, keep) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x.view(np.int64) for _, x in out], pa.list_(pa.int64()))], names=["cls", "set"])

    found = id_and_text(docs).mapInArrow(run, "cls long, set array<long>")
    return found.join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("set").alias("set"))


def least_shared(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares at least with any set at Jaccard num / den or more."""
    return -(-n * num // den)


def prefixes(docs: DataFrame, k: int, sketch: np.ndarray, num: int, den: int) -> DataFrame:
    """cls, n, need (l), head (shingles of the plain prefix), more (those added for l), sig (parities).  A task
    gives each class it meets once."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 31) - 1).astype(np.int32))
    usual = float(np.median(sketch))

    def run(batches):
        counts, seen = sent.value, set()
        for _, part, classes in text_sets(batches, k):
            out: list[list] = [[] for _ in range(6)]
            for cls, s in zip(classes, part):
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                n = len(s)
                est = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                shared = least_shared(n, num, den)
                p = n - shared + 1
                order = np.argsort(est, kind="stable")
                cost = np.maximum(0.0, est[order[:p]] - 1.5 * usual - 4).sum()
                need = int(min(shared, 1 + n // STEP + (2 * np.log2(cost / FREE) if cost > FREE else 0)))
                sig = parities(s)
                s = s.view(np.int64)
                for col, v in zip(out, (cls, n, need, s[order[:p]], s[order[p : p + need - 1]], sig)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64()))], names=["cls", "n", "need", "head", "more", "sig"])

    return id_and_text(docs).mapInArrow(run, "cls long, n int, need int, head array<long>, more array<long>, sig array<long>")


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every document (doc_id, text), linked at Jaccard >= num / den."""
    rows = table(shingled(docs, k), "shingles")
    sketch = merged_chunks(rows.filter("chunk is not null").select("chunk", "v"), np.int64, np.add)
    head = table(prefixes(docs, k, np.zeros(SKETCH, np.int64) if sketch is None else sketch, num, den), "prefixes")

    def near(a: str, b: str):
        return (F.least(a, b) * den >= F.greatest(a, b) * num)

    def within(n: str, i: str, m: str, j: str):
        """The shingle may be the first that two sets of n and m share, at places i and j of the order: from
        there on enough is left.  What two similar sets share first always passes."""
        most = F.lit(1) + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) - 1
        return most * (num + den) >= (F.col(n) + F.col(m)) * num

    # dealt by shingle once: the lists' pivots and their join read the same columns of one exchange
    posts = head.select(F.posexplode("head").alias("at", "token"), "cls", "n").repartition("token")
    sigs = table(head.groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "parities")
    lists = posts.groupBy("token").agg(F.min(F.struct("cls", "n", "at")).alias("pivot"), F.max("cls").alias("last")).filter("pivot.cls < last").select("token", F.col("pivot.cls").alias("pc"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat"))
    shared = table(posts.join(lists, "token"), "shared")
    stars = shared.filter(F.col("cls") != F.col("pc")).filter(near("n", "pn") & within("n", "at", "pn", "pat")).select(F.col("pc").alias("a"), F.col("cls").alias("b")).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs (a, b), those whose sets reach the threshold; pairs are those that parities let pass."""

        def classes(p: DataFrame) -> DataFrame:
            return table(p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls"))).distinct(), name + "_classes")

        pairs = table(pairs, name + "_pairs")
        wanted = classes(pairs)
        pre = rows_of(head.select("cls", "n", "need", "head", "more"), wanted).groupBy("cls").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.first(F.concat("head", "more")).alias("p"))
        pre = table(pre, name + "_prefixes")
        x = pairs.join(pre.toDF("a", "n_a", "need_a", "p_a"), "a").join(pre.toDF("b", "n_b", "need_b", "p_b"), "b")
        # one of the prefixes ends first in the order, and behind it no more is shared than that set has left
        rest = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
        least = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den) - 1e-6) - rest
        x = table(x.filter(F.size(F.array_intersect("p_a", "p_b")) >= F.greatest(F.least("need_a", "need_b"), least)).select("a", "b"), name + "_candidates")
        for read_out in (pairs, wanted, pre):
            drop_table(read_out)
        wanted = classes(x)
        full = table(sets_of(docs, k, wanted, rows.filter("chunk is null").select("doc_id", "cls")), name + "_sets")

        # row by row: a batch of pairs of long sets for Python would be as large as its longest rows make it
        y = x.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
        y = y.withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
        out = table(y.filter(F.col("both") * den >= (F.size("sa") + F.size("sb") - F.col("both")) * num).select("a", "b"), name)
        for read_out in (x, wanted, full):
            drop_table(read_out)
        return out

    like = stars.join(sigs.toDF("a", "n_a", "sig_a"), "a").join(sigs.toDF("b", "n_b", "sig_b"), "b")
    links = verified(like.filter(may_reach("n_a", "sig_a", "n_b", "sig_b", num, den)).select("a", "b"), "stars")
    comps = components(links, "star_components")
    def placed(lists: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows of the lists (token, cls, …) with their component as part, of lists that are not settled: those of two are by
        their pivot, and those of one component."""
        at = lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls")).drop("component")
        at = table(at, "placed")
        open_ = at.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")).filter("lo < hi and c > 2").select("token")
        return at.join(open_, "token")

    def met(lists: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs (a, b) of a list and deal, across components, that may link and are not tested."""
        x, y = (lists.select("token", "deal", *[F.col(c).alias(c[0] + i) for c in ("cls", "n", "at", "sig", "part")]) for i in "ab")
        pairs = x.join(y, ["token", "deal"]).filter("ca < cb and pa <> pb").filter(near("na", "nb") & within("na", "aa", "nb", "ab") & may_reach("na", "sa", "nb", "sb", num, den))
        return pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")

    cols = ["token", "cls", "n", "at", "sig", "part"]
    # a task gave each class once, so a list may hold it as often as there were tasks
    left = placed(shared.select("token", "cls", "n", "at"), comps).dropDuplicates(["token", "cls"])
    left = table(left.join(sigs.select("cls", "sig"), "cls").select(*cols), "open")
    tested, turn, before = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), 0, None
    # while whole lists would make many pairs for a row, they are dealt out, as long as that leaves fewer pairs
    while True:
        sizes = left.groupBy("token", "part").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("s"))
        crossing, members = sizes.agg(F.coalesce(F.sum(F.col("c") * F.col("c") - F.col("s")) / 2, F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
        if crossing <= DEAL * members or before is not None and crossing > 0.8 * before:
            break
        dealt = left.join(left.groupBy("token").agg(F.count("*").alias("c")), "token").withColumn("deal", F.pmod(F.xxhash64("cls", F.lit(turn)), F.ceil(F.col("c") / DEAL)))
        pairs = table(met(dealt, tested), "dealt")
        tested, turn, before = tested.union(pairs), turn + 1, crossing
        links = links.union(verified(pairs, "dealt_links"))
        comps = components(links, "dealt_components")
        left = table(placed(left.drop("part"), comps).select(*cols), "open")
    across = met(left.withColumn("deal", F.lit(0)), tested)
    more = verified(across, "across")
    joined = components(links.union(more), "components") if more.limit(1).count() else comps
    member = rows.filter("chunk is null").select("doc_id", F.col("n").alias("n_shingles"), "cls")
    member = member.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    low = member.filter("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = member.join(low, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
