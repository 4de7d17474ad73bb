"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct k-word shingles. For sets x, y with Jaccard >= t the
overlap is at least ceil(t * max(|x|, |y|)), so under *every* total order of the tokens the
first |x| - ceil(t|x|) + l tokens of x share l tokens or more with those of y. Order A (rare
tokens first) makes the candidates; orders B and C are two more orders whose prefixes a
candidate pair must share before its full sets are compared by the exact integer test
den * |x & y| >= num * |x | y|.

Index of order A. l grows with the set size. Prefix tokens are dealt to l - 1 groups by a
hash, so two of the l shared ones fall in one group: the index key is a pair of tokens, which
unrelated documents hardly ever share. (Small sets use single tokens.) Tokens that no other
prefix holds cannot be shared and make no keys.

Candidates. Equal sets become one representative first, so copies cost nothing later. Keys
with two members name a pair, those with up to SMALL members are enumerated (lists
of the same members are one list). Longer lists are compared in blocks of at most 2 * ROWS rows, in
matrices that never leave the task. A set carries a parity sketch: each token flips one of
about 8 n bits, so the bits in which two sketches differ are never more than the tokens in
which the sets do, and a pair that they rule out is no link.

Links by rounds. Each set offers its closest candidate of another component (in later rounds
a random one); offers are verified and components grow. So a group of near copies costs
its size and not its square. When most offers of a round fail, the candidates that still lie
between components, which are false ones but for a few, are verified one and all, so no link
between two components is lost.

Scale. Rarity comes from a fixed-size count sketch over all documents (4 MB whatever the
input), and any error in it only changes the order, never the result. Full sets are read
again from the texts of documents with a candidate, which a bitmap of fixed size finds
without a shuffle of texts. Tables that later steps don't need are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bitloom.llm.common import byte_classes, mix, shingles, slices, string_buffers, tune, words
from bitloom.llm.graph import merge_components
from bitloom.llm.itq import _groups
from bitloom.session import discard, materialize

#: Word separators: space and U+0009 to U+000D.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Counters of the rarity sketch, and counters in one of its blocks.
SLOTS, BLOCK = 1 << 20, 1 << 12
#: Shared prefix tokens that a pair needs: of single-token keys, of token pairs at least; largest set that has no token pairs.
SHARED, PAIRED, TINY = 3, 12, 24
#: Longest list that is enumerated, rows of a block of longer ones, bits of a sketch (at least and at most).
SMALL, ROWS, SKETCH = 8, 512, (512, 1 << 16)
#: Bits of the bitmap that finds documents with candidates; more documents than that only mean that more texts are read again.
BITMAP = 1 << 25

_CLASSES = byte_classes(SEPARATORS)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets):
        h, _, _, first = words(data, offsets[i : j + 1], *_CLASSES)
        s, begin = shingles(h, first, k)
        for d in range(j - i):
            yield np.unique(s[begin[d] : begin[d + 1]])


def _need(n, num: int, den: int):
    """ceil(t * n)"""
    return -(-num * n // den)


def _size_class(n: int) -> int:
    return max(n, 1).bit_length() - 1


def _class_shared(c: int) -> int:
    """Shared prefix tokens of two sets in size class c; a sixteenth of their size, so the keys of a set are linear in it."""
    return max(PAIRED, (1 << c) >> 4)


def _classes(n: int, num: int, den: int) -> range:
    """Size classes in which a set of n may meet a partner."""
    return range(_size_class(max(1, n * num // den)), _size_class(n * den // num + 1) + 1)


def _prefix(rank: np.ndarray, tokens: np.ndarray, p: int) -> np.ndarray:
    return tokens if p >= len(tokens) else tokens[np.argpartition(rank, p - 1)[:p]]


def rarity_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """SLOTS counters of distinct shingles over all documents; a fixed 4 MB on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(SLOTS, np.int64), False
        for batch in batches:
            held = [np.concatenate([s for s in _sets(batch.column(0), k)] or [np.zeros(0, np.uint64)])]
            total += np.bincount((held[0] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            some = True
        if some:
            pid = int(mix(total[:4096].astype(np.uint64).sum(keepdims=True))[0] & np.uint64(63))
            yield pa.record_batch({
                "block": pa.array(range(SLOTS // BLOCK), pa.int32()),
                "salt": pa.array([pid] * (SLOTS // BLOCK), pa.int32()),
                "counts": pa.array([c.astype(np.int32 if c.max() < 2**31 else np.int64).astype(np.int64).tobytes() for c in total.reshape(-1, BLOCK)], pa.binary()),
            })

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for c in group["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "block int, salt int, counts binary"
    part = docs.select("text").mapInArrow(count, schema).groupBy("block", "salt").applyInPandas(add, schema)
    rows = part.groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


def set_features(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, key (64-bit hash of the set), a (its prefix in order A, in that order)."""
    order = docs.sparkSession.sparkContext.broadcast(rarity_sketch(docs, k))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = order.value
        for batch in batches:
            n, key, a = [], [], []
            for s in _sets(batch.column(1), k):
                m = len(s)
                need = _need(m, num, den)
                most = max(SHARED, _class_shared(_classes(m, num, den)[-1])) if m > TINY else SHARED
                r = _rank_a(s, rarity)
                x = _prefix(r, s, m - need + min(most, need))
                n.append(m)
                key.append(_set_key(s))
                a.append(x[np.lexsort((x, _rank_a(x, rarity)))].astype(np.int64))
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.int64()), "a": pa.array(a, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(features, "doc_id long, n long, key long, a array<long>")


def _rank_a(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return rarity[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | (mix(s, 1) >> np.uint64(32))


def _set_key(s: np.ndarray) -> int:
    return int((mix(s, 11).sum() ^ mix(np.array([len(s)], np.uint64), 5)[0]).astype(np.int64))


def index_keys(owners: DataFrame, num: int, den: int) -> DataFrame:
    """(t, k): index keys t of each set k."""
    tokens = owners.select(F.col("key").alias("k"), F.col("n").cast("int").alias("n"), F.explode("a").alias("t"))
    common = materialize(tokens.select("t").groupBy("t").agg(F.count("*").alias("size")).where("size > 1").select("t"), "common")
    shared = tokens.join(common, "t").groupBy("k", "n").agg(F.collect_list("t").alias("p"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, int]] = []
            column = batch.column(2)
            tok, off = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            for i, (k, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                t = np.sort(tok[off[i] : off[i + 1]])
                if n <= -(-TINY * den // num):
                    out.append((mix(t, 17), k))
                if n > TINY:
                    for c in _classes(n, num, den):
                        x, y = _same_group((mix(t, 19) % np.uint64(_class_shared(c) - 1)).astype(np.int64))
                        out.append((mix(mix(t[x], 23) + t[y] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c), 29), k))
            if out:
                size = [len(o[0]) for o in out]
                yield pa.record_batch({"t": pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), "k": pa.array(np.repeat([o[1] for o in out], size))})

    out = materialize(shared.select("k", "n", "p").mapInArrow(keys, "t long, k long"), "keys")
    discard(common)
    return out


def _same_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (x before y) of places with the same group."""
    by = np.argsort(group, kind="stable")
    g = group[by]
    end = np.searchsorted(g, g, "right")
    later = end - np.arange(len(g)) - 1  # members of the group after each
    first = np.repeat(np.arange(len(g)), later)
    step = np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later) + 1
    return by[first], by[first + step]


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit; the number of bits is a power of two, about 8 for a token."""
    bits = min(max(SKETCH[0], 8 << max(len(s) - 1, 0).bit_length()), SKETCH[1])
    flips = np.bincount((mix(s, 31) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _fold(words_: np.ndarray, size: int) -> np.ndarray:
    """Sketches of size words from longer ones."""
    while words_.shape[-1] > size:
        half = words_.shape[-1] // 2
        words_ = words_[..., :half] ^ words_[..., half:]
    return words_


def _slack(x: list[np.ndarray], nx: np.ndarray, y: list[np.ndarray], ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """(len(x), len(y)) of what sketches of sets of nx and ny tokens leave of the difference that a link allows; negative: no link."""
    out = np.full((len(x), len(y)), -1, np.int64)
    wx, wy = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    for a in np.unique(wx):
        for b in np.unique(wy):
            i, j, size = np.flatnonzero(wx == a), np.flatnonzero(wy == b), min(a, b)
            u, v = _fold(np.stack([x[k] for k in i]), size), _fold(np.stack([y[k] for k in j]), size)
            if len(i) * len(j) * size <= 1 << 18:
                d = np.bitwise_count(u[:, None] ^ v[None]).sum(2, dtype=np.int64)
            else:
                d = np.zeros((len(i), len(j)), np.int64)
                for w in range(size):
                    d += np.bitwise_count(u[:, w, None] ^ v[None, :, w])
            n, m = nx[i][:, None], ny[j][None, :]
            fits = np.minimum(n, m) * den >= np.maximum(n, m) * num
            out[np.ix_(i, j)] = np.where(fits, (n + m) * (den - num) - d * (den + num), -1)
    return out


class _Links:
    """Verified links from candidates, round by round."""

    def __init__(self, sets: DataFrame, num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.labels: DataFrame | None = None
        self.tested: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) of pairs(k1, k2): order filters B and C on their prefixes, then the exact test on full sets."""
        num, den = self.num, self.den

        @F.pandas_udf("boolean")
        def linked(s1: pd.Series, s2: pd.Series, b1: pd.Series, b2: pd.Series, c1: pd.Series, c2: pd.Series) -> pd.Series:
            out = np.zeros(len(s1), bool)
            for i, found in enumerate(zip(s1, s2, b1, b2, c1, c2)):
                x, y, *sig = (np.frombuffer(f, np.uint64) for f in found)
                l = min(SHARED, _need(len(x), num, den), _need(len(y), num, den))
                if len(np.intersect1d(sig[0], sig[1], True)) >= l and len(np.intersect1d(sig[2], sig[3], True)) >= l:
                    both = len(np.intersect1d(x, y, True))
                    out[i] = both > 0 and den * both >= num * (len(x) + len(y) - both)
            return pd.Series(out)

        side = lambda i: self.sets.select(F.col("key").alias(f"k{i}"), *(F.col(c).alias(f"{c}{i}") for c in "sbc"))
        return pairs.select("k1", "k2").join(side(1), "k1").join(side(2), "k2").where(linked("s1", "s2", "b1", "b2", "c1", "c2")).select(F.col("k1").alias("a"), F.col("k2").alias("b"))

    def close(self, rows: DataFrame, i: str) -> DataFrame:
        """rows with the component c of column k."""
        label = F.col(i).alias("c") if self.labels is None else F.coalesce("component", i).alias("c")
        return (rows if self.labels is None else rows.join(self.labels.withColumnRenamed("id", i), i, "left")).select(*rows.columns, label)

    def test(self, offers: DataFrame) -> tuple[int, int, int]:
        """Verify distinct pairs. How many there are, how many of them were not tested before, and how many of those are links."""
        offers = materialize(offers, "offers")
        fresh, n = offers, offers.count()
        if not n:
            discard(offers)
            return 0, 0, 0
        if self.tested is not None:
            fresh = materialize(offers.join(self.tested, ["k1", "k2"], "left_anti"), "fresh")
            discard(offers)
        last, self.tested = self.tested, materialize(fresh if self.tested is None else self.tested.union(fresh), "tested")
        if last is not None:
            discard(last)
        found = materialize(self.verified(fresh), "links")
        linked = found.count()
        if linked:
            self.labels = merge_components(self.labels, found)
        tried = fresh.count()
        discard(found, fresh)
        return n, tried, linked


def _ordered(df: DataFrame) -> DataFrame:
    """Distinct pairs (k1, k2), the smaller first."""
    return df.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()


def _small_pairs(keys: DataFrame, lists: DataFrame) -> DataFrame:
    """Distinct pairs of the members of lists with up to SMALL members."""
    two = lists.where("size = 2").select(F.col("lo").alias("k1"), F.col("hi").alias("k2")).distinct()
    few = keys.join(lists.where(F.col("size").between(3, SMALL)).select("t"), "t")
    few = few.groupBy("t").agg(F.collect_list("k").alias("m"))
    few = few.select("m", F.explode("m").alias("k1")).select("k1", F.explode("m").alias("k2")).where("k1 < k2")
    return two.union(few).distinct()


def _sketched(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(k1, k2, slack) of the pairs that their sketches don't rule out."""

    @F.pandas_udf("long")
    def slack(n1: pd.Series, n2: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        out = np.full(len(n1), -1, np.int64)
        for i, (n, m, x, y) in enumerate(zip(n1, n2, d1, d2)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(n, m) * den >= max(n, m) * num:
                size = min(len(x), len(y))
                out[i] = (n + m) * (den - num) - int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) * (den + num)
        return pd.Series(out)

    side = lambda i: sets.select(F.col("key").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.col("d").alias(f"d{i}"))
    out = pairs.join(side(1), "k1").join(side(2), "k2").select("k1", "k2", slack("n1", "n2", "d1", "d2").alias("slack"))
    return out.where("slack >= 0")


def _block_offers(rows: DataFrame, num: int, den: int, seed: int | None, every: bool) -> DataFrame:
    """Distinct candidate pairs of different components in the lists of rows(t, k, c, n, d, size).

    Each row offers its closest candidate (seed: a random one), or with every all of them.
    """
    met = rows.withColumn("blocks", F.ceil(F.col("size") / ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), "own", "k", "c", "n", "d")
    met = met.repartition("t", "pair").sortWithinPartitions("t", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["t", "pair"]):
            own, k, c, n = (t[x].to_numpy() for x in ("own", "k", "c", "n"))
            d = [np.frombuffer(x, np.uint64) for x in t["d"].to_pylist()]
            one = np.flatnonzero(own == own.min())
            two = np.flatnonzero(own != own.min()) if own.min() != own.max() else one
            for i in (one[a : a + ROWS] for a in range(0, len(one), ROWS)):
                for j in (two[a : a + ROWS] for a in range(0, len(two), ROWS)):
                    left = _slack([d[x] for x in i], n[i], [d[x] for x in j], n[j], num, den)
                    left[c[i][:, None] == c[j][None, :]] = -1
                    if every:
                        x, y = np.nonzero(left >= 0)
                    else:
                        worth = left if seed is None else np.where(left >= 0, (mix(k[i].view(np.uint64)[:, None] ^ k[j].view(np.uint64)[None, :], seed) >> np.uint64(2)).astype(np.int64), -1)
                        best, back = worth.argmax(1), worth.argmax(0)
                        x = np.concatenate([np.arange(len(i)), back])
                        y = np.concatenate([best, np.arange(len(j))])
                        x, y = x[left[x, y] >= 0], y[left[x, y] >= 0]
                    if len(x):
                        a, b = k[i][x], k[j][y]
                        u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                        yield pa.record_batch({"k1": pa.array(u[0]), "k2": pa.array(u[1])})

    return met.mapInArrow(compare, "k1 long, k2 long").distinct()


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

    Two documents link when den * intersection >= num * union of their k-word shingle sets
    (words: runs of bytes other than SEPARATORS, A-Z lower-cased; fewer than k words: all of
    them are the one shingle). component_id is the smallest doc_id reachable by links.

    Defined cases: a null or empty text, or one of separators only, has an empty set and
    links with nothing (component_id = doc_id). A null doc_id keeps its row and gets a null
    component. Repeated rows give repeated rows. Other columns are ignored, whatever their
    names. Shingles are compared by 64-bit hashes.
    """
    tune(docs.sparkSession)
    feats = materialize(set_features(docs.select("doc_id", "text"), k, num, den), "features")
    full = feats.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("key").agg(F.min("doc_id").alias("rep")), "sets")

    # One row per distinct set: the prefix of its representative.
    owners = full.join(reps.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
    keys = index_keys(owners.select("key", "n", "a"), num, den)
    # Keys whose lists have the same members (equal in number, least, largest and two sums of hashes) are one.
    lists = keys.groupBy("t").agg(F.count("*").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"))
    lists = materialize(lists.where("lo <> hi").groupBy("size", "lo", "hi", "x", "y").agg(F.min("t").alias("t")), "lists")
    pairs = materialize(_small_pairs(keys, lists), "pairs")
    long = materialize(keys.join(lists.where(F.col("size") > SMALL).select("t", "size"), "t"), "long")
    discard(keys, lists)
    wanted = materialize(pairs.select(F.col("k1").alias("key")).union(pairs.select("k2")).union(long.select("k")).distinct(), "wanted")
    sets = _full_sets(docs, reps, wanted, k, num, den)
    small = materialize(_sketched(pairs, sets, num, den), "near")
    discard(pairs, wanted)

    links, seed = _Links(sets, num, den), None
    sketches = sets.select(F.col("key").alias("k"), "n", "d")
    while True:
        a = links.close(links.close(small, "k1").withColumnRenamed("c", "c1"), "k2").where("c1 <> c")
        worth = F.col("slack") if seed is None else F.xxhash64("k1", "k2", F.lit(seed))
        ends = a.select("k1", "k2", worth.alias("worth"), F.explode(F.array("k1", "k2")).alias("k"))
        offers = ends.groupBy("k").agg(F.max(F.struct("worth", "k1", "k2")).alias("b")).select("b.k1", "b.k2")
        open_ = links.close(long, "k")
        mixed = open_.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t")
        last, long = long, materialize(open_.join(mixed, "t").select(*long.columns), "long")
        discard(last)
        rows = links.close(long, "k").join(sketches, "k")
        offered, tried, linked = links.test(_ordered(offers.union(_block_offers(rows, num, den, seed, False))))
        if 2 * linked <= tried:
            break
        seed = 101 if seed is None else seed + 1
    if offered:
        # What is left between components: few rows, and almost all of them false ones.
        a = links.close(links.close(small, "k1").withColumnRenamed("c", "c1"), "k2").where("c1 <> c")
        rows = links.close(long, "k").join(sketches, "k")
        links.test(_ordered(a.select("k1", "k2").union(_block_offers(rows, num, den, None, True))))
    comp = links.labels if links.labels is not None else reps.select(F.col("key").alias("id"), F.col("key").alias("component")).limit(0)

    # From components of sets to components of documents: the smallest doc_id of all its sets.
    named = reps.join(comp.select(F.col("id").alias("key"), "component"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "component").select("key", "component_id"), "named")
    discard(reps, sets, small, long, *(t for t in (links.tested, links.labels) if t is not None))
    out = feats.select("doc_id", "n", "key").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITMAP bits, those of the ids' hashes set: 4 MB on the driver whatever the number of ids."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)) + 1  # buckets and positions are those of h - 1
    rows = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = np.zeros((BITMAP >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(bytes(r.m), np.uint8)
    return out.reshape(-1)


def _full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, n, s, b, c, d) of each wanted set, from its representative's text: its sorted shingles, its prefixes in orders B and C, its sketch."""
    ids = materialize(reps.join(wanted, "key", "left_semi").select(F.col("rep").alias("doc_id")), "ids")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((bitmap.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            found = list(_sets(batch.column(2), k)) if batch.num_rows else []
            size = [len(s) - _need(len(s), num, den) + min(SHARED, _need(len(s), num, den)) for s in found]
            order = lambda seed: [np.sort(_prefix(mix(s, seed), s, p)).tobytes() for s, p in zip(found, size)]
            yield pa.record_batch({
                "doc_id": batch.column(0).cast(pa.int64()), "key": pa.array([_set_key(s) for s in found], pa.int64()), "n": pa.array(map(len, found), pa.int64()), "s": pa.array([s.tobytes() for s in found], pa.binary()),
                "b": pa.array(order(2), pa.binary()), "c": pa.array(order(3), pa.binary()), "d": pa.array([_sketch(s) for s in found], pa.binary()),
            })

    texts = docs.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("h"), "text")
    found = texts.mapInArrow(read, "doc_id long, key long, n long, s binary, b binary, c binary, d binary")
    # The bitmap lets others through, and a doc_id may repeat with other texts: nobody asked for their sets.
    pairs = reps.join(wanted, "key", "left_semi").select("key", F.col("rep").alias("doc_id"))
    out = materialize(found.join(pairs, ["key", "doc_id"], "left_semi").dropDuplicates(["key", "doc_id"]).drop("doc_id"), "full")
    discard(ids)
    return out
