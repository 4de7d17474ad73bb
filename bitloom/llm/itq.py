"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Fit. A bounded sample gives the mean and the principal axes of the unit vectors; for each
of several seeds an orthogonal rotation is learned that moves the centred coordinates towards
+-1 (iterative quantisation), so the signs make balanced binary codes.

Retrieve. Each code is cut into chunks, and each chunk is a table: vectors with the same
label and chunk are candidates. The width of a chunk and the number of tables are chosen on
the sample: partners at exactly the threshold, off in random directions and off towards other
vectors of the sample, must miss all tables with a probability under MISS. Wide chunks
come first, since they make few candidates.

Rerank. Candidates are compared by cosine of the original vectors in double precision. A
pair is counted in the first table that has it. Equal vectors are one entry with a weight.
Large buckets are cut into blocks, and every pair of blocks is a task of its own of at most
2 * BLOCK rows; only link counts and spanning links leave it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bitloom.llm.common import tune
from bitloom.llm.graph import components
from bitloom.session import materialize

#: Bound on the vectors that rotations are learned from; iterations, rows of a block.
MAX_SAMPLE, ITERATIONS, BLOCK = 20_000, 30, 1024
#: Bits of a table's key in the order they are tried, most tables, chance to miss a pair at the threshold, sampled pairs.
WIDTHS, MAX_TABLES, MISS, PROBES = (16, 14, 12, 10, 8, 6, 4), 32, 0.002, 2_000


@dataclass
class ItqModel:
    """The mean, and matrices (dimension, bits) whose product with a centred vector has the signs of one table's key."""

    mean: np.ndarray
    matrices: list[np.ndarray]

    @property
    def tables(self) -> int:
        return len(self.matrices)

    def chunks(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) of keys of vectors of unit length."""
        x = x - self.mean
        return np.stack([((x @ m) >= 0) @ (1 << np.arange(m.shape[1])) for m in self.matrices], 1).astype(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, whatever their scale."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rotated(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def _partners(x: np.ndarray, num: float, rng: np.random.Generator) -> np.ndarray:
    """For each row one at cosine num: half of them off in a random direction, half towards another row."""
    off = rng.normal(size=x.shape)
    half = len(x) // 2
    off[:half] = x[rng.permutation(len(x))[:half]] - x[:half] if half else off[:half]
    off -= (off * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(off, axis=1, keepdims=True)
    size[size == 0] = 1
    return num * x + np.sqrt(max(0.0, 1 - num * num)) * off / size


def learn(x: np.ndarray, num: float = 0.98, max_bits: int = 64, seed: int = 5) -> ItqModel:
    """From rows of unit length."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    bits = min(x.shape[1], max_bits)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    probes = x[rng.permutation(len(x))[:PROBES]]
    mates = _partners(probes, num, rng)
    rotations: list[np.ndarray] = []
    for width in WIDTHS:
        cuts = [(r, at) for r in range(MAX_TABLES) for at in range(0, max(bits - width, 0) + 1, width)][:MAX_TABLES]
        missed, matrices = np.ones(len(probes), bool), []
        for r, at in cuts:
            if r == len(rotations):
                rotations.append(axes @ _rotated(v, rng))
            matrices.append(rotations[r][:, at : at + width])
            m = ItqModel(mean, matrices[-1:])
            missed &= (m.chunks(probes) != m.chunks(mates))[:, 0]
            if missed.mean() < MISS:
                # As many tables again by half: the sample shows no smaller chance, and real pairs may be harder.
                more = cuts[len(matrices) : len(matrices) + -(-len(matrices) // 2)]
                for q, p in more:
                    if q == len(rotations):
                        rotations.append(axes @ _rotated(v, rng))
                    matrices.append(rotations[q][:, p : p + width])
                return ItqModel(mean, matrices)
    return ItqModel(mean, [*matrices, np.zeros((x.shape[1], 1))])  # all vectors of a label meet


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *new.tolist(), t.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def embedding_components(vectors: DataFrame, num: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label, ...).

    Rows with equal labels link when the cosine of their embeddings is num or more. n_links
    counts the other rows linked directly (copies too), component_id is the smallest vec_id
    reachable by links, kept is vec_id = component_id.

    A row links with nothing, and is its own component, if its label, id or embedding is
    null, or its embedding is zero, holds a null or non-finite component or has another
    length than most. Rows are vectors of their own also where ids repeat: rows of one id link
    with each other as any others do, and each row has its own links. An empty table gives none. Other columns are ignored.
    """
    spark = tune(vectors.sparkSession)
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    base = vectors.select("vec_id", "label", "embedding", F.size("embedding").alias("d"), F.coalesce(fine, F.lit(False)).alias("fine"))
    sizes = base.where("fine").groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    plus = F.transform(e, lambda v: v + F.lit(0.0).cast("float"))  # -0.0 as 0.0
    base = base.select("vec_id", "label", "embedding", (F.col("fine") & (F.col("d") == d)).alias("fine"), F.xxhash64(plus).alias("k1"), F.xxhash64(plus, F.lit(1)).alias("k2"))
    if not sizes:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    # A node is a distinct vector of a label: the smallest of its ids, then a hash of label and vector.
    copies = ["label", "k1", "k2"]
    reps = base.where("fine").groupBy(*copies).agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count("*").alias("w"))
    reps = reps.select(*copies, F.col("m.vec_id").alias("rep"), F.xxhash64(*copies).alias("node"), F.col("m.embedding").alias("embedding"), "w")

    sample = base.where("fine").select("k1", "embedding").orderBy("k1").limit(MAX_SAMPLE).toPandas()
    model = spark.sparkContext.broadcast(learn(unit(np.stack(sample["embedding"].map(lambda v: np.asarray(v, np.float64)))), num))
    n_tables = model.value.tables

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = model.value.chunks(unit(_matrix(b.column(b.schema.get_field_index("embedding")), d)))
                yield b.append_column("codes", pa.array(list(c), pa.list_(pa.int32())))

    schema = T.StructType([*reps.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
    coded = materialize(reps.mapInArrow(code, schema), "codes")
    keys = coded.select("label", "rep", "node", F.posexplode("codes").alias("table", "code"))
    crowd = keys.groupBy("label", "table", "code").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(crowd, ["label", "table", "code"])
    # A bucket of n rows has ceil(n / BLOCK) blocks; a row goes to each pair of blocks with its own.
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "table", "code", "rep", "node", "own", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"))
    rows = met.join(coded.select("rep", "node", "embedding", "w", "codes"), ["rep", "node"])
    # Labels of any type make runs by their hash.
    rows = rows.withColumn("lab", F.xxhash64("label")).drop("label")
    names = ["lab", "table", "code", "pair"]
    rows = rows.repartition(*names).sortWithinPartitions(*names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, names):
            v = _matrix(t["embedding"], d)
            norm = np.sqrt((v * v).sum(1))
            cos = (v @ v.T) / (norm[:, None] * norm[None, :])
            own = t["own"].to_numpy()
            # A pair of two blocks holds only their cross pairs; a block with itself all of its own.
            two = own.min() != own.max()
            hit = np.triu(cos >= num, 1)
            if two:
                hit &= own[:, None] != own[None, :]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            codes = _matrix(t["codes"], n_tables).astype(np.int32)
            table = int(t["table"][0].as_py())
            fresh = ~(codes[i, :table] == codes[j, :table]).any(1)
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            w, rep, node = t["w"].to_numpy(), t["rep"].to_numpy(), t["node"].to_numpy()
            links = np.bincount(i, w[j], len(rep)) + np.bincount(j, w[i], len(rep))
            some = np.flatnonzero(links)
            top = list(range(len(rep)))

            def root(k: int) -> int:
                while top[k] != k:
                    top[k] = top[top[k]]
                    k = top[k]
                return k

            span = []
            for p, q in zip(i.tolist(), j.tolist()):
                rp, rq = root(p), root(q)
                if rp != rq:
                    top[max(rp, rq)] = min(rp, rq)
                    span.append((p, q))
            a, b = np.array([*zip(some, some), *span], np.int64).T
            n = np.concatenate([links[some].astype(np.int64), np.zeros(len(span), np.int64)])
            yield pa.record_batch({"a": rep[a], "an": node[a], "b": rep[b], "bn": node[b], "n": n, "link": n == 0})

    met = materialize(rows.mapInArrow(compare, "a long, an long, b long, bn long, n long, link boolean"), "links")
    counts = met.where("not link").groupBy(F.col("a").alias("rep"), F.col("an").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(met.where("link").select(F.struct(F.col("a").alias("rep"), F.col("an").alias("node")).alias("a"), F.struct(F.col("b").alias("rep"), F.col("bn").alias("node")).alias("b")))
    comp = comp.select(F.col("id.rep").alias("rep"), F.col("id.node").alias("node"), F.col("component.rep").alias("component"))
    named = coded.select(*copies, "rep", "node", "w").join(counts, ["rep", "node"], "left").join(comp, ["rep", "node"], "left")
    named = named.select(*copies, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.where("fine").join(named, copies).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"))
    alone = base.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
