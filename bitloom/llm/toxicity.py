"""Toxic passages by maximum-scoring segments over token log-odds.

Fit. A bounded sample of labelled documents gives, for every word and for its first seven
to four bytes, the number of documents of either class that hold it. Log-odds are
smoothed by a Dirichlet prior whose mean is the class split of the next shorter prefix (the
shortest: even odds), so an unseen form takes the evidence of its stem. Values of less than
Z standard errors count as 0.

Score. Each token scores its log-odds less a drift. The linear scan of Ruzzo and Tompa finds
all maximal segments; only positive tokens are looped over, the drift between them is one
sum. Segment scores of clean documents follow an extreme-value law, P(S >= x) = 1 -
exp(-K n exp(-lambda x)), fitted on clean labelled documents; a segment is significant where
its E-value K n exp(-lambda S) is under E_MAX. The evidence of a document, the sum of
-log(E) over its significant segments, becomes a probability by a logistic fit. Both fits see
each document scored by log-odds of the other FOLDS - 1 parts of the sample, never by its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.llm.common import byte_classes, slices, string_buffers, tune, words, mix, _powers
from bitloom.session import materialize

#: Bound on the labelled documents that the classifier is fitted on.
MAX_SAMPLE = 20_000
#: Pseudo-documents of the Dirichlet prior, standard errors that log-odds need, drift per token, largest E-value of a passage.
PRIOR, Z, DRIFT, E_MAX = 3.0, 3.0, 0.1, 0.05
STEMS = (7, 6, 5, 4)
FOLDS = 4

# Words: ASCII letters and digits and all bytes of longer UTF-8 sequences.
_CLASSES = byte_classes(b"", only=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_SCHEMA = "doc_id long, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>"


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of its stems, word starts and ends, first word of each document."""
    h, s, e, first = words(data, offsets, *_CLASSES)
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CLASSES[0][data[base : base + n]] * up[:n], out=total[1:])
    out = [h]
    for k in STEMS:
        to = np.minimum(s + k, e)
        out.append(mix((total[to] - total[s]) * down[s], 100 + k))
    return out, s, e, first


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, by Ruzzo and Tompa's linear scan."""
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    run = np.concatenate([[0.0], np.cumsum(score)])
    before, after = run[at], run[at + 1]
    stack: list[list] = []  # first, last + 1, sum before, sum after, stack index of the nearest segment with a smaller sum before
    for i, l, r in zip(at.tolist(), before.tolist(), after.tolist()):
        seg = [i, i + 1, l, r]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append([*seg, j])
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class ToxicityModel:
    keys: np.ndarray
    values: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    offset: float = -2.0

    def token_scores(self, feats: list[np.ndarray]) -> np.ndarray:
        """Log-odds of the longest known form of each word."""
        out = np.zeros(len(feats[0]))
        todo = np.arange(len(out))
        if not len(self.keys):
            return out
        for h in feats:
            x = h[todo]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            hit = self.keys[at] == x
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def e_value(self, s: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-min(self.rate * s, 700.0))

    def probability(self, evidence: float) -> float:
        z = self.slope * math.log1p(max(evidence, 0.0)) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def documents(self, column: pa.Array) -> Iterator[tuple[int, float, list[tuple[int, int, float]]]]:
        """(tokens, best segment score, segments with byte offsets) of each text."""
        data, offsets = string_buffers(column)
        for i, j in slices(offsets):
            feats, s, e, first = _features(data, offsets[i : j + 1])
            score = self.token_scores(feats) - DRIFT
            for d in range(j - i):
                a, b = int(first[d]), int(first[d + 1])
                begin = int(offsets[i + d] - offsets[i])
                found = [(int(s[a + x]) - begin, int(e[a + y - 1]) - begin, v) for x, y, v in segments(score[a:b])]
                yield b - a, max((v for *_, v in found), default=0.0), found

    def judge(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability and significant segments (start, end, score, E-value)."""
        kept = [(a, b, v, x) for a, b, v in found if (x := self.e_value(v, n)) < E_MAX]
        return self.probability(self.evidence([x for *_, x in kept])), kept

    @staticmethod
    def evidence(e_values: list[float]) -> float:
        return sum(-math.log(max(x, 1e-300)) for x in e_values)


def _sampled(docs: DataFrame, labels: DataFrame, max_sample: int) -> DataFrame:
    """(doc_id, text, toxic) of at most max_sample labelled documents, equal texts once; the sample's order is a hash of doc_id."""
    few = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    )
    few = materialize(few, "sample")
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Of equal texts that of the smallest doc_id, so that the model is the same in each run.
    one = found.groupBy("h").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("d"))
    return materialize(one.select("d.doc_id", "d.text", "d.toxic"), "labelled")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> ToxicityModel:
    """Fit on docs(doc_id, text) with labels(doc_id, toxic).

    At most max_sample labelled documents are used (all of them if there are fewer); null
    labels and ids are left out, of repeated labels the largest counts. Without labels of
    both classes nothing is toxic.
    """
    tune(docs.sparkSession)
    sample = _sampled(docs, labels, max_sample).select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = 2 * batch.column(2).to_numpy() + batch.column(1).to_numpy()
            data, offsets = string_buffers(batch.column(0))
            for i, j in slices(offsets):
                feats, _, _, first = _features(data, offsets[i : j + 1])
                rows = []
                for d in range(j - i):
                    a, b = first[d], first[d + 1]
                    _, at = np.unique(feats[0][a:b], return_index=True)
                    own = [f[a:b][at] for f in feats]
                    for level, f in enumerate(own):
                        u, x = np.unique(f, return_index=True)
                        parent = own[level + 1][x] if level < len(STEMS) else np.zeros(len(u), np.uint64)
                        rows.append((np.full(len(u), level), u, parent, np.full(len(u), label[i + d])))
                if not rows:
                    continue
                level, u, parent, t = (np.concatenate(x) for x in zip(*rows))
                order = np.lexsort((level, u))
                level, u, parent, t = level[order], u[order], parent[order], t[order]
                new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (level[1:] != level[:-1])])[: len(u)])
                cells = {f"y{k % 2}_{k // 2}": pa.array(np.add.reduceat((t == k).astype(np.int64), new)) for k in range(2 * FOLDS)}
                yield pa.record_batch({"level": pa.array(level[new], pa.int32()), "h": pa.array(u[new].astype(np.int64)), "parent": pa.array(parent[new].astype(np.int64)), **cells})

    names = [f"y{k % 2}_{k // 2}" for k in range(2 * FOLDS)]
    counts = sample.mapInArrow(count, "level int, h long, parent long, " + ", ".join(f"{c} long" for c in names))
    counts = counts.groupBy("level", "h").agg(F.min("parent").alias("parent"), *(F.sum(c).alias(c) for c in names))
    # The largest log-odds that fewer documents could reach is under Z standard errors.
    counts = counts.where(" + ".join(names) + " >= 3").select(F.col("level").cast("byte").alias("level"), "h", "parent", *(F.col(c).cast("int").alias(c) for c in names))
    table = counts.toArrow()
    held = {c: table[c].to_numpy() for c in table.column_names}
    del table
    size = {(r.fold, r.toxic): float(r.n) for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    every = range(FOLDS)
    model = _log_odds(held, size, every)
    if len({c for _, c in size}) < 2:
        return model
    _calibrate(model, [_log_odds(held, size, [f for f in every if f != out]) for out in every], sample)
    return model


def _log_odds(counts: dict[str, np.ndarray], size: dict[tuple[int, int], float], folds) -> ToxicityModel:
    """Log-odds from the counts of some folds; no keys unless they hold both classes.

    Only forms that tell the classes apart are keys: any other has log-odds 0, and so have all its stems.
    """
    n1, n0 = (sum(size.get((f, c), 0.0) for f in folds) for c in (1, 0))
    if not n1 or not n0:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    n = 2 / (1 / n1 + 1 / n0)
    ones, zeros = (sum(counts[f"y{c}_{f}"] for f in folds) for c in (1, 0))
    stems, shares = np.zeros(0, np.int64), np.zeros(0)  # told forms of the level before, sorted
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for level in range(len(STEMS), -1, -1):
        here = np.flatnonzero((counts["level"] == level) & (ones + zeros >= 3))
        h, y1, y0, parent = counts["h"][here], ones[here].astype(float), zeros[here].astype(float), counts["parent"][here]
        prior = np.full(len(h), 0.5)
        if len(stems):
            at = np.minimum(np.searchsorted(stems, parent), len(stems) - 1)
            prior = np.where(stems[at] == parent, shares[at], 0.5)
        a, b = y1 / n1 + PRIOR * prior / n, y0 / n0 + PRIOR * (1 - prior) / n
        odds = np.log(a / b)
        error = np.sqrt(1 / (y1 + PRIOR / 2) + 1 / (y0 + PRIOR / 2))
        # A form whose stem tells the classes apart inherits that by its prior; others need evidence of their own.
        told = np.flatnonzero((np.abs(odds) >= Z * error) | (prior != 0.5))
        told = told[np.argsort(h[told])]
        stems, shares = h[told], np.clip(a / (a + b), 0.02, 0.98)[told]
        keys.append(stems.view(np.uint64))
        values.append(odds[told])
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k, kind="stable")
    return ToxicityModel(k[order], v[order])


def _calibrate(model: ToxicityModel, others: list[ToxicityModel], sample: DataFrame) -> None:
    """Fit the extreme-value law on clean documents of the sample, then the logistic on all of them; others[fold] has not seen that fold."""
    held = sample.sparkSession.sparkContext.broadcast(others)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for f in np.unique(fold):
                part = batch.filter(pa.array(fold == f))
                rows = list(held.value[f].documents(part.column(0)))
                yield pa.record_batch({"toxic": part.column(1).cast(pa.int32()), "n": pa.array([r[0] for r in rows], pa.int64()), "best": pa.array([r[1] for r in rows], pa.float64()), "all": pa.array([[v for *_, v in r[2]] for r in rows], pa.list_(pa.float64()))})

    pdf = sample.mapInArrow(measure, "toxic int, n long, best double, all array<double>").toPandas()
    y = pdf["toxic"].to_numpy() == 1
    n, s = np.maximum(pdf["n"].to_numpy(float), 1), pdf["best"].to_numpy(float)
    clean_n, clean_s = n[~y], s[~y]
    if not len(clean_n):
        return

    def likelihood(rate: float) -> float:
        k = 1 / np.mean(clean_n * np.exp(-rate * clean_s))
        return float(np.sum(np.log(rate * k * clean_n) - rate * clean_s - k * clean_n * np.exp(-rate * clean_s)))

    model.rate = float(max(np.geomspace(0.2, 3.0, 60), key=likelihood))
    model.k = float(1 / np.mean(clean_n * np.exp(-model.rate * clean_s)))
    x = np.log1p([model.evidence([e for v in vs if (e := model.e_value(v, m)) < E_MAX]) for m, vs in zip(n, pdf["all"])])
    # Newton steps on the smoothed targets of Platt, with a small ridge.
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    t, w = np.where(y, hi, lo), np.array([1.0, -2.0])
    m = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), m.T @ (t - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(max(w[0], 1e-3)), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, passages) for each row of docs(doc_id, text, ...).

    score is the probability (0 to 1) that the text is toxic; passages holds every
    significant segment with code-point offsets, end exclusive, in order. A null or empty
    text scores as one without evidence. Repeated rows score alike, a null doc_id stays
    null, other columns are ignored.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out, passages = [], []
            for i, (n, _, found) in enumerate(m.documents(batch.column(1))):
                p, kept = m.judge(n, found)
                out.append(p)
                if kept:
                    raw = batch.column(1)[i].as_py().encode()
                    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    kept = [{"start": int(lead[a]), "end": int(lead[b]), "score": v, "e_value": x} for a, b, v, x in kept]
                passages.append(kept)
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(out, pa.float64()), "passages": pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])))})

    return docs.select("doc_id", "text").mapInArrow(score, _SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under threshold."""
    held = tune(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = held.value
            yield batch.filter(pa.array([m.judge(n, found)[0] < threshold for n, _, found in m.documents(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id's text leaves 1 when divided by 3; such rows never train."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
