"""Byte-level BPE encoding and decoding.

Encoding. Pre-tokens of all documents are counted, and the most frequent ones (at most
MAX_WORDS distinct words of at most MAX_BYTES bytes, so a bounded table) are encoded by Spark
higher-order functions: a fold over the byte array of each word looks up pair ranks in a
literal rank map, merges the pair of the lowest rank and updates the two pairs beside it.
That table seeds the dictionary of every task; words outside of it, the rare tail, are
merged on first sight in the task by the same rule, and remembered up to a bound. Texts
are never shuffled.

Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bitloom.llm.common import tune
from bitloom.session import materialize, release

#: Bounds on the shared table of distinct words, and on the words that a task remembers beside it.
MAX_WORDS, MAX_BYTES, MEMO = 200_000, 64, 100_000
#: Buckets of the literal rank map: a lookup in a map literal is a scan, so each bucket is a small map.
BUCKETS = 1 << 14
NO_RANK = 2**31 - 1

#: Characters for which the standard library's classes equal those of the pattern (Latin letters, ASCII, common punctuation).
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027]")
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Tokenizer:
    """Ranks by bytes, and the pattern of the pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    @staticmethod
    def load(path: str, pattern: str) -> "Tokenizer":
        """From a file of lines "base64 rank" on the driver."""
        with open(path, "rb") as f:
            return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


class Splitter:
    """Pre-tokens of a text; the faster engine takes the texts for which both agree."""

    def __init__(self, pattern: str):
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.exact = regex.compile(exact)
        fast = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast = None if r"\p" in fast else re.compile(fast)

    def __call__(self, text: str) -> list[str]:
        if self.fast is not None and not _OTHER.search(text):
            return self.fast.findall(text)
        return [m.group() for m in self.exact.finditer(text)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of the lowest rank, the leftmost of equals, until none is left. n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[p], i, 2) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] - i != size:
            continue
        j = end[i]
        alive[j] = False
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
            if (r := ranks.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]] - i))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k : end[i]])) is not None:
            heapq.heappush(heap, (r, k, end[i] - k))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: the ids of a pre-token, by a fold of ranked merges over its byte array."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for k, v in ranks.items():
        maps[zlib.crc32(k) % BUCKETS][k.hex().upper()] = v
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    none = F.array().cast("array<int>")
    b = F.encode(word, "UTF-8")
    n = F.octet_length(b)

    def ids(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            found = F.try_element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), F.hex(piece))
            return F.coalesce(found, F.lit(NO_RANK))

        def merged(s: Column) -> Column:
            i, p, r, new = s["i"], s["p"], s["r"], s["new"]
            left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(none)
            right = F.when(i < F.size(r), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r))).alias("r"),
            )

        def step(s: Column, _: Column) -> Column:
            least = F.array_min(s["r"])
            i = F.array_position(s["r"], least).cast("int")
            at = F.struct(i.alias("i"), s["p"].alias("p"), s["r"].alias("r"), F.concat(F.get(s["p"], i - 1), F.get(s["p"], i)).alias("new"))
            return F.when(F.coalesce(least, F.lit(NO_RANK)) == NO_RANK, s).otherwise(F.get(F.transform(F.array(at), merged), F.lit(0)))

        pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(b, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(b, i, F.lit(2))))).otherwise(none)
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.struct(pieces.alias("p"), pairs.alias("r")), step, lambda s: F.transform(s["p"], rank))
        return F.when(rank(b) != NO_RANK, F.array(rank(b))).otherwise(folded)

    # The literal is bound once, as the variable of a one-element transform.
    return F.get(F.transform(F.array(table), ids), F.lit(0))


def word_table(docs: DataFrame, tokenizer: Tokenizer, max_words: int = MAX_WORDS) -> dict[str, bytes]:
    """The most frequent distinct pre-tokens of all documents with their ids (little-endian, 32 bits), at most max_words."""
    pattern = tokenizer.pattern.replace(r"\s", r"[\p{IsWhite_Space}]").replace(r"\S", r"[\P{IsWhite_Space}]").replace(r"[^[\p{IsWhite_Space}]", r"[^\p{IsWhite_Space}")
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("w"))
    counts = found.groupBy("w").agg(F.count("*").alias("n")).where(F.octet_length("w").between(1, MAX_BYTES)).where("n > 1")
    counts = materialize(counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "words")
    floor, held = None, 0
    for r in counts.groupBy("bin").agg(F.count("*").alias("m")).orderBy(F.desc("bin")).collect():  # 16 bins an octave: under 1,000 rows
        if held + r.m > max_words:
            break
        floor, held = r.bin, held + r.m
    if floor is None:
        return {}
    few = counts.where(F.col("bin") >= floor).select("w").repartition(64)
    # The rank map's literal would fill descriptions and events of this plan, which the driver keeps: only the first column is named there.
    spark, limits = docs.sparkSession, {"spark.sql.maxPlanStringLength": "4096", "spark.sql.debug.maxToStringFields": "1"}
    held_limits = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        found = few.select("w", fold_merges(F.col("w"), tokenizer.ranks).alias("ids")).toArrow()
    finally:
        for k, v in held_limits.items():
            spark.conf.set(k, v)
    release(spark)  # of the literal's copies in plans and tasks
    ids, ends = found["ids"].combine_chunks(), found["w"].to_pylist()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks)
    data, off = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return {w: data[off[i] : off[i + 1]].tobytes() for i, w in enumerate(ends)}


class _Words(dict):
    """Ids of pre-tokens met by a task: taken from the shared table, else merged. At most MEMO are remembered; a full memory begins anew."""

    def __init__(self, table: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__()
        self.table, self.ranks = table, ranks

    def __missing__(self, word: str) -> bytes:
        ids = self.table.get(word)
        if ids is None:
            ids = np.array(merge(word.encode(), self.ranks), "<u4").tobytes()
        if len(word) <= MAX_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def _encoded(docs: DataFrame, tokenizer: Tokenizer, schema: str, row, columns: list[str]) -> DataFrame:
    sc = tune(docs.sparkSession).sparkContext
    seed, held = sc.broadcast(word_table(docs, tokenizer)), sc.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = None, None
        for batch in batches:
            if words is None:
                words, split = _Words(seed.value, held.value.ranks), Splitter(held.value.pattern)
                pieces = {v: k for k, v in held.value.ranks.items()}
            out = [row(b"".join(map(words.__getitem__, split(t.as_py() or ""))), pieces) for t in batch.column(1)]
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(x) for x in zip(*out))] if out else None
            if arrays:
                yield pa.record_batch(arrays, names=["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs(doc_id, text, ...); ids are bytes, little-endian 32-bit ids in order.

    A null text is an empty one and has no ids. Repeated rows give repeated rows, a null
    doc_id stays null, other columns are ignored.
    """
    return _encoded(docs, tokenizer, "doc_id long, n_tokens long, ids binary", lambda ids, _: (len(ids) // 4, ids), ["n_tokens", "ids"])


def decode(ids: bytes, pieces: dict[int, bytes]) -> bytes:
    """The bytes of a text from its ids."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_documents(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, decoded) for each row of encoded(doc_id, ids): the concatenated pieces as bytes."""
    held = tune(encoded.sparkSession).sparkContext.broadcast({v: k for k, v in tokenizer.ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([decode(x.as_py() or b"", held.value) for x in batch.column(1)], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both in one pass over the texts."""

    def row(ids: bytes, pieces: dict[int, bytes]) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, pieces)).hexdigest()

    return _encoded(docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, ["n_tokens", "ids_sha256", "decoded_sha256"])
