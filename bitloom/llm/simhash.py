"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius. DataFrame functions only.

Terms are pairs of adjacent words; a term's weight is its frequency. Each term votes with
128 hash bits: 64 sums of two 32-bit lanes each, so one shift and one mask count two bits,
and the votes of a document never leave its task.

Search. A fingerprint has radius + 1 blocks. Two fingerprints within the radius agree in
one block at least, so every block's table (the fingerprint permuted to begin with that
block) is joined by equality; a pair is taken from the first block in which it agrees and
checked by counting bits. Equal fingerprints are one entry with a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from bitloom.session import materialize

BITS = 128
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF
NULL_ID = -(2**63)


def terms(text: Column) -> Column:
    """array<long>: hashes of the pairs of adjacent words; the last word pairs with nothing."""
    words = F.split(text, r"\s+")
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _votes() -> list[Column]:
    out = []
    for name, h in (("a", F.col("h")), ("b", F.xxhash64("h"))):
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"{name}{i}") for i in range(32)]
    return [*out, F.count("*").alias("n_terms")]


def _word(name: str) -> Column:
    """The 64 bits of one half: set where more than half of the terms vote for it."""
    bits = []
    for i in range(32):
        s = F.col(f"{name}{i}")
        bits.append(F.when(s.bitwiseAND(F.lit(_LOW)) * 2 > F.col("n_terms"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        high = (1 << (i + 32)) if i < 31 else -(1 << 63)
        bits.append(F.when(F.shiftrightunsigned(s, 32) * 2 > F.col("n_terms"), F.lit(high).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f1, f2) for each row; keys name the row and must be unique, text must not be null.

    All keys are grouped by, so the sums are a hash aggregate; if rows is partitioned by some
    of the keys no shuffle is added. An empty text has one empty term, so all empty texts have
    the same fingerprint.
    """
    out = rows.select(*keys, F.explode(terms(F.col(text))).alias("h")).groupBy(*keys).agg(*_votes())
    return out.select(*keys, _word("a").alias("f1"), _word("b").alias("f2"))


def text_form(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def likeness(a1, a2, b1, b2) -> Column:
    return 1 - (F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))) / F.lit(float(BITS))


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int = 3) -> DataFrame:
    """(q1, q2, f1, f2, n, distance): for each distinct query fingerprint all table entries within radius.

    queries(f1, f2) and table(f1, f2, n) hold distinct fingerprints. radius is 1 or 3, so
    that blocks are whole halves or quarters.
    """
    if radius not in (1, 3):
        raise ValueError("radius must be 1 or 3")
    width = BITS // (radius + 1)

    def blocks(a: str, b: str) -> list[Column]:
        mask = F.lit(_LOW if width == 32 else -1).cast("long")
        return [F.shiftrightunsigned(F.col(x), s).bitwiseAND(mask) for x in (a, b) for s in range(0, 64, width)]

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*blocks(a, b))).alias("block", "value"))

    pairs = tables(queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")), "q1", "q2").join(tables(table.select("f1", "f2", "n"), "f1", "f2"), ["block", "value"])
    first = F.coalesce(*(F.when(x == y, F.lit(i)) for i, (x, y) in enumerate(zip(blocks("q1", "q2"), blocks("f1", "f2")))))
    distance = F.bit_count(F.col("q1").bitwiseXOR(F.col("f1"))) + F.bit_count(F.col("q2").bitwiseXOR(F.col("f2")))
    return pairs.where((first == F.col("block")) & (distance <= radius)).select("q1", "q2", "f1", "f2", "n", distance.alias("distance"))


def _followers(rows: DataFrame) -> DataFrame:
    """rows(key, md, n, copies), distinct by (key, md), with the next row's key and md in descending key and ascending md (after the last: the first), and the previous row's n.

    Rows are ordered within ranges of the order; of a range only its first and last row meet
    those of the others, in one task with one row for each range.
    """
    order = [F.desc("key"), F.asc("md")]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("range").orderBy(*order)
    one = ranged.withColumns({"nkey": F.lead("key").over(inside), "nmd": F.lead("md").over(inside), "pn": F.lag("n").over(inside), "first": F.lag("key").over(inside).isNull()})
    ends = one.where(F.col("first") | F.col("nkey").isNull()).groupBy("range").agg(
        F.max(F.when(F.col("first"), F.struct("key", "md"))).alias("head"), F.max(F.when(F.col("nkey").isNull(), F.col("n"))).alias("tail"))
    every, whole = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("after"), F.coalesce(F.lag("tail").over(every), F.last("tail").over(whole)).alias("before"))
    out = one.join(F.broadcast(ends), "range")  # one row for each partition of a shuffle
    return out.select("key", "md", "n", "copies", F.coalesce("nkey", "after.key").alias("nkey"), F.coalesce("nmd", "after.md").alias("nmd"), F.when(F.col("first"), F.col("before")).otherwise(F.col("pn")).alias("pn"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, for each row of docs(doc_id, text, ...).

    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the next document in descending doc_id; after the last comes the first. Returns
    doc_id, n_chars, edited_sha256, f1, f2 (the text), e1, e2 (edited), x1, x2 (next document).

    A null text is an empty one, a null doc_id orders last. Documents of one doc_id follow
    each other in the order of the md5 values of their texts; rows with the same id and text
    are one document and have equal results. A table of one document follows itself, an empty
    table gives none. Other columns are ignored.

    Only ids, lengths and hashes are ordered, in ranges of rows whatever the ids. Texts are
    shuffled once by (id, hash), and once more is sent what a document's predecessor takes.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("key", "none", F.md5(F.col("text").cast("binary")).alias("md"), "text")
    known = base.groupBy("key", "md").agg(F.max(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies"))
    order = materialize(_followers(known), "order")
    rows = base.select("key", "md", "text").join(order, ["key", "md"])
    # Rows that are no repetition pass as they are; the others are one row each before anything else is done.
    names = ["key", "md", "n", "copies", "nkey", "nmd", "pn"]
    again = rows.where("copies > 1").groupBy(*names).agg(F.max("text").alias("text"))
    rows = rows.where("copies = 1").select(*names, "text").unionByName(again)
    # Each document sends what its predecessor takes of it, to the predecessor's place.
    before = order.select(F.col("key").alias("to"), F.col("md").alias("tomd"), F.col("nkey").alias("key"), F.col("nmd").alias("md"))
    heads = rows.select("key", "md", F.substring("text", F.lit(1), F.floor(F.col("pn") / 2).cast("int")).alias("head")).join(before, ["key", "md"])
    heads = heads.select(F.col("to").alias("key"), F.col("tomd").alias("md"), "head")
    both = rows.join(heads, ["key", "md"])
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - half).cast("int")), F.col("head"))
    both = both.select("key", "md", "n", "copies", "nkey", "nmd", "text", edited.alias("edited"))
    both = both.select("key", "md", "n", "copies", "nkey", "nmd", F.explode(F.array(
        F.struct(F.lit("").alias("sha"), F.col("text").alias("text")),
        F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("text")),
    )).alias("v")).select("key", "md", "n", "copies", "nkey", "nmd", "v.sha", "v.text")
    prints = fingerprints(both, ["key", "md", "n", "copies", "nkey", "nmd", "sha"])
    own, other = (lambda c: F.max(F.when(F.col("sha") == "", F.col(c)))), (lambda c: F.max(F.when(F.col("sha") != "", F.col(c))))
    prints = materialize(prints.groupBy("key", "md", "n", "copies", "nkey", "nmd").agg(
        F.max("sha").alias("edited_sha256"), own("f1").alias("f1"), own("f2").alias("f2"), other("f1").alias("e1"), other("f2").alias("e2")), "fingerprints")
    after = prints.select(F.col("key").alias("nkey"), F.col("md").alias("nmd"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    out = prints.join(after, ["nkey", "nmd"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    # A null id and the id that stands for it are told apart by the rows that have it.
    nulls = base.where(F.col("key") == NULL_ID).groupBy("key", "md").agg(F.count_if("none").alias("nulls"))
    out = out.join(nulls, ["key", "md"], "left")
    doc = F.when((F.col("key") == NULL_ID) & (F.col("copy") <= F.coalesce("nulls", F.lit(0))), F.lit(None)).otherwise(F.col("key")).alias("doc_id")
    return out.select(doc, F.col("n").alias("n_chars"), "edited_sha256", "f1", "f2", "e1", "e2", "x1", "x2")
