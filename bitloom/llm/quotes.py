"""Quotation linking in conversations. DataFrame functions only.

Each text is parsed line by line: the quote level of a line is the number of ">" in its
leading run, and adjacent lines of one level form a passage. Passages of level 1 and more,
and each of their lines, are normalised (quote marks dropped, lower case, single spaces) and
hashed; the same hashes of whole texts, paragraphs and lines without quotes name the
earliest message of the conversation that holds them. A quote links to that message if it
is an earlier turn: first as a whole passage, else by its lines. Texts under MIN_CHARS name
the latest message before the quote instead, and decide only where no longer line does.

A message replies to the latest message that its outermost quotes link to, else to the
message before it. Reply order is depth first, replies of a message in the order of turns.
Runs of messages that each reply to the one before are one segment, so only branches need
work: their order comes from pointer doubling over the segment tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from bitloom.session import materialize

_MARK = r"^(\s*>)+"
#: Turns (and positions) in one range of a conversation, as bits.
BIN_BITS = 8
#: Shorter texts (normalised characters) are often said again: they link to the latest earlier message, not the earliest.
MIN_CHARS = 8


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse_passages(text: Column) -> Column:
    """array<struct<level,text>>: runs of lines of one quote level, without their marks, in order. Each line is copied once."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(l, _MARK, 0), r"[^>]", "")).alias("level"), F.regexp_replace(l, _MARK + " ?", "").alias("text")))

    one = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  value is bound once

    def runs(rows: Column) -> Column:
        n = F.size(rows)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(rows, i)["level"] != F.get(rows, F.greatest(i - 1, F.lit(0)))["level"]))

        def passage(starts: Column) -> Column:
            part = lambda s, j: F.slice(rows, s + 1, F.coalesce(F.get(starts, j + 1), n) - s)
            return F.transform(starts, lambda s, j: F.struct(F.get(rows, s)["level"].alias("level"), F.array_join(F.transform(part(s, j), lambda l: l["text"]), "\n").alias("text")))

        return one(begins, passage)

    return one(lines, runs)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text) with pos (0, 1, ... in the conversation), own text and quoted passages.

    Messages are ordered by turn, then role and text; repeated rows are one message.
    """
    m = messages.select("conv_id", "turn", "role", "text").distinct().withColumn("bin", F.shiftright(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))), BIN_BITS))
    # A conversation may hold a third of all rows: rank in ranges of turns, then add the rows of earlier ranges.
    sizes = m.groupBy("conv_id", "bin").agg(F.count("*").alias("size"))
    sizes = sizes.select("conv_id", "bin", (F.sum("size").over(Window.partitionBy("conv_id").orderBy("bin")) - F.col("size")).alias("skipped"))
    order = Window.partitionBy("conv_id", "bin").orderBy("turn", "role", "text")
    m = m.withColumn("rn", F.row_number().over(order)).join(sizes, ["conv_id", "bin"])
    m = m.withColumn("pos", (F.col("skipped") + F.col("rn") - 1).cast("int"))
    # Most texts hold no quote; the fold runs over the others only.
    some = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^\s*>")
    whole = F.array(F.struct(F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("text")))
    m = m.withColumn("passages", F.when(some, parse_passages(F.col("text"))).otherwise(whole))
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    return m.select("conv_id", "turn", "role", "pos", F.trim(own).alias("own"), F.filter("passages", lambda p: p["level"] > 0).alias("quotes"))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    n = normalise(F.col(text))
    return df.where(F.length(n) > 0).withColumn("hash", F.md5(n)).withColumn("short", F.length(n) < MIN_CHARS).drop(text)


def _latest(quoted: DataFrame, origins: DataFrame) -> DataFrame:
    """quoted with origin, the largest pos of origins(conv_id, hash, pos) before the quote's; rows without one go.

    Windows run in ranges of positions, so a text that fills a conversation is no single task.
    """
    cols = quoted.columns
    both = quoted.withColumn("at", F.lit(None).cast("int")).unionByName(origins.select("conv_id", "hash", "pos", F.col("pos").alias("at")), allowMissingColumns=True)
    both = both.withColumn("bin", F.shiftright("pos", BIN_BITS))
    carry = both.groupBy("conv_id", "hash", "bin").agg(F.max("at").alias("m"))
    carry = carry.select("conv_id", "hash", "bin", F.max("m").over(Window.partitionBy("conv_id", "hash").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    near = F.max("at").over(Window.partitionBy("conv_id", "hash", "bin").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("near", near).where("at is null").join(carry, ["conv_id", "hash", "bin"])
    return both.select(*cols, F.coalesce("near", "carry").alias("origin")).where("origin is not null")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(conv_id, pos, quote, level, linked): for each quoted passage the position of its original, null if none.

    The table of longer texts has one row for each conversation and hash, whatever the number of
    messages with that text, so the join makes no more rows than there are quoted lines.
    """
    quoted = parsed.where(F.size("quotes") > 0)
    q = quoted.select("conv_id", "pos", F.posexplode("quotes").alias("quote", "p")).select("conv_id", "pos", "quote", "p.level", "p.text")
    q = materialize(q, "quotes")
    talks = q.select("conv_id").distinct()
    units = parsed.join(talks, "conv_id", "left_semi").select(
        "conv_id", "pos",
        F.explode(F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n")))).alias("unit"))
    units = _hashed(units, "unit")
    table = units.where("not short").groupBy("conv_id", "hash").agg(F.min("pos").alias("origin"))
    parts = q.select("conv_id", "pos", "quote", F.lit(0).alias("line"), F.col("text").alias("unit")).union(
        q.select("conv_id", "pos", "quote", F.lit(1).alias("line"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("unit")))
    parts = _hashed(parts, "unit")
    hits = parts.where("not short").join(table, ["conv_id", "hash"]).where("origin < pos")
    hits = hits.unionByName(_latest(parts.where("short"), units.where("short").select("conv_id", "hash", "pos").distinct()))
    # The whole passage wins, then the message with most longer lines, then with most lines, then the latest.
    votes = hits.groupBy("conv_id", "pos", "quote", "origin").agg(F.min("line").alias("line"), F.count_if(~F.col("short")).alias("long"), F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "pos", "quote").agg(F.max(F.struct((-F.col("line")).alias("whole"), "long", "n", "origin")).alias("b"))
    return q.drop("text").join(best.select("conv_id", "pos", "quote", F.col("b.origin").alias("linked")), ["conv_id", "pos", "quote"], "left")


def _segment_order(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, rank): depth-first rank of segments(conv_id, seg, parent, at).

    The children of a segment come in the order of at (position of their attachment)
    descending, then seg. The successor of a segment is its first child, else the next
    sibling of its nearest ancestor-or-self that has one; ranks follow by doubling.
    """
    sib = Window.partitionBy("conv_id", "parent").orderBy(F.desc("at"), "seg")
    s = segments.withColumn("sibling", F.when(F.col("parent").isNotNull(), F.lead("seg").over(sib)))
    first = s.where("parent is not null").groupBy("conv_id", "parent").agg(F.min_by("seg", F.struct(-F.col("at"), "seg")).alias("child"))
    s = s.join(first.select("conv_id", F.col("parent").alias("seg"), "child"), ["conv_id", "seg"], "left")
    up = materialize(s.select("conv_id", "seg", "child", F.col("sibling").alias("to"), F.when(F.col("sibling").isNull(), F.col("parent")).alias("ask")), "up")
    while up.where("to is null and ask is not null").limit(1).count():
        other = up.select("conv_id", F.col("seg").alias("ask"), F.col("to").alias("to2"), F.col("ask").alias("ask2"))
        up = materialize(up.join(other, ["conv_id", "ask"], "left").select("conv_id", "seg", "child", F.coalesce("to", "to2").alias("to"), F.when(F.col("to").isNull() & F.col("to2").isNull(), F.col("ask2")).alias("ask")), "up")
    # Distance to the end of the list, by doubling.
    run = materialize(up.select("conv_id", "seg", F.coalesce("child", "to").alias("next")).withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "run")
    while run.where("next is not null").limit(1).count():
        other = run.select("conv_id", F.col("seg").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        run = materialize(run.join(other, ["conv_id", "next"], "left").select("conv_id", "seg", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), "run")
    return run.select("conv_id", "seg", (-F.col("left")).alias("rank"))


def reply_conversations(messages: DataFrame) -> DataFrame:
    """One row per distinct message of messages(conv_id, turn, role, text, ...), in reply order within its conversation.

    Returns conv_id, position (0, 1, ... in reply order), turn, role, text (without quotes,
    trimmed), reply_turn (turn of the message it replies to, null for the first), n_quotes
    (quoted passages) and n_linked (those linked to an original).

    A null conv_id is a conversation of its own; its rows come back with null. A
    null turn orders first, a null text is empty. An empty table gives none.
    """
    spare = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    parsed = materialize(parse_messages(messages.withColumn("conv_id", spare)), "parsed")
    links = link_quotes(parsed)
    counts = links.groupBy("conv_id", "pos").agg(
        F.count("*").alias("n_quotes"), F.count("linked").alias("n_linked"),
        F.max(F.when(F.col("linked").isNotNull(), F.struct((-F.col("level")).alias("outer"), F.col("linked").alias("to")))).alias("best"))
    m = parsed.select("conv_id", "pos", "turn").join(counts, ["conv_id", "pos"], "left")
    m = m.select("conv_id", "pos", "turn", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                 F.when(F.col("pos") > 0, F.coalesce("best.to", F.col("pos") - 1)).alias("reply"))
    m = materialize(m, "replies")

    # A segment starts at the first message and wherever a message replies to another than the one before.
    seg = m.withColumn("bin", F.shiftright("pos", BIN_BITS)).withColumn("start", F.when((F.col("pos") == 0) | (F.col("reply") != F.col("pos") - 1), F.col("pos")))
    carry = seg.groupBy("conv_id", "bin").agg(F.max("start").alias("m"))
    carry = carry.select("conv_id", "bin", F.max("m").over(Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    seg = seg.withColumn("own", F.max("start").over(Window.partitionBy("conv_id", "bin").orderBy("pos"))).join(carry, ["conv_id", "bin"])
    seg = materialize(seg.withColumn("seg", F.coalesce("own", "carry")).drop("bin", "start", "own", "carry"), "segments")
    heads = seg.where("seg = pos and pos > 0").select("conv_id", "seg", F.col("reply").alias("at"))
    if heads.limit(1).count():
        branched = heads.join(seg.select("conv_id", F.col("pos").alias("at"), F.col("seg").alias("parent")), ["conv_id", "at"])
        roots = heads.select("conv_id").distinct().select("conv_id", F.lit(0).alias("seg"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("int").alias("at"))
        ranks = _segment_order(roots.unionByName(branched))
    else:
        ranks = heads.select("conv_id", "seg", F.lit(0).cast("long").alias("rank")).limit(0)
    # Messages of a segment are neighbours, so only segments are ordered.
    sizes = seg.groupBy("conv_id", "seg").agg(F.count("*").alias("size")).join(ranks, ["conv_id", "seg"], "left")
    offset = F.sum("size").over(Window.partitionBy("conv_id").orderBy(F.coalesce("rank", F.lit(0)), "seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    place = seg.join(sizes.select("conv_id", "seg", offset.alias("offset")), ["conv_id", "seg"])
    place = place.withColumn("position", (F.col("offset") + F.col("pos") - F.col("seg")).cast("long"))
    earlier = seg.select("conv_id", F.col("pos").alias("reply"), F.col("turn").alias("reply_turn"))
    place = place.join(earlier, ["conv_id", "reply"], "left").select("conv_id", "pos", "position", "reply_turn", "n_quotes", "n_linked")
    out = parsed.select("conv_id", "pos", "turn", "role", "own").join(place, ["conv_id", "pos"])
    back = F.when(F.col("conv_id") != "\0", F.col("conv_id")).cast(messages.schema["conv_id"].dataType)
    return out.select(back.alias("conv_id"), "position", "turn", "role", F.col("own").alias("text"), "reply_turn", F.col("n_quotes").cast("long").alias("n_quotes"), F.col("n_linked").cast("long").alias("n_linked"))
