"""Mixing sources to target weights on a domain-language-source tree.

Budgets go down the tree: a node's budget is shared among its children in proportion to
their weights, no child gets more than its subtree can supply (tokens x max_epochs), and
what one cannot take goes to its siblings first; only if all of them are full does it reach
the parent's siblings, since a parent is never given more than its subtree holds. All
arithmetic is on integers, so the result is exact and does not depend on row order.

Selection. A leaf's documents are ordered anew in each epoch by md5(seed, epoch, doc_id). A
leaf takes whole epochs and then a token prefix of the next one: documents whose first token
lies in the prefix. Only per-leaf sums are ever ordered by key: prefix sums run over
hash buckets first (BUCKETS a leaf, pre-aggregated), and documents are ordered only in the
bucket where the budget ends, so a leaf with a third of all rows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from bitloom.session import materialize

#: Hash buckets of a leaf: the first hexadecimal digits of the md5 value.
DIGITS = 3
BUCKETS = 16**DIGITS
LEVELS = ("domain", "lang", "source")


def _share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Add grant: budget shared by weight among the children of each parent, at most cap each.

    Children are ordered by cap / weight; a child is full if its cap is no more than its
    share of what is left. Rounding leaves less than one token a child.
    """
    big = "decimal(38,0)"
    nodes = nodes.withColumn("budget", budget.cast(big)).withColumn("cap", F.col("cap").cast(big)).withColumn("w", F.col("w").cast(big))
    key = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf")))
    nodes = nodes.withColumn("fill", key)
    # All children together, then those that come before: full ones are a prefix of the order.
    names = [c for c in LEVELS if c in nodes.columns]
    order = Window.partitionBy(*parent).orderBy("fill", *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    zero = F.lit(0).cast(big)
    nodes = (
        nodes.withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero))
        .withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("left_w") <= F.col("left_b") * F.col("w")))
    )
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), zero)
    open_w = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), zero)
    nodes = nodes.withColumn("open_b", F.col("budget") - full_cap).withColumn("open_w", open_w)
    part = F.when(F.col("w") > 0, F.floor(F.expr("cast(open_b as decimal(38,0)) * w div open_w")).cast(big)).otherwise(zero)
    grant = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.greatest(part, zero)))
    return nodes.withColumn("grant", grant).drop("fill", "left_b", "left_w", "full", "open_b", "open_w", "budget")


def leaf_budgets(leaves: DataFrame, total: int | Column, max_epochs: int) -> DataFrame:
    """(domain, lang, source, supply, grant) from leaves(domain, lang, source, supply, w_domain, w_lang, w_source)."""
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w"), F.max("w_domain").alias("w_domain"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w"))
    total = total if isinstance(total, Column) else F.lit(total)
    # There are few domains: the one window without a key is over them.
    domains = _share(domains.withColumn("root", F.lit(0)), ["root"], total).select("domain", F.col("grant").alias("budget"))
    langs = _share(langs.drop("w_domain").join(domains, "domain"), ["domain"], F.col("budget")).select("domain", "lang", F.col("grant").alias("budget"))
    out = _share(leaves.withColumn("w", F.col("w_source")).join(langs, ["domain", "lang"]), ["domain", "lang"], F.col("budget"))
    return out.select(*LEVELS, F.col("supply").cast("long"), F.col("grant").cast("long").alias("grant"))


def token_count(text: Column) -> Column:
    """Tokens of a text for the budgets: runs between spaces, U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies, take_tokens) for each document.

    docs(doc_id, text, lang, source); domain is an expression on its columns. weights has
    integer weights by level ("domain", "lang", "source") and value, 1 where a value is
    missing. The total budget is share[0] / share[1] of all tokens. copies is the number of
    whole epochs that take the document, one more if it starts within the last, partial one;
    take_tokens counts its tokens in the selection.

    Nulls in lang or source are the value "". Rows with the same doc_id in a leaf are taken
    together. A document without tokens has copies of the whole epochs only. An empty table
    gives an empty result. Other columns are ignored.
    """
    leaf = [F.col(c) for c in LEVELS]
    base = docs.select(
        "doc_id", F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        token_count(F.col("text")).alias("tokens"),
    )
    base = materialize(base, "tokens")
    leaves = base.groupBy(*leaf).agg(F.sum("tokens").alias("supply"))

    def weight(level: str) -> Column:
        table = weights.get(level, {})
        if not table:
            return F.lit(1)
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(int(v)))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1))

    leaves = leaves.select(*leaf, "supply", weight("domain").alias("w_domain"), weight("lang").alias("w_lang"), weight("source").alias("w_source"))
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("decimal(38,0)").alias("t")).collect()[0]["t"]
    budgets = leaf_budgets(leaves, int(total) * share[0] // share[1], max_epochs)
    budgets = budgets.select(*LEVELS, F.when(F.col("supply") > 0, F.expr("grant div supply")).otherwise(0).alias("epochs"), F.when(F.col("supply") > 0, F.col("grant") % F.col("supply")).otherwise(0).alias("rest"))
    budgets = materialize(budgets, "budgets")

    keyed = base.join(budgets, list(LEVELS)).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, DIGITS))
    sums = keyed.where("rest > 0").groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("s"), F.first("rest").alias("rest"))
    run = F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    edge = sums.withColumn("end", run).where("end - s < rest and end >= rest").select(*LEVELS, F.col("bucket").alias("edge"), (F.col("end") - F.col("s")).alias("done"))
    edge = materialize(edge, "edges")
    keyed = keyed.join(edge, list(LEVELS), "left")
    inside = keyed.where("bucket = edge")
    order = Window.partitionBy(*LEVELS).orderBy("h")
    peers = Window.partitionBy(*LEVELS, "h")
    inside = inside.withColumn("start", F.col("done") + F.sum("tokens").over(order) - F.sum("tokens").over(peers))
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("tokens"), F.col("rest") - F.col("start"))))
    outside = keyed.where("edge is null or bucket <> edge").withColumn("part", F.when((F.col("rest") > 0) & (F.col("bucket") < F.col("edge")), F.col("tokens")).otherwise(F.lit(0).cast("long")))
    both = inside.drop("start").unionByName(outside)
    return both.select(
        "doc_id", *LEVELS, "tokens",
        (F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("long").alias("copies"),
        (F.col("epochs") * F.col("tokens") + F.col("part")).cast("long").alias("take_tokens"),
    )
