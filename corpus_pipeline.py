"""A corpus pipeline of five stages; each reads all rows that its predecessor kept.

toxicity: documents with a toxic score of 0.7 or more go. near duplicates: one document of
each group (five-word shingles, Jaccard 0.8 or more) stays, the one of the smallest doc_id.
secrets: findings are replaced by their kind. mixing: documents are repeated or left out for
the target weights. encoding: byte-level BPE ids of each document, checked by decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.llm.bpe import digest_documents
from bitloom.llm.mixing import mix_documents
from bitloom.llm.ngram_join import ngram_jaccard_components
from bitloom.llm.queries import WEIGHTS, domain_of_source, tokenizer
from bitloom.llm.secrets import fit_secrets, redact_secrets
from bitloom.llm.toxicity import fit_toxicity, held_out, keep_clean
from bitloom.session import materialize, read_table, release


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.7 stay, a null or empty text and rows without an id too. Labels of the held-out third are not read."""
    release(spark)
    labels = read_table(spark, sf_dir, "labels")
    return keep_clean(docs, fit_toxicity(docs, labels.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id isn't the smallest of their group go; rows of one doc_id stay or go together, rows without one stay."""
    release(spark)
    groups = ngram_jaccard_components(docs, k=5, num=80, den=100)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; each finding of a text is replaced by its kind, and n_chars counted anew. Null texts stay null."""
    release(spark)
    return redact_secrets(docs, fit_secrets(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes; the budget is all tokens, a source repeats at most twice.

    Tokens are runs between white space (the next stage makes the tokenizer's). Rows of one
    doc_id, null too, are taken as often as any of them is. Other columns may have any names.
    """
    release(spark)
    key, copies, copy = (next(n for i in range(len(docs.columns) + 1) if (n := f"{name}{i}") not in docs.columns) for name in ("key", "copies", "copy"))
    mixed = mix_documents(docs, domain_of_source(), WEIGHTS, share=(1, 1), max_epochs=2)
    many = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies))
    taken = docs.join(many, F.col("doc_id").eqNullSafe(F.col(key)))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy)).drop(copy)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text is an empty one."""
    release(spark)
    return digest_documents(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Model scores and tokenizers have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
