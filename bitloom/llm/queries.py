"""The queries of this subpackage: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.llm.bpe import Tokenizer, digest_documents
from bitloom.llm.itq import embedding_components
from bitloom.llm.licenses import scan_licenses
from bitloom.llm.mixing import mix_documents
from bitloom.llm.ngram_join import ngram_jaccard_components
from bitloom.llm.quotes import reply_conversations
from bitloom.llm.secrets import fit_secrets, scan_secrets
from bitloom.llm.simhash import edited_fingerprints, likeness, near_fingerprints, text_form
from bitloom.llm.toxicity import fit_toxicity, held_out, score_toxicity
from bitloom.llm.unigram import UnigramModel, count_tokens
from bitloom.session import materialize, read_table

#: The mix that the queries ask for: weights by tree level and value, 1 where none is given; and the domain of a source.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}}


def domain_of_source():
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other"))


def tokenizer() -> Tokenizer:
    return Tokenizer.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_conversations(read_table(spark, sf_dir, "conversations"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"), domain_of_source(), WEIGHTS, share=(3, 4), max_epochs=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"), tokenizer())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), UnigramModel.load(public_tokenizers.path("piece_bpe_32k.model")))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for each row whose doc_id is divisible by 20, the other rows within 3 of 128 bits; null for other rows."""
    prints = materialize(edited_fingerprints(read_table(spark, sf_dir, "documents")), "prints")
    asked = prints.where("doc_id % 20 = 0").select("f1", "f2").distinct()
    near = near_fingerprints(asked, prints.groupBy("f1", "f2").agg(F.count("*").alias("n")), radius=3)
    near = near.groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg((F.sum("n") - 1).alias("near"))
    return prints.join(near, ["f1", "f2"], "left").select(
        "doc_id", "n_chars", "edited_sha256", text_form("f1", "f2").alias("fingerprint"), text_form("e1", "e2").alias("edited_fingerprint"),
        likeness("f1", "f2", "e1", "e2").alias("near_edited"), likeness("f1", "f2", "x1", "x2").alias("near_next"), F.when(F.col("doc_id") % 20 == 0, F.col("near")).alias("n_near"),
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"), num=0.98)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit_secrets(docs))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != "network")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"), count("network").alias("n_network"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quote_linking, op2_license_scan, op3_source_mix, op4_byte_bpe, op5_token_counts, op6_toxic_segments, op7_simhash, op8_embedding_near_dedup, op9_ngram_jaccard_join, op10_secret_scan)}


def _share_sql(name: str, source: str, parent: str, keys: str, order: str) -> str:
    """CTEs that grant each row of source(keys, cap, w, budget) its share among the rows of its parent, full ones first."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_a AS (SELECT *, CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE ELSE 'inf'::DOUBLE END AS fill FROM {source}),
{name}_b AS (SELECT *, w > 0 AND cap * (sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY fill, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) <= (budget - coalesce(sum(cap) OVER ({part} ORDER BY fill, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS open_b, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({part}), 0) AS open_w FROM {name}_b),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap WHEN w <= 0 THEN 0 ELSE least(cap, greatest((open_b * w) // open_w, 0)) END AS granted FROM {name}_c)"""


def _mix_sql(share: tuple[int, int] = (3, 4), epochs: int = 2, seed: int = 42) -> str:
    weight = lambda level: "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS.get(level) else "1"
    leaf = "domain, lang, source"
    return f"""WITH base AS (SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER) % 4)::VARCHAR, 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT {leaf}, sum(tokens)::HUGEINT AS supply, sum(tokens)::HUGEINT * {epochs} AS cap, 1 AS w, {weight("lang")} AS wl, {weight("domain")} AS wd FROM base GROUP BY {leaf}),
dom AS (SELECT domain, sum(cap)::HUGEINT AS cap, max(wd) AS w, (SELECT sum(supply)::HUGEINT FROM leaves) * {share[0]} // {share[1]} AS budget FROM leaves GROUP BY domain),
{_share_sql("gd", "dom", "", "domain", "domain")},
lan AS (SELECT l.domain, l.lang, sum(l.cap)::HUGEINT AS cap, max(l.wl) AS w, max(g.granted)::HUGEINT AS budget FROM leaves l JOIN gd g ON l.domain = g.domain GROUP BY l.domain, l.lang),
{_share_sql("gl", "lan", "domain", "domain, lang", "domain, lang")},
src AS (SELECT l.domain, l.lang, l.source, l.supply, l.cap, l.w, g.granted AS budget FROM leaves l JOIN gl g ON l.domain = g.domain AND l.lang = g.lang),
{_share_sql("gs", "src", "domain, lang", "domain, lang, source, supply", "domain, lang, source")},
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN granted // supply ELSE 0 END AS epochs, CASE WHEN supply > 0 THEN granted % supply ELSE 0 END AS rest FROM gs),
keyed AS (SELECT b.*, p.epochs, p.rest, md5('{seed}:' || (p.epochs + 1)::BIGINT::VARCHAR || ':' || coalesce(b.doc_id::VARCHAR, 'null')) AS h FROM base b JOIN plan p ON b.domain = p.domain AND b.lang = p.lang AND b.source = p.source),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY h) - sum(tokens) OVER (PARTITION BY {leaf}, h) AS start FROM keyed),
taken AS (SELECT *, greatest(0, least(tokens, rest - start)) AS part FROM placed)
SELECT doc_id, {leaf}, tokens, (epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS copies, (epochs * tokens + part)::BIGINT AS take_tokens FROM taken"""


_REACH = """reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""


def _jaccard_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, {joined} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM split WHERE len(w) >= {k}) UNION SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND {k - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE {den} * m >= {num} * (p.n + q.n - m)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of r ON r.a = d.doc_id"""


def _cosine_sql(num: float = 0.98) -> str:
    return f"""WITH RECURSIVE fine AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS l FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_inner_product(x.v, y.v) / (x.l * y.l) >= {num}::DOUBLE),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT e.vec_id, c.n, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least_of r ON r.a = e.vec_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query on whole tables; the others are held against brute force in tests/llm."""
    return {"op3_source_mix": _mix_sql(), "op8_embedding_near_dedup": _cosine_sql(), "op9_ngram_jaccard_join": _jaccard_sql()}
