"""The registered query of each operator, with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reefline.llm import (
    chat, exact_dedup, merkle, minhash, mixing, multi_index, packing, quality, recompression, sharding, suffix_sort, topk, whitening,
)
from reefline.llm.common import WORD_PATTERN, read, text_of

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP4_RULE = minhash.Rule(width=3, percent=85)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), OP4_RULE).select(
        "doc_id", "n_shingles", "component_id", "kept")


# Every pair of documents with a common shingle, and the components of those similar enough.
OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{WORD_PATTERN}') AS ws FROM documents),
placed AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
spans AS (
  SELECT doc_id, n, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s
  FROM placed),
shingles AS (SELECT DISTINCT doc_id, s FROM spans WHERE i <= greatest(n - 2, 1)),
sizes AS (SELECT doc_id, count(*) AS k FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.k + y.k - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.k, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


TOP_K, QUERY_EVERY = 5, 50


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    queries = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return topk.top_k(vectors, queries, TOP_K)


OP1_SQL = f"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS vec FROM embeddings
           WHERE embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""


# A conversation whose texts hold the template's own control strings
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(
            ("user", "assistant"))])).alias("t")).select(
        F.lit(-1).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(CONTROL_TEXT).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_turns(chat.canonical_turns(chat.records(rows)).select("conv_id", "turns"))
    back = chat.read_back(formatted.select("conv_id", "formatted", "loss_spans"))
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(i, role)),
marked AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\\[\\\\]', '', 'g')) + 3
            + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.remove_repeated_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Every window of 200 bytes, as 400 hexadecimal digits.
OP7_SQL = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, length(h) // 2 AS n, h, unnest(range(0, length(h) // 2 - 199, 250)) AS p FROM raw WHERE length(h) >= 400),
pieces AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 898) AS h FROM parts),
starts AS (SELECT doc_id, p, h, unnest(range(1, least(250, n - 199 - p) + 1)) AS j FROM pieces),
windows AS (SELECT doc_id, p + j AS i, md5(substr(h, 2 * j - 1, 400)) AS w FROM starts),
twice AS (SELECT w FROM windows GROUP BY 1 HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i > 200 + coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS fresh
         FROM windows SEMI JOIN twice ON windows.w = twice.w),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (SELECT doc_id, span, min(i) AS first, max(i) + 199 AS last FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, span, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM spans),
kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(last - first + 1) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (first - 1 - before)), '' ORDER BY span) || substr(any_value(h), 2 * max(last) + 1) AS rest
  FROM gaps g JOIN raw r ON r.doc_id = g.doc_id GROUP BY 1)
SELECT r.doc_id, (length(r.h) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       coalesce(k.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.rest, r.h))) AS kept_sha256
FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), F.array("source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(quality.HOLD_OUT_MOD)) == 0


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.fit(docs, labels.filter(~held_out()))
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeated_words(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


# Every window of 13 words with the least document it starts in.
OP10_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS ws FROM documents),
placed AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
windows AS (
  SELECT doc_id, n, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s
  FROM placed),
full_windows AS (SELECT doc_id, i, md5(s) AS s FROM windows WHERE i <= n - 12),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM full_windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM hits),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p.i) AS rest
         FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.rest, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.tampered(read(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


NEAREST, NEAREST_EVERY = 20, 20


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = vectors.filter(F.col("vec_id") % NEAREST_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return multi_index.search(vectors, queries, NEAREST)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_multi_index": op13_multi_index,
}
ORACLES: dict[str, str] = {
    "op1_exact_topk": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_mixing": mixing.ORACLE,
    "op10_substring_dedup": OP10_SQL,
    "op11_merkle_manifest": merkle.ORACLE,
}
