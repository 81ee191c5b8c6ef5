"""The numbered queries: each operator on its whole table with the parameters for production."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lloyd, minhash, packing, pii, runs, sharding, simhash, tokencount, topk, warc
from .shared import materialise, read, shared_dir

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=3)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), MULTI_RANKS).drop("text")
    both = bpe.decode(ids, MULTI_RANKS)
    return both.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(read(spark, sf_dir, "documents").select("text", "lang"))
    return langid.page_languages(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 62):x}"
    warc.write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = warc.assemble(materialise(warc.read(spark, path), "records"))
    size = F.coalesce("response.payload_bytes", "first.payload_bytes")
    return captures.select("page_id", size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 256)
    return topk.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, size=2048, end=1)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return ann.approximate_top_k(vectors, "id % 20 = 0", 20)


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(docs, [1.0] * 40, write=True).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, 1024)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.planted(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, least_length=6, least_exponent=4).withColumn("best", runs.strongest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=5, similarity=0.85)


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lloyd.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", lloyd.hex_code(F.col("code")).alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_neardup, op2_contextual_pii, op3_byte_bpe, op4_language_fusion, op5_warc_transactions, op6_ball_tree_topk, op7_histogram_packing, op8_cross_polytope_ann, op9_rendezvous_shards, op10_pretoken_counts, op11_periodic_runs, op12_minhash_odd_sketch, op13_filtering_lloyd)
}


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's algorithm round by round, every part against every entry."""
    far = "CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
        n{r} AS MATERIALIZED (
            SELECT vec_id, part, min(f) AS far, arg_min(entry, f * 256 + entry) AS entry
            FROM (SELECT p.vec_id, p.part, c.entry, {far} AS f FROM p JOIN b{r} c ON p.part = c.part) GROUP BY vec_id, part),"""
        if r < rounds:
            steps += f"""
        s{r} AS (
            SELECT n.part, n.entry, i.i, CAST(floor(sum(p.x[i.i])::DOUBLE / count(*)) AS BIGINT) AS x
            FROM n{r} n JOIN p ON p.vec_id = n.vec_id AND p.part = n.part JOIN range(1, (SELECT d FROM k LIMIT 1) // 4 + 1) i(i) ON true
            GROUP BY n.part, n.entry, i.i),
        b{r + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(u.x, b.x) AS x
            FROM b{r} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS x FROM s{r} GROUP BY part, entry) u ON u.part = b.part AND u.entry = b.entry),"""
    return f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, len(embedding) AS d, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, q.q AS part, v[q.q * d // 4 + 1:(q.q + 1) * d // 4] AS x FROM k JOIN range(4) q(q) ON true),
        b0 AS MATERIALIZED (
            SELECT p.part, f.entry, p.x
            FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) f JOIN p ON p.vec_id = f.vec_id),{steps}
        e AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id),
        l AS (SELECT k.label, CAST(sum(e.error) AS BIGINT) AS label_error FROM e JOIN k ON k.vec_id = e.vec_id GROUP BY k.label),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT e.vec_id, e.code, e.error, l.label_error, (SELECT codebooks_sha256 FROM h) AS codebooks_sha256
        FROM e JOIN k ON k.vec_id = e.vec_id JOIN l ON l.label IS NOT DISTINCT FROM k.label"""


SQL = {
    "op5_warc_transactions": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
        FROM f""",
    "op6_ball_tree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_minhash_odd_sketch": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
            FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS MATERIALIZED (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
            JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
            HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
        LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op13_filtering_lloyd": _lloyd_sql(4),
}
