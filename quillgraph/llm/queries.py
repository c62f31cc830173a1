"""The queries ``opN_<name>``: each applies one operator to the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitplanes, bpe, flac, langid, packing, pii, quality, resampling, sharding, simhash, topk, toxicity
from .common import documents, held_out, stored

#: Ends of documents in the two vocabularies that the queries use.
END_ID_BYTES = 2
END_ID_WORDS = 0


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(simhash.fingerprints(documents(spark, sf_dir), words=3), "prints")
    found = simhash.near_duplicates(prints, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(flac.encode_texts(documents(spark, sf_dir)), "media", "zstd")
    return flac.describe(media)


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = bitplanes.write_token_shards(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), END_ID_BYTES)
    return bitplanes.read_token_shards(shards)


def op5_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(documents(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), END_ID_WORDS, capacity=2048)


def op10_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express: counts and base rules of every whole text."""
    found = quality.counted(documents(spark, sf_dir), ("doc_id",)).withColumn("base_failed", quality.base_failed())
    return found.select("doc_id", *quality.COUNTS[:5], "base_failed")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express: all sizes are placed, places are gapless, and shards
    differ by less than the largest size."""
    placed = op8_virtual_slots(spark, sf_dir)
    shards = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.max("size").alias("largest"))
    gapless = F.bool_and((F.col("last") + 1 == F.col("n")) & (F.col("slots") == F.col("n")))
    even = F.max("bytes") - F.min("bytes") <= F.max("largest")
    return shards.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), gapless.alias("gapless"), even.alias("near_equal"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_contextual_pii, op3_flac_media, op4_bitplane_tokens, op5_naive_bayes_language, op6_toxic_segments, op7_robust_outliers, op8_virtual_slots, op9_genetic_packing, op10_bpe_backtracking, op11_importance_resampling, op12_token_alignment, op13_exact_top_products, quality_base, shard_balance)}


_WORD = r"'[^\x20\x09-\x0D]+'"
_QUALITY_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
    w AS (SELECT doc_id, generate_subscripts(words, 1) AS i, words FROM d),
    t AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w WHERE i + 2 <= len(words)),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t),
    h AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(3) s(j) WHERE n > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""
_SHARD_SQL = """SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS shards, true AS gapless, true AS near_equal FROM documents"""

#: Bucket counts over distinct words; CRC-32 by its table of 256 values, made from the polynomial.
_RESAMPLING_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    c AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
    w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
    u AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    y AS (SELECT word, hex(word) AS h FROM (SELECT word FROM w UNION SELECT word FROM u)),
    b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, c),
    s AS (SELECT bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM u JOIN b USING (word) GROUP BY bucket),
    a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
    g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
    f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
    r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN f USING (doc_id)),
    k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM k) // 100 THEN place END AS rank FROM r LEFT JOIN k USING (doc_id)"""

_PRODUCTS_SQL = """WITH w AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, w.vec_id, list_inner_product(q.v, w.v)::BIGINT AS score FROM w JOIN w q ON q.vec_id % 50 = 0 AND len(q.v) = len(w.v) AND (q.vec_id <> w.vec_id OR q.v <> w.v))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express; the operators' own queries are held against brute force."""
    return {"quality_base": _QUALITY_SQL, "shard_balance": _SHARD_SQL, "op11_importance_resampling": _RESAMPLING_SQL, "op13_exact_top_products": _PRODUCTS_SQL}
