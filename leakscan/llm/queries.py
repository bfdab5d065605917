"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm import (
    alignment,
    attribution,
    bpe,
    embeddings,
    importance,
    language,
    lm,
    mixing,
    quality,
    sharding,
    simhash,
    substring,
    tiling,
)

SHARDS = [f"shard-{k:03d}" for k in range(sharding.SHARDS)]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# What a document's label makes of its chance to be taken from a source that is not taken whole.
LIKED, DISLIKED = 2.0, 0.5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def tokenizer(spark: SparkSession) -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The contaminated documents, with the items found in them."""
    return tiling.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.token_counts(_table(spark, folder, "documents"), tokenizer(spark))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from three folds of four."""
    docs = _table(spark, folder, "documents")
    here = fold(F.col("doc_id"), 4)
    model = language.train(docs.filter((here >= 0) & (here != 2)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (here == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(_table(spark, folder, "documents").select("doc_id"), SHARDS)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), tokenizer(spark))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from four folds of five."""
    docs = _table(spark, folder, "documents")
    here = fold(F.col("doc_id"), 5)
    found = lm.scores(docs, (here >= 0) & (here != 1))
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return found.select("doc_id", (here == 1).alias("held_out"), *columns)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from the labels of three folds of four."""
    here = fold(F.col("doc_id"), 4)
    labels = _table(spark, folder, "labels").filter((here >= 0) & (here != 2))
    found = quality.classify(_table(spark, folder, "documents"), labels)
    return found.select("doc_id", (here == 2).alias("held_out"), "score", "predicted")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digests(_table(spark, folder, "documents"))


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled good are preferred over those without a label, and these over those labelled bad."""
    weight = F.when(F.col("quality") == 1, F.lit(LIKED)).when(F.col("quality") == 0, F.lit(DISLIKED))
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "labels").select("doc_id", weight.alias("weight")))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pair = alignment.Pair(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.scored(_table(spark, folder, "documents"), pair)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_simhash_near_dedup,
        op3_decontamination,
        op4_token_counts,
        op5_language_id,
        op6_sharding,
        op7_byte_bpe,
        op8_lm_scores,
        op9_quality,
        op10_substring_dedup,
        op11_source_mix,
        op12_importance_resampling,
        op13_token_alignment,
    )
}

def _sharding_sql() -> str:
    """The lookup table as one text, two hexadecimal digits for each slot."""
    table = "".join(f"{k:02x}" for k in sharding.lookup_table(SHARDS).tolist())
    return f"""WITH placed AS (
          SELECT doc_id, CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot
          FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(CAST('0x' || substr('{table}', 2 * slot + 1, 2) AS INTEGER) AS VARCHAR), 3, '0')
          AS shard FROM placed"""


def _mix_sql() -> str:
    first, second, third = mixing.WEIGHTS
    return f"""WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3
            WHEN 1 THEN {first} WHEN 2 THEN {second} ELSE {third} END AS w FROM d GROUP BY source),
        -- Sources in the order in which they fill up, with what those before them take, and the level of the rest.
        f AS (
          SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level, row_number() OVER (ORDER BY source_size / w, source) AS n
          FROM s WINDOW earlier AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
          SELECT source, source_size, least(3.0 * source_size, w * (SELECT min_by(level, n) FROM f WHERE 3 * source_size >= level * w)) AS target FROM s),
        g AS (
          SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
        q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN {LIKED} WHEN 0 THEN {DISLIKED} END) AS w FROM labels GROUP BY doc_id),
        k AS (
          SELECT d.*, source_size, CAST(target AS DOUBLE) AS target, epochs, greatest(0, target - epochs * source_size) AS wanted,
            -ln((CAST('0x' || left(sha256('{mixing.SEED}:' || d.doc_id), {mixing.HASH_DIGITS}) AS BIGINT) + 0.5)
              / {float(16**mixing.HASH_DIGITS)!r}) / coalesce(q.w, 1.0) AS key
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q USING (doc_id)),
        a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM k)
        SELECT doc_id, size, source_size, target,
          CAST(size * (epochs + CASE WHEN 2 * so_far - size <= 2 * wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a"""


def _resampling_sql() -> str:
    table = "".join(f"{x:08x}" for x in importance.crc_of_bytes().tolist())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = f"""regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
    return f"""WITH d AS (SELECT doc_id, {found} AS words FROM documents),
        b AS (SELECT {found} AS words FROM benchmark),
        w AS (SELECT doc_id, unnest(words) AS word FROM d),
        v AS (SELECT unnest(words) AS word FROM b),
        -- crc32 of each distinct word, byte by byte, by the table of what a byte does to it.
        h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM v)),
        c AS (
          SELECT word, list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x), 2), lambda i: CAST('0x' || substr(x, i + 1, 2) AS BIGINT))),
            lambda crc, byte: xor(crc >> 8, CAST('0x' || substr('{table}', 8 * (xor(crc, byte) & 255) + 1, 8) AS BIGINT))) AS crc FROM h),
        k AS (SELECT word, xor(crc, 4294967295) % {importance.BUCKETS} AS bucket FROM c),
        s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM v JOIN k USING (word) GROUP BY bucket),
        gain AS (
          SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM w) + {importance.BUCKETS})
            / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM v) + {importance.BUCKETS})))) AS BIGINT) AS gain
          FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        m AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM w JOIN k USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        r AS (
          SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
            (CAST('0x' || left(sha256('{importance.SEED}:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
          FROM d LEFT JOIN m USING (doc_id)),
        p AS (
          SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
          FROM r WHERE n_features >= {importance.LEAST_WORDS})
        SELECT r.*, CASE WHEN rank <= n * {importance.PERCENT} // 100 THEN rank END AS rank FROM r LEFT JOIN p USING (doc_id)"""


SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) >= 0.95 * a.size * b.size),
        reach(vec_id, found) AS (
          SELECT vec_id, vec_id FROM v UNION SELECT vec_id, b FROM reach JOIN links ON found = a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(found) AS component_id,
          min(found) = vec_id AS kept FROM reach GROUP BY vec_id""",
    "op6_sharding": _sharding_sql(),
    "op11_source_mix": _mix_sql(),
    "op12_importance_resampling": _resampling_sql(),
}
