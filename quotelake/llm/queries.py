"""Queries op1 to op13 over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm import chat_format, embedding_dedup, fill_in_middle, jump_sharding, language_id, mixing, mpeg_audio, packing, quality, sentencepiece_fst, simhash, substring_dedup, whitening
from quotelake.llm.common import documents

SHARDS = 24


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(spark, documents(spark, sf_dir))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_features(spark, documents(spark, sf_dir))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_sharding.shard_documents(spark, documents(spark, sf_dir), SHARDS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    ok = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_format.format_digest(spark, rows.unionByName(own))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_documents(spark, documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(spark, documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints over 3-word shingles, linked at 3 or fewer differing bits."""
    found = simhash.near_duplicate_components(spark, documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")[0]).alias("fingerprint"), "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(spark, documents(spark, sf_dir))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digest(documents(spark, sf_dir))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(spark, documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup, op2_mpeg_audio, op3_jump_sharding, op4_quality_classifier, op5_embedding_dedup, op6_chat_format, op7_sentencepiece, op8_language_id,
        op9_simhash_near_dedup, op10_mix_sources, op11_whiten, op12_fill_in_middle, op13_pack,
    )
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), []) AS ws FROM documents
), windows AS (
  SELECT rid, doc_id, unnest(range(1, greatest(len(ws) - 48, 1))) AS p, ws FROM w
), keyed AS (
  SELECT rid, doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS k FROM windows
), low AS (
  SELECT k, min(doc_id) AS m FROM keyed GROUP BY k
), gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM keyed JOIN low USING (k) WHERE m < doc_id
), sets AS (
  SELECT rid, list(i) AS gs FROM gone GROUP BY rid
), long AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM long ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gs), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN sets USING (rid) LEFT JOIN kept USING (rid)
"""

#: The jump walk by recursion on (candidate, next); the generator's state needs 128-bit products. Slots follow doc_id within a shard.
OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), walk AS (
  SELECT rid, n, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM d, (VALUES ({SHARDS}), ({SHARDS + 1})) AS s(n)
  UNION ALL
  SELECT rid, n, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * {jump_sharding.MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM walk WHERE j < n)
), homes AS (
  SELECT rid, max(b) FILTER (WHERE n = {SHARDS})::INTEGER AS shard, max(b) FILTER (WHERE n = {SHARDS + 1})::INTEGER AS grown_shard FROM walk GROUP BY rid
), crc_table AS (
  SELECT list(c ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), sized AS (
  SELECT rid, doc_id, t, octet_length(encode(t))::BIGINT + 8 AS size, hex(encode(t)) AS h FROM d
), bytes AS (
  SELECT rid, generate_subscripts AS p, ('0x' || substr(h, 2 * generate_subscripts - 1, 2))::BIGINT AS v FROM (SELECT rid, h, unnest(range(1, length(h) // 2 + 1)) AS generate_subscripts FROM sized)
), crcs AS (
  SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list(v ORDER BY p)), lambda c, v: xor(c >> 8, tbl[(xor(c, v) & 255) + 1])), 4294967295) AS crc
  FROM bytes, crc_table GROUP BY rid, tbl
), numbered AS (
  SELECT doc_id, size, coalesce(crc, 0)::BIGINT AS text_crc32, shard, grown_shard FROM sized JOIN homes USING (rid) LEFT JOIN crcs USING (rid)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM numbered
"""

OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid AS a, a.vec_id AS ia, b.rid AS b, b.vec_id AS ib FROM good a JOIN good b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}
), reach AS (
  SELECT a AS origin, b AS rid FROM links UNION SELECT r.origin, l.b FROM reach r JOIN links l ON r.rid = l.a
), low AS (
  SELECT origin, min(vec_id) AS m FROM reach JOIN v USING (rid) GROUP BY origin
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(m, vec_id)), false) AS kept
FROM v LEFT JOIN degree ON a = rid LEFT JOIN low ON origin = rid
"""

_CONTROLS = "<\\|im_start\\|>|<\\|im_sep\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]"

OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 2 * len(regexp_extract_all(role || chr(0) || text, '{_CONTROLS}'))
    + length(role || text) - length(replace(role || text, chr(27), '')) + {len("<|im_start|><|im_sep|><|im_end|>") + 1} AS n
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP10_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, {mixing.MOST} * source_size AS cap, [5, 2, 1][(r % 3 + 1)::INTEGER]::BIGINT AS w FROM per
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS k FROM weighed
), levels AS (
  SELECT a.k, CASE WHEN sum(b.w) FILTER (WHERE b.k >= a.k) > 0
      THEN ((SELECT {mixing.SHARE} * sum(source_size) FROM per)::DOUBLE - coalesce(sum(b.cap) FILTER (WHERE b.k < a.k), 0)::DOUBLE) / (sum(b.w) FILTER (WHERE b.k >= a.k))::DOUBLE END AS level,
    a.cap::DOUBLE / a.w AS own
  FROM ranked a, ranked b GROUP BY a.k, a.cap, a.w
), final AS (
  SELECT level FROM levels WHERE w_ok ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN w * level > cap THEN cap::DOUBLE ELSE w * level END AS target FROM weighed, final
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':{mixing.SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
""".replace("w_ok", "level IS NULL OR level <= own")


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_in_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '{fill_in_middle.UNIT}') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d
), cuts AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {fill_in_middle.CHANGED} THEN 'plain'
      WHEN h[4] % 100 < {fill_in_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_jump_sharding": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op10_mix_sources": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
