"""Windows and sessions over events: the streaming operators run as tables, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.plans.registry import query, table
from quotelake.streaming import incremental


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm09_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "6 hours").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def stm09_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "8 hours")


_STATES_SQL = """
WITH known AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, source, left(sha256(text), 16) AS h FROM documents),
seen AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 2000000000 ELSE doc_id END AS doc_id, source, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE left(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END), 16) END AS h,
  CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS n FROM documents)
"""


@query(_STATES_SQL + """
SELECT coalesce(k.doc_id, s.doc_id) AS doc_id, coalesce(s.source, k.source) AS owner,
  CASE WHEN s.doc_id IS NULL AND k.source IN ('src1', 'src2') THEN 'NEVERIFICAT' WHEN s.doc_id IS NULL THEN 'LIPSA' WHEN s.h IS NULL THEN 'NEDESCARCAT' WHEN s.n = 2 THEN 'AMBIGUU'
    WHEN k.doc_id IS NULL THEN 'NOU' WHEN k.h = s.h THEN 'NESCHIMBAT' ELSE 'SCHIMBAT' END AS state
FROM known k FULL JOIN seen s ON k.doc_id = s.doc_id
""")
def stm02_document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents known, a third under addresses that weren't seen again, and all seen: some moved, changed, unread, or with two contents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner"), "text")
    digest = lambda c: F.left(F.sha2(c, 256), F.lit(16))
    moved = lambda by, to: F.when(F.col("doc_id") % by == 0, F.col("doc_id") + to).otherwise(F.col("doc_id")).alias("doc_id")
    known = docs.select(moved(3, 1_000_000_000), "owner", digest(F.col("text")).alias("hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    read = F.when(F.col("doc_id") % 11 != 0, digest(changed))
    twice = F.when(F.col("doc_id") % 13 == 0, F.array(read, F.concat(read, F.lit("+")))).otherwise(F.array(read))
    seen = docs.select(moved(7, 2_000_000_000), "owner", F.explode(twice).alias("hash")).withColumn("ok", F.col("hash").isNotNull())
    crawled = docs.select("owner").distinct().where("owner not in ('src1', 'src2')")
    return incremental.document_states(known, seen, crawled, "doc_id")


@query("SELECT doc_id FROM documents WHERE left(sha256(text), 16) NOT IN (SELECT left(sha256(text), 16) FROM documents WHERE lang = 'en')")
def stm01_skip_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents those whose content no English one holds: what an earlier run over that part has read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"))
    return incremental.skip_known(docs, docs.where("lang = 'en'"), ["hash"]).select("doc_id")
