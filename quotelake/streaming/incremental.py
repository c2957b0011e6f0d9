"""Incremental behaviour as Structured Streaming: unchanged content is skipped, documents pass through states, tables are kept by upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotelake.operators import upsert


def skip_known(arrivals: DataFrame, known: DataFrame, key: Sequence[str] = ("source", "hash")) -> DataFrame:
    """Arrivals (a stream or a table) whose key isn't in the table of what was processed."""
    return arrivals.join(known.select(*key), list(key), "left_anti")


def first_arrivals(stream: DataFrame, key: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def document_states(known: DataFrame, seen: DataFrame, crawled: DataFrame, key: str = "url", owner: str = "owner") -> DataFrame:
    """(url, owner, state) from what is known (url, owner, hash) and what was seen (url, owner, hash, ok): NOU, NESCHIMBAT, SCHIMBAT, NEDESCARCAT (seen but not
    read), LIPSA (not seen though its owner was crawled), NEVERIFICAT (its owner wasn't), AMBIGUU (seen with several contents)."""
    now = seen.groupBy(key).agg(F.first(owner).alias("__o"), F.countDistinct(F.when(F.col("ok"), F.col("hash"))).alias("__n"), F.max(F.when(F.col("ok"), F.col("hash"))).alias("__h"))
    both = known.select(key, F.col(owner).alias("__ko"), F.col("hash").alias("__kh"), F.lit(True).alias("__known")).join(now.withColumn("__seen", F.lit(True)), key, "full_outer")
    both = both.withColumn("owner", F.coalesce("__o", "__ko"))
    marked = both.join(crawled.select(F.col(owner).alias("owner"), F.lit(True).alias("__c")).distinct(), "owner", "left")
    state = (
        F.when(F.col("__seen").isNull() & F.col("__c").isNull(), "NEVERIFICAT")
        .when(F.col("__seen").isNull(), "LIPSA")
        .when(F.col("__n") == 0, "NEDESCARCAT")
        .when(F.col("__n") > 1, "AMBIGUU")
        .when(F.col("__known").isNull(), "NOU")
        .when(F.col("__h") == F.col("__kh"), "NESCHIMBAT")
        .otherwise("SCHIMBAT")
    )
    return marked.select(key, "owner", state.alias("state"))


def _transitions(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's arrivals in order of time to its state changes; the state is the last content read."""
    rows = pd.concat(list(frames)).sort_values(["ts", "hash"])
    last, count = state.get if state.exists else (None, 0)
    out = []
    for ts, content in zip(rows["ts"], rows["hash"], strict=True):
        if content is None:
            out.append((key[0], ts, "NEDESCARCAT", count))
            continue
        verdict = "NOU" if last is None else "NESCHIMBAT" if content == last else "SCHIMBAT"
        count += verdict == "SCHIMBAT"
        last = content
        out.append((key[0], ts, verdict, count))
    if last is not None:
        state.update((last, count))
    yield pd.DataFrame(out, columns=["url", "ts", "state", "changes"])


def document_stream(stream: DataFrame) -> DataFrame:
    """A stream (url, ts, hash) to (url, ts, state, changes), with one small state for each address."""
    return stream.groupBy("url").applyInPandasWithState(_transitions, "url string, ts timestamp, state string, changes long", "last string, changes long", "append", GroupStateTimeout.NoTimeout)


def validator_trust(probes: DataFrame, origin: str = "origin", least: int = 2) -> DataFrame:
    """(origin, validator, trusted): a validator (etag, last_modified, length) that said "unchanged" while the content changed, or the other way round at
    least ``least`` times, isn't trusted for that origin. probes: origin, validator, same_validator, same_content."""
    return probes.groupBy(origin, "validator").agg(
        F.count_if(F.col("same_validator") & ~F.col("same_content")).alias("missed"), F.count_if(~F.col("same_validator") & F.col("same_content")).alias("needless"), F.count("*").alias("n")
    ).withColumn("trusted", (F.col("missed") == 0) & (F.col("needless") < least))


def comparable(old_parser: Column, new_parser: Column) -> Column:
    """Values of two runs may be compared only if one parser read both."""
    return F.coalesce(old_parser == new_parser, F.lit(False))


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: Sequence[str], rules: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Keeps a table by upserts, batch by batch (``write`` must be idempotent), until all that is there has been read."""

    def apply(batch: DataFrame, _: int) -> None:
        write(upsert.upsert(read(), batch, key, rules))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(todo: DataFrame, done: DataFrame, key: Sequence[str], day: Column) -> DataFrame:
    """What a run of the day hasn't finished yet: a broken run goes on where it stopped."""
    finished = done.where((F.col("day") == day) & (F.col("status") == "ok")).select(*key)
    return todo.join(finished, list(key), "left_anti")


def windowed(events: DataFrame, time: str, by: Sequence[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; late events are taken up to the watermark. An extension: the same for tables and streams."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``gap`` without an event. An extension."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
