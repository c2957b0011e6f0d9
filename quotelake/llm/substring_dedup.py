"""Repeated passages: words covered by a window of 50 words that also starts in a document with a smaller id.

First pass, a count-min prefilter. Every window has an anchor, the smallest hash among its runs of ten words: equal windows
have equal anchors, and neighbouring windows mostly share one, so there is about one anchor for 20 words. Each partition
sketches the anchors of its documents; the sketches are merged by adding their cells, and the cells that reached two are
kept as a bitmap. A window's estimate, the smallest of its cells, is never below the number of documents that hold it.

Second pass. Windows whose estimate is one can't be repeated and are left out; the others are grouped exactly, by the hash
of all their 50 words, and each group yields its smallest doc_id. Windows travel as tiles, runs of neighbouring windows with
one anchor: a tile whose anchor has no other tile is settled by its key alone, so long copied passages cost one row for
about 20 words and only the edges of passages are spread out to single windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import MOST_BITS, U64, bitmap, flat_words, materialize, maybe_among, mix, rolling, slices, utf8, word_hashes

WINDOW = 50
GRAM = 10
#: Rows of the sketch; each has at most 2**MOST_BITS cells, and the bitmap that is broadcast never more bits.
DEPTH = 2


def _anchored(texts: list[bytes | None], window: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text index, first word, anchor, hash of all words."""
    gram = min(GRAM, window)
    words, counts = flat_words(texts)
    total = int(counts.sum())
    empty = np.zeros(0, np.int64)
    if total < window:
        return empty, empty, empty.astype(U64), empty.astype(U64)
    grams, windows = rolling(word_hashes(words, total), (gram, window))
    low, span = mix(grams), window - gram + 1
    reach = 1
    while reach * 2 <= span:  # minima over 2, 4, 8, ... grams
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[: total - window + 1] == owner[window - 1 :])
    first = np.cumsum(counts) - counts
    return owner[at], at - first[owner[at]], low[at], mix(windows[at], 1)


def _run_starts(owner: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(new)


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchor, 11 + row) >> U64(64 - bits)).astype(np.int64) + (row << bits)


def _sketch(window: int, bits: int):
    """A partition's sketch: its cells that aren't 0. An anchor counts once for each run in a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for part in slices(batches, "text"):
            owner, _, anchor, _ = _anchored(part.column("text").to_pylist(), window)
            seen.append(anchor[_run_starts(owner, anchor)])
        anchors = np.concatenate(seen) if seen else np.zeros(0, U64)
        for row in range(DEPTH):
            cells, n = np.unique(_cells(anchors, row, bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.minimum(n, 2).astype(np.int8))], ["cell", "n"])

    return run


def repeated_cells(docs: DataFrame, window: int, bits: int) -> bytes:
    """The merged sketch as a bitmap of the cells that reached two, DEPTH rows of 2**bits bits: its size doesn't follow the input."""
    cells = docs.select("text").mapInArrow(_sketch(window, bits), "cell long, n byte")
    merged = cells.groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2")
    return bitmap(merged, DEPTH << bits)


def _tiles(window: int, bits: int, sketch):
    """Documents to tiles of windows whose estimate is two or more."""
    longest = window - min(GRAM, window) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sketch.value, np.uint8)
        for part in slices(batches, "text"):
            owner, at, anchor, hashes = _anchored(part.column("text").to_pylist(), window)
            if not len(at):
                continue
            likely = np.ones(len(at), bool)
            for row in range(DEPTH):
                cell = _cells(anchor, row, bits)
                likely &= (held[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            starts = _run_starts(owner, anchor)
            in_run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            starts = np.flatnonzero(in_run % longest == 0)
            sizes = np.diff(np.append(starts, len(at)))
            keep = likely[starts]
            member = np.repeat(keep, sizes)
            starts, sizes = starts[keep], sizes[keep]
            wins = hashes[member].view(np.int64)
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            rows = pa.array(owner[starts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[starts].view(np.int64)),
                    pa.array(hashes[starts].view(np.int64)),
                    pa.array(hashes[starts + sizes - 1].view(np.int64)),
                    pa.array(sizes.astype(np.int32)),
                    part.column("doc_id").take(rows),
                    part.column("doc_key").take(rows),
                    pa.array(at[starts].astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, wins),
                ],
                ["anchor", "w0", "w1", "n", "doc_id", "doc_key", "start", "wins"],
            )

    return run


_TILE = "anchor long, w0 long, w1 long, n int, doc_id long, doc_key long, start int, wins array<long>"
#: A tile's key: its first and last windows hold all its words, and its anchor is another hash of some of them: 128 bits at least.
_KEY = ["anchor", "w0", "w1", "n"]
#: The tiles of an anchor that many share are cut into so many parts.
SALTS = 16


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, spans array<struct<start, mask>>) of the documents that repeat a passage: bit i of mask says that the window
    starting at word start + i also starts in a document with a smaller id. doc_key is xxhash64 of the text.

    Documents with null ids or fewer words than ``window`` neither lose nor take anything.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), utf8().alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # about an anchor for 20 words of six bytes; eight cells for each keep chance hits at a few hundredths
    bits = min(MOST_BITS, max(16, int(size / 120 * 8).bit_length()))
    sketch = spark.sparkContext.broadcast(repeated_cells(rows, window, bits))
    tiles = materialize(spark, rows.mapInArrow(_tiles(window, bits, sketch), _TILE))
    keys = tiles.groupBy(*_KEY).agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("mx"), F.first("wins").alias("wins"))
    keys = materialize(spark, keys.withColumn("kid", F.monotonically_increasing_id()))
    anchors = keys.groupBy("anchor").agg(F.count("*").alias("k"), F.min("m").alias("am"), F.max("mx").alias("amx")).where("am < amx")
    # windows of tiles whose anchor has other tiles take the smallest document of all of these
    several = anchors.where("k > 1").select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("w0"), F.lit(SALTS)).cast("int"))
    spread = salted.join(several, ["anchor", "salt"]).select("kid", "m", F.expr("cast(anchor & 2147483647 as int)").alias("half"), F.posexplode("wins").alias("at", "w"))
    lowest = spread.groupBy("half", "w").agg(F.min("m").alias("wm"), F.max("m").alias("most")).where("wm < most").drop("most")
    lower = spread.join(lowest, ["half", "w"]).where("wm < m").groupBy("kid").agg(F.expr("bit_or(shiftleft(1L, at))").alias("lower"))
    known = keys.select("kid", *_KEY, "m", "mx").join(lower, "kid", "left").where("m < mx or lower is not null")
    # in a tile's first document the windows that other tiles hold earlier are covered, in its later documents all are
    mask = F.expr("if(m < doc_id, shiftleft(1L, n) - 1, coalesce(lower, 0L))")
    hits = tiles.select(*_KEY, "doc_id", "doc_key", "start").join(known.drop("kid", "mx"), _KEY).withColumn("mask", mask).where("mask <> 0")
    return hits.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        start, mask = s["start"], s["mask"] & (1 << 64) - 1
        while mask:
            i = (mask & -mask).bit_length() - 1
            edge[start + i] += 1
            edge[start + i + window] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


_WORD_AND_SPACE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without those words and the white space after each; the rest stays byte for byte."""
    head = text[: len(text) - len(text.lstrip(b" \t\n\r\x0b\x0c"))]
    return head + b"".join(w for w, g in zip(_WORD_AND_SPACE.findall(text), gone.tolist(), strict=True) if not g)


def _digest(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, gone, sha = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.split() if text else []
                n.append(len(words))
                removed = 0
                if spans:
                    flags = covered(len(words), spans, window)
                    removed = int(flags.sum())
                    words = [w for w, g in zip(words, flags.tolist(), strict=True) if not g]
                gone.append(removed)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return run


def _cut_texts(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                out.append(cut(text, covered(len(text.split()), spans, window)).decode() if spans else None if text is None else text.decode())
            names = [c for c in part.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(part.column(c) for c in names)], ["__new", *names])

    return run


def _with_spans(spark: SparkSession, docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(the documents that surely repeat nothing, the others with their ``__spans``, which may be null)."""
    spans = materialize(spark, repeated_spans(spark, docs, window))
    touched, clean = maybe_among(spark, spans.select(F.col("doc_key").alias("key")))(docs, F.xxhash64("text"))
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("doc_key").alias("__key"), F.col("spans").alias("__spans"))
    marked = touched.join(spans, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left").drop("__doc", "__key")
    return clean, marked


def removal_digest(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Null and empty texts have no words. Rows with a null id keep all words. Repeated rows are one document: each loses what the
    others lose. Texts are read whole, whatever their length. Other columns are ignored; an empty table gives an empty table.
    """
    clean, marked = _with_spans(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    rows = marked.select("doc_id", utf8().alias("text"), F.col("__spans").alias("spans"))
    rows = rows.unionByName(clean.select("doc_id", utf8().alias("text"), F.lit(None).cast(rows.schema["spans"].dataType).alias("spans")))
    return rows.mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, without repeated passages. A text that repeats nothing stays byte for byte; one of which
    nothing is left is dropped. ``docs`` must be a table that reads the same each time, since it is read twice."""
    clean, marked = _with_spans(spark, docs, window)
    names = [c for c in docs.columns if c != "text"]
    inner = marked.select(utf8().alias("text"), F.col("__spans").alias("spans"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    kinds = ", ".join(f"c{i} {inner.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    cut_ = inner.where("spans is not null").mapInArrow(_cut_texts(window), f"__new string{', ' + kinds if kinds else ''}").where(F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    done = cut_.select(*(F.col("__new").alias("text") if c == "text" else F.col(f"c{names.index(c)}").alias(c) for c in docs.columns))
    return clean.unionByName(marked.where("__spans is null").select(docs.columns)).unionByName(done)
