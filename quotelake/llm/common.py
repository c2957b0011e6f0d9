"""Helpers shared by the training-data operators: shared storage, batches of whole texts, rolling hashes, row numbering."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: A bitmap that is broadcast has at most so many bits for each of its rows: 2**28 bits are 32 MB.
MOST_BITS = 28
#: A bitmap of Spark's bitmap_construct_agg holds so many bits.
_BUCKET = 32_768
#: An odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset the context's own checkpoint folder is taken, and a
    temporary folder only in local mode (tests), where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quotelake-")
    context.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have 1,000 rows at most: they exist twice in the JVM and twice in Python, for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches have ``rows`` rows at most in what Spark runs meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes; Arrow then hands them to Python without decoding."""
    return F.col(column).cast("binary")


def remainder(column: Column, by: int) -> Column:
    """crc32 of the value as text modulo ``by``; a null counts as an empty text (remainder 0)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(by)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of ``column`` (or one longer value)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at a task's end: Spark keeps Python workers waiting for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (``bytes.split`` splits at exactly these six bytes) and their counts."""
    words = [t.split() if t else [] for t in texts]
    return words, np.fromiter(map(len, words), np.int64, len(words))


def word_hashes(words: list[list[bytes]], total: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), U64, total)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that hashes order and bucket at random."""
    x = x + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=U64))
    return _powers[0][:n], _powers[1][:n]


def rolling(hashes: np.ndarray, widths: Iterable[int]) -> list[np.ndarray]:
    """For each width, the polynomial hash of each run of so many consecutive items."""
    n = len(hashes)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=sums[1:], dtype=U64)
    return [(sums[w:] - sums[: n + 1 - w]) * down[: n + 1 - w] if n >= w else np.zeros(0, U64) for w in widths]


def global_index(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its gapless 0-based rank in ``order``: ranges are sorted apart, then offset by the counts before them.

    No task sees more than one range; the driver sees one count for each range.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = F.monotonically_increasing_id()
    placed = materialize(
        spark,
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns(
            {"__part": F.spark_partition_id(), "__at": local.bitwiseAND(F.lit((1 << 33) - 1))}
        ),
    )
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "__part int, __base long")
    return placed.join(F.broadcast(table), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def bitmap(cells: DataFrame, size: int) -> bytes:
    """The cells (column ``cell``, numbers below ``size``) as a bitmap of ``size`` bits, put together from pieces that Spark aggregates."""
    maps = cells.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits"))
    out = bytearray(size // 8)
    for bucket, piece in maps.toLocalIterator():
        at = (bucket - 1) * _BUCKET // 8
        out[at : at + len(piece)] = piece[: max(0, len(out) - at)]
    return bytes(out)


def maybe_among(spark: SparkSession, keys: DataFrame) -> Callable[[DataFrame, Column], tuple[DataFrame, DataFrame]]:
    """A function that parts a table by a 64-bit hash: (rows whose hash may be among ``keys`` (column ``key``), rows whose hash surely isn't).

    The keys' leading bits make a bitmap of at most 2**MOST_BITS bits, in pieces that are broadcast and looked up by a hash join, in the JVM: rows that surely have no partner
    needn't be shuffled to find that out. With more keys than bits it only lets more rows through.
    """
    bits = min(MOST_BITS, max(16, (16 * keys.count()).bit_length()))
    cell = lambda c: F.shiftrightunsigned(c, 64 - bits)
    cells = keys.select(cell(F.col("key")).alias("cell"))
    pieces = materialize(spark, cells.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("__bits")))

    def part(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        placed = df.withColumn("__cell", cell(key))
        met = placed.join(F.broadcast(pieces), F.expr("bitmap_bucket_number(__cell + 1)") == F.col("__bucket"), "left")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__cell + 1) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        found = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__cell + 1) % 8 as int))")) != 0, F.lit(False))
        kept = [F.col(f"`{c}`") for c in df.columns]
        return met.where(found).select(*kept), met.where(~found).select(*kept)

    return part


class Memo:
    """Short texts to runs of integers, each different text worked out once; starts anew beyond ``most`` texts or 16 * ``most`` integers.

    ``work`` takes a list of different texts and returns their runs one after another, and the length of each.
    """

    def __init__(self, work: Callable[[list[str]], tuple[Iterable[int], Iterable[int]]], most: int = 1 << 19) -> None:
        self.work, self.most = work, most
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ends, self.values = array("q", [0]), array("i")

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's run starts in ``values``, and its length."""
        if len(self.codes) > self.most or len(self.values) > 16 * self.most:
            self._clear()
        at = list(map(self.codes.get, texts))
        if None in at:
            new = list(dict.fromkeys(t for t, i in zip(texts, at, strict=True) if i is None))
            values, counts = self.work(new)
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            self.values.frombytes(np.ascontiguousarray(values, np.int32).tobytes())
            self.ends.frombytes((self.ends[-1] + np.cumsum(np.asarray(counts, np.int64))).tobytes())
            at = list(map(self.codes.__getitem__, texts))
        codes, ends = np.array(at, np.int64), np.frombuffer(self.ends, np.int64)  # a view: it must be gone before the array grows
        return ends[codes], ends[codes + 1] - ends[codes]

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``texts`` one after another, and the length of each."""
        starts, counts = self.places(texts)
        return gathered(np.frombuffer(self.values, np.int32), starts, counts), counts


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``starts`` and have ``counts`` items, one after another."""
    placed = np.cumsum(counts)
    total = int(placed[-1]) if len(placed) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - placed + counts).astype(kind), counts)
    at += np.arange(total, dtype=kind)
    return values[at]
