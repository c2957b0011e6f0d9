"""Best-fit packing by minimum bin slack: documents' tokens in as few sequences of a fixed capacity as the heuristic finds.

Only how many pieces have each length matters for the packing, and there are at most ``capacity`` lengths, so the plan is made from a
histogram: the longest piece left opens a sequence, a subset-sum over the available lengths, with one bitset of reachable fillings a step, finds the
fullest combination with it, and the combination is removed as often as its pieces last (as long as it can be taken it stays the fullest: pieces
only get fewer). The plan says which of the pieces of a length (by their number among those) go to which sequences. Its size and
the time to make it are bounded by the capacity and don't grow with the documents. Numbers come from counts of each task's pieces, so no task
and no driver sees all pieces, and a length that a third of all pieces have is spread like any other.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.llm.common import batches_of, gathered, materialize, slices

CAPACITY = 2048
END = 0
#: An Arrow batch of texts has so many rows at most.
ROWS = 4000
#: Texts are encoded by so many bytes at a time, so that each different stretch among them is encoded once; so many stretches in one call.
TEXTS, TOGETHER = 16 << 20, 1 << 15
#: A space between two characters that aren't white space begins a pre-token of a byte-level model, whatever stands around.
SAFE = re.compile(r"(?<=\S) (?=\S)")
UNSAFE = r"(?:^|[\pZ\s\x0b\x1c-\x1f\x85]) | (?:[\pZ\s\x0b\x1c-\x1f\x85]|$)"
#: Stretches of these letters are one pre-token each; a byte-level model writes a space as SPACE.
LETTERS, SPACE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$", "\u0120"
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids by the tokenizers library, for byte-level models. No merge crosses pre-tokens, and a safe space begins one, so for a batch of texts the library
    is asked once for each different stretch between safe spaces: for many stretches in one text, whose ids are told apart by the ids that begin with a space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(words.values()) + 1, bool)
        self.spaced[[i for word, i in words.items() if word.startswith(SPACE)]] = True
        # a stretch of letters is one pre-token, so only its bytes need writing as the model's letters
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = np.arange(256, dtype=np.uint16)
        for c in map(chr, range(0xC0, 0x250)):
            self.written[list(c.encode())] = list(map(ord, bytes_of.pre_tokenize_str(c)[0][0]))
        self.written[ord("_")] = ord(SPACE)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        runs = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *runs]), np.fromiter(map(len, runs), np.int64, len(runs))

    def _joined(self, parts: list[str], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that each come after a safe space; ``letters``: of parts that hold nothing else."""
        found = []
        for i in range(0, len(parts), TOGETHER):
            some = parts[i : i + TOGETHER]
            tokenizer, text = self.tokenizer, " " + " ".join(some)
            if letters:
                tokenizer, text = self.merges, self.written[np.frombuffer(f"_{' _'.join(some)}".encode(), np.uint8)].tobytes().decode("utf-16-le")
            found.append(np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        return ids, np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), UNSAFE)).to_pylist()
        marked = [t.replace(" ", "\0") if ok else SAFE.sub("\0", t) for t, ok in zip(texts, plain, strict=True)]
        split = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        bounds, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        of, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = np.zeros(len(of), bool)
        first[bounds[:-1]] = True
        values, starts, counts, at = [], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), 0
        letters = pc.match_substring_regex(coded.dictionary, LETTERS).to_numpy(zero_copy_only=False)
        spaces = np.array([" " in p or p[:1].isspace() or p[-1:].isspace() for p in different], bool) if not all(plain) else np.zeros(len(different), bool)
        for where, work in (
            (first, self._alone),
            (~first & letters[of], lambda parts: self._joined(parts, letters=True)),
            (~first & ~letters[of] & ~spaces[of], self._joined),
            (~first & spaces[of], lambda parts: self._alone([f" {p}" for p in parts])),
        ):
            codes = np.flatnonzero(np.bincount(of[where], minlength=len(different)))
            found, sizes = work([different[c] for c in codes])
            place, n = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
            place[codes], n[codes] = at + np.cumsum(sizes) - sizes, sizes
            starts[where], counts[where] = place[of[where]], n[of[where]]
            values.append(found)
            at += len(found)
        flat = gathered(np.concatenate(values), starts, counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
        out = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i, t in enumerate(texts):  # these can't be marked
            if "\0" in t:
                out[i] = self._alone([t])[0]
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for a Python worker, whatever number of tasks it runs."""
    return Encoder(path)


def cuts(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document of so many ids start, and last its length: only the first piece may be short."""
    return [0, *range(length % capacity or capacity, length + 1, capacity)]


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", TEXTS):
            rows = []
            texts = [t.decode("utf-8", "replace") if t else "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).batch(texts), strict=True):
                ids = np.append(ids, end).astype("<u4")
                places = cuts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(places, places[1:], strict=False)):
                    rows.append((key, piece, a, b - a, ids[a:b].tobytes(), part, int(seen[b - a])))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return run


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """The documents' ids (little-endian unsigned 32 bits, ``end`` after each document) in pieces of at most ``capacity``; part and nth number the pieces of a length."""
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(_pieces(path or tokenizer_path(), capacity, end), PIECES)


def fullest(counts: np.ndarray | list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of available lengths that fills ``room`` as far as possible; among equals the one with longer pieces.

    The bitset after a step has bit s set if some of the lengths so far, none more often than it is available, have sum s.
    """
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        times = 1
        while left > 0:  # 1, 2, 4 ... copies at once reach each number of copies
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & (1 << room + 1) - 1
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:  # not reachable without
            at -= length * times
            taken[length] = taken.get(length, 0) + times
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, times in a sequence, first sequence, first offset): the pieces of ``length`` from the first number on go, ``times`` to a sequence, to the sequences
    from the first on, until the next line of that length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, lines, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        chosen = dict(fullest(left, capacity - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        repeats, offset = min(int(left[length]) // times for length, times in chosen.items()), 0
        for length, times in sorted(chosen.items(), reverse=True):
            lines.append((length, int(used[length]), times, sequence, offset))
            used[length] += times * repeats
            left[length] -= times * repeats
            offset += length * times
        sequence += repeats
    return lines


def place(spark: SparkSession, rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (length, part, nth and others; read several times, so give a written table) with sequence_id and offset instead of part and nth."""
    counted = rows.groupBy("part", "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = materialize(spark, counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    # at most one row for each length reaches the driver
    lines = plan({r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("__n")).collect()}, capacity)
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lines, length, number = shared.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        line = np.searchsorted(lines[:, 0] * (1 << 48) + lines[:, 1], length * (1 << 48) + number, "right") - 1
        _, first, times, sequence, offset = lines[line].T
        return pd.DataFrame({"sequence_id": sequence + (number - first) // times, "offset": offset + (number - first) % times * length})

    numbered = rows.join(counted.drop("__n"), ["part", "length"])
    at = placed(F.col("length"), F.col("nth") + F.col("__before"))
    return numbered.withColumn("__at", at).select(*[c for c in rows.columns if c not in ("part", "nth")], "__at.sequence_id", "__at.offset")


def _written(spark: SparkSession, found: DataFrame) -> DataFrame:
    with batches_of(spark, ROWS):
        return materialize(spark, found)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows and rows with a null id are packed each for itself; ties in length are
    packed as they come; bytes that aren't UTF-8 are read as U+FFFD; other columns aren't read; an empty table gives none. A length that more pieces have than
    others is numbered by tasks, so no task holds it whole.
    """
    return place(spark, _written(spark, pieces(docs, capacity=capacity, path=path, end=end)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids: the pieces of a sequence one after another, at most ``capacity`` ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))


def packing_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op13's rows: the checksum stands for the ids, so only numbers are shuffled."""
    rows = _written(spark, pieces(docs))
    small = rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return place(spark, small)
