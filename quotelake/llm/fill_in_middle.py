"""Fill-in-middle: texts cut at two places into prefix, middle and suffix and put in another order, so that a model learns to fill gaps.

The tokenizers library's ``Split`` pre-tokenizer, with each match isolated, gives the places where a text may be cut, as code points; nothing is
trained. A text's offsets become one array: its length is the number of units, its entries at the drawn ranks are the cuts. A space is always a
unit of its own, so the pre-tokenizer is asked once for each different stretch between spaces and the offsets are moved into place.

The draws are hashes of the document's id, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import Memo, slices

#: What a cut may not split: runs of letters; every other code point stands alone.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are changed, and of a hundred of those so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
#: Long texts are looked at in stretches of about so many code points.
STRETCH = 1 << 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output binary"


class Cutter:
    """Offsets of a text's units by the library's pre-tokenizer."""

    def __init__(self, unit: str = UNIT) -> None:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(unit), "isolated")

        def starts(texts: list[str]) -> tuple[list[int], list[int]]:
            runs = [[a for _, (a, _) in split.pre_tokenize_str(t)] for t in texts]
            return list(chain.from_iterable(runs)), list(map(len, runs))

        self.memo = Memo(starts)

    def offsets(self, text: str) -> np.ndarray:
        """Where each unit starts, in code points, and last the text's length. Lone surrogates stand for bytes that aren't UTF-8: one unit each."""
        found, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STRETCH)
            end = len(text) if end < 0 else end
            parts = text[at:end].split(" ")
            try:
                units, counts = self.memo.runs(parts)
            except UnicodeEncodeError:  # the library takes no lone surrogates
                units, counts = self.memo.runs([p.encode("utf-8", "replace").decode() for p in parts])
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            starts = at + np.cumsum(sizes + 1) - sizes - 1
            starts_of = np.concatenate([np.repeat(starts, counts) + units, starts[1:] - 1])  # each unit, and the space before each stretch but the first
            starts_of.sort()
            found.append(starts_of)
            if end < len(text):
                found.append(np.array([end]))  # the space that ended the stretch
            at = end + 1
        return np.concatenate([*found, np.array([len(text)])]).astype(np.int64)


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 from the id (null: as an empty text) and the seed."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def reorder(text: str, key: object, cutter: Cutter, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text. Forms: ``plain``, ``psm`` and ``spm`` (suffix first)."""
    offsets = cutter.offsets(text)
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= CHANGED or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(offsets[rank]) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: bytes, form: str) -> bytes:
    """The text again from an output and its form. No part of a changed text holds a mark, and a mark's first character occurs in none but there."""
    if form == "plain":
        return output
    first, second, middle = output[len(PREFIX) :].replace(MIDDLE.encode(), PREFIX.encode()).replace(SUFFIX.encode(), PREFIX.encode()).split(PREFIX.encode())
    return (first + middle + second) if form == "psm" else (second + middle + first)


def _reordered(seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in slices(batches, "text"):
            rows = [
                reorder("" if t is None else t.decode("utf-8", "surrogateescape"), k, cutter, seed)
                for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            n, form, a, b, output = zip(*rows, strict=True)
            output = [o.encode("utf-8", "surrogateescape") for o in output]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(output, pa.binary())],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def _restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "output"):
        texts = [rebuild(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: key, n (units), form, prefix_chars and middle_chars (null if plain), output (UTF-8 bytes).

    Null texts are empty texts: no unit, plain. A null key draws as an empty one; rows with one key draw alike, whatever their texts, and
    repeated rows give repeated rows. Draws of one rank (ties) make an empty middle. Bytes that aren't UTF-8 are units of their own and come back as
    they were. Other columns of ``docs`` aren't read, so their names can't clash; an empty table gives none. Nothing is shuffled; a task holds one
    text and its offsets, 8 bytes a unit.
    """
    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(_reordered(seed), f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (columns form and output, and others) with ``restored``: the text rebuilt from them alone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(_restored, f"{fields}, restored binary")


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """op12's rows."""
    rows = restore(fill_in_middle(docs))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
