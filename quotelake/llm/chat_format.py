"""Chat formatting: conversations rendered by a compiled template, with the spans a model should learn to generate.

Control strings that a text happens to hold are escaped: ESC ``c`` follows their first character, and ESC itself becomes ESC ``e``.
So the only control strings in the output are the template's, and the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.templates import compile_template

#: Strings with a meaning for this or another common chat format.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
ESC = "\x1b"
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{{ '\\n' }}{% endfor %}"
)
_CONTROL = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROLS)) + "))(.)", re.S)
_ESCAPED = re.compile(ESC + "([ce])")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(r"\1" + ESC + "c", (text or "").replace(ESC, ESC + "e"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESC if m[1] == "e" else "", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in order of turn (null first), then role, then text. Null roles and texts are empty."""
    empty = F.lit("")
    one = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns"))


def _format_batches(template: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        for batch in batches:
            out = [render({"messages": turns}) for turns in batch.column("turns").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in out]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([t for t, _ in out], pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    return run


def format_conversations(spark: SparkSession, rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, end>>) of conversations given by rows (conv_id, turn, role, text).

    Spans count code points and cover what generation blocks wrote. Rows with a null conv_id are one conversation; repeated rows
    are repeated turns; other columns are ignored; an empty table gives an empty table. A conversation is one row, so it must fit
    a task, as any document must; no other grouping takes place.
    """
    return conversations(rows).mapInArrow(_format_batches(template), "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            row = (
                len(turns),
                hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                len(loss),
                hashlib.sha256(loss.encode()).hexdigest(),
                len(text),
            )
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """op6's rows, all read back from the formatted text."""
    return format_conversations(spark, rows).mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
