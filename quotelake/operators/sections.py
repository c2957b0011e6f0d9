"""The path of titles under which each line of a document stands.

A title closes the titles of its own level and below. Which ones are open at a line needs no stack that walks through the document: the title of a level is open
if it is the latest of its level and nothing that closes this level came after it. So a document is scanned by running maxima, in segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocabulary as V
from quotelake.operators.scans import SEGMENT, dealt, running_in

#: Levels: a chapter in Roman numerals, a numbered chapter whose numbering starts anew below it, numbered titles by depth, lettered titles, a group's heading in a table.
ROMAN, CHAPTER, FIRST, DEEPEST, LETTER, HEADING = 0, 5, 10, 80, 90, 990
LEVELS = (ROMAN, CHAPTER, *range(FIRST, DEEPEST + 1, 10), LETTER, HEADING)
_INDEX = r"^\s*((?:\d+(?:\.\d+)*\.?)|[IVX]+\.|[A-Z]\.)\s+(\S.*)$"


def letters(words: Column, least: int = 1) -> Column:
    """The words' runs of at least so many letters, in lower case."""
    return F.regexp_extract_all(F.lower(words), F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1))


def without_brackets(words: Column) -> Column:
    return F.regexp_replace(words, r"\([^)]*\)?", " ")


def is_capitals(title: Column) -> Column:
    """A chapter's title: in capitals besides brackets, with enough letters not to be a code."""
    bare = without_brackets(title)
    return (bare == F.upper(bare)) & (F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) >= V.CAPITAL_LETTERS)


def split_index(line: Column) -> tuple[Column, Column]:
    """A line's index (``4.2.``, ``IV.``, ``A.``; null if there is none) and the rest."""
    index = F.regexp_extract(line, _INDEX, 1)
    return F.nullif(index, F.lit("")), F.when(index != "", F.regexp_extract(line, _INDEX, 2)).otherwise(line)


def numbers_of(index: Column) -> Column:
    """``15.8.`` as [15, 8]; null for letters and Roman numerals."""
    return F.when(index.rlike(r"^\d+(?:\.\d+)*\.?$"), F.transform(F.split(F.regexp_replace(index, r"\.$", ""), r"\."), lambda x: x.try_cast("int")))


def title_level(index: Column, title: Column) -> Column:
    """Numbered titles by the count of their numbers, letters and Roman numerals below all of them, Roman numerals in capitals above; a title without index is like ``1.``."""
    depth = F.least(F.size(numbers_of(index)), F.lit(DEEPEST // 10)) * 10
    roman = index.rlike(r"^[IVX]+\.$") & (title == F.upper(title)) & is_capitals(title)
    return F.when(index.isNull(), F.lit(FIRST)).when(roman, F.lit(ROMAN)).when(index.rlike(r"^[A-Z]\.$|^[IVX]+\.$"), F.lit(LETTER)).otherwise(depth).cast("int")


def is_variant(label: Column) -> Column:
    """Does a row's label name only a variant of the service above it: a continuation, a bare band, at most two words with a meaning?"""
    bare = F.regexp_replace(F.regexp_replace(label, V.I + V.BAND, " "), V.I + r"\b(?:inclusiv|exclusiv|lei|leu|ron|euro?|usd|gbp|chf)\b", " ")
    words = F.filter(letters(without_brackets(label), 3), lambda w: ~w.isin(*V.EMPTY_WORDS))
    return label.rlike(r"^[a-zăâîșț(\[]") | label.rlike(r"^\s*[-–—•]\s*\S") | (F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) < 4) | (F.size(words) <= 2)


def heading_word(heading: Column) -> Column:
    """The last word with a meaning of a short heading; null for a long one."""
    bare = F.trim(without_brackets(heading))
    words = F.filter(letters(bare, 5), lambda w: ~w.isin(*V.EMPTY_WORDS))
    return F.when(F.size(F.split(bare, r"\s+")) <= V.SHORT_HEADING, F.try_element_at(words, F.lit(-1)))


def _behind(old: Column, new: Column) -> Column:
    """Is the first number in which they differ smaller in ``old``?"""
    pairs = F.filter(F.arrays_zip(old.alias("o"), new.alias("n")), lambda p: p["o"].isNotNull() & p["n"].isNotNull() & (p["o"] != p["n"]))
    return F.coalesce(F.get(pairs, F.lit(0))["o"] < F.get(pairs, F.lit(0))["n"], F.lit(False))


def section_paths(lines: DataFrame, document: str = "document", at: str = "at", kind: str = "kind", line: str = "line", segment: int = SEGMENT) -> DataFrame:
    """``lines`` with ``section``: the open titles from the outermost to the innermost, joined by " > "; null if none is open.

    ``kind`` says what a line is: ``title``, ``more`` (the second line of the title just before it, which is whole from its first line on), ``heading`` (of a group of rows), ``row`` (a line with a label of its own), and
    anything else for lines that only stand somewhere. ``at`` numbers a document's lines from 0.

    Besides opening and closing by level: a numbered title in capitals begins a new chapter; where numbering starts again at 1 below it, it becomes the
    chapter above; a row with an index closes the branch that its index has left behind; a row that names its own service closes a heading, unless it repeats the heading's
    word. A title that a row closed still counts as its level's latest when later rows look back. Null kinds and texts open and close nothing; repeated
    lines at one place don't see each other; an empty table gives none.
    """
    words, what = F.coalesce(F.col(line), F.lit("")), F.coalesce(F.col(kind), F.lit(""))
    more = lines.where(F.col(kind) == "more").groupBy(F.col(document).alias("__d"), (F.col(at) - 1).alias("__p")).agg(F.max(line).alias("__more"))
    whole = lines.join(more, F.col(document).eqNullSafe(F.col("__d")) & (F.col(at) == F.col("__p")), "left")
    index, title = split_index(words)
    read = whole.withColumns({"__index": index, "__title": F.concat_ws(" ", F.trim(title), F.when(what == "title", F.col("__more"))), "__no": numbers_of(index)})
    is_title, is_row, capitals = what == "title", what == "row", is_capitals(F.col("__title"))
    single = F.size("__no") == 1
    level = F.when(is_title, title_level(F.col("__index"), F.col("__title"))).when(what == "heading", F.lit(HEADING))
    read = read.withColumns({"__level": level, "__cut": F.when(is_title & single & capitals, F.lit(CHAPTER)).when(is_title, level)})
    read = read.withColumn("__own", F.struct(F.col(at).alias("at"), F.col("__level").alias("level"), F.when(what == "heading", words).otherwise(F.col("__title")).alias("title"), F.col("__no").alias("no")))
    of_level = {f"__set_{k}": F.when(F.col("__level") == k, F.col("__own")) for k in LEVELS if k != CHAPTER}
    cut_at = {f"__cut_{k}": F.when(F.col("__cut") <= k, F.col(at)) for k in LEVELS}
    state = running_in(dealt(read, [document], at, segment), at, {**of_level, **cut_at})

    def is_open(k: int) -> Column:
        return F.coalesce(F.col(f"__set_{k}.at") >= F.coalesce(F.col(f"__cut_{k}"), F.lit(-1)), F.lit(False))

    before = F.col(f"__set_{FIRST}")
    restarts = ((is_title & ~capitals) | is_row) & single & (F.get("__no", F.lit(0)) == 1)
    promoted = F.coalesce(restarts & is_open(FIRST) & before["no"].isNotNull() & is_capitals(before["title"]), F.lit(False))
    closes = F.lit(None).cast("int")
    for k in reversed(range(FIRST, DEEPEST + 1, 10)):
        left = is_row & F.col("__no").isNotNull() & (F.size("__no") * 10 <= k) & is_open(k) & F.col(f"__set_{k}.no").isNotNull() & _behind(F.col(f"__set_{k}.no"), F.col("__no"))
        closes = F.when(left & (~promoted if k == FIRST else F.lit(True)), F.lit(k)).otherwise(closes)
    word = heading_word(F.col(f"__set_{HEADING}.title"))
    ends = is_row & is_open(HEADING) & ~is_variant(words) & ~F.coalesce(F.array_contains(letters(words), word), F.lit(False))
    chapter = F.struct(F.col(at).alias("at"), F.lit(CHAPTER).alias("level"), before["title"].alias("title"), before["no"].alias("no"))
    state = state.withColumns({"__promoted": promoted, "__closes": closes, "__ends": ends, "__chapter": F.when(promoted, chapter)})
    second = {f"__shut_{k}": F.when(F.col("__closes") <= k, F.col(at)) for k in LEVELS if k not in (ROMAN, CHAPTER)}
    second |= {"__raised": F.col("__chapter"), "__moved": F.when(F.col("__promoted"), F.col(at)), "__ended": F.when(F.col("__ends"), F.col(at))}
    state = running_in(state, at, second)

    def now(name: str, own: Column) -> Column:
        return F.greatest(F.col(name), own)

    names = []
    for k in LEVELS:
        latest = now("__raised", F.col("__chapter")) if k == CHAPTER else now(f"__set_{k}", of_level[f"__set_{k}"])
        gone = [now(f"__cut_{k}", cut_at[f"__cut_{k}"])]
        if k not in (ROMAN, CHAPTER):
            gone.append(now(f"__shut_{k}", second[f"__shut_{k}"]))
        gone += [now("__moved", second["__moved"])] if k == FIRST else [now("__ended", second["__ended"])] if k == HEADING else []
        last = F.greatest(F.lit(-1), F.lit(-1), *gone)
        names.append(F.when(latest["at"] >= last, latest["title"]))
    return state.select(*lines.columns, F.nullif(F.concat_ws(" > ", F.array_compact(F.array(*names))), F.lit("")).alias("section"))
