"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIM signs. A trigram's vector binds (multiplies) its letters' vectors, permuted (turned) by
their position: ``turn(turn(a)) * turn(b) * c``. A text's vector bundles (adds) its trigrams' vectors; a language's prototype
bundles those of its learned texts. A text has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import remainder, slices, utf8

DIM = 512
SEED = 7
#: Signs of the alphabet: 0 between words, 1 to 26 for a to z, 27 to 63 for other letters by their code.
SIGNS = 64
GRAMS = SIGNS**3
#: Prototypes are learned from about so many documents, those with the smallest hashes of their ids.
MOST_ROWS = 40_000
UNKNOWN = "und"
#: Bytes of text that are counted together.
_CHUNK = 1 << 20


def letter_vectors() -> np.ndarray:
    """Random signs for each letter; fixed by SEED."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SIGNS, DIM))


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    twice, once = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return twice[grams // SIGNS**2] * once[grams // SIGNS % SIGNS] * v[grams % SIGNS]


_signs: list[np.ndarray] = []


def _sign_table() -> np.ndarray:
    """The sign of each code point below 2**16, after lower-casing."""
    if not _signs:
        table = np.zeros(1 << 16, np.uint8)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SIGNS - 27)
        _signs.append(table)
    return _signs[0]


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, trigram) of each trigram of signs; runs of other characters count as one 0, and so do both ends."""
    codes = [np.frombuffer((t or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    edge = np.zeros(1, np.uint32)
    flat = np.concatenate([x for c in codes for x in (edge, c, edge)]) if codes else edge
    owner = np.repeat(np.arange(len(codes)), [len(c) + 2 for c in codes])
    sign = np.zeros(len(flat), np.int32)
    low = flat < 1 << 16
    sign[low] = _sign_table()[flat[low]]
    for c in np.unique(flat[~low]):
        sign[flat == c] = 27 + int(c) % (SIGNS - 27) if chr(c).isalpha() else 0
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != 0) | (sign[:-1] != 0) | (owner[1:] != owner[:-1])
    sign, owner = sign[keep], owner[keep]
    if len(sign) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (sign[:-2] * SIGNS + sign[1:-1]) * SIGNS + sign[2:]
    inside = owner[:-2] == owner[2:]
    return owner[:-2][inside], gram[inside].astype(np.int64)


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for part in slices(batches, "text", _CHUNK):
        owner, gram = trigrams(part.column("text").to_pylist())
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs):
            at = langs[owner] == lang
            totals.setdefault(lang, np.zeros(GRAMS, np.int64))
            totals[lang] += np.bincount(gram[at], minlength=GRAMS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])


def learn(docs: DataFrame, most: int = MOST_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from text and lang of rows whose crc32(doc_id as text) mod 4 isn't 2 and whose lang and text aren't null."""
    own = docs.where("lang is not null and text is not null").where(remainder(F.col("doc_id"), 4) != 2)
    share = min(1.0, most / max(1, own.count()))
    order = F.xxhash64(F.col("doc_id"), F.lit("language")).bitwiseAND(F.lit((1 << 52) - 1))
    rows = own.where(order < int(share * (1 << 52)) + 1).select("lang", utf8().alias("text"))
    counts = rows.mapInArrow(_count_batches, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    prototypes = np.zeros((len(langs), DIM))
    for i, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        at, n = mine["gram"].to_numpy(), mine["n"].to_numpy(np.float64)
        for a in range(0, len(at), 8192):
            prototypes[i] += n[a : a + 8192] @ trigram_vectors(at[a : a + 8192])
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, np.divide(prototypes, lengths, out=prototypes, where=lengths > 0)


def text_vectors(owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """The bundled vector of each of n texts: counts of the trigrams at hand times their vectors (whole numbers, exact in float32)."""
    present = np.zeros(GRAMS, bool)
    present[gram] = True
    at = np.flatnonzero(present)
    place = np.zeros(GRAMS, np.int64)
    place[at] = np.arange(len(at))
    out = np.zeros((n, DIM), np.float32)
    if not len(at):
        return out
    vectors = trigram_vectors(at).astype(np.float32)
    rows = max(1, (4 << 20) // len(at))
    bounds = np.searchsorted(owner, np.arange(0, n + rows, rows))
    for k, first in enumerate(range(0, n, rows)):
        a, b = bounds[k], bounds[k + 1]
        some = min(rows, n - first)
        counts = np.bincount((owner[a:b] - first) * len(at) + place[gram[a:b]], minlength=some * len(at))
        out[first : first + some] = counts.reshape(some, len(at)).astype(np.float32) @ vectors
    return out


def _predict(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = model.value
        for part in slices(batches, "text", _CHUNK):
            owner, gram = trigrams(part.column("text").to_pylist())
            n = part.num_rows
            vectors = text_vectors(owner, gram, n).astype(np.float64)
            lengths = np.linalg.norm(vectors, axis=1)
            lettered = np.zeros(n, bool)
            lettered[owner] = True  # a text without a letter has one sign 0, or two: no trigram
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if langs:
                cosines = vectors @ prototypes.T / np.where(lengths > 0, lengths, 1)[:, None]
                best = cosines.argmax(axis=1)
                names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                scores = np.where(lettered, cosines[np.arange(n), best].clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def predict_languages(spark: SparkSession, docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """op8's rows: doc_id, held_out, lang_pred, score (the cosine). Null texts and texts without a letter are ``und`` with score 0, and
    so are all if nothing could be learned. A null doc_id counts as an empty text where its remainder is taken; repeated rows are
    predicted alike; other columns are ignored; an empty table gives an empty table. Very long texts are counted whole.

    Prototypes (languages x DIM) are broadcast: their size follows the number of languages only.
    """
    model = spark.sparkContext.broadcast(learn(docs, most))
    found = docs.select("doc_id", utf8().alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
