"""Whitening, fill-in-middle and packing: brute force, exact round trips and hard cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelake.llm import fill_in_middle, packing, whitening
from quotelake.llm.common import Memo

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x int, key int, n int, whitened int"
DOCS = "doc_id long, text string, lang string, n int, form int, part int, nth int, output int, length int"
ODD = [(1, None), (2, ""), (3, " \t\n  "), (None, "a b c"), (None, "a b c"), (4, "x" * 300_000), (5, "é 日本 \U0001f600 don't"), (5, "é 日本 \U0001f600 don't"), (6, "has <P> mark"), (7, "line\nline\r\n  two  spaces ")]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0, 0) for i, v in rows], EMBEDDINGS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0, 0, 0, 0, 0, 0) for i, t in rows], DOCS)


# --- whitening


def plain_whitening(rows, components=16):
    """All of it in plain NumPy over the rows that may stay."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    grid = [(i, np.floor(64 * v).astype(np.int64) + 1_000_000) for i, v in good]
    once = np.array(sorted({tuple(x) for _, x in grid}))
    n, sums = len(once), once.sum(axis=0)
    centred = (once * n - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    found = {}
    for i, x in grid:
        z = ((x * n - sums) / n) @ axes / np.sqrt(values)
        found[i] = (n, int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))), z)
    return found, values / np.trace(centred.T @ centred / n)


def test_whitening_equals_plain_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * np.linspace(3, 0.5, 20)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot vector counts once
    rows += [(-1, None), (-2, [1.0] * 19 + [float("nan")]), (-3, [1.0] * 19 + [float("-inf")]), (-4, [1.0] * 19 + [None])]
    want, explained = plain_whitening(rows)
    got = whitening.whiten(spark, vectors(spark, rows).repartition(7)).collect()
    assert len(got) == 16 * 700 and {r.vec_id for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, z = want[r.vec_id]
        z = z[r.component - 1]
        s = sign.setdefault(r.component, np.sign(z * r.whitened))
        assert (r.n, r.deviation) == (n, deviation) and abs(s * r.whitened - z) < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_hard_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (None, [4.0, 2.0]), (3, []), (4, [5.0]), (5, [3e38, 1.0]), (6, [1.0, 2.0])]
    got = whitening.whiten(spark, vectors(spark, rows)).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert set(by) == {(i, c) for i in (1, 2, None, 6) for c in (1, 2)} | {(4, 1)}  # an entry beyond a long counts as non-finite
    assert by[1, 1].n == 3 and by[4, 1].n == 1
    assert by[1, 2].whitened is None and by[4, 1].whitened is None and by[4, 1].identity_error is None  # no variance there
    assert by[1, 1].identity_error < 1e-9 and by[1, 1].explained == pytest.approx(1) and by[4, 1].explained == 0
    assert by[1, 1].deviation == (3 * 64 - 64 * 7) ** 2 and by[1, 1].whitened == by[6, 1].whitened


def test_whitening_of_nothing(spark):
    assert whitening.whiten(spark, vectors(spark, [])).collect() == []
    assert whitening.whiten(spark, vectors(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@given(st.lists(st.lists(st.integers(-(1 << 61), 1 << 61), min_size=3, max_size=3), min_size=1, max_size=5), st.sampled_from([1, 1 << 20]))
def test_deviations_are_exact(rows, spread):
    x = np.array(rows, np.int64) // (1 << 61) if spread == 1 else np.array(rows, np.int64) // spread
    n, sums = len(rows), [int(s) for s in x.astype(object).sum(axis=0)]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_sums_are_exact_beyond_doubles(spark):
    big = [(1 << 61) + 1, -(1 << 61) + 3]
    rows = spark.createDataFrame([(big,)] * 9, "x array<long>").repartition(3)
    assert whitening.exact_sums(rows) == {2: (9, [9 * v for v in big])}


# --- fill in the middle


def plain_fim(key, text):
    """The contract over Python's own regular expressions."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z\n<PSM>é日\U0001f600\0"), max_size=60), st.integers(-5, 10**12))
def test_fill_in_middle_equals_plain_expressions(text, key):
    cutter = fill_in_middle.Cutter()
    found = fill_in_middle.reorder(text, key, cutter)
    assert found == plain_fim(key, text)
    assert fill_in_middle.rebuild(found[4].encode(), found[1]) == text.encode()


def test_offsets_of_long_texts_in_stretches(monkeypatch):
    cutter = fill_in_middle.Cutter()
    text = "one two, three  four\nfive " * 40 + "x" * 90
    whole = cutter.offsets(text).tolist()
    monkeypatch.setattr(fill_in_middle, "STRETCH", 7)
    assert cutter.offsets(text).tolist() == whole == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]


def test_fill_in_middle_rows(spark):
    rows = ODD + [(100 + i, f"Some text, number {i}.\nWith <two> lines") for i in range(200)]
    docs = documents(spark, rows).repartition(5)
    got = fill_in_middle.fill_in_middle_digest(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, *plain_fim(k, t or "")[:4], sha(plain_fim(k, t or "")[4]), sha(t or "")) for k, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle_digest(docs.limit(0)).collect() == []


def test_bytes_that_are_no_text_come_back(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("cast(x'4120ff42e2209f3c503e43' as string)").alias("text"))
    docs = docs.withColumn("text", F.expr("cast(replace(hex(text), '3C503E', '3C513E') as string)")).withColumn("text", F.expr("cast(unhex(text) as string)"))
    got = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs)).collect()
    assert {bytes(r.restored) for r in got} == {bytes.fromhex("4120ff42e2209f3c513e43")} and {r.n for r in got} == {11} and len({r.form for r in got}) > 1


# --- packing


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    return packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())


_TEXT = st.text(alphabet=st.sampled_from("abé1 ñɏ× \n\t日'\x85\x1c\0​.!_"), max_size=40) | st.lists(st.sampled_from(["ab", "a.b", "é", " ", "  ", "don't", "\n"]), max_size=12).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(_TEXT | st.just("a <|endoftext|> b"), max_size=6), together=st.sampled_from([1, 2, 1 << 15]))
def test_ids_equal_the_library(encoders, texts, together):
    own, library = encoders
    before, packing.TOGETHER = packing.TOGETHER, together
    try:
        assert [ids.tolist() for ids in own.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        packing.TOGETHER = before


def test_memo_forgets_and_stays_right():
    asked = []
    memo = Memo(lambda texts: asked.extend(texts) or ([ord(c) for t in texts for c in t], list(map(len, texts))), most=3)
    for texts in (["a", "b", "a"], ["c", "d", "", "a"], ["a", "ee"], []):
        values, counts = memo.runs(texts)
        assert values.tolist() == [ord(c) for t in texts for c in t] and counts.tolist() == [len(t) for t in texts]
    assert asked == ["a", "b", "c", "d", "", "a", "ee"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12), st.integers(0, 14))
def test_fullest_combination_equals_brute_force(counts, room):
    counts = [0, *counts]
    sums = {0}
    for length, n in enumerate(counts):
        for _ in range(n):
            sums |= {s + length for s in sums}
    chosen = packing.fullest(counts, room)
    assert sum(length * n for length, n in chosen) == max(s for s in sums if s <= room)
    assert all(0 < n <= counts[length] for length, n in chosen)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), max_size=10))
def test_plan_places_every_piece_once(counts):
    lines = sorted(packing.plan(counts, 24))
    used = {}
    for i, (length, first, times, sequence, offset) in enumerate(lines):
        last = lines[i + 1][1] if i + 1 < len(lines) and lines[i + 1][0] == length else counts[length]
        for number in range(first, last):
            used.setdefault(sequence + (number - first) // times, []).append((offset + (number - first) % times * length, length))
    placed = [length for parts in used.values() for _, length in parts]
    assert {length: placed.count(length) for length in counts} == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 24
    assert sorted(used) == list(range(len(used)))


def test_plan_meets_known_optima():
    assert 1 + max(line[3] for line in packing.plan({k: 1 for k in range(1, 2048)}, 2048)) == 1024  # k with 2048 - k
    assert 1 + max(line[3] for line in packing.plan({1: 10**9, 2: 5, 2047: 10**6}, 2048)) == -(-(10**9 + 10 + 2047 * 10**6) // 2048)


def test_plan_stays_small_however_many_pieces():
    few, many = packing.plan({k: 3 for k in range(1, 2049)}), packing.plan({k: 3_000_000 for k in range(1, 2049)})
    assert len(many) < 2 * 2048 * 10 and len(few) < 2 * 2048 * 10


def test_packing_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    long_text = "The quick brown fox, jumping over 13 lazy dogs. " * 900
    rows = ODD + [(50, long_text), (51, long_text)] + [(100 + i, "same length text") for i in range(150)] + [(300 + i, "word " * (i * 7 % 90)) for i in range(300)]
    docs = documents(spark, rows).repartition(6)
    packed = packing.pack_documents(spark, docs, capacity=256)
    got = packed.collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    want = []
    for k, t in rows:
        found = ids(t)
        short = len(found) % 256 or 256
        starts = [0, *range(short, len(found), 256)]
        want += [(k, i, a, np.array(found[a:b], "<u4").tobytes()) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(found)], strict=True))]
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        assert r.length == len(r.ids) // 4 <= 256
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {s: b"".join(p[2] for p in parts) for s, parts in by.items()}


def test_packing_digest(spark):
    docs = documents(spark, ODD)
    got = packing.packing_digest(spark, docs).collect()
    assert len(got) >= len(ODD) and got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert [(r.piece, r.start, r.length, r.ids_crc32) for r in empty] == [(0, 0, 1, zlib.crc32(bytes(4)))] * 2
    assert packing.packing_digest(spark, docs.limit(0)).collect() == []
