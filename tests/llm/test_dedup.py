"""Substring dedup, SimHash and embedding near-dedup against brute force, and their hard cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quotelake.llm import components, embedding_dedup, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w0 string, fp int, spans int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, 2) for d, t in rows], DOCS)


def brute_removal(rows, window):
    first = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        if d is None:
            continue
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def removal(spark, rows, window):
    got = substring_dedup.removal_digest(spark, docs_frame(spark, rows), window).collect()
    return sorted([tuple(r) for r in got], key=str)


@pytest.mark.parametrize("window", [3, 12, 50])
def test_substring_dedup_equals_brute_force(spark, window):
    r = random.Random(window)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", " x", "\u0085"]
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(window, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(r.randrange(0, 5)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(1, 2 * window))]
        rows.append((d * 7 % 61, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(None, " ".join(passages[0])), (100, None), (101, ""), (102, "  \n"), (103, "a " * 400), (104, "a " * 300), (5, rows[5][1]), rows[9]]
    assert removal(spark, rows, window) == brute_removal(rows, window)


def test_substring_dedup_hot_passage_and_copies(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(d, f"a{d} b{d} {passage} c{d}") for d in range(300)] + [(1000 + d, passage) for d in range(200)]
    assert removal(spark, rows, 50) == brute_removal(rows, 50)


def test_substring_dedup_of_nothing(spark):
    assert removal(spark, [], 50) == []
    assert substring_dedup.remove_repeats(spark, docs_frame(spark, [])).count() == 0


def test_remove_repeats_keeps_clean_texts_byte_for_byte(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one  two\n{passage}\tend "), (2, f" x\t{passage}\n\ny z"), (3, passage), (4, None), (5, "  clean \n text "), (None, passage)]
    table = substring_dedup.materialize(spark, docs_frame(spark, rows))
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark, table).collect()}
    assert got == {1: rows[0][1], 2: " x\ty z", 4: None, 5: "  clean \n text ", None: passage}
    assert substring_dedup.remove_repeats(spark, table).columns == table.columns


def test_remove_repeats_drops_texts_of_which_only_white_space_is_left(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, "\n\t" + passage), (3, passage + "\x0b\n"), (4, "\n\t"), (5, passage + " x")]
    table = substring_dedup.materialize(spark, docs_frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark, table).collect()} == {1: passage, 4: "\n\t", 5: "x"}


def test_substring_dedup_of_a_very_long_text(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new"] + words[30_000:30_500] + ["end"])), (3, " ".join(words[100:149]))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digest(spark, docs_frame(spark, rows)).collect()}
    assert got == {1: (60_000, 0), 2: (502, 500), 3: (49, 0)}


def test_count_min_never_underestimates(spark):
    texts = [" ".join(f"w{(i * j) % 97}" for i in range(80)).encode() for j in range(1, 30)] * 2
    frame = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    bits = 16
    bitmap = np.frombuffer(substring_dedup.repeated_cells(frame, 50, bits), np.uint8)
    _, _, anchors, _ = substring_dedup._anchored(texts, 50)
    for row in range(substring_dedup.DEPTH):
        cells = substring_dedup._cells(anchors, row, bits)
        assert ((bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all()  # every window is held twice


def fingerprint(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_simhash_equals_brute_force(spark):
    r = random.Random(3)
    base = [[r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.randrange(1, 80))] for _ in range(40)]
    rows = []
    for d in range(400):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.randrange(len(words))] = "Z" + str(r.randrange(99))
        rows.append((d, r.choice([" ", "\n"]).join(words)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "ONE"), (504, "one"), (505, "É é"), (3, rows[3][1])]
    got = simhash.near_duplicate_components(spark, docs_frame(spark, rows)).select("doc_id", simhash.hex_digits(F.col("fp")[0]).alias("fp"), "component_id").collect()
    fps = {d: fingerprint(t, 3) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    low = roots(fps, links)
    assert sorted(tuple(x) for x in got) == sorted((d, f"{fps[d]:016x}", low[d]) for d, _ in rows)


def test_simhash_of_nothing_and_null_ids(spark):
    assert simhash.near_duplicate_components(spark, docs_frame(spark, [])).count() == 0
    got = simhash.near_duplicate_components(spark, docs_frame(spark, [(None, "a b c"), (1, "a b c")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (1, 1)}


@pytest.mark.parametrize("bits,lead,budget", [(64, 16, 3), (32, 8, 3), (64, 0, 3), (32, 8, 1)])
def test_trie_self_join_finds_all_links(bits, lead, budget):
    rng = np.random.default_rng(bits + lead)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    keys = []
    for c in centres:
        for _ in range(int(rng.integers(1, 60))):
            x = int(c)
            for b in rng.integers(0, bits, rng.integers(0, 4)):
                x ^= 1 << int(63 - b)
            keys.append(x)
    mask = ~((1 << (64 - bits)) - 1) & (1 << 64) - 1
    keys = np.sort(np.array([k & mask for k in keys], np.uint64))
    label = simhash.trie_self_join(keys, keys[:, None], bits, lead, budget, budget)
    links = [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if int(keys[i] ^ keys[j]).bit_count() <= budget and (lead == 0 or int(keys[i]) >> (64 - lead) == int(keys[j]) >> (64 - lead))]
    low = roots(range(len(keys)), links)
    assert label.tolist() == [low[i] for i in range(len(keys))]


def test_bit_majorities_of_long_runs():
    h = np.full(140_000, 0xF0F0, np.uint64)
    h[:60_000] = 0
    assert simhash.bit_majorities(h, np.array([0, 0, 140_000, 140_000])).tolist() == [0, 0xF0F0, 0]


def test_keep_one_of_each(spark):
    r = random.Random(5)
    base = [" ".join(f"{r.choice('abcdef')}{r.randrange(500)}" for _ in range(200)) for _ in range(20)]
    near = [b.replace(b.split()[50], "changed", 1) for b in base]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [(200, base[0]), (7, base[7]), (None, base[1])]
    kept = simhash.keep_one_of_each(spark, simhash.materialize(spark, docs_frame(spark, rows)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*(str(i) for i in range(20)), "None"])


def test_keep_one_of_each_loses_no_text_under_a_repeated_id(spark):
    words = lambda k, n=40: " ".join(f"k{k}w{i}" for i in range(n))
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(1) + " more"), (3, words(3)), (3, words(3).upper()), (4, None), (4, ""), (5, " \t"), (6, words(3) + " x")]
    kept = simhash.keep_one_of_each(spark, simhash.materialize(spark, docs_frame(spark, rows))).collect()
    assert sorted((r["doc_id"], (r["text"] or "").lower().strip()) for r in kept) == sorted([(1, words(1)), (1, words(2)), (3, words(3)), (4, "")])
    assert simhash.keep_one_of_each(spark, simhash.materialize(spark, docs_frame(spark, []))).count() == 0


def test_near_copies_pass_the_sketch_and_others_dont(spark):
    r = random.Random(8)
    texts = [" ".join(f"t{k}w{r.randrange(10**6)}" for _ in range(r.randrange(1, 120))) for k in range(150)]
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(k, f"{t} {common}") for k, t in enumerate(texts)] + [(1000 + k, f"{t} {common} end") for k, t in enumerate(texts) if k % 3 == 0]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows}
    frame = docs_frame(spark, rows).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    keys = frame.mapInArrow(simhash._sketch_batches(5), "doc_id long, text_hash long, key binary, sketch array<long>")
    near = {x["rep"] for x in simhash.maybe_near(keys.select(F.col("doc_id").alias("rep"), "key", "sketch")).collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(a in near and b in near for a, b in itertools.combinations(sets, 2) if like(a, b) >= 0.8)
    assert len(near) < 0.8 * len(rows)


@pytest.mark.parametrize("shingles,goes", [(45, True), (44, False)])
def test_keep_one_of_each_at_the_threshold(spark, shingles, goes):
    """One word changed in the middle replaces five shingles: 40 / 50 = 0.8 links, 39 / 49 doesn't."""
    rows = []
    for k in range(150):
        words = [f"k{k}w{i}" for i in range(shingles + 4)]
        rows += [(k, " ".join(words)), (1000 + k, " ".join([*words[:20], "other", *words[21:]]))]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(spark, simhash.materialize(spark, docs_frame(spark, rows))).collect()}
    assert kept == set(range(150)) | (set() if goes else set(range(1000, 1150)))


def test_keep_one_of_each_compares_parts_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*words[: 10 * k], "other", *words[10 * k + 1 :]])) for k in range(1, 29)]
    rows += [(100 + k, " ".join([*words[:200], *(f"x{k}y{i}" for i in range(60))])) for k in range(3)]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(spark, simhash.materialize(spark, docs_frame(spark, rows))).collect()}
    assert kept == {1, 100, 101, 102}


@pytest.mark.parametrize("parts", [1, 2])
def test_alike_equals_brute_force(parts):
    r = random.Random(parts)
    sets = [set(r.sample(range(100, 130), r.randrange(0, 25))) for _ in range(20)]
    sets += [s ^ set(r.sample(range(100, 130), r.randrange(1, 4))) for s in sets for _ in range(3)]
    part = np.array([r.randrange(parts) for _ in sets])
    label = simhash.alike([np.array(sorted(s), np.uint64) for s in sets], 0.8, part)
    near = lambda a, b: len(a | b) > 0 and 10 * len(a & b) >= 8 * len(a | b)
    low = roots(range(len(sets)), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if near(sets[i], sets[j]) and (parts == 1 or part[i] != part[j])])
    assert label.tolist() == [low[i] for i in range(len(sets))]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(tuple(r) for r in components.connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(40)}}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    v = np.concatenate([c + rng.normal(scale=0.15, size=(12, 24)) for c in centres]).astype(np.float32)
    rows = [(i, [float(x) for x in e], 0, 1) for i, e in enumerate(v)]
    rows += [(900, rows[0][1], 0, 1), (901, [2 * x for x in rows[0][1]], 0, 1), (902, None, 0, 1), (903, [0.0] * 24, 0, 1), (904, [float("nan")] * 24, 0, 1), (905, [], 0, 1), (906, [1.0, 2.0], 0, 1)]
    rows += [(907, [1.0, 2.0], 0, 1), (None, rows[3][1], 0, 1), (908, [None] * 24, 0, 1), rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long")
    got = [tuple(r) for r in embedding_dedup.near_duplicate_vectors(spark, frame).collect()]
    ok = [i for i, (k, e, *_) in enumerate(rows) if k is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = []
    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
        if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
            links.append((i, j))
    n = {i: sum(i in link for link in links) for i in range(len(rows))}
    group = roots(range(len(rows)), links)
    least = {}
    for i in ok:
        least[group[i]] = min(least.get(group[i], 10**9), rows[i][0])
    want = [(k, n[i], least.get(group[i], k) if i in ok else k, k is not None and (least.get(group[i], k) if i in ok else k) == k) for i, (k, *_) in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicate_vectors(spark, frame).count() == 0


def test_links_to_many_hubs_become_one_each(spark):
    """A group that was found in many ways, around another hub each time, meets itself in about as many rows as it has members."""
    members, ways = list(range(1000, 1400)), 128
    rng = random.Random(5)
    links = []
    for _ in range(ways):
        found = sorted(rng.sample(members, 40))
        links += [(x, found[0]) for x in found[1:]]
    links += [(5, 3), (3, 5), (7, 7)]
    given = spark.createDataFrame(links, "a long, b long")
    few = components.one_hub(given)
    assert few.count() < 2 * len(members) < given.distinct().count() / 4
    want = {r.id: r.component for r in components.connected_components(spark, given).collect()}
    assert {r.id: r.component for r in components.connected_components(spark, few).collect()} == want
