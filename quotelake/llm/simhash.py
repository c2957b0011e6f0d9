"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are computed over word shingles of the whole text; equal fingerprints collapse to one row first, so a group
of any number of copies costs one row. Rows that may link share an exact block of the fingerprint (with an error budget of
k, some of k + 1 blocks must be equal): each row is dealt once for each block, the block turned to the front. A task then
holds whole block groups in order, which are subtrees of a binary trie. The self-join walks pairs of trie nodes together,
level by level, adds up the bits in which they differ, and drops a pair beyond the budget. Links are not emitted: a task
returns a spanning forest of what it linked (at most one row for each row it read).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import U64, flat_words, give_back, materialize, maybe_among, mix, rolling, slices, utf8, word_hashes
from quotelake.llm.components import connected_components, one_hub

SEED = 42
#: Node pairs that are split at once; the rest waits on a stack.
FRONTIER = 1 << 17
#: A task joins its block groups once it holds so many rows (a larger group is joined whole).
HELD = 100_000
_LANES = [U64(0x0001000100010001)] + [U64(k) for k in range(1, 16)]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, joined by spaces, A-Z lower-cased; fewer words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], U64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    a, b = starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), U64, len(a))


def bit_majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of hashes between ``bounds``, the 64-bit word of the bits set in over half of it. Empty runs give 0."""
    counts = np.diff(bounds)
    # lanes of 16 bits overflow beyond 65,535 rows: longer runs are added up in pieces
    pieces = np.maximum(1, -(-counts // 65_535))
    owner = np.repeat(np.arange(len(counts)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[:-1][owner] + inner * 65_535
    full = counts[owner] > 0
    out = np.zeros(len(counts), U64)
    if not full.any():
        return out
    padded = np.append(hashes, U64(0))
    for k in range(16):
        lanes = np.add.reduceat((padded >> U64(k)) & _LANES[0], starts)
        lanes[~full] = 0
        for lane in range(4):
            sums = np.zeros(len(counts), np.int64)
            np.add.at(sums, owner, ((lanes >> U64(16 * lane)) & U64(0xFFFF)).astype(np.int64))
            out |= (2 * sums > counts).astype(U64) << U64(16 * lane + k)
    return out


def _fingerprint_batches(width: int, n_words: int, distinct: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes = [shingle_hashes(t or b"", width) for t in part.column("text").to_pylist()]
            if distinct:
                hashes = [np.unique(h) for h in hashes]
            bounds = np.zeros(len(hashes) + 1, np.int64)
            np.cumsum([len(h) for h in hashes], out=bounds[1:])
            flat = np.concatenate(hashes) if hashes else np.zeros(0, U64)
            words = [bit_majorities(mix(flat, k) if k else flat, bounds) for k in range(n_words)]
            table = np.stack(words, axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, n_words, dtype=np.int32), table.reshape(-1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, n_words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp array<long>): SimHash words over shingles of ``width`` words. The first word hashes by XXH64 with seed 42;
    further ones remix those hashes. ``distinct``: a shingle that repeats counts once. Null and empty texts, and texts of white space alone, give zeros."""
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(_fingerprint_batches(width, n_words, distinct), "doc_id long, fp array<long>")


# ---- the trie self-join


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merges the labels (smallest member) of linked positions in place."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def trie_self_join(keys: np.ndarray, full: np.ndarray, bits: int, lead: int, budget: int, most: int) -> np.ndarray:
    """Labels of the sorted rows ``keys``: rows linked directly or by others have one label (a position).

    keys: sorted 64-bit words whose leading ``bits`` bits form the trie; the first ``lead`` bits are the block group, within
    which nodes pair. Leaves within ``budget`` bits link if their ``full`` fingerprints (rows of words) differ in ``most`` bits at
    most. Pairs of nodes that differ in more than ``budget`` bits so far are pruned, and so are those whose rows have one label.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    group = keys >> U64(64 - lead) if lead else np.zeros(n, U64)
    starts = np.flatnonzero(np.diff(group, prepend=~group[0]) != 0)
    ends = np.append(starts[1:], n)
    keep = ends - starts > 1
    z = np.zeros(int(keep.sum()), np.int64)
    stack = [(starts[keep], ends[keep], starts[keep], ends[keep], z, z + lead)]
    while stack:
        a0, a1, b0, b1, err, depth = stack.pop()
        if len(a0) > FRONTIER:
            stack.append(tuple(x[FRONTIER:] for x in (a0, a1, b0, b1, err, depth)))
            a0, a1, b0, b1, err, depth = (x[:FRONTIER] for x in (a0, a1, b0, b1, err, depth))
        # pairs of single rows, and of nodes at the bottom of the trie, are compared at once
        small = (a1 - a0) * (b1 - b0) <= 16
        bottom = depth >= bits
        done = small | bottom
        if done.any():
            la, lb = (a1 - a0)[done], (b1 - b0)[done]
            base_a, base_b = a0[done], b0[done]
            # nodes of many rows are compared a few rows at a time
            step = np.maximum(1, FRONTIER // np.maximum(1, lb))
            times = -(-la // step)
            own = np.repeat(np.arange(len(la)), times)
            skip = (np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)) * step[own]
            base_a, base_b, la, lb = base_a[own] + skip, base_b[own], np.minimum(la[own] - skip, step[own]), lb[own]
            size = la * lb
            part = np.cumsum(size) // FRONTIER
            for c0, c1 in zip(*(lambda x: (x, [*x[1:], len(size)]))(np.flatnonzero(np.diff(part, prepend=-1)).tolist()), strict=True):
                s = size[c0:c1]
                row = np.repeat(np.arange(len(s)), s)
                at = np.arange(len(row)) - np.repeat(np.cumsum(s) - s, s)
                width = lb[c0:c1][row]
                i, j = base_a[c0:c1][row] + at // width, base_b[c0:c1][row] + at % width
                ok = i < j
                i, j = i[ok], j[ok]
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
                x = keys[i] ^ keys[j]
                if bits < 64:
                    x = x >> U64(64 - bits)
                ok = _ones(x) <= budget
                i, j = i[ok], j[ok]
                if full.shape[1] > 1:
                    ok = _ones(full[i] ^ full[j]).sum(axis=1) <= most
                    i, j = i[ok], j[ok]
                if len(i):
                    _forest(n, i, j, label)
        a0, a1, b0, b1, err, depth = (x[~done] for x in (a0, a1, b0, b1, err, depth))
        if not len(a0):
            continue
        # a node is a run of rows; its two children meet where the bit at its depth turns to 1
        one = U64(1) << (63 - depth).astype(U64)

        def middle(lo: np.ndarray, hi: np.ndarray, one: np.ndarray = one) -> np.ndarray:
            return np.searchsorted(keys, (keys[lo] & ~(one | (one - U64(1)))) | one).clip(lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = a0 == b0
        parts = []
        for p0, p1, q0, q1, d, own in ((a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True), (a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, False)):
            live = (p1 > p0) & (q1 > q0) & (err + d <= budget)
            if not own:
                live &= ~same  # the mirror of the third in a node's pair with itself
            live &= ~((p0 == q0) & (p1 - p0 == 1))
            parts.append(tuple(x[live] for x in (p0, p1, q0, q1, err + d, depth + 1)))
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(nxt[0]):
            # a pair of nodes whose rows are all in one component has nothing more to link
            lo, hi = np.minimum.reduceat(np.append(label, n), _runs(nxt[0], nxt[1]))[::2], np.maximum.reduceat(np.append(label, -1), _runs(nxt[0], nxt[1]))[::2]
            lo2, hi2 = np.minimum.reduceat(np.append(label, n), _runs(nxt[2], nxt[3]))[::2], np.maximum.reduceat(np.append(label, -1), _runs(nxt[2], nxt[3]))[::2]
            live = ~((lo == hi) & (lo2 == hi2) & (lo == lo2))
            stack.append(tuple(x[live] for x in nxt))
    return label


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).reshape(-1)


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of the budget + 1 blocks of a segment, from its leading bit."""
    cuts = [bits * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _recut(fp: np.ndarray) -> np.ndarray:
    """The fingerprints with their bytes in another order: each byte of a segment of 32 bits comes from another quarter."""
    n_words = fp.shape[1]
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 4, 2 * n_words).transpose(0, 2, 1).reshape(-1, 8 * n_words).copy().view(U64)


def _turned(fp: np.ndarray, segment: int, bits: int, first: int) -> np.ndarray:
    """The segment's bits at the top of a word, turned so that bit ``first`` leads. Segments beyond the last are cut from the reordered bytes."""
    per = 64 // bits
    if segment >= per * fp.shape[1]:
        fp, segment = _recut(fp), segment - per * fp.shape[1]
    x = fp[:, segment // per] << U64(bits * (segment % per))
    if bits < 64:
        x &= ~U64((1 << (64 - bits)) - 1)
        return ((x << U64(first)) | (x >> U64(bits - first))) & ~U64((1 << (64 - bits)) - 1) if first else x
    return (x << U64(first)) | (x >> U64(64 - first)) if first else x


def _words(column: pa.Array, n_words: int) -> np.ndarray:
    """A column of packed fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, n_words)


def _deal(n_words: int, bits: int, budget: int, segments: int):
    """Rows (rep, fp) dealt once for each segment and block: ``code`` is the segment, the block and the block's value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(U64).reshape(-1, n_words)
            packed = pa.array([row.tobytes() for row in fp], pa.binary())
            for segment in range(segments):
                for block, (first, width) in enumerate(_blocks(bits, budget)):
                    value = _turned(fp, segment, bits, first) >> U64(64 - width)
                    code = value.astype(np.int64) | (segment * 16 + block) << 40
                    yield pa.RecordBatch.from_arrays([pa.array(code), batch.column("rep"), packed], ["code", "rep", "fp"])

    return run


def _join(n_words: int, bits: int, budget: int, most: int):
    """Dealt rows in order of code to (a, b): a spanning forest of the links found there."""

    def flush(deal: int, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        segment, block = divmod(deal, 16)
        first, width = _blocks(bits, budget)[block]
        key = _turned(fp, segment, bits, first)
        order = np.argsort(key, kind="stable")
        label = trie_self_join(key[order], fp[order], bits, width, budget, most)
        rep = rep[order]
        # stars around the smallest id: deals that find the same group return the same links, which then collapse
        hub = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(hub, label, rep)
        hub = hub[label]
        child = rep != hub
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(hub[child])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                code, rep, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                deal = code >> 40
                for d in np.unique(deal):
                    at = deal == d
                    yield flush(int(d), rep[at], fp[at])
                held.clear()

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "rep"))
            fp = _words(batch.column("fp"), n_words)
            if held and rows > HELD:  # all but the last block group are whole
                cut = np.flatnonzero(code != held[-1][0][-1])
                if len(cut):
                    c = cut[0]
                    held.append((code[:c], rep[:c], fp[:c]))
                    yield from emit()
                    code, rep, fp, rows = code[c:], rep[c:], fp[c:], 0
            held.append((code, rep, fp))
            rows += len(code)
        yield from emit()
        give_back()

    return run


def link_fingerprints(spark: SparkSession, reps: DataFrame, n_words: int = 1, bits: int = 64, budget: int = 3, most: int | None = None, segments: int | None = None) -> DataFrame:
    """(id, component) of the representatives (rep, fp) that link with another one.

    Fingerprints of ``n_words`` words are cut into segments of ``bits`` bits; beyond the last of them, up to twice as many, into segments of the same bytes
    in another order. Two link if some of the first ``segments`` (default: all of the first order) differs in at most
    ``budget`` bits and all segments together in at most ``most`` (default: budget; then all links of one segment are found).
    """
    dealt = reps.select("rep", "fp").mapInArrow(_deal(n_words, bits, budget, segments or n_words * 64 // bits), "code long, rep long, fp binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = dealt.repartition(parts, "code").sortWithinPartitions("code")
    links = sorted_.mapInArrow(_join(n_words, bits, budget, budget if most is None else most), "a long, b long")
    # a row is dealt a fixed number of times, and each deal may name another hub for the same group
    return connected_components(spark, one_hub(links))


def near_duplicate_components(spark: SparkSession, docs: DataFrame, width: int = 3, n_words: int = 1, bits: int = 64, budget: int = 3, most: int | None = None, segments: int | None = None, distinct: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id reachable by links, itself included.

    Equal fingerprints always link (also those of empty and null texts, which are zero). Rows with a null doc_id keep a null
    component and link nothing; repeated rows appear as often as they come; other columns are ignored; an empty table gives
    an empty table. Very long texts are counted whole.
    """
    fps = materialize(spark, fingerprints(docs, width, n_words, distinct))
    reps = materialize(spark, fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = link_fingerprints(spark, reps, n_words, bits, budget, most, segments)
    named = reps.join(found, reps["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("__component"))
    joined = fps.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("__component")).alias("component_id"))


#: Candidates for similarities: eight words of hash bits over distinct five-word shingles, cut in two ways into sixteen segments each.
SHINGLE = 5
SIMILAR = {"n_words": 8, "bits": 32, "budget": 3, "segments": 32}
#: A text may have a near copy if so many (as a share) of its SKETCH smallest shingle hashes are found in another text's.
SKETCH, SHARED = 16, 0.375
#: Keys that many rows share are cut into so many.
SALTS = 16
#: A group of candidates is compared in parts of about so many texts and so many shingles, each pair of parts on its own.
PART_ROWS, PART_SHINGLES = 1_000, 4_000_000


def most_bits(similarity: float, bits: int) -> int:
    """How many of so many bits two texts of that Jaccard similarity differ in, with four standard deviations added: shingle counts of
    Jaccard similarity s have a cosine of about 2s / (1 + s), and a bit differs with probability angle / pi."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def distinct_shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's distinct runs of ``width`` words, A-Z lower-cased, as sorted 64-bit hashes; of fewer words the whole sequence."""
    words, counts = flat_words([t.lower() if t else t for t in texts])
    hashes = rolling(word_hashes(words, int(counts.sum())), range(1, width + 1))
    hashes = [mix(h, w) for w, h in enumerate(hashes, 1)]
    first = (np.cumsum(counts) - counts).tolist()
    return [np.unique(hashes[min(n, width) - 1][a : a + max(1, n - width + 1)]) if n else np.zeros(0, U64) for a, n in zip(first, counts.tolist(), strict=True)]


def _sketch_batches(width: int):
    """Texts to ``key``, which stands for the set of their shingles, and ``sketch``, its smallest hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = distinct_shingles(part.column("text").to_pylist(), width)
            keys = [hashlib.sha256(x.tobytes()).digest()[:16] for x in sets]
            heads = [x[:SKETCH].view(np.int64) for x in sets]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(x) for x in heads], out=offsets[1:])
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(heads) if heads else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.binary()), lists], ["doc_id", "text_hash", "key", "sketch"])

    return run


def _set_batches(width: int, n_words: int):
    """Texts to ``key``, their packed distinct ``shingles``, and ``fp``, the SimHash over them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = distinct_shingles(part.column("text").to_pylist(), width)
            packed = [x.tobytes() for x in sets]
            keys = [hashlib.sha256(x).digest()[:16] for x in packed]
            bounds = np.zeros(len(sets) + 1, np.int64)
            np.cumsum([len(x) for x in sets], out=bounds[1:])
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            table = np.stack([bit_majorities(mix(flat, k) if k else flat, bounds) for k in range(n_words)], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, n_words, dtype=np.int32), table.reshape(-1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), lists], ["doc_id", "key", "shingles", "fp"])

    return run


def maybe_near(classes: DataFrame) -> DataFrame:
    """Of classes (key, rep, sketch) those that may have a near copy.

    Two texts of similarity 0.8 have on average 0.8 of the smallest hashes of both in common, and each such hash is in both sketches. A class that shares
    fewer than SHARED of its sketch with others is alone but for a chance of 3 in 100,000 (exactly so if the sketch holds all shingles), and is spared the
    trie join. Counting combines before the shuffle; a hash that many classes share is cut into SALTS parts.
    """
    hashes = classes.select("rep", "key", F.explode("sketch").alias("hash"))
    shared = hashes.groupBy("hash").agg(F.count("*").alias("__n")).where("__n > 1").select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = hashes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(shared, ["hash", "salt"])
    counts = found.groupBy("key").agg(F.count("*").alias("__shared"))
    return classes.join(counts, "key").where(F.col("__shared") >= F.size("sketch") * SHARED)


def alike(sets: list[np.ndarray], similarity: float, part: np.ndarray | None = None) -> np.ndarray:
    """Labels (a position) of sets linked directly or by others: two link if their Jaccard similarity is ``similarity`` or more.

    Where ``part`` holds two values, only sets of different parts are compared. Pairs that are linked already, or whose sizes alone keep them
    below, aren't compared.
    """
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(x) for x in sets], np.int64)
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    ids = np.split(dense, np.cumsum(sizes)[:-1])
    own = np.zeros(int(dense.max(initial=-1)) + 1, np.int64)
    cross = part is not None and len(np.unique(part)) > 1
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        open_ = (label[j] != label[i]) & (sizes[j] > 0) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) * (1 - 1e-9))
        if cross:
            open_ &= part[j] != part[i]
        j = j[open_]
        if not len(j) or not sizes[i]:
            continue
        own[ids[i]] = 1
        starts = np.cumsum(sizes[j]) - sizes[j]
        shared = np.add.reduceat(own[np.concatenate([ids[k] for k in j])], starts)
        own[ids[i]] = 0
        hit = j[shared / (sizes[i] + sizes[j] - shared) >= similarity]
        if len(hit):
            merged = np.unique(np.append(label[hit], label[i]))
            label[np.isin(label, merged)] = merged[0]
    return label


def _verify(similarity: float):
    """Rows of groups of candidates, in order of ``code``, to (a, b): stars of those that are alike."""

    def stars(rows: list[tuple]) -> pa.RecordBatch:
        rep = np.array([r[0] for r in rows], np.int64)
        label = alike([np.frombuffer(r[2], U64) for r in rows], similarity, np.array([r[1] for r in rows], np.int64))
        hub = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(hub, label, rep)
        hub = hub[label]
        child = rep != hub
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(hub[child])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for group, low, high, *row in zip(*(batch.column(c).to_pylist() for c in ("component", "low", "high", "rep", "part", "shingles")), strict=True):
                if held and (group, low, high) != last:
                    yield stars(held)
                    held = []
                last = group, low, high
                held.append(tuple(row))
        if held:
            yield stars(held)
        give_back()

    return run


def similar_components(spark: SparkSession, docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, text_hash, component_id, stays) of every document: component_id is the smallest doc_id reachable by pairs whose distinct five-word shingles
    have a Jaccard similarity of ``similarity`` or more, text_hash is xxhash64 of the text, and stays marks one text of each component, of those under its
    smallest doc_id.

    Equal sets of shingles (also those of texts without words) are one class. Classes that may have near copies meet by their SimHash, and each group of
    candidates is compared by the shingles themselves. Rows with a null doc_id keep a null component and link nothing. Several texts under one id are
    documents of their own.
    """
    n_words = SIMILAR["n_words"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    keys = materialize(spark, texts.mapInArrow(_sketch_batches(SHINGLE), "doc_id long, text_hash long, key binary, sketch array<long>"))
    name = F.struct(F.col("doc_id").alias("rep"), "key", "text_hash")
    classes = materialize(spark, keys.where("doc_id is not null").groupBy("key").agg(F.min(name).alias("name"), F.first("sketch").alias("sketch")).withColumn("rep", F.col("name.rep")))
    some = materialize(spark, maybe_near(classes).select("key", "rep", "name", F.xxhash64("key").alias("node")))
    near, _ = maybe_among(spark, some.select(F.xxhash64("rep").alias("key")))(texts, F.xxhash64("doc_id"))
    # a class's shingles come from a text of its smallest id, which may be repeated with other texts
    sets = near.select("doc_id", "text").mapInArrow(_set_batches(SHINGLE, n_words), "doc_id long, key binary, shingles binary, fp array<long>").withColumnRenamed("doc_id", "rep")
    sets = materialize(spark, sets.join(some.select("rep", "key", "node"), ["rep", "key"]).dropDuplicates(["node"]).select("node", "shingles", "fp"))
    loose = link_fingerprints(spark, sets.select(F.col("node").alias("rep"), "fp"), most=most_bits(similarity, n_words * 64), **SIMILAR)
    rows = materialize(spark, loose.join(sets, F.col("id") == F.col("node")).select("component", F.col("node").alias("rep"), "shingles"))
    size = rows.groupBy("component").agg(F.count("*").alias("__n"), F.sum(F.length("shingles") / 8).alias("__size"))
    parts = F.greatest(F.ceil(F.col("__n") / PART_ROWS), F.ceil(F.col("__size") / PART_SHINGLES), F.lit(1)).cast("int")
    dealt = rows.join(size.select("component", parts.alias("__parts")), "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("__parts")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    dealt = dealt.select("component", F.least("part", "__other").alias("low"), F.greatest("part", "__other").alias("high"), "rep", "part", "shingles")
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = dealt.repartition(count, "component", "low", "high").sortWithinPartitions("component", "low", "high")
    found = connected_components(spark, one_hub(sorted_.mapInArrow(_verify(similarity), "a long, b long")))
    # a component is called by the smallest name of its classes
    named = materialize(spark, found.join(some, F.col("id") == F.col("node")).select("component", "key", "name"))
    linked = named.join(named.groupBy("component").agg(F.min("name").alias("first")), "component").select("key", "first")
    every = classes.select("key", "name").join(linked, "key", "left").select("key", F.coalesce("first", "name").alias("first"))
    stays = (F.col("doc_id") == F.col("first.rep")) & (F.col("key") == F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    known = F.col("doc_id").isNotNull()
    return keys.drop("sketch").join(every, "key", "left").select("doc_id", "text_hash", F.when(known, F.col("first.rep")).alias("component_id"), F.when(known, stays).otherwise(True).alias("stays"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns kept, without near-duplicates: of each component one text under its smallest doc_id stays.

    Texts link if the Jaccard similarity of their distinct five-word shingles is ``similarity`` or more; see ``similar_components``. Rows with
    null ids stay, as does the first of the texts without words; of rows with one id and one text one stays; different texts under one id
    are compared like any others, so none is lost without a near copy. An empty table gives an empty table.
    """
    found = similar_components(spark, docs.select("doc_id", "text"), similarity).where("doc_id is not null")
    found = materialize(spark, found.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("__stays"), F.count("*").alias("__times")).where("not __stays or __times > 1"))
    listed = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "__stays")
    # the rest, most of the documents, meets nothing and isn't shuffled
    some, rest = maybe_among(spark, listed.select(F.xxhash64("__doc", "__hash").alias("key")))(docs, F.xxhash64("doc_id", F.xxhash64("text")))
    same = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__hash"))
    out = rest.unionByName(some.join(listed, same, "left_anti"))
    again = listed.where("__stays")
    if again.isEmpty():
        return out
    # of rows repeated under one id and text the same one whatever their order
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ordered = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    once = some.join(again, same).groupBy("__doc", "__hash").agg(F.min_by(row, ordered).alias("__row")).select("__row.*")
    return out.unionByName(once)


def hex_digits(fp: Column) -> Column:
    """A fingerprint word as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
