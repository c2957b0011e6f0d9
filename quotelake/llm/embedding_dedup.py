"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact for every pair.

Unit vectors are turned to their principal axes, strongest first, put in order of the first coordinate and cut into tiles of TILE
rows. Tiles are dealt to pairs of blocks, SPAN tiles each, and two of them are compared only if their ranges come near enough. Within it, products over the LEAD leading
coordinates are accumulated as one matrix product; what the others can add is at most the product of the two suffix norms, so
a pair is dropped once that bound is below the threshold. The survivors go on LEAD coordinates at a time, and what is left at
the end is decided by the cosine of the original components in double precision.

Equal vectors collapse to one row first. A task returns a count for each vector and a spanning forest of its links, never the
links: a group of copies of any size stays linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import global_index, materialize
from quotelake.llm.components import connected_components

THRESHOLD = 0.95
TILE = 2048
#: So many neighbouring tiles are a block; a task reads two blocks and compares their tiles.
SPAN = 4
LEAD = 16
#: Turning to the axes rounds in the last digits: bounds give way by so much.
SLACK = 1e-9


def _vectors(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sum of outer products, by dimension (vectors of unlike dimensions never link, so each has axes of its own)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("d").to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            v = _vectors(batch.filter(pa.array(dims == d)))
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + v.T @ v
    for d, m in sums.items():
        i, j = np.indices(m.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(i.reshape(-1).astype(np.int32)), pa.array(j.reshape(-1).astype(np.int32)), pa.array(m.reshape(-1))], ["d", "i", "j", "x"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the axes (columns, strongest first). The driver gets d * d sums, whatever the number of rows."""
    sums = vectors.mapInArrow(_moments, "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for d, part in sums.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["x"]
        axes[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def _first_coordinate(axes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy(zero_copy_only=False)
            first = np.zeros(len(dims))
            for d in np.unique(dims):
                at = dims == d
                v = _vectors(batch.filter(pa.array(at)))
                first[at] = v @ axes.value[int(d)][:, 0] / np.linalg.norm(v, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "first"])

    return run


def _to_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole tiles, in order of (tile, d, place), to tiles of one dimension each: packed ids, counts of equal vectors, and components."""
    held: list[pa.RecordBatch] = []

    def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number, dims = table.column("tile").to_numpy(), table.column("d").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(dims) != 0)) + 1), len(dims)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = table.slice(a, b - a)
            first = part.column("first").to_numpy()
            v = np.ascontiguousarray(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            packed = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "times")]
            row = [int(number[a]), int(dims[a]), first.min(), first.max(), packed[0], v.tobytes(), packed[1]]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["tile", "d", "low", "high", "ids", "body", "times"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        if held and tile[0] != held[-1].column("tile")[-1].as_py():
            yield from tiles(pa.Table.from_batches(held))
            held = []
        cut = int(np.flatnonzero(tile == tile[-1])[0])
        if cut:
            yield from tiles(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from tiles(pa.Table.from_batches(held))


def link_mask(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """(rows of a, rows of b) as two columns: the pairs whose cosine is at least ``threshold``."""
    ua, ub = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    pa_, pb = ua @ axes, ub @ axes
    d = pa_.shape[1]
    lead = min(LEAD, d)
    rest = lambda p, k: np.sqrt(np.maximum(0, 1 - (p[:, :k] ** 2).sum(axis=1))) if k < d else np.zeros(len(p))
    ra, rb = rest(pa_, lead), rest(pb, lead)
    out = []
    for start in range(0, len(a), 256):
        rows = slice(start, start + 256)
        part = pa_[rows, :lead] @ pb[:, :lead].T
        bound = ra[rows, None] * rb[None, :]
        bound += part
        i, j = np.nonzero(bound >= threshold - SLACK)
        x = part[i, j]
        i = i + start
        k = lead
        while k < d and len(i):
            k2 = min(d, k + lead)
            x = x + np.einsum("ij,ij->i", pa_[i, k:k2], pb[j, k:k2])
            keep = x + rest(pa_, k2)[i] * rest(pb, k2)[j] >= threshold - SLACK
            i, j, x, k = i[keep], j[keep], x[keep], k2
        if len(i):
            cosine = np.einsum("ij,ij->i", a[i], b[j]) / (np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1))
            keep = cosine >= threshold
            out.append(np.stack([i[keep], j[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position) of positions linked by pairs."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def _compare(axes, threshold: float, reach: float):
    """Tiles dealt to pairs of blocks, in order of (block_a, block_b), to (id, other, n): n links found for id (other null), and the forest's links
    (n 0), stars at the smallest id. Of a pair of blocks each two tiles of one dimension whose ranges come near enough are compared."""

    def links(x: dict, y: dict) -> pa.RecordBatch | None:
        own, d = x["tile"] == y["tile"], x["d"]
        ids, times = ([np.frombuffer(t[c], np.int64) for t in (x, y)] for c in ("ids", "times"))
        a, b = (np.frombuffer(t["body"], np.float64).reshape(-1, d) for t in (x, y))
        pairs = link_mask(a, b, axes.value[d], threshold)
        if own:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        if not len(pairs):
            return None
        # sums of how many vectors the other row stands for
        na = np.bincount(pairs[:, 0], times[1][pairs[:, 1]], len(a)).astype(np.int64)
        nb = np.bincount(pairs[:, 1], times[0][pairs[:, 0]], len(b)).astype(np.int64)
        both, counts = np.concatenate(ids), np.concatenate([na, nb])
        label = _spanning(len(both), pairs[:, 0], pairs[:, 1] + (0 if own else len(a)))
        hub = np.full(len(both), np.iinfo(np.int64).max)
        np.minimum.at(hub, label, both)
        hub = hub[label]
        hit, child = np.flatnonzero(counts), np.flatnonzero(hub != both)
        other = pa.array(np.concatenate([np.zeros(len(hit), np.int64), hub[child]]), mask=np.arange(len(hit) + len(child)) < len(hit))
        return pa.RecordBatch.from_arrays([pa.array(both[np.concatenate([hit, child])]), other, pa.array(np.concatenate([counts[hit], np.zeros(len(child), np.int64)]))], ["id", "other", "n"])

    def compared(block_a: int, block_b: int, tiles: list[dict]) -> Iterator[pa.RecordBatch]:
        for x in tiles:
            for y in tiles:
                if x["block"] == block_a and y["block"] == block_b and x["d"] == y["d"] and x["tile"] <= y["tile"] and x["low"] <= y["high"] + reach and y["low"] <= x["high"] + reach:
                    found = links(x, y)
                    if found is not None:
                        yield found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        pair = None
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["block_a"], row["block_b"]) != pair:
                    yield from compared(*pair, held)
                    held = []
                pair = row["block_a"], row["block_b"]
                held.append(row)
        if held:
            yield from compared(*pair, held)

    return run


def near_duplicate_vectors(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Null vectors, empty and zero ones and those with null or non-finite components link with nothing; nor do rows with a null
    vec_id, whose component is null and which aren't kept. Vectors of unlike dimensions don't link. Repeated rows (one id, one
    vector) are other vectors to each other. Other columns are ignored; an empty table gives an empty table.
    """
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # two hashes stand for a vector; equal vectors collapse
    hashes = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    reps = rows.where(usable).withColumns({"h": hashes[0], "g": hashes[1]}).groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v"))
    reps = materialize(spark, reps.withColumn("d", F.size("v")))
    axes = spark.sparkContext.broadcast(principal_axes(reps.select("d", "v")))
    kinds = "vec_id long, times long, d int, v array<double>, first double"
    placed = reps.select(F.col("rep").alias("vec_id"), "times", "d", "v").mapInArrow(_first_coordinate(axes), kinds)
    # tiles are runs of TILE rows of the whole order, however many partitions hold it
    ordered = global_index(spark, placed, [F.col("d"), F.col("first"), F.col("vec_id")], "place").withColumn("tile", F.floor(F.col("place") / TILE).cast("long"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ordered.repartition(parts, "tile").sortWithinPartitions("tile", "d", "place").select("tile", "d", "first", "vec_id", "times", "v")
    tiles = dealt.mapInArrow(_to_tiles, "tile long, d int, low double, high double, ids binary, body binary, times binary")
    tiles = materialize(spark, tiles.withColumn("block", F.floor(F.col("tile") / SPAN).cast("long")))
    # unit vectors whose cosine reaches the threshold are at most this far apart, in any coordinate
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    band = lambda c: F.floor(c / F.lit(reach)).cast("int")
    meta = tiles.groupBy("block", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    meta = meta.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high") + reach))))
    right = meta.select("d", "band", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    near = meta.withColumnRenamed("block", "block_a").join(right, ["d", "band"]).where(f"block_a <= block_b and low_b <= high + {reach} and low <= high_b + {reach}")
    pairs = near.select("block_a", "block_b").distinct()
    met = pairs.withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b")))).join(tiles, "block")
    grid = met.repartition(parts, "block_a", "block_b").sortWithinPartitions("block_a", "block_b", "tile")
    found = materialize(spark, grid.mapInArrow(_compare(axes, threshold, reach), "id long, other long, n long"))
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(spark, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # only vectors with a link or an equal are joined back
    linked = counts.join(components, "id", "left").select("id", "n", "component")
    named = (
        reps.select("h", "g", "rep", "times")
        .join(linked, F.col("rep") == F.col("id"), "left")
        .where("id is not null or times > 1")
        .select(F.col("h").alias("__h"), F.col("g").alias("__g"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("__n"), F.coalesce("component", "rep").alias("__component"))
    )
    keyed = rows.select("vec_id", F.when(usable, hashes[0]).alias("h"), F.when(usable, hashes[1]).alias("g"))
    joined = keyed.join(named, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")), "left")
    component = F.coalesce("__component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
