"""Hard negatives by inner product, from lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, candidates are sorted once by an upper bound of their score that holds for
all its members: norm times the cosine of the angle to the cluster's centre less the cluster's radius. Every member walks that
list until the bound of what follows is below all that it still looks for; what it has then is certified to be exact.

Candidates lie in blocks of one cell each (the cells are the clusters' centres), so that a list is walked block by block, each
in its own task: first the blocks of the members' own cell, which give every member a limit, then those of other cells
whose bound reaches a limit. A block meets the anchors in slices, so that no task holds more than a block and a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.llm.common import bounded, materialize, ship

SAMPLE = 4096  # rows the cells are fitted on; every row is searched
CELLS = 256  # at most
BLOCK = 8192  # candidates, about
PACK = 256  # anchors that share a list, about
SLICE = 32  # packs that meet a block in one task, about
STEP = 256  # candidates scored at a time
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers, rounded down; beyond a bigint they stop at its ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros, which changes no product."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False) if len(vectors) else np.zeros(0, int)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; what no bigint can hold stops at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = np.abs(a.astype(float)).max() * np.abs(b.astype(float)).max() * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, LOWEST, HIGHEST).astype(np.int64)


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and rows of norm 1; a zero vector stays zero."""
    wide = rows.astype(float)
    norms = np.sqrt((wide * wide).sum(axis=1))
    return norms, wide / np.where(norms > 0, norms, 1)[:, None]


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row with a centre, or with its own one. A zero vector lies in every direction."""
    cosines = units @ centres if centres.ndim == 1 else (units * centres).sum(axis=1)
    return np.where(units.any(axis=1), np.arccos(np.clip(cosines, -1, 1)), 0.0)


def fitted_cells(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of norm 1: k-means by direction. Empty cells keep their centre."""
    units = directions(sample)[1]
    centres = np.unique(units[:: max(1, len(units) // cells)][:cells], axis=0)
    for _ in range(rounds):
        near = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where((norms > 0)[:, None], sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def walk(
    anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, lows: list[list[int]], highs: list[list[int]], centre: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int, step: int = STEP,
) -> tuple[list[tuple[int, int, int, int]], int]:
    """The first ``k`` rows of each band of each anchor (by score, then smaller id), and how many products were formed.

    A band takes scores from its low to its high end; ``same`` looks at rows of the anchor's label, else at all others. An
    anchor leaves the list once the bound of the next row is below the lowest score that any of its bands still wants.
    """
    norms, units = directions(rows)
    own_norms, own_units = directions(anchors)
    radius = angles(own_units, centre).max()
    bound = norms * np.cos(np.clip(angles(units, centre) - radius, 0, np.pi))
    order = np.argsort(-bound, kind="stable")
    found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low] for low in lows]
    limits = [list(low) for low in lows]
    wanted = np.array([min(x, default=HIGHEST) for x in limits], np.int64)
    active, formed = np.array([u for u, x in enumerate(limits) if x], int), 0
    for start in range(0, len(order), step):
        reach = own_norms[active] * bound[order[start]]
        active = active[reach + np.abs(reach) * 1e-9 + 1e-6 >= wanted[active].astype(float)]
        if not len(active):
            break
        part = order[start:start + step]
        scores = products(anchors[active], rows[part])
        formed += scores.size
        fits = (anchor_labels[active][:, None] == labels[part][None, :]) == same
        fits &= anchor_ids[active][:, None] != ids[part][None, :]
        fits &= scores >= wanted[active][:, None]
        for at in np.flatnonzero(fits.any(axis=1)):
            u, mine = active[at], np.flatnonzero(fits[at])
            new, new_ids = scores[at, mine], ids[part[mine]]
            for j, (old, old_ids) in enumerate(found[u]):
                inside = (new >= limits[u][j]) & (new <= highs[u][j])
                if inside.any():
                    both, both_ids = np.concatenate([old, new[inside]]), np.concatenate([old_ids, new_ids[inside]])
                    first = np.lexsort((both_ids, ~both))[:k]  # ~x falls as x rises, without overflow
                    found[u][j] = both[first], both_ids[first]
                    if len(first) == k:
                        limits[u][j] = max(limits[u][j], int(both[first[-1]]))
            wanted[u] = min(limits[u])
    out = [(int(anchor_ids[u]), j, int(i), int(s)) for u, bands in enumerate(found) for j, (ss, ii) in enumerate(bands) for s, i in zip(ss, ii)]
    return out, formed


class Search:
    """Rows in blocks and anchors in packs, written once; ``first`` finds the best rows of each anchor's bands.

    vectors  (vec_id, label, v): unique ids, no nulls, ``v`` of whole numbers
    """

    def __init__(self, vectors: DataFrame, is_anchor: Column, block: int = BLOCK, pack: int = PACK, slice_packs: int = SLICE, cells: int | None = None, sample: int = SAMPLE, step: int = STEP):
        self.slice_packs, self.step = slice_packs, step
        seen = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(is_anchor, 1))).first()
        self.rows, self.width, self.anchors_n = seen[0], max(1, seen[1] or 1), seen[2]
        self.empty = not self.anchors_n
        if self.empty:
            return
        sample = min(sample, max(256, (1 << 20) // self.width))
        drawn = [r["v"] for r in bounded(vectors.select("vec_id", "v"), sample, id_col="vec_id").collect()]
        wanted = cells or min(CELLS, max(1, round(self.rows**0.5 / 8)))
        centres = self.centres = fitted_cells(matrix(pa.array(drawn, pa.list_(pa.int64())), self.width), wanted)
        width = self.width

        def place(batches):
            for batch in batches:
                norms, units = directions(matrix(batch.column("v"), width))
                cell = (units @ centres.T).argmax(axis=1) if len(units) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(norms), pa.array(angles(units, centres[cell]))],
                                                 names=[*batch.schema.names, "cell", "norm", "angle"])

        kind = vectors.schema["label"].dataType.simpleString()
        self.label_kind = kind
        placed = vectors.select("vec_id", "label", "v", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).mapInArrow(
            place, f"vec_id long, label {kind}, v array<bigint>, is_anchor boolean, cell int, norm double, angle double")
        placed = materialize(placed)
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("is_anchor"), 1)).alias("_anchors"))
        dealt = placed.join(F.broadcast(sizes), "cell")  # one row per cell
        chunk = lambda n, size: F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col(n) / size)))
        place_of = lambda n, size: F.col("cell").cast("long") * (1 << 40) + chunk(n, size)
        self.blocks = materialize(dealt.select("vec_id", "label", "v", "cell", "norm", "angle", place_of("_rows", block).alias("block")))
        self.packs = materialize(dealt.filter("is_anchor").select("vec_id", "label", "v", "cell", "norm", "angle", place_of("_anchors", pack).alias("pack")))
        self.pack_n = max(1, self.packs.select("pack").distinct().count())
        apart = np.arccos(np.clip(centres @ centres.T, -1, 1))
        pairs = [(i, j, float(apart[i, j])) for i in range(len(centres)) for j in range(len(centres))]
        self.apart = materialize(placed.sparkSession.createDataFrame(pairs, "cell int, block_cell int, apart double"))
        self.block_info = materialize(self.blocks.groupBy(F.col("cell").alias("block_cell"), "block").agg(F.max("norm").alias("most"), F.max("angle").alias("reach")))

    def _visit(self, bands: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
        """(anchor, band, id, score) from the blocks of the packs' own cells, or of all others that may hold more."""
        spark, width, centres, step = bands.sparkSession, self.width, self.centres, self.step
        members = bands.join(self.packs, "vec_id")
        low = F.when(F.col("norm") > 0, F.array_min("lows") / F.col("norm")).otherwise(F.lit(float("-inf")))
        info = members.groupBy("pack", "cell").agg(F.max("angle").alias("radius"), F.min(low).alias("need"))
        pairs = info.join(F.broadcast(self.apart), "cell").join(self.block_info, "block_cell")
        pairs = pairs.filter((F.col("cell") == F.col("block_cell")) if home else (F.col("cell") != F.col("block_cell")))
        closest = F.greatest(F.lit(0.0), F.col("apart") - F.col("radius") - F.col("reach"))
        best = F.greatest(F.lit(0.0), F.col("most") * F.cos(F.least(closest, F.lit(np.pi))))
        slices = -(-self.pack_n // self.slice_packs)
        pairs = pairs.filter(best * (1 + 1e-9) + 1e-6 >= F.col("need")).select(
            "pack", "block", F.pmod(F.xxhash64("pack"), F.lit(slices)).cast("int").alias("slice"))
        pairs = materialize(pairs)
        left = self.blocks.join(pairs.select("block", "slice").distinct(), "block").select("block", "slice", "vec_id", "label", "v")
        right = members.join(pairs, "pack").select(F.col("block").alias("met"), F.col("slice").alias("met_slice"), "pack", "cell", "vec_id", "label", "v", "lows", "highs")
        ship(spark)

        def tile(key, block, anchors):
            rows, ids = matrix(block.column("v"), width), block.column("vec_id").to_numpy()
            levels = {x: n for n, x in enumerate(sorted({*block.column("label").to_pylist(), *anchors.column("label").to_pylist()}))}
            codes = lambda t: np.array([levels[x] for x in t.column("label").to_pylist()], np.int64)
            labels, own_labels, own, own_ids = codes(block), codes(anchors), matrix(anchors.column("v"), width), anchors.column("vec_id").to_numpy()
            lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
            packs, cells, out = anchors.column("pack").to_numpy(), anchors.column("cell").to_numpy(), []
            for pack in np.unique(packs) if len(rows) else ():
                at = np.flatnonzero(packs == pack)
                out += walk(own[at], own_ids[at], own_labels[at], [lows[i] for i in at], [highs[i] for i in at], centres[cells[at[0]]],
                            rows, ids, labels, same, k, step)[0]
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "band", "id", "score"])

        return left.groupBy("block", "slice").cogroup(right.groupBy("met", "met_slice")).applyInArrow(tile, "anchor long, band int, id long, score long")

    def first(self, bands: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, band, rank, id, score): the first ``k`` rows of each band of (vec_id, lows, highs), ranked from 1."""
        def merged(found):
            by = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
            return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

        bands = materialize(bands)
        near = materialize(merged(self._visit(bands, True, same, k)))
        full = near.filter(F.col("rank") == k).groupBy(F.col("anchor").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("_full"))
        raised = F.transform("lows", lambda x, j: F.greatest(x, F.try_element_at(F.col("_full"), j)))  # greatest() leaves nulls out
        far = self._visit(materialize(bands.join(full, "vec_id", "left").select("vec_id", raised.alias("lows"), "highs")), False, same, k)
        return merged(near.drop("rank").unionByName(far))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **sizes,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)

    Scores are inner products of vectors scaled to whole numbers. An anchor's positives are its first rows of the same
    label, and their negatives the first rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's; equal scores go by smaller id. ``is_anchor`` is a condition on ``vec_id``.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Of rows that repeat an id
    the one with the smallest label and vector counts. Vectors of different length are compared as if the shorter one
    had zeros at its end; an empty one is a zero vector, whose scores are 0. Other columns are ignored. A positive
    with a score below 0 has no negatives.
    """
    if not 0 <= low <= high:
        raise ValueError("low and high are percentages, low not above high")
    v = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", "label", scaled(F.col("v"), scale).alias("v"))
    ship(vectors.sparkSession)
    once = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"))
    search = Search(once, is_anchor, **sizes)
    if search.empty:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anything = F.array(F.lit(LOWEST)).alias("lows"), F.array(F.lit(HIGHEST)).alias("highs")
    best = materialize(search.first(once.filter(is_anchor).select("vec_id", *anything), True, positives))
    ordered = best.filter("score >= 0").groupBy(F.col("anchor").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: x["score"]).alias("s"))
    wide = "cast(x AS decimal(30,0))"  # a product of whole numbers that no bigint need hold
    bands = ordered.select("vec_id", F.expr(f"transform(s, x -> ({wide} * {low} + 99) div 100)").alias("lows"),
                           F.expr(f"transform(s, x -> {wide} * {high} div 100)").alias("highs"))
    found = search.first(bands, False, negatives)
    known = best.select("anchor", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(known, ["anchor", "band"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
