"""Distance to the nearest member of a set, exact, without pairing every row with every member."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.functions.numeric import euclid
from areapanel.operators.distribution import below_group_quantile
from areapanel.operators.scale import BROADCAST_BYTES, ONE_TASK_ROWS, lookup_join, materialize, materialize_counted, number_rows

# A leaf of the tree holds at most this many members, wherever they lie.
LEAF_MEMBERS = 16
# A node is cut into so many strips, and each strip into as many tiles.
WAYS = 4
# So many members are sent to the tasks with their tree: 16 bytes each, and 40 for a leaf, which has four members or so.
SENT_MEMBERS = BROADCAST_BYTES // 26
# Of a tree with more members the levels are sent that have so many nodes at most: 48 bytes each, and the nodes above them.
SENT_NODES = BROADCAST_BYTES // 56
# Places that a task takes at a time, and pairs of a place and a node that it looks at.
PLACES_AT_ONCE = 1_024
NODES_AT_ONCE = 4_096


def _finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))  # false for NaN, NULL for NULL


def _placed(df: DataFrame, by: Sequence[str], x: str, y: str, names: tuple[str, str]) -> DataFrame:
    """Distinct places per group; a place has two finite coordinates and a group no NULL key."""
    out = df.select(*by, F.col(x).cast("double").alias(names[0]), F.col(y).cast("double").alias(names[1]))
    return out.dropna("any").filter(_finite(F.col(names[0])) & _finite(F.col(names[1]))).distinct()


def _wide(function) -> Column:
    """Whether the members that ``function`` sums up span at least as much of the first coordinate as of the second."""
    return function(F.max("_mx")) - function(F.min("_mx")) >= function(F.max("_my")) - function(F.min("_my"))


def _cut(spots: DataFrame, part: Sequence[str], name: str, in_windows: bool) -> DataFrame:
    """Deal the rows of each part, in the order of the coordinate that spans more there, into ``WAYS`` runs whose sizes differ by one at most."""
    if in_windows:
        spots = spots.withColumn("_wide", _wide(lambda c: c.over(Window.partitionBy(*part))))
    else:
        spots = lookup_join(spots, spots.groupBy(*part).agg(_wide(lambda c: c).alias("_wide")), part, "inner")
    first, second = F.when(F.col("_wide"), F.col("_mx")).otherwise(F.col("_my")), F.when(F.col("_wide"), F.col("_my")).otherwise(F.col("_mx"))
    spots = spots.withColumns({"_first": first, "_second": second}).drop("_wide")
    if in_windows:
        return spots.withColumn(name, F.ntile(WAYS).over(Window.partitionBy(*part).orderBy("_first", "_second")) - 1).drop("_first", "_second")
    numbered = number_rows(spots, part, [F.col("_first").asc(), F.col("_second").asc()], "_no")
    sizes = numbered.groupBy(*part).agg(F.max("_no").alias("_size"))
    dealt = lookup_join(numbered, sizes, part, "inner")
    # The same runs as ntile's: the first (size mod WAYS) of them have one row more.
    short, longer = F.expr(f"_size div {WAYS}"), F.col("_size") % WAYS
    run = F.when(F.col("_no") <= longer * (short + 1), F.expr(f"(_no - 1) div (_size div {WAYS} + 1)")).otherwise(
        longer + F.try_divide(F.col("_no") - 1 - longer * (short + 1), short).cast("bigint"))
    return dealt.withColumn(name, run.cast("int")).drop("_no", "_size", "_first", "_second")


def member_tree(members: DataFrame, by: Sequence[str], x: str, y: str, leaf: int = LEAF_MEMBERS, one_task_rows: int | None = None) -> tuple[DataFrame, int]:
    """(by, _mx, _my, _node): distinct members and the leaf each is in, and the depth of the tree.

    Nodes are cut at quantiles of their own members' coordinates, so a leaf's size does not depend on where members lie, and
    across their longer side, so that leaves are no long strips where one coordinate spans far more than the other. A
    level below is ``_node`` divided by ``WAYS`` squared. While a group is too large for one task it is cut over ranges.
    """
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    spots, _ = materialize_counted(_placed(members, by, x, y, ("_mx", "_my")).withColumn("_node", F.lit(0).cast("bigint")))
    largest = spots.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    depth, size, above = 0, largest, []
    while size > leaf:
        # Rows stay in the task of a node above them, as all rows it is cut into lie there.
        part = [*by, *above, "_node"]
        spots = _cut(spots, part, "_strip", size <= limit)
        spots = _cut(spots, [*part, "_strip"], "_tile", size <= limit)
        spots = spots.withColumn("_node", F.col("_node") * WAYS * WAYS + F.col("_strip") * WAYS + F.col("_tile")).drop("_strip", "_tile")
        depth, size = depth + 1, -(-(-(-size // WAYS)) // WAYS)
        if size > limit:
            spots = materialize(spots)
        elif not above:
            spots, above = spots.withColumn("_above", F.col("_node")), ["_above"]
    return (materialize(spots.drop("_above")) if depth else spots), depth


def _arrays(
    nodes: DataFrame, groups: DataFrame, by: Sequence[str], depth: int, at: Sequence[str]
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """A tree as arrays: per level where a node's children begin, per level the nodes' boxes, the rows' columns ``at`` and their ``_node``.

    A node's children lie together on the level below, and a lowest node's rows among all rows. On the first level a node is a group.
    A row has the coordinates of a member, or the corners of a box.
    """
    rows = lookup_join(nodes, groups, by, "inner").select("_group", "_node", *at).toArrow()
    group, node, *at = [rows[c].to_numpy() for c in rows.column_names]
    order = np.lexsort((node, group))
    group, node, at = group[order], node[order], np.stack([c[order] for c in at])
    begins, boxes, low, high, ids = [], [], at[:2], at[-2:], node
    for level in range(depth, -1, -1):
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
        first = np.flatnonzero(new)
        begins.insert(0, np.append(first, len(group)))
        low, high = np.minimum.reduceat(low, first, axis=1), np.maximum.reduceat(high, first, axis=1)
        boxes.insert(0, np.concatenate([low, high]))
        group, node = group[first], node[first] // (WAYS * WAYS)
    return begins, boxes, at, ids


def _numbered(tree: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _group): the groups that have members, numbered from 0."""
    groups = number_rows(tree.select(*by).distinct(), [], [F.col(c).asc() for c in by], "_group")
    return materialize(groups.withColumn("_group", F.col("_group") - 1))


def _searching(sent, nodes: bool = False) -> Callable[[Iterator[tuple[pd.Series, pd.Series, pd.Series]]], Iterator[pd.Series]]:
    """Distance from each place to the nearest member of its group, a number as in ``_arrays``; none for a negative number.

    A place descends the tree: of the children of its nodes it keeps those whose nearest possible member is not farther than a
    member that one of them is known to have. Distances to boxes are rounded as those to members are, step by step, so
    the bounds hold for rounded distances too. ``sent`` is a broadcast of ``_arrays``, with members or ``_node``. If it is of ``nodes``, what
    comes out is a list of those one of which has the nearest member.
    """
    places_at_once, nodes_at_once = PLACES_AT_ONCE, NODES_AT_ONCE

    def squared(dx, dy):
        return dx * dx + dy * dy

    def sides(q, low, high):
        """Distances to the box along one axis: to it, to its nearer face, to its farther face."""
        one, other = np.abs(q - low), np.abs(q - high)
        return np.maximum(np.maximum(low - q, q - high), 0), np.minimum(one, other), np.maximum(one, other)

    def search(begins, boxes, rows, names, group, x, y):
        best, last, met = np.full(len(group), np.inf), len(boxes) - 1, []
        fronts = [(0, np.arange(len(group)), group, np.zeros(len(group)))]
        while fronts:  # the deepest first, so that what is kept is bounded however many nodes are met
            level, who, at, low = fronts.pop()
            if nodes and level == last:
                met.append((who, at, low))
                if len(group) > 1 and sum(len(c[0]) for c in met) > 64 * nodes_at_once:  # about as near to very many nodes: fewer places at a time
                    half = len(group) // 2
                    return [ids for i in (slice(half), slice(half, None)) for ids in search(begins, boxes, rows, names, group[i], x[i], y[i])]
                continue
            if len(at) > nodes_at_once:
                fronts += [(level, *(c[i : i + nodes_at_once] for c in (who, at, low))) for i in range(0, len(at), nodes_at_once)]
                continue
            start, n = begins[level][at], begins[level][at + 1] - begins[level][at]
            child = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            first = (np.cumsum(n) - n)[np.flatnonzero(np.append(True, who[1:] != who[:-1]))]
            who = np.repeat(who, n)
            qx, qy = x[who], y[who]
            if level == last:
                known = squared(qx - rows[0][child], qy - rows[1][child])
            else:
                x0, y0, x1, y1 = (side[child] for side in boxes[level + 1])
                (dx, near_x, far_x), (dy, near_y, far_y) = sides(qx, x0, x1), sides(qy, y0, y1)
                # Each face of a smallest box has a member on it, so one is as near as the far end of the nearer face.
                known = np.minimum(squared(near_x, far_y), squared(far_x, near_y))
            best[who[first]] = np.minimum(best[who[first]], np.minimum.reduceat(known, first))
            if level < last:
                low = squared(dx, dy)
                kept = np.flatnonzero((low <= best[who]) & (nodes | (low < np.inf)))
                if len(kept):
                    fronts.append((level + 1, who[kept], child[kept], low[kept]))
        if not nodes:
            return np.sqrt(best)
        who, at, low = (np.concatenate(c) for c in zip(*met))
        kept = np.flatnonzero(low <= best[who])
        kept = kept[np.argsort(who[kept], kind="stable")]
        return np.split(names[at[kept]], np.searchsorted(who[kept], np.arange(1, len(group))))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            group, x, y = (c.to_numpy() for c in batch)
            out = np.full(len(group), None if nodes else np.nan)
            asked = np.flatnonzero(group >= 0)
            with np.errstate(over="ignore", under="ignore"):
                for i in range(0, len(asked), places_at_once):
                    some = asked[i : i + places_at_once]
                    got = search(*sent.value, group[some], x[some], y[some])
                    for j, listed in zip(some, got) if nodes else ():
                        out[j] = listed
                    if not nodes:
                        out[some] = got
            yield pd.Series(out)

    return run


def candidate_pairs(
    points: DataFrame, members: DataFrame, by: Sequence[str], x: str, y: str, leaf: int = LEAF_MEMBERS, lookup_rows: int | None = None,
    one_task_rows: int | None = None,
) -> DataFrame:
    """(by, _qx, _qy, _mx, _my): each distinct place with the few members one of which is its nearest.

    A place descends the members' tree: of the children of its nodes it keeps those whose nearest possible member is not
    farther than a member that one of them is known to have. Levels that can be sent to the tasks (``SENT_NODES``, or
    ``lookup_rows``) are descended there; below them, each level's front is written out, so that plans stay short.
    """
    by = list(by)
    return _pairs(points, *member_tree(members, by, x, y, leaf, one_task_rows), by, x, y, lookup_rows)


def _front(places: DataFrame, tree: DataFrame, depth: int, by: Sequence[str], lookup_rows: int | None) -> tuple[DataFrame, int]:
    """Places at the nodes that one of their nearest members is below, and the level of the nodes: the lowest one that can be sent."""
    sides = {"_x0": F.min("_x0"), "_y0": F.min("_y0"), "_x1": F.max("_x1"), "_y1": F.max("_y1")}
    boxes = tree.select(*by, "_node", *[F.col(c).alias(n) for n, c in zip(sides, ("_mx", "_my", "_mx", "_my"))])
    for level in range(depth, 0, -1):
        boxes, rows = materialize_counted(boxes.groupBy(*by, "_node").agg(*[c.alias(n) for n, c in sides.items()]))
        if 0 < rows <= (SENT_NODES if lookup_rows is None else lookup_rows):
            groups = _numbered(boxes, by)
            begins, corners, _, names = _arrays(boxes, groups, by, level, list(sides))
            sent = places.sparkSession.sparkContext.broadcast((begins, corners, None, names))
            search = F.pandas_udf(_searching(sent, nodes=True), T.ArrayType(T.LongType()))
            found = lookup_join(places, groups, by, "inner", limit=lookup_rows, derived=False)
            return materialize(found.select(*places.columns, search("_group", "_qx", "_qy").alias("_nodes"))).select(
                *places.columns, F.explode("_nodes").alias("_node")), level
        boxes = boxes.withColumn("_node", F.expr(f"_node div {WAYS * WAYS}"))
    return places.withColumn("_node", F.lit(0).cast("bigint")), 0


def _pairs(points: DataFrame, tree: DataFrame, depth: int, by: Sequence[str], x: str, y: str, lookup_rows: int | None) -> DataFrame:
    """``candidate_pairs`` of the members of a tree."""
    keys = [*by, "_qx", "_qy"]
    front, sent = _front(_placed(points, by, x, y, ("_qx", "_qy")), tree, depth, by, lookup_rows)
    front = front.withColumn("_best", F.lit(float("inf")))
    qx, qy = F.col("_qx"), F.col("_qy")

    def sides(q, low, high):
        """Distances to the box along one axis: to it, to its nearer face, to its farther face."""
        return F.greatest(low - q, q - high, F.lit(0.0)), F.least(F.abs(q - low), F.abs(q - high)), F.greatest(F.abs(q - low), F.abs(q - high))

    for level in range(sent + 1, depth + 1):
        shift = WAYS ** (2 * (depth - level))
        node = F.expr(f"_node div {shift}")
        boxes = tree.groupBy(*by, node.alias("_child")).agg(
            F.min("_mx").alias("_x0"), F.max("_mx").alias("_x1"), F.min("_my").alias("_y0"), F.max("_my").alias("_y1"))
        boxes = boxes.withColumn("_node", F.expr(f"_child div {WAYS * WAYS}"))
        met = lookup_join(front, boxes, [*by, "_node"], "inner", limit=lookup_rows)
        (dx, near_x, far_x), (dy, near_y, far_y) = sides(qx, F.col("_x0"), F.col("_x1")), sides(qy, F.col("_y0"), F.col("_y1"))
        # Each face of a smallest box has a member on it, so one is as near as the far end of the nearer face.
        known = F.least(F.hypot(near_x, far_y), F.hypot(far_x, near_y))
        met = met.select(*keys, F.col("_child").alias("_node"), F.hypot(dx, dy).alias("_low"), F.least("_best", known).alias("_known"))
        met = met.withColumn("_best", F.min("_known").over(Window.partitionBy(*keys)))
        # A little slack, because the two bounds are rounded each in its own way.
        front = materialize(met.filter(F.col("_low") <= F.col("_best") * (1 + 1e-12)).select(*keys, "_node", "_best"))
    return lookup_join(front.drop("_best"), tree, [*by, "_node"], "inner", limit=lookup_rows, derived=False).select(*keys, "_mx", "_my")


def _nearest_sent(points: DataFrame, tree: DataFrame, depth: int, by: Sequence[str], x: str, y: str, name: str, lookup_rows: int | None) -> DataFrame:
    """``nearest_in_set`` by tasks that have the whole tree: points are not shuffled."""
    groups = _numbered(tree, by)
    begins, boxes, at, _ = _arrays(tree, groups, by, depth, ["_mx", "_my"])
    sent = points.sparkSession.sparkContext.broadcast((begins, boxes, at, None))
    search = F.pandas_udf(_searching(sent), T.DoubleType())
    place = [F.col(c).cast("double") for c in (x, y)]
    marked = lookup_join(points, groups, by, "left", limit=lookup_rows, derived=False)
    asked = F.when(_finite(place[0]) & _finite(place[1]), F.col("_group"))
    return marked.select(*points.columns, search(F.coalesce(asked, F.lit(-1)), *[F.coalesce(c, F.lit(0.0)) for c in place]).alias(name))


def nearest_in_set(
    points: DataFrame, members: DataFrame, by: Sequence[str], x: str, y: str, name: str = "proximity",
    leaf: int = LEAF_MEMBERS, lookup_rows: int | None = None, one_task_rows: int | None = None,
) -> DataFrame:
    """Smallest straight-line distance from each point to a member of the same group.

    Members that can be sent to the tasks (``SENT_MEMBERS``, or ``lookup_rows``) are searched there. Beyond that, distances are
    computed once per distinct place, to its ``candidate_pairs``, and joined back. A place has two finite
    coordinates: NULL where the point has none, where its group key is NULL, or where a group has no member.
    """
    by = list(by)
    if not by:
        raise ValueError("give the group columns; a constant column makes one group")
    tree, depth = member_tree(members, by, x, y, leaf, one_task_rows)
    if 0 < tree.count() <= (SENT_MEMBERS if lookup_rows is None else lookup_rows):
        return _nearest_sent(points, tree, depth, by, x, y, name, lookup_rows)
    keys = [*by, "_qx", "_qy"]
    met = _pairs(points, tree, depth, by, x, y, lookup_rows)
    found = met.groupBy(*keys).agg(F.min(euclid(F.col("_qx"), F.col("_qy"), F.col("_mx"), F.col("_my"))).alias(name))
    marked = points.withColumns({"_qx": F.col(x).cast("double"), "_qy": F.col(y).cast("double")})
    return lookup_join(marked, found, keys, "left", limit=lookup_rows).select(*points.columns, name)


def proximity_to_top(
    panel: DataFrame, value: str, x: str, y: str, p: float = 0.9, year: str = "year", name: str = "proximity", **kw
) -> DataFrame:
    """Distance to the nearest area at or above the year's quantile ``p`` of ``value``."""
    top = below_group_quantile(panel.select(year, value, x, y), [year], value, p, at_or_above=True)
    return nearest_in_set(panel, top, [year], x, y, name, **kw)
