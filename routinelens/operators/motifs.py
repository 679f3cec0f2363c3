"""Motifs of numeric series: for each window its nearest other window after normalisation, the nearest ones first.

The self-join of windows is cut into tiles. A series is held as segments of ``TILE`` windows; tasks take pairs of segments, diagonal by diagonal
of the tiles, so that no task holds more than two segments and their products. Each tile gives the least distance of its rows and of
its columns; these minima are merged by position. The work grows with the square of a series, as the profile is over all pairs, and is
spread over as many tasks as there are tiles.

Defined results: distances are Euclidean between windows of mean 0 and deviation 1; two constant windows are at distance 0, a constant one is at the
root of the length from any other. Windows nearer than a quarter of their length are the same event and not compared. Points without a number are left
out; ties go to the earlier window and the earlier neighbour. Series of fewer than four windows' points give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routinelens.model import DAY
from routinelens.storage import materialise

WINDOW, TOP, TILE = 12, 3, 1024
#: Tiles of a block, of which tasks that look for the nearest take pairs.
BLOCK = 16
#: Decimal places of a distance, so that the shape of tiles does not show.
PLACES = 6


def numbered(points: DataFrame) -> DataFrame:
    """Points (entity_id, us, sid, num) with i, their number in the series from 0. A series is numbered a day at a time, with one carried count a day."""
    rows = points.filter(F.col("num").isNotNull() & ~F.isnan("num")).select("entity_id", "us", "sid", F.col("num").cast("double").alias("num"), F.floor(F.col("us") / DAY).alias("day"))
    days = rows.groupBy("entity_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("entity_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = days.select("entity_id", "day", before.alias("before"), F.sum("n").over(W.partitionBy("entity_id")).alias("points"))
    nth = F.row_number().over(W.partitionBy("entity_id", "day").orderBy("us", "sid"))
    return rows.withColumn("nth", nth).join(carried, ["entity_id", "day"]).select("entity_id", "us", "num", "points", (F.col("before") + F.col("nth") - 1).alias("i"))


def segments(series: DataFrame, window: int, tile: int) -> DataFrame:
    """Per series and tile: the values of its windows in order, which reach into the next tile by a window less one."""
    own = F.floor(F.col("i") / tile)
    both = F.when((F.col("i") % tile < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.filter(F.col("points") >= 4 * window).select("entity_id", "i", "num", F.explode(both).alias("tile"))
    # at most tile + window - 1 values
    held = rows.groupBy("entity_id", "tile").agg(F.sort_array(F.collect_list(F.struct("i", "num")))["num"].alias("x"))
    return held.filter(F.size("x") >= window)


def _normal(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows with mean 0 and length 1, and whether each is constant (then all zero)."""
    w = np.lib.stride_tricks.sliding_window_view(x, window)
    w = w - w.mean(axis=1, keepdims=True)
    size = np.sqrt((w**2).sum(axis=1, keepdims=True))
    flat = size[:, 0] <= 1e-12 * (1 + np.abs(x).max())
    return np.where(flat[:, None], 0.0, w / np.where(flat[:, None], 1.0, size)), flat


def tile_minima(x: np.ndarray, y: np.ndarray, at_x: int, at_y: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of two segments the distance of each one's nearest in the other and its number: for the first, then for the second."""
    (a, flat_a), (b, flat_b) = _normal(x, window), _normal(y, window)
    square = 2 * window * (1 - np.clip(a @ b.T, -1, 1))
    square[flat_a, :] = window
    square[:, flat_b] = window
    square[np.ix_(flat_a, flat_b)] = 0
    far = np.round(np.sqrt(square), PLACES)
    i, j = at_x + np.arange(len(a)), at_y + np.arange(len(b))
    far[np.abs(i[:, None] - j[None, :]) <= math.ceil(window / 4)] = np.inf
    return far.min(axis=1), j[far.argmin(axis=1)], far.min(axis=0), i[far.argmin(axis=0)]


def profile(points: DataFrame, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """Per window that has another to compare with: entity_id, i (number of its first point), distance and neighbour."""
    held = materialise(segments(numbered(points), window, tile), "segments")
    left = held.select("entity_id", F.col("tile").alias("r"), F.col("x").alias("xr"))
    right = held.select("entity_id", F.col("tile").alias("c"), F.col("x").alias("xc"))
    diagonals = left.join(right, "entity_id").filter("r <= c").repartition("entity_id", F.col("c") - F.col("r"), "r")
    names = ["entity_id", "i", "distance", "neighbour"]

    def run(batches):
        for batch in batches:
            for entity, r, x, c, y in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                near, at, near_c, at_c = tile_minima(np.array(x), np.array(y), r * tile, c * tile, window)
                for first, distance, neighbour in ((r * tile, near, at), (c * tile, near_c, at_c)):
                    some = np.flatnonzero(np.isfinite(distance))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(entity, pa.string()), len(some)), pa.array(first + some), pa.array(distance[some]), pa.array(neighbour[some])], names)

    minima = diagonals.select("entity_id", "r", "xr", "c", "xc").mapInArrow(run, "entity_id string, i long, distance double, neighbour long")
    best = minima.groupBy("entity_id", "i").agg(F.min(F.struct("distance", "neighbour")).alias("best"))
    return best.select("entity_id", "i", "best.distance", "best.neighbour")


def _tiles(x: np.ndarray, window: int, tile: int) -> list[np.ndarray]:
    """The values of each tile of a block, with those its windows reach into."""
    return [x[k : k + tile + window - 1] for k in range(0, len(x) - window + 1, tile)]


def _bounds(held: DataFrame, window: int, top: int, tile: int) -> DataFrame:
    """Per series (entity_id, bound) a distance that at least ``top`` windows have a neighbour within, found inside tiles; null where there are not so many."""

    def run(batches):
        for batch in batches:
            for entity, block, x in zip(*[batch.column(k) for k in range(3)]):
                least = np.empty(0)
                for k, part in enumerate(_tiles(x.values.to_numpy(), window, tile)):
                    at = block.as_py() * BLOCK * tile + k * tile
                    least = np.sort(np.append(least, tile_minima(part, part, at, at, window)[0]))[:top]
                least = least[np.isfinite(least)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(entity.as_py(), pa.string()), len(least)), pa.array(least)], ["entity_id", "distance"])

    some = held.select("entity_id", "tile", "x").repartition(_tasks(held), "entity_id", "tile").mapInArrow(run, "entity_id string, distance double")
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy("distance"))).filter(F.col("rank") <= top)
    return first.groupBy("entity_id").agg(F.when(F.count(F.lit(1)) == top, F.max("distance")).alias("bound"))


def _tasks(df: DataFrame) -> int:
    """Blocks are few bytes and much work, so their number of tasks is told."""
    return 8 * df.sparkSession.sparkContext.defaultParallelism


def nearest(points: DataFrame, window: int = WINDOW, top: int = TOP, tile: int = TILE) -> DataFrame:
    """The rows of profile() that can be among the ``top`` of a series.

    Every pair of windows is looked at: products in single precision tell, with a margin, which tiles hold a pair within the series' bound, and only those
    are worked out as in profile(). All pairs within the bound lie in such tiles, so the least distance and the first neighbour are those of the profile.
    """
    wide = BLOCK * tile
    held = materialise(segments(numbered(points), window, wide), "segments")
    bounds = materialise(_bounds(held, window, top, tile), "bounds")
    left = held.join(bounds, "entity_id", "left").select("entity_id", "bound", F.col("tile").alias("r"), F.col("x").alias("xr"))
    right = held.select("entity_id", F.col("tile").alias("c"), F.col("x").alias("xc"))
    blocks = left.join(right, "entity_id").filter("r <= c").repartition(_tasks(held), "entity_id", F.col("c") - F.col("r"), "r")

    def run(batches):
        for batch in batches:
            for entity, bound, r, x, c, y in zip(*[batch.column(k) for k in range(6)]):
                entity, r, c = entity.as_py(), r.as_py(), c.as_py()
                far = np.inf if not bound.is_valid else bound.as_py()
                like = 1 - (far + 2 * 10.0**-PLACES) ** 2 / (2 * window) - 1e-5
                sides = []
                for values in (x, y):
                    parts = _tiles(values.values.to_numpy(), window, tile)
                    normal = [_normal(part, window) for part in parts]
                    sides.append([(part, a.astype(np.float32), flat.any()) for part, (a, flat) in zip(parts, normal)])
                for k, (px, a, flat_a) in enumerate(sides[0]):
                    for m, (py, b, flat_b) in enumerate(sides[1]):
                        if r == c and m < k:
                            continue
                        if not ((a @ b.T).max() >= like or (flat_a and flat_b) or ((flat_a or flat_b) and like <= 0.5)):
                            continue
                        at_x, at_y = r * wide + k * tile, c * wide + m * tile
                        near, at, near_c, at_c = tile_minima(px, py, at_x, at_y, window)
                        for first, distance, neighbour in ((at_x, near, at), (at_y, near_c, at_c)):
                            some = np.flatnonzero(np.isfinite(distance) & (distance <= far))
                            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(entity, pa.string()), len(some)), pa.array(first + some), pa.array(distance[some]), pa.array(neighbour[some])], ["entity_id", "i", "distance", "neighbour"])

    minima = blocks.select("entity_id", "bound", "r", "xr", "c", "xc").mapInArrow(run, "entity_id string, i long, distance double, neighbour long")
    best = minima.groupBy("entity_id", "i").agg(F.min(F.struct("distance", "neighbour")).alias("best"))
    return best.select("entity_id", "i", "best.distance", "best.neighbour")


def motifs(points: DataFrame, window: int = WINDOW, top: int = TOP, tile: int = TILE) -> DataFrame:
    """Per series its ``top`` windows of least distance: entity_id, rank, i, neighbour, distance, start_us."""
    # each tile keeps its own first ones, so the last window ranks few rows of a series
    order = ["distance", "i"]
    tiles = nearest(points, window, top, tile).withColumn("tile", F.floor(F.col("i") / tile))
    some = tiles.withColumn("rank", F.row_number().over(W.partitionBy("entity_id", "tile").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(numbered(points).select("entity_id", "i", F.col("us").alias("start_us")), ["entity_id", "i"]).select("entity_id", "rank", "i", "neighbour", "distance", "start_us")
