"""The 2-D map: levels of detail, tiles, viewports, heat and terrain rasters, label picking."""

from __future__ import annotations

import math
import struct
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions.scalar import key_hash
from corpuscope.operators.stages import cut_lineage, stored

#: Points of the coarsest level along an axis.
BASE = 32
#: Ranges of hashes in which points are counted.
RANGES = 4096


def lod_levels(count: int) -> int:
    """Levels of detail for so many points: each quadruples the points shown, the last shows all."""
    return max(1, math.ceil(math.log2(max(1, count) / BASE**2) / 2) + 1)


def map_meta(points: DataFrame) -> DataFrame:
    """One row: extent, score range, count and levels."""
    aggs = [f(c).alias(f"{c}_{n}") for c in ("x", "y", "score") for n, f in (("min", F.min), ("max", F.max))]
    levels = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("count"), F.lit(1)) / BASE**2) / 2) + 1).cast("int")
    return points.agg(*aggs, F.count("*").alias("count")).withColumn("lod_levels", levels)


def _cell(c: str, n: int) -> Column:
    width = (F.col(f"{c}_max") - F.col(f"{c}_min")) / n
    return F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}_min"), width)), F.lit(n - 1)), F.lit(0)).cast("int")


def with_cells(points: DataFrame, meta: DataFrame, n: int, prefix: str) -> DataFrame:
    """Add ``{prefix}_x`` and ``{prefix}_y``: the cell of each point on an n by n grid over the whole extent."""
    placed = points.crossJoin(F.broadcast(meta.select("x_min", "x_max", "y_min", "y_max")))
    return placed.withColumns({f"{prefix}_x": _cell("x", n), f"{prefix}_y": _cell("y", n)}).drop("x_min", "x_max", "y_min", "y_max")


def top_per_cell(points: DataFrame, meta: DataFrame, lod: int) -> DataFrame:
    """The best point (then the smallest id) of every cell of a level."""
    celled = with_cells(points, meta, BASE << lod, "cell")
    best = celled.groupBy("cell_x", "cell_y").agg(_best_of_cell().alias("b"))
    return best.select("cell_x", "cell_y", F.col("b.id").alias("id"), F.col("b.score").alias("score"))


def lod_sample(points: DataFrame, meta: DataFrame) -> DataFrame:
    """``lod, id``: each level holds the best point per cell, then points of earlier levels, then others by hash, up to its size; the last holds all.

    All points are read once, for the cells of the finest grid. The best of a cell is the best of its four cells' best, and of the
    others a level of n points can only take some of the first n of all by hash. So a level's work goes with its size, and
    the sizes of all add up to four thirds of the last sample.
    """
    levels = meta.select("lod_levels").first()["lod_levels"]
    last = points.select(F.lit(levels - 1).alias("lod"), "id")
    if levels == 1:
        return last
    celled = with_cells(points.select("id", "x", "y", "score"), meta, BASE << (levels - 2), "cell")
    placed = stored(celled.select("id", "score", "cell_x", "cell_y", key_hash(F.col("id")).alias("at")), "placed")
    finest = placed.groupBy("cell_x", "cell_y").agg(_best_of_cell().alias("b"))
    best = [cut_lineage(finest.select("cell_x", "cell_y", "b.id", "b.score"))]
    for _ in range(levels - 2):
        wider = best[0].groupBy(*[F.shiftright(c, 1).alias(c) for c in ("cell_x", "cell_y")]).agg(_best_of_cell().alias("b"))
        best.insert(0, cut_lineage(wider.select("cell_x", "cell_y", "b.id", "b.score")))
    counts = {r["range"]: r["count"] for r in placed.groupBy(_hash_range(F.col("at")).alias("range")).count().collect()}
    out, before = [], None
    for lod in range(levels - 1):
        n, seen, ranges = (BASE << lod) ** 2, 0, 0
        while seen < n and ranges < RANGES:
            seen, ranges = seen + counts.get(ranges, 0), ranges + 1
        turns = best[lod].select("id", F.lit(0).alias("turn")).union(placed.where(F.col("at") < ranges * ((1 << 32) // RANGES)).select("id", F.lit(2)))
        if before is not None:
            turns = turns.union(before.select("id", F.lit(1)))
        ranked = cut_lineage(turns.groupBy("id").agg(F.min("turn").alias("turn")).withColumn("at", key_hash(F.col("id"))))
        before = cut_lineage(first_rows(ranked, n))
        out.append(before.select(F.lit(lod).alias("lod"), "id"))
    return reduce(DataFrame.unionByName, [*out, last])


def _best_of_cell() -> Column:
    return F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id")))


def _hash_range(at: Column, ranges: int = RANGES) -> Column:
    return F.floor(at / ((1 << 32) // ranges)).cast("int")


def first_rows(ranked: DataFrame, n: int, ranges: int = RANGES) -> DataFrame:
    """The ``id`` of the first ``n`` rows of ``ranked(id, turn, at)`` by turn, at (a hash below 2^32) and id.

    Rows are counted by turn and range of hashes, a table of a few thousand numbers, which tells in which range the n-th row
    lies: ranges before it are taken whole, and only that one is sorted.
    """
    placed = ranked.withColumn("range", _hash_range(F.col("at"), ranges))
    left = n
    for row in sorted(placed.groupBy("turn", "range").count().collect()):
        if row["count"] > left:
            here = (F.col("turn") == row["turn"]) & (F.col("range") == row["range"])
            whole = (F.col("turn") < row["turn"]) | (F.col("turn") == row["turn"]) & (F.col("range") < row["range"])
            return placed.where(whole).select("id").union(placed.where(here).orderBy("at", "id").limit(left).select("id"))
        left -= row["count"]
    return placed.select("id")


def tile_range(meta: DataFrame, lod: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """One row ``tile_x_min, tile_x_max, tile_y_min, tile_y_max``: the tiles of a level that a viewport touches."""
    n = 1 << lod

    def at(c: str, v: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(F.floor(F.try_divide((F.lit(v) - F.col(f"{c}_min")) * n, F.col(f"{c}_max") - F.col(f"{c}_min"))), F.lit(0)))).cast("int")

    return meta.select(at("x", x0).alias("tile_x_min"), at("x", x1).alias("tile_x_max"), at("y", y0).alias("tile_y_min"), at("y", y1).alias("tile_y_max"))


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """The map's tiles as Parquet, a folder per level and row of tiles, so that a lookup reads only those that it asks for.

    Tasks write ranges of tiles, so there are about as many files as folders and tasks, not their product.
    """
    tiles.repartitionByRange("lod", "tile_y", "tile_x", "chunk").sortWithinPartitions("lod", "tile_y", "tile_x", "chunk").write.partitionBy("lod", "tile_y").mode("overwrite").parquet(folder)


def viewport_tiles(spark: SparkSession, folder: str, meta: DataFrame, lod: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The written tiles of a level that a viewport touches."""
    r = tile_range(meta, lod, x0, y0, x1, y1).first()
    tiles = spark.read.parquet(folder).where((F.col("lod") == lod) & F.col("tile_y").between(r["tile_y_min"], r["tile_y_max"]))
    return tiles.where(F.col("tile_x").between(r["tile_x_min"], r["tile_x_max"]))


def lod_tiles(points: DataFrame, sample: DataFrame, meta: DataFrame, most: int = 4096) -> DataFrame:
    """``lod, tile_x, tile_y, chunk, points``: each level's points by tile, 2^lod tiles an axis, sorted by id.

    A tile with more than ``most`` points comes in as many chunks as leave about so many to each, dealt by a hash of the id, so
    that no row grows with the density of the map.
    """
    placed = sample.join(points, "id").crossJoin(F.broadcast(meta.select("x_min", "x_max", "y_min", "y_max")))
    n = F.pow(F.lit(2.0), F.col("lod"))

    def tile(c: str) -> Column:
        at = F.floor(F.try_divide((F.col(c) - F.col(f"{c}_min")) * n, F.col(f"{c}_max") - F.col(f"{c}_min")))
        return F.coalesce(F.least(at, n.cast("long") - 1), F.lit(0)).cast("int")

    tiled = stored(placed.select("lod", tile("x").alias("tile_x"), tile("y").alias("tile_y"), F.struct("id", "x", "y", "score").alias("p")), "tiled")
    # only tiles with several chunks are looked up; these are at most points / most
    full = tiled.groupBy("lod", "tile_x", "tile_y").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")).where("chunks > 1")
    dealt = tiled.join(full, ["lod", "tile_x", "tile_y"], "left").withColumn("chunk", F.pmod(F.xxhash64("p.id"), F.coalesce("chunks", F.lit(1))).cast("int"))
    return dealt.groupBy("lod", "tile_x", "tile_y", "chunk").agg(F.sort_array(F.collect_list("p")).alias("points"))


def lod_of_zoom(zoom: float, levels: int) -> int:
    return max(0, min(levels - 1, int(zoom)))


def viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a rectangle, best first."""
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).orderBy(F.desc("score"), "id")


def nearest_points(points: DataFrame, x: float, y: float, k: int = 10) -> DataFrame:
    square = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("dist2", square).orderBy("dist2", "id").limit(k)


def terrain_cells(points: DataFrame, meta: DataFrame, dpi: float = 32) -> DataFrame:
    """``cell_x, cell_y, density``: log(points + 1) per cell, ``dpi`` cells a unit."""
    placed = points.crossJoin(F.broadcast(meta.select("x_min", "x_max", "y_min", "y_max")))

    def cell(c: str) -> Column:
        width = F.floor((F.col(f"{c}_max") - F.col(f"{c}_min")) * dpi)
        return F.greatest(F.lit(0), F.least(F.floor((F.col(c) - F.col(f"{c}_min")) * dpi), width - 1)).cast("int")

    return placed.groupBy(cell("x").alias("cell_x"), cell("y").alias("cell_y")).agg(F.log1p(F.count("*").cast("double")).alias("density"))


def blurred(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, separable, edges mirrored."""
    if sigma <= 0:
        return grid
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pads = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        grid = np.apply_along_axis(np.convolve, axis, np.pad(grid, pads, mode="symmetric"), kernel, "valid")
    return grid


def png(rgba: np.ndarray) -> bytes:
    """An image file of (height, width, 4) bytes."""
    h, w, _ = rgba.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgba.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def dense(cells: pd.DataFrame, value: str, upscale: int, size: tuple[int, int]) -> np.ndarray:
    """Cells on a full grid of ``size`` (width, height), repeated ``upscale`` times along each axis."""
    grid = np.zeros(size[::-1])
    filled = cells[cells["cell_x"].notna()]
    grid[filled["cell_y"].astype(int), filled["cell_x"].astype(int)] = filled[value]
    return grid.repeat(upscale, axis=0).repeat(upscale, axis=1)


def heat_image(cells: DataFrame, size: DataFrame, color: tuple[int, int, int], alpha_scale: float = 2.0, sigma: int = 4, upscale: int = 2) -> DataFrame:
    """One row ``width, height, png``: the cells blurred, as alpha of one colour.

    ``size`` is one row (width, height) of cells: that of the whole map, so that the picture of a narrow query lies on it where
    it belongs. Without a cell the picture is clear.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = dense(pdf, "weight", upscale, (int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])))
        alpha = np.clip(blurred(grid, sigma) * alpha_scale, 0, 1)
        rgba = np.zeros((*alpha.shape, 4), np.uint8)
        rgba[..., :3], rgba[..., 3] = color, (alpha * 255).astype(np.uint8)
        return pd.DataFrame({"width": [alpha.shape[1]], "height": [alpha.shape[0]], "png": [png(rgba)]})

    return size.join(cells, F.lit(True), "left").groupBy().applyInPandas(draw, "width int, height int, png binary")


def _outline(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Outer boundary of the shape that ``start`` (its first cell in reading order) belongs to, clockwise."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    path, at, back = [start], start, 4
    first_move = None
    while True:
        for turn in range(1, 9):
            d = (back + turn) % 8
            to = (at[0] + around[d][0], at[1] + around[d][1])
            if inside(to):
                break
        else:
            return path
        if (at, d) == first_move:
            return path[:-1] if len(path) > 1 and path[-1] == path[0] else path
        first_move = first_move or (at, d)
        at, back = to, (d + 4) % 8
        path.append(at)


def _corners(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A closed path without the points at which it goes straight on."""
    step = lambda a, b: (b[0] - a[0], b[1] - a[1])
    return [p for i, p in enumerate(path) if step(path[i - 1], p) != step(p, path[(i + 1) % len(path)])]


def _shapes(mask: np.ndarray) -> list[tuple[int, int]]:
    """First cell in reading order of each 8-connected shape."""
    seen = np.zeros(mask.shape, bool)
    starts = []
    for cell in map(tuple, np.argwhere(mask)):
        if not seen[cell]:
            starts.append(cell)
            stack = [cell]
            seen[cell] = True
            while stack:
                y, x = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        to = y + dy, x + dx
                        if 0 <= to[0] < mask.shape[0] and 0 <= to[1] < mask.shape[1] and mask[to] and not seen[to]:
                            seen[to] = True
                            stack.append(to)
    return starts


def terrain_paths(cells: DataFrame, meta: DataFrame, dpi: float = 32, upscale: int = 1, sigma: int = 1, contours: int = 4) -> DataFrame:
    """``level, path_id, path``: outlines of equal-density shapes of the blurred grid, as map coordinates.

    Outlines of fewer than four points are no polygons and left out; so are those of level 0 with a point in the first row or
    column: only holes in higher ground are of interest there. The grid's size is bounded by the map's extent.
    """

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        size = tuple(max(1, int((pdf[f"{c}_max"].iloc[0] - pdf[f"{c}_min"].iloc[0]) * dpi)) for c in ("x", "y"))
        grid = blurred(dense(pdf, "density", upscale, size), sigma * upscale)
        step = (grid.max() - grid.min()) / contours
        levels = np.clip((grid - grid.min()) // step, 0, contours - 1) if step > 0 else np.zeros(grid.shape)
        x0, y0 = pdf["x_min"].iloc[0], pdf["y_min"].iloc[0]
        rows = []
        for level in range(contours):
            mask = levels == level
            for start in _shapes(mask):
                cells = _corners(_outline(mask, start))
                if len(cells) < 4 or level == 0 and any(0 in cell for cell in cells):
                    continue
                path = [{"x": float(x0 + x / upscale / dpi), "y": float(y0 + y / upscale / dpi)} for y, x in cells]
                rows.append((level, len(rows), path))
        return pd.DataFrame(rows, columns=["level", "path_id", "path"])

    return cells.crossJoin(F.broadcast(meta.select("x_min", "y_min", "x_max", "y_max"))).groupBy().applyInPandas(trace, "level int, path_id int, path array<struct<x:double,y:double>>")


def per_group_sample(rows: DataFrame, group: str, n: int) -> DataFrame:
    """``n`` rows of each group, chosen by hash of their id."""
    w = Window.partitionBy(group).orderBy(key_hash(F.col("id")), "id")
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).drop("pick")
