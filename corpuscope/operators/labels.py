"""Labels of the whole map: at every zoom the best titles that do not overlap, carried on to all deeper zooms.

Greedy picking in order of score depends on what was picked before, across all borders. It is done in rounds: regions of the
picture, each a group of its own, decide what they can decide alone. A label that lies whole in a region meets there
all that it could overlap; it is picked unless it overlaps a pick, or waits if a better label that it overlaps is undecided
itself. What waits goes to the next round, with regions moved by half, so that every label lies whole in one of four. Of
many labels that begin in one place a round decides the best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.stages import cut_lineage, first_of

#: Fixed values of the drawing, in pixels: size of the type, gap and radius of the point, margin above and below, padding of the map.
FONT_SIZE, POINT_GAP, POINT_RADIUS, MARGIN_Y, PADDING = 13, 4, 3, 6, 32
#: Width of a letter as a share of the type's size, zooms per level of detail, and what a title's length is cut to (one byte).
LETTER, ZOOMS_PER_LOD, MOST_LETTERS = 0.6, 3, 255
#: Regions in pixels: more than twice the widest and highest label.
REGION_X, REGION_Y = 4096, 512
#: Cells in which a region looks for overlaps.
CELL_X, CELL_Y = 256, 32
#: Cells in which labels look for picks, labels (or cells of picks) that are few, and the labels of a small cell that a round decides.
GRID_X, GRID_Y, SMALL, OF_CELL = 512, 64, 200_000, 8
BOX = ["x0", "x1", "y0", "y1"]


def zoom_scale(zoom: int, base: float) -> float:
    """Pixels per unit of the map."""
    return base * (1 + 1 / ZOOMS_PER_LOD) ** zoom


def base_scale(meta: DataFrame, width: int, height: int) -> float:
    """Pixels per unit at zoom 0: the map fills the shorter side of the window. 1 for a map without extent."""
    m = meta.first()
    pixels, axis = (height, "y") if height < width else (width, "x")
    extent = (m[f"{axis}_max"] or 0.0) - (m[f"{axis}_min"] or 0.0)
    return (pixels - 2 * PADDING) / extent if extent else 1.0


def with_boxes(points: DataFrame, scale: float, last: bool) -> DataFrame:
    """Add ``x0, x1, y0, y1`` in pixels: the label of a point (x, y, letters) begins at it, at half its height."""
    high = FONT_SIZE + 2 * (0 if last else MARGIN_Y)
    x, y = F.col("x") * scale, F.col("y") * scale
    wide = F.least(F.col("letters"), F.lit(MOST_LETTERS)) * (FONT_SIZE * LETTER) + (POINT_RADIUS + POINT_GAP)
    return points.withColumns({"x0": x, "x1": x + wide, "y0": y - high / 2, "y1": y + high / 2})


class _Boxes:
    """Boxes of a region by cell; borders that touch overlap."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], list[tuple[float, float, float, float]]] = {}

    @staticmethod
    def places(box: tuple[float, float, float, float]) -> Iterator[tuple[int, int]]:
        x0, x1, y0, y1 = box
        for i in range(int(x0 // CELL_X), int(x1 // CELL_X) + 1):
            for j in range(int(y0 // CELL_Y), int(y1 // CELL_Y) + 1):
                yield i, j

    def add(self, box: tuple[float, float, float, float]) -> None:
        for place in self.places(box):
            self.cells.setdefault(place, []).append(box)

    def overlaps(self, box: tuple[float, float, float, float]) -> bool:
        x0, x1, y0, y1 = box
        return any(a0 <= x1 and x0 <= a1 and b0 <= y1 and y0 <= b1 for place in self.places(box) for a0, a1, b0, b1 in self.cells.get(place, ()))


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by region, then from the best label to the worst: the ids of those that are picked.

    A row without an id stands for labels of its cell that were left out, all worse than the one before it: what its box overlaps
    waits, unless a label of the cell is picked, which all others of the cell overlap.
    """
    region, picked, waiting, done = None, _Boxes(), _Boxes(), set()
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            if region != (r.rx, r.ry):
                region, picked, waiting, done = (r.rx, r.ry), _Boxes(), _Boxes(), set()
            box = r.x0, r.x1, r.y0, r.y1
            if r.left_out:
                if (r.cx, r.cy) not in done:
                    waiting.add(box)
            elif picked.overlaps(box):
                continue
            elif r.whole and not waiting.overlaps(box):
                picked.add(box)
                done.add((r.cx, r.cy))
                out.append(r.id)
            else:
                waiting.add(box)
        yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})


def _regions(boxes: DataFrame, turn: int) -> DataFrame:
    """One row per region that a box touches; ``whole`` if that is just one."""
    dx, dy = (turn & 1) * REGION_X / 2, (turn >> 1 & 1) * REGION_Y / 2

    def touched(lo: str, hi: str, size: int, shift: float) -> Column:
        return F.sequence(F.floor((F.col(lo) + shift) / size), F.floor((F.col(hi) + shift) / size))

    spread = boxes.withColumns({"xs": touched("x0", "x1", REGION_X, dx), "ys": touched("y0", "y1", REGION_Y, dy)})
    whole = (F.size("xs") == 1) & (F.size("ys") == 1)
    return spread.withColumn("whole", whole).withColumn("rx", F.explode("xs")).withColumn("ry", F.explode("ys")).drop("xs", "ys")


def _clear_of(labels: DataFrame, picks: DataFrame) -> DataFrame:
    """The labels that overlap none of ``picks(x0, x1, y0, y1)``, found by the cell in which a label begins."""
    wide, high = labels.agg(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).first()
    if wide is None:
        return labels
    cell = lambda c, size: F.floor(c / size)
    spots = picks.select(*[F.col(c).alias(f"p_{c}") for c in BOX])
    # one cell more at each end, so that rounding loses none
    spots = spots.withColumn("gx", F.explode(F.sequence(cell(F.col("p_x0") - wide, GRID_X) - 1, cell(F.col("p_x1"), GRID_X) + 1)))
    spots = spots.withColumn("gy", F.explode(F.sequence(cell(F.col("p_y0") - high, GRID_Y) - 1, cell(F.col("p_y1"), GRID_Y) + 1)))
    spots = cut_lineage(spots)
    placed = labels.withColumns({"gx": cell(F.col("x0"), GRID_X), "gy": cell(F.col("y0"), GRID_Y)})
    over = [placed["gx"] == spots["gx"], placed["gy"] == spots["gy"], F.col("p_x0") <= F.col("x1"), F.col("x0") <= F.col("p_x1"), F.col("p_y0") <= F.col("y1"), F.col("y0") <= F.col("p_y1")]
    near = F.broadcast(spots) if spots.count() <= SMALL else spots
    return placed.join(near, over, "left_anti").drop("gx", "gy")


def _front(left: DataFrame, count: int) -> DataFrame:
    """What is decided now: all labels if they are few, else the best of every cell, followed by a row for those that are left out.

    Cells are as small as the smallest label, so that all labels that begin in one overlap each other.
    """
    if count <= SMALL:
        return left.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long"), "left_out": F.lit(False)})
    low_x, low_y, wide, high = left.agg(*[f(F.col(f"{c}1") - F.col(f"{c}0")) for f in (F.min, F.max) for c in "xy"]).first()
    # a little smaller, so that rounding doesn't part two that overlap
    celled = left.withColumns({"cx": F.floor(F.col("x0") / (low_x * 0.99)), "cy": F.floor(F.col("y0") / (low_y * 0.99)), "left_out": F.lit(False)})
    best = cut_lineage(first_of(celled, ["cx", "cy"], [F.desc_nulls_last("score"), F.asc("id")], OF_CELL + 1))
    place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(F.desc_nulls_last("score"), "id"))
    ranked = best.withColumn("place", place)
    box = {"x0": F.col("cx") * (low_x * 0.99) - 1, "x1": (F.col("cx") + 1) * (low_x * 0.99) + wide + 1, "y0": F.col("cy") * (low_y * 0.99) - 1, "y1": (F.col("cy") + 1) * (low_y * 0.99) + high + 1}
    return ranked.select(*celled.columns[:2], *[F.when(F.col("place") > OF_CELL, v).otherwise(F.col(k)).alias(k) for k, v in box.items()], "cx", "cy", (F.col("place") > OF_CELL).alias("left_out"))


def greedy(labels: DataFrame, picks: DataFrame) -> DataFrame:
    """The ``id`` of each of ``labels(id, score, x0, x1, y0, y1)`` that greedy picking keeps beside ``picks(x0, x1, y0, y1)``.

    From the greatest score down (then the smallest id, null scores last), a label is kept if it overlaps no pick and no label
    kept before. Equal to one serial pass over all labels. What overlaps a pick goes in a join; of the rest only the best of
    each small cell are decided in a round, so a region's work is bounded by its area, however many labels begin there.
    """
    left, kept, turn = cut_lineage(_clear_of(labels.select("id", "score", *BOX), picks.select(*BOX))), None, 0
    while count := left.count():
        dealt = _regions(_front(left, count), turn).repartition("rx", "ry").sortWithinPartitions("rx", "ry", F.desc_nulls_last("score"), "id")
        picked = dealt.select("rx", "ry", "id", "left_out", "whole", "cx", "cy", *BOX).mapInPandas(_decide, "id long").distinct()
        new = cut_lineage(left.join(picked, "id").select("id", *BOX))
        kept = new.select("id") if kept is None else kept.unionByName(new.select("id"))
        left, turn = cut_lineage(_clear_of(left, new)), (turn + 1) % 4
    return labels.select("id").where("false") if kept is None else kept


def pick_labels(points: DataFrame, sample: DataFrame, meta: DataFrame, *, width: int = 1280, height: int = 800, zooms: int | None = None) -> DataFrame:
    """``zoom, id, since``: the labelled points at every zoom, and the zoom at which each was first picked.

    ``points(id, x, y, score, letters)`` with distinct ids, ``sample(lod, id)`` the points of each level of detail, ``meta`` one row
    with the map's extent and levels. A zoom chooses among its level's points; what an earlier zoom picked stays, whatever its
    labels overlap by then, and is in the way of others. Points without a place are left out; null titles have no letters.
    """
    m = meta.first()
    levels = m["lod_levels"]
    base = base_scale(meta, width, height)
    last = levels * ZOOMS_PER_LOD if zooms is None else zooms
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")).alias("score"), F.coalesce("letters", F.lit(0)).alias("letters"))
    candidates = cut_lineage(sample.join(placed, "id"))
    picked = cut_lineage(placed.limit(0).withColumn("since", F.lit(0)))
    for zoom in range(last + 1):
        lod = min(levels - 1, zoom // ZOOMS_PER_LOD)
        boxed = lambda df: with_boxes(df, zoom_scale(zoom, base), lod == levels - 1)  # noqa: B023, E731
        fresh = boxed(candidates.where(F.col("lod") == lod).join(picked.select("id"), "id", "left_anti"))
        kept = greedy(fresh, boxed(picked))
        picked = cut_lineage(picked.unionByName(placed.join(kept, "id").withColumn("since", F.lit(zoom))))
    # a pick is shown from its zoom on
    return picked.select(F.explode(F.sequence(F.col("since"), F.lit(last))).alias("zoom"), "id", "since")
