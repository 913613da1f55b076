"""The declarative query: similarity to query vectors, derived columns, range filters, weighted score, outputs.

A query compiles to one lazy DataFrame per output. Similarities are computed where the vectors are scanned, so that one
number per row joins the other columns, never a vector; constant range filters on base columns sit below that join, where
Catalyst pushes them into the scan; derived columns that nothing uses are not made.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import scalar, vectors
from corpuscope.operators.spatial import heat_image
from corpuscope.operators.stages import cut_lineage

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class Clip:
    min: float
    max: float


@dataclass(frozen=True)
class ItemsOutput:
    """Rows in order; ties by id."""

    cols: tuple[str, ...] = ("id", "final_score")
    order_by: str = "final_score"
    order_asc: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class GroupByOutput:
    """Aggregates per value of ``by``, or per bucket of it; one aggregate per column, the last named wins."""

    by: str
    bucket: float | None = None
    cols: tuple[tuple[str, str], ...] = (("final_score", "sum"),)
    order_by: str = "group"
    order_asc: bool = True
    limit: int | None = None


@dataclass(frozen=True)
class HeatmapOutput:
    """Sum of scores per cell of a grid over the whole dataset's extent, ``density`` cells a unit; drawn as an image if a colour is given."""

    density: float
    color: tuple[int, int, int] | None = None
    alpha_scale: float = 1.0
    sigma: int = 1
    upscale: int = 1


Output = ItemsOutput | GroupByOutput | HeatmapOutput


@dataclass(frozen=True)
class Dataset:
    """``rows`` has ``id``, its other columns and ``emb_key``; ``vectors`` has ``vec_id`` and ``embedding`` of length 1."""

    name: str
    rows: DataFrame
    vectors: DataFrame


@dataclass(frozen=True)
class QueryInput:
    outputs: tuple[Output, ...]
    queries: tuple[tuple[float, ...], ...] = ()
    sim_agg: str = "mean"
    ts_decay: float = 0.1
    now_days: float | None = None
    pre_filter_ann: int | None = None
    scales: dict[str, Clip] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    weights: dict[str, str | float] = field(default_factory=dict)
    post_filter_clip: dict[str, Clip] = field(default_factory=dict)


def validate(q: QueryInput, columns: list[str]) -> None:
    """Raise ValueError for what the query names and nothing makes."""
    known = {*columns, "final_score", *([] if not q.queries else ["sim"]), *(["ts_norm"] if "ts_day" in columns and q.now_days is not None else [])}
    for kind, names in (("scale", q.scales), ("threshold", q.thresholds)):
        for c in names:
            if c not in known:
                raise ValueError(f"no column {c!r} to {kind}")
        known |= {f"{c}_scaled" if kind == "scale" else f"{c}_thresh" for c in names}
    used = [*q.weights, *[w for w in q.weights.values() if isinstance(w, str)], *q.post_filter_clip]
    for o in q.outputs:
        if isinstance(o, ItemsOutput):
            used += [*o.cols, o.order_by]
        elif isinstance(o, GroupByOutput):
            used += [o.by, *[c for c, _ in o.cols]]
            if o.order_by != "group" and o.order_by not in dict(o.cols):
                raise ValueError(f"no group column {o.order_by!r}")
            if unknown := {a for _, a in o.cols} - set(AGGREGATES):
                raise ValueError(f"no aggregate {sorted(unknown)}")
        else:
            used += ["x", "y"]
    for c in used:
        if c not in known:
            raise ValueError(f"no column {c!r}")
    if not q.outputs:
        raise ValueError("no output")


def _range(c: str, clip: Clip) -> Column:
    return F.col(c).between(F.lit(float(clip.min)), F.lit(float(clip.max)))


def scored(dataset: Dataset, q: QueryInput) -> DataFrame:
    """Rows that pass all filters, with the derived columns and ``final_score``."""
    rows = dataset.rows
    validate(q, rows.columns)
    floats = {f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")}
    base = [_range(c, r) for c, r in q.post_filter_clip.items() if c in rows.columns]
    if base:  # on the stored columns, so that ranges reach the scan; NaN is above any bound and falls out
        rows = rows.where(reduce(and_, base))
    rows = rows.withColumns({c: scalar.no_nan(F.col(c)) for c in floats})
    if q.queries:
        queries = [list(v) for v in q.queries]
        if q.pre_filter_ann is not None:
            sims = vectors.top_k_union(dataset.vectors, queries, q.pre_filter_ann)
            each = [F.col(f"sim_{i}") for i in range(len(queries))]
            sim = each[0] if len(each) == 1 else reduce(add, each) / len(each) if q.sim_agg == "mean" else (F.least if q.sim_agg == "min" else F.greatest)(*each)
            sims = sims.select("vec_id", sim.alias("sim"))
        else:
            each = vectors.many_similarities(dataset.vectors, np.asarray(queries, float))
            how = {"mean": F.aggregate("sims", F.lit(0.0), lambda a, b: a + b) / len(queries), "min": F.array_min("sims"), "max": F.array_max("sims")}
            if q.sim_agg not in how:
                raise ValueError(f"no similarity aggregate {q.sim_agg!r}")
            sims = each.select("vec_id", how[q.sim_agg].alias("sim"))
        sims = sims.withColumn("sim", scalar.no_nan(F.col("sim")))
        if "sim" in q.post_filter_clip:
            sims = sims.where(_range("sim", q.post_filter_clip["sim"]))
        rows = rows.join(sims, rows["emb_key"] == sims["vec_id"]).drop("vec_id")
    if "ts_day" in rows.columns and q.now_days is not None:
        rows = rows.withColumn("ts_norm", scalar.recency(F.col("ts_day"), q.now_days, q.ts_decay))
    rows = rows.withColumns({f"{c}_scaled": scalar.scaled(F.col(c).cast("double"), r.min, r.max) for c, r in q.scales.items()})
    rows = rows.withColumns({f"{c}_thresh": scalar.reaches(F.col(c).cast("double"), t) for c, t in q.thresholds.items()})
    terms = [F.coalesce(F.col(c) * (F.col(w) if isinstance(w, str) else F.lit(float(w))), F.lit(0.0)) for c, w in q.weights.items()]
    rows = rows.withColumn("final_score", reduce(add, terms, F.lit(0.0)))
    late = [_range(c, r) for c, r in q.post_filter_clip.items() if c not in dataset.rows.columns and c != "sim"]
    return rows.where(reduce(and_, late)) if late else rows


def _ordered(df: DataFrame, by: str, asc: bool, tie: str, limit: int | None) -> DataFrame:
    out = df.orderBy(F.asc_nulls_last(by) if asc else F.desc_nulls_last(by), tie)
    return out.limit(limit) if limit is not None else out


def extent(rows: DataFrame) -> DataFrame:
    """One row: the extent of all points."""
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def grid_size(whole: DataFrame, density: float) -> DataFrame:
    """One row ``width, height``: the cells of a grid over the extent of ``whole``, one an axis at least."""
    cells = lambda c: F.greatest(F.lit(1), F.floor((F.col(f"{c}_max") - F.col(f"{c}_min")) * density)).cast("int")
    return extent(whole).select(cells("x").alias("width"), cells("y").alias("height"))


def heat_cells(points: DataFrame, whole: DataFrame, density: float, weight: str = "final_score", agg: str = "sum") -> DataFrame:
    """``cell_x, cell_y, weight``: the aggregate of a weight per cell, the grid laid over the extent of ``whole``."""
    placed = points.crossJoin(F.broadcast(extent(whole)))

    def cell(c: str) -> Column:
        width = F.floor((F.col(f"{c}_max") - F.col(f"{c}_min")) * density)
        return F.greatest(F.lit(0), F.least(F.floor((F.col(c) - F.col(f"{c}_min")) * density), width - 1)).cast("int")

    return placed.select(cell("x").alias("cell_x"), cell("y").alias("cell_y"), F.col(weight).alias("w")).groupBy("cell_x", "cell_y").agg(AGGREGATES[agg]("w").alias("weight"))


def compile_query(dataset: Dataset, q: QueryInput) -> list[DataFrame]:
    """One DataFrame per output. With several outputs the scored rows are written once, and each output reads them."""
    rows = scored(dataset, q)
    if len(q.outputs) > 1:
        rows = cut_lineage(rows)
    out = []
    for o in q.outputs:
        if isinstance(o, ItemsOutput):
            out.append(_ordered(rows, o.order_by, o.order_asc, "id", o.limit).select(*o.cols))
        elif isinstance(o, GroupByOutput):
            group = scalar.bucket(F.col(o.by), o.bucket) if o.bucket is not None else F.col(o.by)
            named = rows.withColumn("group", group).where("`group` is not null")
            aggs = [AGGREGATES[how](c).alias(c) for c, how in dict(o.cols).items()]
            out.append(_ordered(named.groupBy("group").agg(*aggs), o.order_by, o.order_asc, "group", o.limit))
        else:
            cells = heat_cells(rows, dataset.rows, o.density)
            out.append(cells if o.color is None else heat_image(cells, grid_size(dataset.rows, o.density), o.color, o.alpha_scale, o.sigma, o.upscale))
    return out
