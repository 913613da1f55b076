"""The named queries: thin, validated compositions of :class:`QueryInput`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.scalar import bucket_date
from corpuscope.plans.query import Clip, Dataset, GroupByOutput, HeatmapOutput, ItemsOutput, QueryInput, compile_query

#: How similar a row must be to count at all, per dataset.
SIM_FLOOR = {"post": 0.7, "toppost": 0.55}
Vector = list[float]


def _between(name: str, value: float, lo: float, hi: float) -> float:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be between {lo} and {hi}")
    return value


def _sim_min(hundredths: int, floor: int = 80) -> float:
    return _between("sim_min_hundredths", hundredths, floor, 100) / 100


def search(dataset: Dataset, query: Vector, *, limit: int, w_sim: float, w_score: float, w_ts: float, decay: float, now_days: float, sim_floor: float | None = None) -> DataFrame:
    """Rows by a weighted sum of scaled similarity, normalised votes and recency."""
    _between("limit", limit, 1, 128)
    has_map = {"x", "y"} <= set(dataset.rows.columns)
    cols = ("id", *(("x", "y") if has_map else ()), "sim", "final_score")
    q = QueryInput((ItemsOutput(cols, limit=limit),), (tuple(query),), ts_decay=decay, now_days=now_days, scales={"sim": Clip(SIM_FLOOR.get(dataset.name, 0.7) if sim_floor is None else sim_floor, 1.0)}, weights={"sim_scaled": w_sim, "ts_norm": w_ts, "votes_norm": w_score})
    return compile_query(dataset, q)[0]


def items(dataset: Dataset, query: Vector, *, limit: int, sim_min_hundredths: int, order_by: str, floor: int = 80) -> DataFrame:
    """Rows similar enough, by votes or time."""
    _between("limit", limit, 1, 500)
    if order_by not in ("votes", "ts"):
        raise ValueError("order_by must be votes or ts")
    q = QueryInput((ItemsOutput(("id", "sim"), order_by, limit=limit),), (tuple(query),), post_filter_clip={"sim": Clip(_sim_min(sim_min_hundredths, floor), 1.0)})
    return compile_query(dataset, q)[0]


def top_users(dataset: Dataset, query: Vector, *, limit: int, sim_min_hundredths: int, floor: int = 80) -> DataFrame:
    """Users by the sum of their comments' scaled similarity."""
    _between("limit", limit, 1, 20)
    q = QueryInput((GroupByOutput("user", cols=(("final_score", "sum"),), order_by="final_score", order_asc=False, limit=limit),), (tuple(query),), scales={"sim": Clip(_sim_min(sim_min_hundredths, floor), 1.0)}, weights={"sim_scaled": 1.0})
    return compile_query(dataset, q)[0].select(F.col("group").alias("user"), F.col("final_score").alias("score"))


def analyze_popularity(dataset: Dataset, query: Vector, *, sim_min_hundredths: int, floor: int = 80) -> DataFrame:
    """Votes times similarity per week."""
    q = QueryInput((GroupByOutput("ts_day", 7.0),), (tuple(query),), weights={"votes": "sim"}, post_filter_clip={"sim": Clip(_sim_min(sim_min_hundredths, floor), 1.0), "ts_day": Clip(1.0, float("inf"))})
    return compile_query(dataset, q)[0].select("group", bucket_date(F.col("group")).alias("week"), F.col("final_score").alias("score"))


def analyze_sentiment(dataset: Dataset, query: Vector, *, sim_min_hundredths: int, floor: int = 80) -> DataFrame:
    """Positive and negative comments per week among those similar enough."""
    t = _sim_min(sim_min_hundredths, floor)
    q = QueryInput((GroupByOutput("ts_day", 7.0, (("sent_pos_thresh", "sum"), ("sent_neg_thresh", "sum"))),), (tuple(query),), thresholds={"sim": t, "sent_pos": 0.5, "sent_neg": 0.5}, post_filter_clip={"sim_thresh": Clip(1, 1)})
    return compile_query(dataset, q)[0].select("group", bucket_date(F.col("group")).alias("week"), F.col("sent_pos_thresh").alias("positive"), F.col("sent_neg_thresh").alias("negative"))


def heatmap(dataset: Dataset, query: Vector, *, sim_floor: float | None = None, density: float = 25.0, color: tuple[int, int, int] | None = None, alpha_scale: float = 2.0, sigma: int = 4, upscale: int = 2) -> DataFrame:
    """Cells of the map by summed scaled similarity; with a colour, the picture of the whole map."""
    q = QueryInput((HeatmapOutput(density, color, alpha_scale, sigma, upscale),), (tuple(query),), scales={"sim": Clip(SIM_FLOOR.get(dataset.name, 0.7) if sim_floor is None else sim_floor, 1.0)}, weights={"sim_scaled": 1.0}, post_filter_clip={"sim_scaled": Clip(0.01, 1.0)})
    return compile_query(dataset, q)[0]
