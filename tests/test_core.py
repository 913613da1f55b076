"""Functions, the declarative query, the map, upserts and streams on small frames."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import html, scalar, vectors
from corpuscope.operators import features, ml, serve, spatial, upsert
from corpuscope.plans.query import Clip, Dataset, GroupByOutput, HeatmapOutput, ItemsOutput, QueryInput, compile_query
from corpuscope.sources import tables
from corpuscope.streaming import ingest

NAN = float("nan")


@pytest.fixture(scope="module")
def dataset(spark):
    rows = [(0, 10.0, -1.0, 0, 0.0, 0.0), (1, 20.0, 8.0, 1, 1.0, 1.0), (2, NAN, 8.5, 2, 0.5, 0.5), (3, 20.0, None, 0, 0.2, 0.9), (4, 5.0, -7.5, 3, 0.9, 0.1)]
    vecs = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, None), (9, [1.0, 0.0, 0.0])]
    return Dataset("t", spark.createDataFrame(rows, "id long, votes double, ts_day double, emb_key long, x double, y double"), spark.createDataFrame(vecs, "vec_id long, embedding array<float>"))


def one(dataset, q):
    return [tuple(r) for r in compile_query(dataset, q)[0].collect()]


def test_items_sort_ties_and_nulls(dataset):
    q = QueryInput((ItemsOutput(("id", "final_score")),), weights={"votes": 1.0})
    assert one(dataset, q) == [(1, 20.0), (3, 20.0), (0, 10.0), (4, 5.0), (2, 0.0)]
    assert [r[0] for r in one(dataset, QueryInput((ItemsOutput(("id",), "votes", True),)))] == [4, 0, 1, 3, 2]


def test_similarity_aggregates_and_filters(dataset):
    base = {"queries": ((1.0, 0.0), (0.0, 1.0)), "outputs": (ItemsOutput(("id", "sim"), "id", True),)}
    got = {how: {i: round(s, 5) for i, s in one(dataset, QueryInput(sim_agg=how, **base))} for how in ("mean", "min", "max")}
    assert got == {"mean": {0: 0.5, 1: 0.5, 2: 0.7, 3: 0.5}, "min": {0: 0.0, 1: 0.0, 2: 0.6, 3: 0.0}, "max": {0: 1.0, 1: 1.0, 2: 0.8, 3: 1.0}}
    assert [r[0] for r in one(dataset, QueryInput(post_filter_clip={"sim": Clip(0.6, 1), "votes": Clip(0, 99)}, **base))] == []
    near = one(dataset, QueryInput((ItemsOutput(("id", "sim"), "id", True),), ((1.0, 0.0),), pre_filter_ann=1))
    assert near == [(0, 1.0), (3, 1.0)]


def test_filters_commute_with_derived_columns(dataset):
    q = QueryInput((ItemsOutput(("id", "votes_scaled", "votes_thresh"), "id", True),), scales={"votes": Clip(0, 10)}, thresholds={"votes": 10}, post_filter_clip={"votes_thresh": Clip(1, 1), "ts_day": Clip(-5, 5)})
    assert one(dataset, q) == [(0, 1.0, 1)]


def test_groups_floor_and_skip_nulls(dataset):
    q = QueryInput((GroupByOutput("ts_day", 7.0, (("votes", "sum"), ("id", "count"))),))
    assert one(dataset, q) == [(-2, 5.0, 1), (-1, 10.0, 1), (1, 20.0, 2)]


def test_heat_cells_and_many_outputs(dataset):
    q = QueryInput((HeatmapOutput(2.0), ItemsOutput(("id",), limit=1)), weights={"y": 1.0})
    cells, items = compile_query(dataset, q)
    assert {(r["cell_x"], r["cell_y"]): r["weight"] for r in cells.collect()} == {(0, 0): 0.0, (1, 1): 1.5, (0, 1): 0.9, (1, 0): 0.1}
    assert items.count() == 1


@pytest.mark.parametrize("bad", [{"weights": {"nope": 1.0}}, {"scales": {"nope": Clip(0, 1)}}, {"post_filter_clip": {"scaled": Clip(0, 1)}}, {"weights": {"sim": 1.0}}, {"outputs": ()}])
def test_unknown_names_raise(dataset, bad):
    with pytest.raises(ValueError):
        compile_query(dataset, QueryInput(**({"outputs": (ItemsOutput(),)} | bad)))


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.scaled(F.lit(5.0), 1, 1).alias("empty"), scalar.bucket(F.lit(-0.5), 7).alias("floor"), scalar.reaches(F.lit(NAN), 0.5).alias("nan"), scalar.log_norm(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("flat"),
        scalar.sentiment_sign(F.lit(0.4), F.lit(0.3), F.lit(0.3)).alias("pos"), scalar.sentiment_sign(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("neg"), scalar.clean_title(F.lit(" show hn: A b ")).alias("title"),
        scalar.site_of(F.lit("a.b/c/d")).alias("site"), scalar.kv_id(F.lit("post/12/emb")).alias("kv"), scalar.kv_id(F.lit("post/x/emb")).alias("kv_bad"), scalar.rfc3339(F.lit("nope")).alias("ts_bad"),
        scalar.days_into(F.lit("2024-03-03 12:00:00").cast("timestamp"), "week").alias("week"), scalar.title_bytes(F.lit("é")).alias("bytes"), scalar.anchor_links(F.lit("http://x.y z http://q")).alias("link"),
    ).first()
    assert row.asDict() == {"empty": None, "floor": -1, "nan": 0, "flat": 0.0, "pos": 0.4, "neg": -0.5, "title": "A b", "site": "a.b", "kv": 12, "kv_bad": None, "ts_bad": None, "week": 0.5, "bytes": 2, "link": "http z http://q"}


def test_vector_bytes_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(vectors.floats_to_bytes(F.col("v")).alias("b"))
    assert [r[0] for r in df.select(vectors.bytes_to_floats(F.col("b"), 2)).collect()] == [[1.5, -2.0], None]


def test_running_average_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), i, ["post", "comment"][int(rng.integers(2))], rng.normal(size=3).tolist()) for i in range(60)]
    got = {r["id"]: (r["n_before"], r["average"]) for r in features.running_average(spark.createDataFrame(rows, "user_id long, id long, kind string, embedding array<double>"), 3).collect()}
    for user, i, kind, _ in rows:
        if kind == "post":
            before = [v for u, j, k, v in rows if u == user and j < i and k == "comment"]
            assert got[i][0] == len(before)
            assert got[i][1] is None if not before else np.allclose(got[i][1], np.mean(before, axis=0))


def test_contiguous_prefix(spark):
    for ids, want in (([0, 1, 2, 5], 2), ([1, 2], -1), ([], -1), ([0], 0)):
        assert features.contiguous_prefix(spark.createDataFrame([(i,) for i in ids], "id long"), 0).first()[0] == want


def test_lod_levels_nest_and_keep_the_best(spark):
    rng = np.random.default_rng(3)
    n = 6000
    points = spark.createDataFrame([(i, float(rng.random()), float(rng.random()), float(rng.integers(100))) for i in range(n)], "id long, x double, y double, score double").persist()
    meta = spatial.map_meta(points)
    sample = spatial.lod_sample(points, meta).persist()
    sizes = {r["lod"]: r["count"] for r in sample.groupBy("lod").count().collect()}
    assert sizes == {0: 1024, 1: 4096, 2: n} and meta.first()["lod_levels"] == spatial.lod_levels(n) == 3
    for lod in (0, 1):
        best = spatial.top_per_cell(points, meta, lod)
        assert best.join(sample.where(F.col("lod") == lod), "id", "left_anti").count() == 0
    tiles = spatial.lod_tiles(points, sample, meta)
    assert tiles.where("lod = 2").agg(F.sum(F.size("points"))).first()[0] == n
    # a dense tile comes in chunks of a bounded size, which hold the same points
    cut = spatial.lod_tiles(points, sample, meta, most=50)
    assert cut.agg(F.max(F.size("points"))).first()[0] < 120 and cut.where("chunk > 0").count() > 0
    ids = lambda df: sorted(map(tuple, df.select("lod", "tile_x", "tile_y", F.explode("points.id")).collect()))
    assert ids(cut) == ids(tiles)


def test_terrain_outline():
    mask = np.zeros((5, 6), bool)
    mask[1:4, 1:5] = True
    path = spatial._outline(mask, spatial._shapes(mask)[0])
    assert set(path) == {(y, x) for y in range(1, 4) for x in range(1, 5) if y in (1, 3) or x in (1, 4)}


def test_parse_page():
    page = '<html lang="en"><head><title>T&amp;t</title><meta name="description" content="d"><meta property="og:title" content="Og"></head><body><nav>n</nav><p>a <b>b</b><br>c<p>d<script>x</script></body></html>'
    got = html.parse_page(page)
    assert (got["title"], got["description"], got["lang"], got["text"]) == ("Og", "d", "en", "a b\n\nc\n\nd")
    assert html.parse_page("<body><main><article><p>in</p></article></main><p>out</p>")["text"] == "in"
    assert html.parse_page(None)["text"] == "" and html.parse_page("<title>x")["title"] is None


def test_kv_defaults_and_flags(spark):
    kv = spark.createDataFrame([("post/1/emb", b"a"), ("post/2/emb_x/dense", b"b"), ("post/z/emb", b"c")], "k string, v binary")
    assert [tuple(r) for r in tables.kv_scan(kv, "post/%/emb").collect()] == [(1, "a")]
    row = tables.without_nulls(spark.createDataFrame([(None, None, None)], "a long, b string, c boolean")).first()
    assert tuple(row) == (0, "", False)
    with pytest.raises(Exception, match="no flag"):
        tables.strict_flag(spark.createDataFrame([(2,)], "f int"), "f").collect()


def test_upserts(spark):
    current = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, seq long, v string")
    changes = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e"), (2, 5, "f")], "k long, seq long, v string")
    assert sorted(tuple(r) for r in upsert.upsert_latest(current, changes, "k", "seq").collect()) == [(1, 2, "c"), (2, 5, "f"), (3, 1, "e")]
    known = spark.createDataFrame([(4, "x")], "id long, name string")
    got = {r["name"]: r["id"] for r in upsert.dictionary_encode(known, spark.createDataFrame([("b",), ("a",), ("x",), (None,), ("a",)], "name string")).collect()}
    assert got == {"x": 4, "a": 5, "b": 6}


def test_rate_limit_admits_25_of_200(spark):
    rows = spark.range(200).select(F.col("id"), F.lit("o").alias("origin"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    assert ingest.admitted(rows).count() == 25


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = spark.range(120).select("id", (F.col("id") % 2).cast("string").alias("origin"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") / 40).cast("long")).alias("ts"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ingest.admitted_stream(stream, per_window=7).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r["id"] for r in ingest.admitted(rows, per_window=7).collect()}
    assert {r["id"] for r in spark.table("admitted").collect()} == want


def test_stream_ingest_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.range(20).select((F.col("id") % 7).alias("k"), (F.col("id") * 3 + i).alias("seq")).repartition(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r["k"]: r["seq"] for r in ingest.ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"), "k", "seq").collect()}
    assert got == {k: max(i * 3 + b for i in range(20) if i % 7 == k for b in range(3)) for k in range(7)}


def test_failure_levels(spark):
    rows = [("a", i, o) for i, o in enumerate(["timeout", "429", "ok", "404", "5xx"])] + [("b", 0, "404")]
    got = {r["origin"]: (r["level"], r["blocked_s"]) for r in ingest.failure_levels(spark.createDataFrame(rows, "origin string, id long, outcome string")).collect()}
    level = 0
    for o in ("timeout", "429", "ok", "404", "5xx"):
        level = ingest.failure_level(level, o)
    assert got == {"a": (level, math.pow(2, level)), "b": (0, 0.0)}


def test_failure_levels_fold_a_hot_origin_in_many_tasks(spark):
    r = random.Random(5)
    rows = [(o, i, r.choice(["timeout", "timeout", "404", "ok", None, "5xx"])) for i in range(6000) for o in ([1] if i % 3 else [1, 2 + i % 7, None])]
    want = {}
    for o, i, outcome in rows:
        want[o] = ingest.failure_level(want.get(o, 0), outcome)
    data = spark.createDataFrame(r.sample(rows, len(rows)), "origin long, id long, outcome string")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = ingest.failure_levels(data)
        assert {x["origin"]: x["level"] for x in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and plan.index("collect_list") < plan.index("MapInArrow")  # only folded maps are gathered
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_neighbour_lists_deal_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ml, "BLOCK_ROWS", 8, raising=False)
    v = np.random.default_rng(3).normal(size=(100, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    found = ml.neighbour_lists(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), 3)
    assert re.search(r"pmod\(xxhash64\([^)]*\), cast\(13 as bigint\)\)", found._jdf.queryExecution().analyzed().toString())
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    got = {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in found.collect()}
    assert got == {i: np.argsort(-sims[i])[:3].tolist() for i in range(100)}


def test_nearest_in_blocks_keep_ties_and_ship_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ml, "BLOCK_ROWS", 16)
    v = np.random.default_rng(5).normal(size=(90, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[40:70] = v[3]  # copies tie, smaller ids go first
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    sims = np.zeros((90, 90))
    for d in range(8):
        sims += np.outer(v[:, d].astype(np.float64), v[:, d].astype(np.float64))
    want = {i: sorted((-sims[i, j], j) for j in range(90) if j != i)[:4] for i in range(90)}
    lists = {r["vec_id"]: [(-n["sim"], n["id"]) for n in r["neighbours"]] for r in ml.neighbour_lists(df, 4).collect()}
    assert lists == want
    found = ml.lsh_nearest_many(df, df.where("vec_id % 5 = 0"), 4, bucket=100.0, tables=16)  # so wide that all meet in some table
    got = {}
    for r in found.collect():
        got.setdefault(r["vec_id"], []).append((-r["sim"], r["other"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: want[q] for q in range(0, 90, 5)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row per pair that meets


def test_lod_sample_reads_points_once_and_holds_every_level(spark):
    n, seen = 20_000, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i * 7919 % 1009)

    base = spark.range(n).select("id", (F.col("id") * 37 % 1013).cast("double").alias("x"), (F.col("id") * 53 % 997).cast("double").alias("y"))
    points = base.withColumn("score", score("id"))
    meta = spark.createDataFrame([(0.0, 1012.0, 0.0, 996.0, 4)], "x_min double, x_max double, y_min double, y_max double, lod_levels int")
    sample = spatial.lod_sample(points, meta)
    assert seen.value == n
    got = {}
    for r in sample.collect():
        got.setdefault(r["lod"], set()).add(r["id"])
    before = set()
    for lod in range(3):
        cells, side = {}, 32 << lod
        for i in range(n):
            at = tuple(min(side - 1, int(v // (m / side))) for v, m in ((i * 37 % 1013, 1012.0), (i * 53 % 997, 996.0)))
            cells[at] = min(cells.get(at, (1, 0)), (-(i * 7919 % 1009), i))
        first = {i for _, i in cells.values()}
        turn = lambda i: (0 if i in first else 1 if i in before else 2, i * 2654435761 % 2**32, i)  # noqa: B023, E731
        before = set(sorted(range(n), key=turn)[: side * side])
        assert got[lod] == before
    assert got[3] == set(range(n))


def test_entry_lists_queries_and_oracles():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
