"""Plans, restarts, pictures, encoders and lookups of the core."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import encoders, scalar
from corpuscope.operators import features, ml, serve, spatial
from corpuscope.plans.query import Clip, Dataset, HeatmapOutput, ItemsOutput, QueryInput, compile_query
from corpuscope.streaming import ingest


def test_ranges_reach_the_scan_and_drop_nan(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame([(i, float(i) if i != 5 else float("nan"), i % 3) for i in range(20)] + [(99, None, 0)], "id long, votes double, emb_key long").write.parquet(path)
    data = Dataset("t", spark.read.parquet(path), spark.createDataFrame([], "vec_id long, embedding array<float>"))
    found = compile_query(data, QueryInput((ItemsOutput(("id",), "id", True),), post_filter_clip={"votes": Clip(3, 8)}))[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(votes,3.0)" in pushed and "LessThanOrEqual(votes,8.0)" in pushed
    assert [r["id"] for r in found.collect()] == [3, 4, 6, 7, 8]


def test_heat_image_has_the_size_of_the_whole_map(spark):
    whole = spark.createDataFrame([(0, 0.0, 0.0, 1), (1, 4.0, 2.0, 1)], "id long, x double, y double, emb_key long")
    data = Dataset("t", whole.withColumn("votes", F.col("id").cast("double")), spark.createDataFrame([], "vec_id long, embedding array<float>"))
    for clip, empty in ((Clip(0, 0), False), (Clip(5, 6), True)):
        q = QueryInput((HeatmapOutput(10.0, (1, 2, 3), 1.0, 0, 2),), weights={"votes": 1.0}, post_filter_clip={"votes": clip})
        row = compile_query(data, q)[0].collect()[0]
        assert (row["width"], row["height"]) == (80, 40) and struct.unpack(">II", bytes(row["png"])[16:24]) == (80, 40), empty


def test_terrain_leaves_out_lines_and_the_sea(spark):
    rows = [(x, y, 5.0 if 4 <= x < 10 and 4 <= y < 10 else 0.0) for x in range(14) for y in range(14)]
    cells = spark.createDataFrame(rows, "cell_x int, cell_y int, density double")
    meta = spark.createDataFrame([(0.0, 0.0, 14.0, 14.0)], "x_min double, y_min double, x_max double, y_max double")
    got = spatial.terrain_paths(cells, meta, dpi=1, sigma=0, contours=2).collect()
    assert [r["level"] for r in got] == [1] and {(p["x"], p["y"]) for p in got[0]["path"]} == {(4, 4), (9, 4), (9, 9), (4, 9)}
    line = spark.createDataFrame([(x, y, 5.0 if y == 6 and 3 <= x < 9 else 0.0) for x, y, _ in rows], "cell_x int, cell_y int, density double")
    assert spatial.terrain_paths(line, meta, dpi=1, sigma=0, contours=2).count() == 0


def test_first_rows_against_sorting(spark):
    rows = [(i, i % 3, (i * 2654435761) % 2**32) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, turn int, at long")
    for n in (0, 1, 999, 1000, 1001, 2345, 3000, 5000):
        want = {i for i, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0]))[:n]}
        assert {r["id"] for r in spatial.first_rows(df, n, ranges=16).collect()} == want


def test_tiles_written_and_looked_up(spark, tmp_path):
    r = np.random.default_rng(1)
    points = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(r.random((5000, 2)))], "id long, x double, y double, score double")
    meta = spatial.map_meta(points)
    spatial.write_tiles(spatial.lod_tiles(points, spatial.lod_sample(points, meta), meta), str(tmp_path / "map"))
    found = spatial.viewport_tiles(spark, str(tmp_path / "map"), meta, 1, 0.6, 0.1, 0.9, 0.2)
    assert [(t["tile_x"], t["tile_y"]) for t in found.collect()] == [(1, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lod" in plan[plan.index("PartitionFilters") :].split("]")[0]


def test_lsh_recall_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 32))
    x = base[r.integers(0, 40, 1500)] + r.normal(size=(1500, 32)) * 0.35
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    v = spark.createDataFrame([(i, [float(f) for f in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in ml.lsh_nearest_many(v, v.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(row["vec_id"], set()).add(row["other"])
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    want = {q: set(np.argsort(-sims[q])[:10].tolist()) for q in range(0, 1500, 50)}
    assert all(len(g) <= 10 for g in got.values())
    assert sum(len(want[q] & got.get(q, set())) for q in want) >= 0.9 * 10 * len(want)


def test_encoders(spark):
    e = encoders.HashingEncoder(64)
    rows = spark.createDataFrame([(1, "One two two"), (2, None), (None, "three"), (1, "one TWO two"), (3, "word " * 50_000)], "id long, text string")
    got = [(r["id"], r["embedding"]) for r in encoders.encode_texts(rows, e).collect()]
    vectors = {i: v for i, v in got}
    assert len(got) == 5 and [v for i, v in got if i == 1][0] == [v for i, v in got if i == 1][1]
    assert not any(vectors[2]) and abs(sum(x * x for x in vectors[3]) - 1) < 1e-6
    assert np.allclose(vectors[1], encoders.encode_query(e, "two one two"), atol=1e-6)
    assert encoders.encode_texts(rows.limit(0), e).count() == 0
    # sums are taken word by word
    texts, want = ["b a\tB c a b", "", "x", "ß ẞ İ é\u2003é"], np.zeros((4, 64))
    for i, text in enumerate(texts):
        words = text.lower().split()
        for w in dict.fromkeys(words):
            h = zlib.crc32(w.encode())
            want[i, h % 64] += (1 if h >> 31 else -1) * (1 + math.log(words.count(w)))
    length = np.sqrt((want * want).sum(1, keepdims=True))
    assert np.array_equal(e.encode(texts), want / np.where(length > 0, length, 1)) and e.encode([]).shape == (0, 64)

    class Wrong:
        name, dim = "wrong", 3

        def encode(self, texts):
            return np.zeros((len(texts), 2))

    with pytest.raises(Exception, match="wrong returned"):
        encoders.encode_texts(rows, Wrong()).collect()


def test_url_parts(spark):
    cases = {
        "http://Example.COM": ("http", "example.com/"), " https://a.b:443/x%2fY?b=2&a=1#f ": ("https", "a.b/x%2FY?a=1&b=2"), "http://a.b:8080/?": ("http", "a.b:8080/"),
        "ftp://a.b/": (None, None), "": (None, None), "https://u:p@h.i/p?q": ("https", "h.i/p?q"), "http://a.b/100%": ("http", "a.b/100%"),
        "http://a.b/x/../y/./z/..?q": ("http", "a.b/y/?q"), "http://a.b/../..": ("http", "a.b/"), "http://a.b/./x/%2E%2e/.": ("http", "a.b/"), "http://a.b/...//x": ("http", "a.b/...//x"), "http://a.b/x/..y": ("http", "a.b/x/..y"),
        "http://a.b/" + "x" * 2996: ("http", "a.b/" + "x" * 2996), "http://a.b/" + "x" * 2997: (None, None), "http://a.b/" + "é" * 1499: (None, None),
    }
    proto, rest = scalar.url_parts(F.col("u"))
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string")
    assert {r["u"]: (r["p"], r["r"]) for r in df.select("u", proto.alias("p"), rest.alias("r")).collect()} == {**cases, None: (None, None)}


def test_interaction_training_against_brute_force(spark):
    r = np.random.default_rng(4)
    ids = r.permutation(300)
    posts, comments = {int(i): r.normal(size=2) for i in ids[:120]}, {int(i): (int(r.integers(0, 5)), r.normal(size=2)) for i in ids[120:]}
    met = {(int(r.integers(0, 5)), int(p)) for p in r.choice([*posts, 1000, 1001], 200)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = features.interaction_training(
        frame([*met, next(iter(met))], "user long, post long"), frame([(i, v.tolist()) for i, v in posts.items()], "id long, embedding array<double>"), frame([(i, u, v.tolist()) for i, (u, v) in comments.items()], "id long, user long, embedding array<double>"), 2
    ).collect()
    assert {(r["user"], r["post"]) for r in got} == {(u, p) for u, p in met if p in posts} and len(got) == len({(u, p) for u, p in met if p in posts})
    for row in got:
        before = [v for i, (u, v) in comments.items() if u == row["user"] and i < row["post"]]
        history = [posts[p] for u, p in met if u == row["user"] and p in posts and p < row["post"]]
        assert (row["n_before"], row["n_history"]) == (len(before), len(history))
        for mean, of in ((row["average"], before), (row["history"], history)):
            assert mean is None if not of else np.allclose(mean, np.mean(of, axis=0))


def test_stream_restart_with_nothing_new_and_with_more(spark, tmp_path):
    schema = "k long, seq long"
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "t", "c"))
    run = lambda: {r["k"]: r["seq"] for r in ingest.ingest(spark.readStream.schema(schema).parquet(source), table, checkpoint, "k", "seq").collect()}
    spark.createDataFrame([(1, 1), (2, 5)], schema).write.parquet(source)
    assert run() == {1: 1, 2: 5} and run() == {1: 1, 2: 5}
    spark.createDataFrame([(1, 7), (2, 2), (3, 3)], schema).write.mode("append").parquet(source)
    assert run() == {1: 7, 2: 5, 3: 3} and run() == {1: 7, 2: 5, 3: 3}
