"""The layout of the neighbour graph, sentiment, and what is done with results."""

import glob

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from corpuscope.functions import sentiment, vectors
from corpuscope.operators import features, layout, neighbour_index, results, upsert
from corpuscope.plans.query import Dataset
from corpuscope.sources import tables


def nearest(x, k=10):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


def kept(true, y):
    return np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(true, nearest(y), strict=True)])


def test_layout_keeps_neighbours_and_places_new_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1000)] + 0.35 * rng.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    old = df.where("vec_id < 900")
    index = neighbour_index.build(old, str(tmp_path / "index"), k=15)
    layout.fit(index, str(tmp_path / "layout"), rounds=16)
    made = layout.load(spark, str(tmp_path / "layout"))
    at = {r["vec_id"]: (r["x"], r["y"]) for r in made.positions().collect()}
    y = np.array([at[i] for i in range(900)])
    true = nearest(x[:900])
    data = old.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="p").fit(data).transform(data).select("vec_id", vector_to_array("p").alias("p")).orderBy("vec_id").collect()
    assert np.isfinite(y).all() and kept(true, y) > 0.3 and kept(true, y) > 2 * kept(true, np.array([r["p"] for r in flat]))
    # new vectors land among those that they are near to
    new = {r["vec_id"]: np.array((r["x"], r["y"])) for r in made.place(df.where("vec_id >= 900")).collect()}
    assert set(new) == set(range(900, 1000))
    among = [np.linalg.norm(y[nearest_of] - new[q], axis=1).mean() for q in new for nearest_of in [np.argsort(-(x[:900] @ x[q]))[:10]]]
    assert np.median(among) < 0.2 * np.linalg.norm(y - y.mean(axis=0), axis=1).mean()


def test_a_round_of_the_layout_takes_few_jobs_and_encodes_once(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(200, 8))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(v):
        asked.add(1)
        return v

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = neighbour_index.build(df.select("vec_id", counted("embedding").alias("embedding")), str(tmp_path / "i"))
    assert asked.value == 200
    jobs = {}
    for rounds in (2, 6):
        spark.sparkContext.setJobGroup(f"layout-{rounds}", "layout")
        try:
            made = layout.fit(index, str(tmp_path / f"l{rounds}"), rounds=rounds)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"layout-{rounds}"))
    assert made.positions().count() == 200 and (jobs[6] - jobs[2]) / 4 <= 5


def test_rounds_move_packed_positions_and_equal_serial_ones(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(1500, 8))
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = neighbour_index.build(df, str(tmp_path / "i"), k=5)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, rounds, at = set(glob.glob(f"{shared}/layout-turn-*")), 3, {}
    for n in (0, rounds):
        made = layout.fit(index, str(tmp_path / f"l{n}"), rounds=n)
        at[n] = np.array([(r["x"], r["y"]) for r in made.positions().orderBy("vec_id").collect()])
    # neither a row for each link nor one for each vector is written in a round
    turns = set(glob.glob(f"{shared}/layout-turn-*")) - before
    assert len(turns) >= rounds and max(spark.read.parquet(f"file://{t}").count() for t in turns) < 100
    links = [np.array(r["around"]) // 3 for r in index.table("links").orderBy("vec_id").collect()]
    y = at[0]
    for turn in range(rounds):
        chosen = [r["vec_id"] // 3 for r in df.orderBy(F.xxhash64(F.lit(turn), F.lit(7), "vec_id")).limit(layout.SAMPLE).collect()]
        new = y.copy()
        for i, around in enumerate(links):
            to, away = y[around] - y[i], y[i] - y[chosen]
            far = (away * away).sum(axis=1, keepdims=True)
            pull = (2 * to / (1 + (to * to).sum(axis=1, keepdims=True))).sum(axis=0)
            push = np.clip(2 * away / ((1e-3 + far) * (1 + far)), -4, 4).mean(axis=0) * layout.REPELLING
            new[i] += layout.STEP * (1 - turn / rounds) * np.clip(pull + push * len(around) / 2, -layout.MOST_MOVE, layout.MOST_MOVE) / len(around)
        y = new
    assert np.allclose(at[rounds], y, atol=1e-3)


def test_layout_of_few_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    made = layout.fit(neighbour_index.build(df, str(tmp_path / "i")), str(tmp_path / "l"))
    assert made.positions().count() == 2 and made.place(df).count() == 2
    none = layout.fit(neighbour_index.build(df.limit(0), str(tmp_path / "i0")), str(tmp_path / "l0"))
    assert none.positions().count() == 0


def test_sentiment_models_and_shapes(spark):
    model = sentiment.WordLists(frozenset({"good"}), frozenset({"bad"}))
    df = spark.createDataFrame([(1, "Good good\tbad"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in sentiment.classify_texts(df, model).collect()}
    e = np.exp([2.0, 1.0, 1.0])
    assert np.allclose(got[1], e / e.sum()) and np.allclose(got[2], got[3]) and abs(sum(got[2]) - 1) < 1e-12

    class Wrong:
        name = "wrong"

        def classify(self, texts):
            return np.zeros((1, 2))

    with pytest.raises(Exception, match="wrong returned"):
        sentiment.classify_texts(df, Wrong()).count()
    assert sentiment.classify_texts(df.limit(0), model).count() == 0


def test_pages_by_mark(spark):
    rows = [(i, float(i % 7)) for i in range(50)] + [(60, None), (61, float("nan"))]
    df = spark.createDataFrame(rows, "id long, score double")
    seen, after = [], None
    while True:
        page = results.page(df, "score", 8, after)
        found = [r["id"] for r in page.rows.collect()]
        seen += found
        if page.after is None:
            break
        after = page.after
    assert seen == [i for i, _ in sorted(rows[:50], key=lambda r: (-r[1], r[0]))]
    # a row that comes on an earlier page moves nothing
    second = [r["id"] for r in results.page(df.union(spark.createDataFrame([(99, 100.0)], df.schema)), "score", 8, results.page(df, "score", 8).after).rows.collect()]
    assert second == seen[8:16]


def test_unions_samples_shown_and_datasets(spark, tmp_path):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2, None], [2, 3, 3]))
    assert sorted(map(tuple, results.union_ids(a, b).collect())) == [(1, 0), (2, 0), (3, 1)]
    big = spark.range(100)
    one, two = ([r["id"] for r in results.shuffled(big, 12, s).collect()] for s in (1, 2))
    assert len(one) == 12 and one != two and one == [r["id"] for r in results.shuffled(big, 12, 1).collect()] != sorted(one)
    items = spark.createDataFrame([(1, "a", 1), (2, "", 1), (3, None, 1), (4, "a", None)], "id long, title string, ts int")
    assert [r["id"] for r in results.shown(items, "title", "ts").collect()] == [1]
    data = Dataset("post", items, spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>"))
    results.write_dataset(data, str(tmp_path / "d"), made="today", rows=4)
    back, about = results.read_dataset(spark, str(tmp_path / "d"))
    assert about == {"name": "post", "made": "today", "rows": 4} and back.name == "post" and back.rows.count() == 4 and back.vectors.first()["embedding"] == [0.5]


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, None]), (2, None)], "g int, v array<double>")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(vectors.mean_vector("v", 2).alias("m")).collect()}
    assert got == {1: [2.0, 2.0], 2: [None, None]}


def test_running_averages_of_a_hot_user_in_many_tasks(spark, monkeypatch):
    """One user with most of the rows spreads over many tasks, and sums are carried from task to task."""
    rng = np.random.default_rng(9)
    rows = [(7 if i % 10 else int(rng.integers(0, 4)), int(i), "post" if rng.random() < 0.3 else "comment", rng.normal(size=3).tolist()) for i in rng.permutation(4000)]
    rows += [(None, 1, "comment", [1.0, 1.0, 1.0]), (None, 2, "post", [0.0, 0.0, 0.0]), (8, 1, "post", [1.0, 0.0, 0.0]), (8, 2, "comment", None), (8, 3, "post", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "user_id long, id long, kind string, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables = []
    real = features.cut_lineage
    monkeypatch.setattr(features, "cut_lineage", lambda t: tables.append(real(t)) or tables[-1])
    try:
        got = {(r["user_id"], r["id"]): r for r in features.running_average(df, 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tables[0].where("user = 7").select("part").distinct().count() >= 8
    sound = [r for r in rows if r[3] is not None and len(r[3]) == 3]
    assert set(got) == {(u, i) for u, i, kind, _ in sound if kind == "post"}
    by_user = {}
    for u, i, kind, v in sorted(sound, key=lambda r: r[1]):
        comments, posts = by_user.setdefault(u, ([], []))
        if kind == "post":
            r = got[u, i]
            assert (r["n_before"], r["n_history"]) == (len(comments), len(posts))
            for mean, of in ((r["average"], comments), (r["history"], posts)):
                assert mean is None if not of else np.allclose(mean, np.mean(of, axis=0))
        (posts if kind == "post" else comments).append(v)


def test_dictionary_ids_stay_when_read_again(spark):
    names = spark.createDataFrame([(f"n{i % 300:03d}",) for i in range(1000)] + [(None,)], "name string").repartition(7)
    made = upsert.dictionary_encode(spark.createDataFrame([(5, "n007")], "id long, name string"), names)
    first = sorted(map(tuple, made.collect()))
    assert first == sorted(map(tuple, made.collect())) and [i for i, _ in first] == list(range(5, 305))
    assert [n for _, n in first[1:]] == sorted(n for _, n in first[1:])


def test_exports_by_schema(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5.0, "x"), (2, "u", None, "y")], "id long, username string, score double, more string")
    tables.export_table(rows, "users", str(tmp_path))
    tables.export_table(rows.limit(0), "users", str(tmp_path))  # is there already
    assert sorted(map(tuple, tables.load_table(spark, str(tmp_path), "users").collect())) == [(1, ""), (2, "u")]
    assert tables.load_table(spark, str(tmp_path), "users", ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="lacks"):
        tables.typed(rows, "posts")
    posts = spark.createDataFrame([(1, 70_000)], "id long, score long").select("*", *[F.lit(None).alias(c) for c in ("deleted", "dead", "author", "ts", "url", "emb_missing_page")])
    with pytest.raises(Exception, match="score can't hold 70000"):
        tables.typed(posts, "posts").collect()


def test_relational_scan_in_ranges_of_the_key(spark):
    url = "jdbc:derby:memory:scan;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    rows.write.jdbc(url, "item", mode="overwrite", properties=driver)
    found = tables.keyset_jdbc(spark, url, "item", 0, 1000, 8, **driver)
    assert found.rdd.getNumPartitions() == 8
    assert sorted(map(tuple, found.select(*[F.col(c).alias(c.lower()) for c in found.columns]).select("id", "name").collect())) == [(i, f"n{i}") for i in range(1000)]
