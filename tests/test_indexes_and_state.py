"""Stored indexes, versioned tables, waiting streams and map labels against brute force."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import encoders
from corpuscope.operators import labels, lexical, neighbour_index, versioned
from corpuscope.streaming import waiting

# --- neighbours -------------------------------------------------------------------------------------------------------------


def planted(n, dims, clusters, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_neighbour_index_recall_and_work(spark, tmp_path):
    n, k = 8000, 10
    x = planted(n, 24, 160)
    folder = str(tmp_path / "index")
    built = neighbour_index.build(vectors(spark, x), folder, k=k)
    assert built.compared < 0.1 * n * (n - 1) / 2
    index = neighbour_index.load(spark, folder)
    assert index == built
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -np.inf)
    true = np.argsort(-sims, axis=1)[:, :k]
    graph = {r["vec_id"]: [e["id"] for e in r["neighbours"]] for r in index.neighbours().collect()}
    assert len(graph) == n and all(len(v) == k for v in graph.values())
    assert np.mean([len(set(graph[i]) & set(true[i].tolist())) / k for i in range(n)]) >= 0.9
    asked = vectors(spark, x).where("vec_id % 100 = 0")
    found = index.search(asked, k).collect()
    got = {}
    for r in found:
        got.setdefault(r["q"], []).append(r["vec_id"])
        assert abs(r["sim"] - sims[r["q"], r["vec_id"]]) < 1e-5 and r["q"] != r["vec_id"]
    assert set(got) == set(range(0, n, 100))
    assert np.mean([len(set(v) & set(true[q].tolist())) / k for q, v in got.items()]) >= 0.9
    assert np.mean([r["compared"] for r in found]) < 0.1 * n


def test_neighbour_index_of_odd_and_few_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbour_index.build(df, str(tmp_path / "few"), k=2)
    assert {r["vec_id"]: [e["id"] for e in r["neighbours"]] for r in index.neighbours().collect()} == {0: [1, 5], 1: [0, 5], 5: [1, 0]}
    assert [(r["q"], r["vec_id"]) for r in index.search(df.where("vec_id = 5"), 1).collect()] == [(5, 1)]
    none = neighbour_index.build(df.limit(0), str(tmp_path / "none"))
    assert none.neighbours().count() == 0 and none.search(df, 3).count() == 0


def test_a_query_s_best_in_one_block_bound_what_the_others_return(spark, tmp_path):
    """All pairs of a small k are the same as by brute force, and blocks other than a query's own return only what is above its bound."""
    n, k = 4000, 5
    x = planted(n, 24, 40, seed=6)
    index = neighbour_index.build(vectors(spark, x), str(tmp_path / "index"), k=k)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    found = spark.read.parquet(f"file://{max(glob.glob(f'{shared}/found-*'), key=os.path.getmtime)}")
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -np.inf)
    kth = -np.sort(-sims, axis=1)[:, k - 1]
    for r in found.collect():
        assert r["least"] <= kth[r["q"]] + 1e-6  # no pair of the best is left out
        assert len(r["near"]) <= k and all(abs(-e["far"] - sims[r["q"], e["id"]]) < 1e-5 for e in r["near"])
    assert found.where("least > -1").count() > 0.9 * n and index.neighbours().count() == n
    rows, ids = np.array([1, 0, 1, 1, 0, 1]), np.array([9, 5, 3, 4, 2, 7])
    best = neighbour_index._best(rows, ids, np.array([0.5, 0.1, 0.5, 0.9, 0.1, 0.5], np.float32), np.arange(6), 3)
    assert [c.tolist() for c in (best[0], best[1], best[3])] == [[0, 0, 1, 1, 1], [2, 5, 4, 3, 7], [4, 1, 3, 2, 5]]


def test_neighbour_index_of_vectors_without_structure_takes_few_jobs(spark, tmp_path):
    n, k = 3000, 10
    x = np.random.default_rng(4).normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    spark.sparkContext.setJobGroup("index", "index")
    try:
        index = neighbour_index.build(vectors(spark, x), str(tmp_path / "index"), k=k)
        found = index.search(vectors(spark, x).where("vec_id % 50 = 0"), k).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("index")) < 60
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -np.inf)
    true = np.argsort(-sims, axis=1)[:, :k]
    graph = {r["vec_id"]: [e["id"] for e in r["neighbours"]] for r in index.neighbours().collect()}
    assert np.mean([len(set(graph[i]) & set(true[i].tolist())) / k for i in range(n)]) >= 0.9
    assert np.mean([r["vec_id"] in true[r["q"]] for r in found]) >= 0.9 and len(found) == 60 * k


# --- lexical ------------------------------------------------------------------------------------------------------------------


def test_lexical_search_equals_full_scoring_and_skips_blocks(spark, tmp_path):
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    texts = {i: " ".join(r.choices(common, k=r.randint(0, 30)) + r.choices(rare, k=r.randint(0, 12))) for i in range(3000)}
    texts |= {3000: None, 3001: "", 3002: texts[7], 3003: texts[7], 3004: "word " * 20_000}
    encoder = encoders.CountingEncoder()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "id long, text string, weights string")
    index = lexical.build(encoders.encode_sparse(docs, encoder), str(tmp_path / "lex"), block=32)
    asked = {1: "c1 r5 r6", 2: "r17 r18 r19 c0 c0", 3: "unknown", 4: "c3", 5: texts[7], 6: "word", 7: None}
    queries = encoders.encode_sparse(spark.createDataFrame(list(asked.items()), "id long, text string"), encoder)
    ranked = index.rarity(queries)
    found = lexical.load(spark, str(tmp_path / "lex")).search(ranked, 10).collect()
    rnd = lambda v: int(np.floor(v + 0.5))
    impacts = {i: {w: rnd(float(np.float32(x)) * 16) for w, x in encoder.weigh([t or ""])[0].items()} for i, t in texts.items()}
    weights = {row["id"]: {w: rnd(float(x) * 100) for w, x in row["weights"].items()} for row in ranked.collect()}
    for q in asked:
        scores = {i: s for i, words in impacts.items() if (s := sum(x * words.get(w, 0) for w, x in weights.get(q, {}).items()))}
        want = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:10]
        assert sorted(((x["id"], x["score"]) for x in found if x["q"] == q), key=lambda e: (-e[1], e[0])) == want
    read = {x["q"]: (x["blocks_read"], x["blocks"]) for x in found}
    assert read[2][0] < 0.5 * read[2][1] and read[1][0] < 0.5 * read[1][1] and all(a <= b for a, b in read.values())
    assert lexical.build(encoders.encode_sparse(docs.limit(0), encoder), str(tmp_path / "no")).search(ranked).count() == 0


def test_lexical_search_reads_postings_once_whatever_the_blocks(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join(r.choices([f"c{i}" for i in range(300)], k=r.randint(5, 60))) for _ in range(2600)]
    encoder = encoders.CountingEncoder()
    encode = lambda rows: encoders.encode_sparse(spark.createDataFrame(rows, "id long, text string"), encoder)
    # 16 documents a block: three shards; every query has words in all blocks
    index = lexical.build(encode(list(enumerate(texts))), str(tmp_path / "lex"), block=16)
    ranked = index.rarity(encode([(q, texts[q]) for q in range(20)]))
    spark.sparkContext.setJobGroup("lexical", "lexical")
    try:
        found = index.search(ranked, 10).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lexical")) < 25
    rnd = lambda v: int(np.floor(v + 0.5))
    impacts = [{w: rnd(float(np.float32(x)) * 16) for w, x in d.items()} for d in encoder.weigh(texts)]
    for row in ranked.collect():
        weights = {w: rnd(float(x) * 100) for w, x in row["weights"].items()}
        scores = [(sum(x * words.get(w, 0) for w, x in weights.items()), -i) for i, words in enumerate(impacts)]
        want = [(-i, s) for s, i in sorted(scores, reverse=True)[:10]]
        assert sorted(((x["id"], x["score"]) for x in found if x["q"] == row["id"]), key=lambda e: (-e[1], e[0])) == want


# --- versioned tables -----------------------------------------------------------------------------------------------------------


def test_versioned_table_touches_few_buckets_and_keeps_versions(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, seq long, v string").schema
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), schema, "k", "seq", buckets=16)
    rows = lambda df: {(x["k"], x["seq"], x["v"]) for x in df.collect()}
    files = lambda: set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    assert table.read().count() == 0 and table.versions() == []
    base = {(k, 1, f"a{k}") for k in range(200)}
    assert table.upsert(spark.createDataFrame(list(base), schema), 0) == 1 and rows(table.read()) == base
    before = files()
    assert len(before) == 16
    # three keys, one of them in two rows, one too old, one tied: at most three buckets get a file
    change = spark.createDataFrame([(3, 5, "new"), (3, 4, "older"), (7, 0, "late"), (9, 1, "tie")], schema)
    assert table.upsert(change, 1) == 2
    assert 1 <= len(files() - before) <= 3 and before <= files()
    want = (base - {(3, 1, "a3"), (9, 1, "a9")}) | {(3, 5, "new"), (9, 1, "tie")}
    assert rows(table.read()) == want
    # a replay does nothing, a restart sees the same table, the first version is still there
    after = files()
    assert table.upsert(change, 1) == 2 and files() == after
    again = versioned.VersionedTable(spark, str(tmp_path / "t"), schema, "k", "seq", buckets=16)
    assert rows(again.read()) == want and rows(again.read(version=1)) == base
    # a reader that began before a write sees the old rows only
    pinned = again.read()
    table.upsert(spark.createDataFrame([(3, 9, "newest"), (None, 1, "null key"), (500, 1, "more")], schema), 2)
    assert rows(pinned) == want
    want = (want - {(3, 5, "new")}) | {(3, 9, "newest"), (None, 1, "null key"), (500, 1, "more")}
    assert rows(table.read()) == want and rows(table.lookup(spark.createDataFrame([(3,), (500,), (12345,)], "k long"))) == {(3, 9, "newest"), (500, 1, "more")}
    # an empty batch counts as taken in; compaction rewrites only the buckets with many files
    assert table.upsert(spark.createDataFrame([], schema), 3) == 4 and rows(table.read()) == want
    held = {b: sum(1 for e in table.entries() if e["bucket"] == b) for b in range(16)}
    before = files()
    table.compact(most_deltas=1)
    assert len(files() - before) == sum(n > 2 for n in held.values()) > 0 and rows(table.read()) == want
    assert rows(pinned)
    table.vacuum(keep=1)
    assert table.versions() == [5] and rows(table.read()) == want and len(files()) < len(before)
    assert table.upsert(change, 3) == 5
    with pytest.raises(ValueError, match="no version"):
        table.entries(77)


def test_lookup_reads_only_buckets_of_its_keys(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, seq long, v string").schema
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), schema, "k", "seq", buckets=32)
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("seq"), F.lit("x").alias("v")), 0)
    assert len(table.lookup(spark.createDataFrame([(5,)], "k long")).inputFiles()) == 1


# --- streams that wait ------------------------------------------------------------------------------------------------------------


def test_waiting_equals_a_batch_join_after_a_restart_and_state_empties(spark, tmp_path):
    r = random.Random(6)
    start = 1_700_000_000
    at = lambda s: F.timestamp_seconds(s)
    tasks = spark.createDataFrame([(i, r.choice([None, 1, 1, 1, *range(2, 40)]), start + r.randrange(20 * 86400)) for i in range(600)], "id long, page long, s long").select("id", "page", at("s").alias("ts"))
    pages = spark.createDataFrame([(p, start + r.randrange(25 * 86400), f"u{p}") for p in range(1, 30)], "page long, s long, url string").select("page", at("s").alias("ts"), "url")
    arrivals = lambda name, like: spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    middle = F.timestamp_seconds(F.lit(start + 10 * 86400))
    queries = []
    for part in (0, 1):
        for name, df in (("tasks", tasks), ("pages", pages)):
            half = df.where(F.col("ts") < middle if part == 0 else F.col("ts") >= middle)
            waiting.deal_out(half, f"{tmp_path}/{name}", 3, disorder="20 hours", first=10 * part)
            if part:
                end = df.limit(1).select(*[(F.lit("2100-01-01").cast("timestamp") if c == "ts" else F.lit(-1 if name == "tasks" else -2) if c == "page" else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
                end.write.parquet(f"{tmp_path}/{name}/in=99999")
        joined = waiting.wait_for(arrivals("tasks", tasks), arrivals("pages", pages), "page", limit="3 days", keep="9 days", late="1 day")
        queries.append(waiting.drain(joined, f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    got = spark.read.parquet(f"{tmp_path}/out")
    want = waiting.wait_for(tasks, pages, "page", limit="3 days", keep="9 days", late="1 day")
    key = lambda df: sorted(map(repr, (tuple(x) for x in df.select("id", "page", "ts", "arrived", "url").collect())))
    assert key(got) == key(want) and got.where("arrived is null").count() > 50 and got.where("arrived > ts").count() > 10 and got.where("arrived < ts").count() > 10
    # only the closing rows are left: one task, and the closing page in each of its parts
    assert waiting.state_rows(queries[0]) > 20 and waiting.state_rows(queries[1]) <= 1 + 8


def test_settled_and_distinct_streams(spark, tmp_path):
    r = random.Random(7)
    start = 1_700_000_000
    rows = spark.createDataFrame([(i, start + (i * 7919) % (10 * 86400), v) for i in range(300) for v in range(r.randint(1, 3))], "id long, s long, version int").select("id", F.timestamp_seconds("s").alias("ts"), "version")
    waiting.deal_out(rows, f"{tmp_path}/in", 5, disorder="24 hours")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = waiting.drain(waiting.settled_stream(stream(), "id", "version"), f"{tmp_path}/out", f"{tmp_path}/c")
    top = rows.agg(F.max("ts")).first()[0]
    last = rows.groupBy("id", "ts").agg(F.max("version").alias("version"))
    settled = last.where(F.col("ts") <= F.lit(top) - F.expr("INTERVAL 48 HOURS"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, settled.collect()))
    assert waiting.state_rows(query) == last.count() - settled.count() < 100
    # a replay of everything gives nothing more
    waiting.deal_out(rows, f"{tmp_path}/in", 2, disorder="24 hours", first=50)
    waiting.drain(waiting.settled_stream(stream(), "id", "version"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == settled.count()
    waiting.drain(waiting.distinct_stream(stream(), "id", within="10 days"), f"{tmp_path}/once", f"{tmp_path}/c2")
    assert sorted(x["id"] for x in spark.read.parquet(f"{tmp_path}/once").collect()) == list(range(300))
    assert os.path.exists(f"{tmp_path}/once/_spark_metadata")


# --- labels -----------------------------------------------------------------------------------------------------------------------


def brute_labels(points, sample, levels, extent, width, height, zooms):
    x0, x1, y0, y1 = extent
    base = (height - 64) / (y1 - y0) if height < width else (width - 64) / (x1 - x0)
    by_id, out, picked = {p[0]: p for p in points}, {}, []

    def box(p, zoom):
        scale, high = base * (4 / 3) ** zoom, 13 + (0 if min(levels - 1, zoom // 3) == levels - 1 else 12)
        return p[1] * scale, p[1] * scale + 7 + min(255, p[4] or 0) * 13 * 0.6, p[2] * scale - high / 2, p[2] * scale + high / 2

    meet = lambda a, b: a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]
    for zoom in range(zooms + 1):
        taken = [box(by_id[i], zoom) for i in picked]
        lod = min(levels - 1, zoom // 3)
        for p in sorted((by_id[i] for i in sample[lod] if i in by_id), key=lambda p: (p[3] is None, -(p[3] or 0), p[0])):
            if p[0] in picked or p[1] is None or p[2] is None:
                continue
            b = box(p, zoom)
            if not any(meet(b, other) for other in taken):
                taken.append(b)
                picked.append(p[0])
                out[p[0]] = zoom
    return {(z, i, s) for i, s in out.items() for z in range(s, zooms + 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_one_serial_pass(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(labels, "REGION_X", 900)  # many regions: labels here are at most 400 pixels wide
    monkeypatch.setattr(labels, "REGION_Y", 80)
    monkeypatch.setattr(labels, "MOST_LETTERS", 50)
    points = [(i, r.uniform(-3, 5), r.gauss(0, 1), r.choice([None, *map(float, range(12))]), r.randint(0, 49)) for i in range(700)]
    points += [(900, None, 1.0, 99.0, 5), (901, 0.0, 0.0, 50.0, None), (902, 0.0, 0.0, 50.0, 300)]
    ids = [p[0] for p in points]
    sample = {0: ids[::9] + [900], 1: ids[::3], 2: ids}
    extent = (-3.0, 5.0, -4.0, 4.0)
    df = spark.createDataFrame(points, "id long, x double, y double, score double, letters int")
    meta = spark.createDataFrame([(*extent, 3)], "x_min double, x_max double, y_min double, y_max double, lod_levels int")
    cut = spark.createDataFrame([(lod, i) for lod, found in sample.items() for i in found], "lod int, id long")
    got = {tuple(x) for x in labels.pick_labels(df, cut, meta, zooms=7).collect()}
    capped = [(i, x, y, s, None if n is None else min(50, n)) for i, x, y, s, n in points]
    want = brute_labels(capped, sample, 3, extent, 1280, 800, 7)
    assert got == want and len({i for _, i, _ in want}) > 100 and len({s for *_, s in want}) > 3


def test_greedy_sends_only_the_best_of_crowded_places_to_a_region(spark, monkeypatch):
    monkeypatch.setattr(labels, "SMALL", 100)
    monkeypatch.setattr(labels, "OF_CELL", 2)
    rng, sent = np.random.default_rng(11), spark.sparkContext.accumulator(0)
    decide = labels._decide

    def counted(frames):
        def told():
            for f in frames:
                sent.add(len(f))
                yield f

        return decide(told())

    monkeypatch.setattr(labels, "_decide", counted)
    rows = [(i, float(s), x, x + w, y, y + 13.0) for i, (s, x, w, y) in enumerate(zip(rng.integers(0, 50, 6000).tolist(), (rng.integers(0, 60, 6000) * 4.0).tolist(), (40.0 + rng.integers(0, 30, 6000)).tolist(), (rng.integers(0, 30, 6000) * 3.0).tolist(), strict=True))]
    df = spark.createDataFrame(rows, "id long, score double, x0 double, x1 double, y0 double, y1 double")
    want = []
    for i, _, x0, x1, y0, y1 in sorted(rows, key=lambda r: (-r[1], r[0])):
        if not any(a0 <= x1 and x0 <= a1 and b0 <= y1 and y0 <= b1 for _, a0, a1, b0, b1 in want):
            want.append((i, x0, x1, y0, y1))
    assert {r["id"] for r in labels.greedy(df, df.limit(0)).collect()} == {w[0] for w in want}
    assert sent.value < 6000


def test_labels_of_an_empty_map(spark):
    df = spark.createDataFrame([], "id long, x double, y double, score double, letters int")
    for extent in (None, 0.0):
        meta = spark.createDataFrame([(extent,) * 4 + (1,)], "x_min double, x_max double, y_min double, y_max double, lod_levels int")
        assert labels.pick_labels(df, df.select(F.lit(0).alias("lod"), "id"), meta, zooms=1).count() == 0


def test_long_lists_are_compared_in_tiles(monkeypatch):
    """A list longer than a tile gives the same best as brute force."""
    monkeypatch.setattr(neighbour_index, "MEMBERS", 100)
    x, k = planted(1000, 16, 20, seed=8), 5
    lists = np.where(np.arange(1000) < 730, 0, 2).astype(np.int32)
    members = pa.table({"vec_id": np.arange(1000), "v": neighbour_index._lists(x), "list": lists})
    asks = np.packbits(np.array([[True, False, True]] * 1000), axis=1)
    asking = pa.table({"q": np.arange(1000), "v": neighbour_index._lists(x), "list": lists, "block": np.zeros(1000, np.int32), "asks": neighbour_index._binary(asks), "least": np.full(1000, -np.inf, np.float32)})
    found = neighbour_index._meet(16, k, np.zeros(1, int))(asking, members)
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(sims, -np.inf)
    for q, near, compared in zip(*(found[c].to_pylist() for c in ("q", "near", "compared")), strict=True):
        assert compared == 1000 and {e["id"] for e in near} == set(np.argsort(-sims[q])[:k].tolist())
