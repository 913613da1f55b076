"""The MessagePack codec, k-means for many k, and the source of ids."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import msgpack
from corpuscope.operators import clusters
from corpuscope.sources import tables
from corpuscope.streaming import ids

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary() | st.datetimes(min_value=datetime(1, 1, 2), max_value=datetime(9999, 12, 30)).map(lambda t: t.replace(tzinfo=UTC)),
    lambda inner: st.lists(inner, max_size=20) | st.dictionaries(st.text(max_size=5), inner, max_size=20),
    max_leaves=30,
)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_codec_round_trip(value):
    assert msgpack.unpack(msgpack.pack(value)) == value


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_give_a_value_or_a_value_error(raw):
    try:
        msgpack.unpack(raw)
    except ValueError:
        pass


def test_known_bytes():
    cases = {
        b"\x00": 0, b"\x7f": 127, b"\xff": -1, b"\xe0": -32, b"\xcc\x80": 128, b"\xcd\x01\x00": 256, b"\xd0\xdf": -33, b"\xd1\xff\x7f": -129, b"\xca?\x80\x00\x00": 1.0, b"\xa3abc": "abc", b"\xd9\x03abc": "abc", b"\xda\x00\x03abc": "abc", b"\xdb\x00\x00\x00\x03abc": "abc",
        b"\xc4\x01x": b"x", b"\xc5\x00\x01x": b"x", b"\x92\x01\xc0": [1, None], b"\xdc\x00\x01\xc3": [True], b"\x81\xa1a\x02": {"a": 2}, b"\xde\x00\x01\xa1a\xc2": {"a": False},
        b"\xd6\xff\x00\x00\x00\x01": datetime(1970, 1, 1, 0, 0, 1, tzinfo=UTC), b"\xd7\xff" + (500_000_000 << 34 | 1).to_bytes(8, "big"): datetime(1970, 1, 1, 0, 0, 1, 500_000, tzinfo=UTC), b"\xc7\x0c\xff" + (0).to_bytes(4, "big") + (-1).to_bytes(8, "big", signed=True): datetime(1969, 12, 31, 23, 59, 59, tzinfo=UTC),
    }
    for raw, value in cases.items():
        assert msgpack.unpack(raw) == value and type(msgpack.unpack(raw)) is type(value)
    for raw in (b"", b"\xc1", b"\x92\x01", b"\xa3ab", b"\x01\x02", b"\xa2\xff\xfe", b"\xd4\x05x", b"\xd5\xff\x00\x00", b"\xd7\xff" + (1_000_000_000 << 34).to_bytes(8, "big"), b"\x81\x90\x01", b"\x91" * 200 + b"\x01"):
        with pytest.raises(ValueError):
            msgpack.unpack(raw)
    assert len(msgpack.pack(datetime(2024, 1, 1, tzinfo=UTC))) == 6 and len(msgpack.pack(datetime(2024, 1, 1, 0, 0, 0, 1, tzinfo=UTC))) == 10 and len(msgpack.pack(datetime(1960, 1, 1, tzinfo=UTC))) == 15


def test_values_as_columns(spark):
    stamp = datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=UTC)
    raws = [
        msgpack.pack({"s": "x", "n": 5, "f": 2, "b": True, "t": stamp, "l": [1, None], "m": {"a": 0.5}, "more": 1}), msgpack.pack({"t": "2024-05-06T09:08:09.123456+02:00"}), msgpack.pack({}), msgpack.pack([1]), None, b"\xc1",
        msgpack.pack({"s": 5}), msgpack.pack({"n": True}), msgpack.pack({"n": 2**64 - 1}), msgpack.pack({"t": "no time"}), msgpack.pack({"s": None, "n": None}), msgpack.pack({"t": 7}),
    ]
    fields = spark.createDataFrame([], "s string, n bigint, f double, b boolean, t timestamp, l array<int>, m map<string,float>").schema
    df = spark.createDataFrame(list(enumerate(raws)), "i int, v binary").repartition(2)
    got = {r["i"]: r["f"] for r in df.select("i", msgpack.unpacked(F.col("v"), fields).alias("f")).collect()}
    local = stamp.astimezone().replace(tzinfo=None)
    assert tuple(got[0]) == ("x", 5, 2.0, True, local, [1, None], {"a": 0.5})
    assert got[1]["t"] == local and got[1]["s"] is None
    assert got[2] is not None and set(got[2]) == {None} and set(got[10]) == {None}
    assert [i for i in got if got[i] is None] and all(got[i] is None for i in (3, 4, 5, 6, 7, 8, 9, 11))
    rows = spark.createDataFrame([(1, "a", stamp, None, {"k": 1.5}, [1, 2]), (2, None, None, 7, None, None)], "id long, s string, t timestamp, n bigint, m map<string,double>, l array<int>")
    kinds = rows.drop("id").schema
    back = rows.select("*", msgpack.packed(rows, kinds.names).alias("v")).select("*", msgpack.unpacked(F.col("v"), kinds).alias("f"))
    for r in back.collect():
        assert tuple(r["f"]) == tuple(r[n] for n in kinds.names)


def test_key_value_scans(spark):
    kv = [("url/7/meta", msgpack.pack({"title": "T"})), ("url/8/meta", b"\xc1"), ("url/x/meta", b""), ("url/9/text", b"t"), ("post/7/meta", b"")]
    df = spark.createDataFrame(kv, "k string, v binary")
    fields = spark.createDataFrame([], "title string").schema
    assert sorted(map(tuple, tables.kv_values(df, "url/%/meta", fields).collect())) == [(7, "T"), (8, None)]
    number, field = tables.kv_id_field(F.col("k"), "url", ["text", "meta"])
    assert [(r[0], r[1]) for r in df.orderBy("k").select(number, field).collect()] == [(None, None), (7, "meta"), (8, "meta"), (9, "text"), (None, None)]


def planted(n=3000, dims=8, centres=12):
    rng = np.random.default_rng(3)
    at = rng.normal(scale=4, size=(centres, dims))
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def serial(x, start, rounds):
    c = start.copy()
    for _ in range(rounds):
        pick = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for i in range(len(c)):
            if (pick == i).any():
                c[i] = x[pick == i].mean(axis=0)
    return ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_many_kmeans_equals_serial_rounds_and_goes_on(spark, tmp_path, monkeypatch):
    x = planted()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 8), (9003, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).cache()
    ks = [2, 5, 12]
    first = clusters.ManyKMeans(df, ks, str(tmp_path / "a"))
    start = {k: c.copy() for k, c in first.centres.items()}
    assert (start[5][:2] == start[2]).all()
    scans = []
    real = clusters.one_round
    monkeypatch.setattr(clusters, "one_round", lambda *a: scans.append(1) or real(*a))
    first.run(3, settled=0)
    assert len(scans) == 3  # one scan a round, for all k
    again = clusters.ManyKMeans(df, ks, str(tmp_path / "a"))
    assert again.round == 3 and all(np.allclose(again.centres[k], first.centres[k]) for k in ks)
    got = {r["k"]: r["inertia"] for r in again.run(2, settled=0).inertia().collect()}
    for k in ks:
        assert abs(got[k] - serial(x, start[k], 5)) < 1e-6 * got[k]
    full = {r["k"]: (r["inertia"], r["clusters"]) for r in clusters.ManyKMeans(df, ks, str(tmp_path / "a")).run(40).inertia().collect()}
    mini = {r["k"]: r["inertia"] for r in clusters.ManyKMeans(df, ks, str(tmp_path / "b")).run(12, share=0.3).inertia().collect()}
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sound = df.where("vec_id < 9000").select(array_to_vector("embedding").alias("features"))
    for k in ks:
        fit = KMeans(k=k, seed=1, maxIter=40).fit(sound).summary.trainingCost
        assert full[k][0] < 1.05 * fit and mini[k] < 1.05 * full[k][0] and full[k][1] == k
    found = again.assign(5).toPandas()
    assert len(found) == len(x) and abs(found["far"].sum() - got[5]) < 1e-6 * got[5]
    df.unpersist()


def test_many_kmeans_of_few_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = clusters.ManyKMeans(df, [1, 3], str(tmp_path / "same")).run(2).inertia().collect()
    assert [(r["k"], r["inertia"], r["clusters"]) for r in got] == [(1, 0.0, 1), (3, 0.0, 1)]
    none = clusters.ManyKMeans(df.limit(0), [2], str(tmp_path / "none")).run(2)
    assert none.inertia().count() == 0 and none.assign(2).count() == 0


def test_ids_lose_and_repeat_nothing(spark, tmp_path):
    asked, fail = [], [True]

    def work(batch):
        found = sorted(r["id"] for r in batch.collect())
        if found and found[0] == 40 and fail:
            fail.clear()
            raise ConnectionError("stopped in the middle")
        asked.append(found)
        return batch.withColumn("done", F.col("id") != 55).withColumn("at", F.lit(len(asked)))

    schema = spark.createDataFrame([], "id long, done boolean, at int").schema
    run = lambda last: ids.work_through(spark, str(tmp_path), last, work, schema, per_batch=20, buckets=4)
    with pytest.raises(ids.StreamingQueryException):
        run(99)
    assert [i for b in asked for i in b] == list(range(40))
    table = run(99)
    assert [i for b in asked for i in b] == list(range(100))
    assert sorted(r["id"] for r in table.read().collect()) == list(range(100)) and ids.committed(table) == 55
    # more ids appear; nothing old is asked for again
    run(109)
    assert [i for b in asked for i in b] == list(range(110)) and run(109).read().count() == 110


def test_ranges_are_cut_alike():
    reader = ids._Ranges({"first": 5, "last": 27, "per_batch": 10, "ranges": 3})
    start, seen = reader.initialOffset(), []
    for _ in range(5):
        rows, end = reader.read(start)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(start, end)) and len(rows) <= 3
        seen += [i for a, b in rows for i in range(a, b + 1)]
        start = end
    assert seen == list(range(5, 28)) and start == {"next": 28}


def test_times_far_from_now():
    for days in (-700_000, -1, 0, 60_000, 2_900_000):
        at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=days, microseconds=3)
        assert msgpack.unpack(msgpack.pack(at)) == at
