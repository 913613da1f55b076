"""k-means for many k at once: one scan of the vectors a round, however many k; resumable, with centres and inertia per k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors, chosen by hash, from which the first centres are taken.
SEEDING_ROWS = 8192
#: How often seeding is begun.
STARTS = 4
#: Vectors compared at once.
SLICE = 2048


def seeds(sample: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Greedy k-means++: of a few candidates drawn by squared distance, the one that leaves the least; the first k serve every k.

    The whole is begun from several first centres, and the one that is best at all k on average (in share of the best) is taken.
    """
    runs = []
    for start in range(STARTS):
        rng = np.random.default_rng((seed, start))
        centres = [sample[rng.integers(len(sample))]]
        far = ((sample - centres[0]) ** 2).sum(axis=1)
        left = [far.sum()]
        while len(centres) < most:
            draw = rng.choice(len(sample), 2 + int(np.log2(most)), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample), size=1)
            after = [np.minimum(far, ((sample - sample[i]) ** 2).sum(axis=1)) for i in draw]
            best = int(np.argmin([a.sum() for a in after]))
            centres.append(sample[draw[best]])
            far = after[best]
            left.append(far.sum())
        runs.append((np.array(centres), np.array(left)))
    least = np.maximum(np.min([left for _, left in runs], axis=0), 1e-300)
    return min(runs, key=lambda run: float((run[1] / least).mean()))[0]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre (the lowest of equals) and its squared distance."""
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]
    pick = far.argmin(axis=1)
    return pick, ((x - centres[pick]) ** 2).sum(axis=1)


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)


def one_round(vectors: DataFrame, centres: dict[int, np.ndarray], share: float = 1.0, turn: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Sums, counts and inertia of the vectors nearest to each centre, for every k, from one scan.

    With a ``share`` below 1 a round sees that share of the vectors, another by hash each ``turn``.
    """
    dims = next(iter(centres.values())).shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    seen = vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64(F.lit(turn), "vec_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros_like(c), np.zeros(len(c), np.int64), 0.0) for k, c in sent.value.items()}
        for _, x in _matrices(batches, 0, dims):
            for k, c in sent.value.items():
                pick, far = _nearest(x, c)
                sums, counts, inertia = held[k]
                np.add.at(sums, pick, x)
                held[k] = sums, counts + np.bincount(pick, minlength=len(c)), inertia + far.sum()
        for k, (sums, counts, inertia) in held.items():
            here = np.flatnonzero(counts)
            if len(here):
                share_of = np.zeros(len(here))
                share_of[0] = inertia  # a task tells each inertia once
                yield pa.record_batch([pa.array(np.full(len(here), k, np.int32)), pa.array(here.astype(np.int32)), pa.array(counts[here]), pa.array(sums[here].tolist(), pa.list_(pa.float64())), pa.array(share_of)], names=["k", "cluster", "n", "sums", "inertia"])

    parts = seen.select("embedding").mapInArrow(add, "k int, cluster int, n long, sums array<double>, inertia double")
    merged = parts.groupBy("k", "cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums"), F.sum("inertia").alias("inertia"))
    out = {k: (np.zeros_like(c), np.zeros(len(c), np.int64), 0.0) for k, c in centres.items()}
    for r in merged.collect():  # at most one row per centre
        sums, counts, inertia = out[r["k"]]
        sums[r["cluster"]], counts[r["cluster"]] = r["sums"], r["n"]
        out[r["k"]] = sums, counts, inertia + r["inertia"]
    sent.unpersist()
    return out


class ManyKMeans:
    """k-means of ``vectors(vec_id, embedding)`` for every k of ``ks``, its state in ``folder``.

    Every round writes its centres, weights and inertia; an object made for the same folder goes on from the last finished round.
    Vectors that are null, of another length than the one of the smallest vec_id, or hold null or non-finite components are
    left out; without any there are no centres. A k above the number of distinct vectors has empty clusters.
    """

    def __init__(self, vectors: DataFrame, ks: Sequence[int], folder: str, seed: int = 7) -> None:
        self.spark, self.folder, self.ks, self.seed = vectors.sparkSession, folder, sorted({int(k) for k in ks}), seed
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        sound = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select("vec_id", "embedding")
        first = sound.orderBy("vec_id").select(F.size("embedding")).first()
        self.dims = first[0] if first else 0
        self.vectors = sound.where(F.size("embedding") == self.dims)
        self.round, self.centres, self.weights = self._last()

    def _rounds(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("k int, cluster int, centre array<double>, weight double, inertia double, round int").parquet(f"{self.folder}/rounds")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _last(self) -> tuple[int, dict[int, np.ndarray], dict[int, np.ndarray]]:
        held = self._rounds()
        if held is not None:
            at = held.agg(F.max("round")).first()[0]
            rows = held.where(F.col("round") == at).orderBy("k", "cluster").collect()
            by_k = {k: [r for r in rows if r["k"] == k] for k in self.ks}
            if all(by_k.values()):
                return at, {k: np.array([r["centre"] for r in x]) for k, x in by_k.items()}, {k: np.array([r["weight"] for r in x]) for k, x in by_k.items()}
        if not self.dims:
            return 0, {}, {}
        place = F.xxhash64(F.lit(self.seed), "vec_id")
        rows = self.vectors.orderBy(place, "vec_id").limit(SEEDING_ROWS).select("embedding").collect()
        start = seeds(np.array([r[0] for r in rows], np.float64), max(self.ks), self.seed)
        return 0, {k: start[:k].copy() for k in self.ks}, {k: np.zeros(k) for k in self.ks}

    def run(self, rounds: int = 20, share: float = 1.0, settled: float = 1e-4) -> ManyKMeans:
        """Up to ``rounds`` more; earlier if no inertia falls by more than ``settled`` of itself. Shares below 1 make mini-batches.

        A centre is the mean of its vectors; over mini-batches, of all that it was given so far.
        """
        before: dict[int, float] = {}
        for _ in range(rounds if self.centres else 0):
            found = one_round(self.vectors, self.centres, share, self.round)
            for k, (sums, counts, _) in found.items():
                given = self.weights[k] + counts if share < 1 else counts
                old = self.centres[k] * (self.weights[k][:, None] if share < 1 else 0)
                self.centres[k] = np.where(counts[:, None] > 0, (old + sums) / np.maximum(given, 1)[:, None], self.centres[k])
                self.weights[k] = np.where(counts > 0, given, self.weights[k])
            self.round += 1
            rows = [(k, i, c.tolist(), float(self.weights[k][i]), float(found[k][2])) for k in self.ks for i, c in enumerate(self.centres[k])]
            self.spark.createDataFrame(rows, "k int, cluster int, centre array<double>, weight double, inertia double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rounds/round={self.round}")
            now = {k: found[k][2] for k in self.ks}
            if share >= 1 and before and all(before[k] - now[k] <= settled * before[k] for k in self.ks):
                break
            before = now
        return self

    def inertia(self) -> DataFrame:
        """``k, inertia, clusters``: the summed squared distances to the present centres, and how many of these have vectors; one more scan."""
        rows = [(k, float(x), int((n > 0).sum())) for k, (_, n, x) in (one_round(self.vectors, self.centres) if self.centres else {}).items()]
        return self.spark.createDataFrame(rows, "k int, inertia double, clusters int").orderBy("k")

    def assign(self, k: int) -> DataFrame:
        """``vec_id, cluster, far``: each vector's cluster and its squared distance to the centre."""
        if k not in self.centres:
            return self.spark.createDataFrame([], "vec_id long, cluster int, far double")
        centres, dims = self.centres[k], self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _matrices(batches, 1, dims):
                pick, far = _nearest(x, centres)
                yield pa.record_batch([part.column(0), pa.array(pick.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "far"])

        return self.vectors.mapInArrow(run, "vec_id long, cluster int, far double")


def cluster_titles(members: DataFrame, posts: DataFrame, urls: DataFrame, titles: DataFrame, n: int = 100) -> DataFrame:
    """``cluster, titles``: up to ``n`` titles of each cluster with their sites, "title (site)", chosen by hash of the id, in order of it.

    ``members(id, cluster)``, ``posts(id, url_id)``, ``urls(id, url)`` without protocol, ``titles(id, text)``; members that lack any of these are left out.
    """
    from corpuscope.functions.scalar import key_hash, site_of
    from corpuscope.operators.stages import first_of

    linked = members.join(posts.select("id", "url_id"), "id").join(urls.select(F.col("id").alias("url_id"), site_of(F.col("url")).alias("site")), "url_id")
    named = linked.join(titles.select("id", "text"), "id").select("cluster", "id", F.concat("text", F.lit(" ("), "site", F.lit(")")).alias("title"))
    chosen = first_of(named.withColumn("at", key_hash(F.col("id"))), "cluster", [F.asc("at"), F.asc("id")], n)
    return chosen.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "title"))), lambda r: r["title"]).alias("titles"))


def write_titles(titles: DataFrame, folder: str) -> None:
    """Cluster titles as JSON lines."""
    titles.write.json(folder)
