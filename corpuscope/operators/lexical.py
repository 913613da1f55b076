"""Lexical search over sparse weights: an inverted index in blocks with upper bounds, and top-k by block-max pruning.

Weights become whole numbers (impacts), so that scores are exact. Documents are dealt to blocks of about ``block`` of them, those of
like total weight together; a word's postings in a block stand in order of impact, and its greatest impact there is its bound.
Blocks are dealt to shards, each of which meets all queries in one group (or parts of them, where they are many). There a query adds
up its words' bounds per block, reads the blocks of the greatest sums first, and leaves out every block whose sum is below
the k-th best score found: none of its documents can be among the best k. The postings of the queries' words are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.stages import first_of, stored

#: Documents are told apart by total weight in so many classes before they are dealt to blocks.
CLASSES = 64
#: Blocks that are worked on in one group, and queries that meet them there, at most about.
SHARD, QUERIES = 64, 512


@dataclass
class LexicalIndex:
    """``bounds(word, block, bound, n)`` and ``postings(word, block, docs)``, the latter structs (impact, id), greatest impact first."""

    spark: SparkSession
    folder: str
    scale: int
    documents: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def frequencies(self) -> DataFrame:
        """``word, n``: in how many documents each word occurs."""
        return self.table("bounds").groupBy("word").agg(F.sum("n").alias("n"))

    def rarity(self, queries: DataFrame, scale: int = 100) -> DataFrame:
        """``id, weights`` of ``queries(id, weights)``, each weight times ln(1 + documents / documents with the word); words of no document go."""
        words = queries.select("id", F.explode("weights").alias("word", "w")).join(self.frequencies(), "word")
        weight = F.round(F.col("w").cast("double") * scale * F.log1p(F.lit(float(self.documents)) / F.col("n"))) / scale
        return words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", weight.cast("float")))).alias("weights"))

    def search(self, queries: DataFrame, k: int = 10, scale: int = 100, first_blocks: int = 2) -> DataFrame:
        """``q, id, score, blocks_read, blocks``: the ``k`` best documents of each of ``queries(id, weights)``, ties to smaller ids.

        A score is the sum of the products of impacts, a query's being its weights times ``scale``, rounded. ``blocks`` counts the
        blocks that hold any of a query's words, ``blocks_read`` those that were read: of each shard first ``first_blocks``, then twice
        as many each time, as long as any is left that could change the shard's result. Queries without a known word have no rows.
        """
        words = stored(queries.select(F.col("id").alias("q"), F.explode("weights").alias("word", "w")).select("q", "word", _impact(F.col("w"), scale).alias("w")).where("w > 0"), "query-words")
        asking, (last,) = words.select("q").distinct().count(), self.table("bounds").agg(F.max("block")).first()
        if not asking or last is None:
            return self.spark.createDataFrame([], "q long, id long, score long, blocks_read long, blocks long")
        shards = -(-(last + 1) // SHARD)
        words = words.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(-(-asking // QUERIES))).cast("int"))
        wanted = self.table("postings").join(words.select("part", "word").distinct(), "word")
        lists = wanted.select(F.col("part").alias("asked_by"), (F.col("block") % shards).cast("int").alias("of_shard"), "word", "block", "docs")
        dealt = words.select("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "word", "w")
        met = lists.groupBy("asked_by", "of_shard").cogroup(dealt.groupBy("part", "shard")).applyInArrow(_best_of_shard(k, first_blocks), "q long, id long, score long, blocks_read long, blocks long")
        found = stored(met, "shard-best")
        counts = found.where("id is null").groupBy("q").agg(F.sum("blocks_read").alias("blocks_read"), F.sum("blocks").alias("blocks"))
        return first_of(found.where("id is not null").select("q", "id", "score"), "q", [F.desc("score"), F.asc("id")], k).join(counts, "q")


def _best_of_shard(k: int, first_blocks: int):
    """Postings of a shard and the words of a part of the queries: each query's best ``k`` there, and in a row without id the blocks it read and has."""
    names = ["q", "id", "score", "blocks_read", "blocks"]

    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        if not lists.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        qs, row = np.unique(asked["q"].to_numpy(), return_inverse=True)
        coded = asked["word"].combine_chunks().dictionary_encode()
        word = coded.indices.to_numpy()
        by_word = np.argsort(word, kind="stable")
        row, weight, count = row[by_word], asked["w"].to_numpy()[by_word], np.bincount(word)
        begin = np.cumsum(count) - count
        lists = lists.append_column("at", pc.index_in(lists["word"], value_set=coded.dictionary)).sort_by([("block", "ascending"), ("at", "ascending")])
        docs = lists["docs"].combine_chunks()
        at, offsets, flat = lists["at"].to_numpy(), docs.offsets.to_numpy(), docs.values
        ids, impacts = flat.field("id").to_numpy(), flat.field("impact").to_numpy()
        blocks, first = np.unique(lists["block"].to_numpy(), return_index=True)
        ends = [*first[1:], len(at)]
        kind: type = np.float64

        def asks(b: int, rows: np.ndarray) -> np.ndarray:
            """Weights of the queries ``rows`` for the words of a block."""
            here = at[first[b] : ends[b]]
            n = count[here]
            entry = np.repeat(begin[here] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out = np.zeros((len(qs), len(here)), kind)
            out[row[entry], np.repeat(np.arange(len(here)), n)] = weight[entry]
            return out[rows]

        every = np.arange(len(qs))
        bounds = np.stack([asks(b, every) @ impacts[offsets[first[b] : ends[b]]].astype(kind) for b in range(len(blocks))], axis=1)
        if bounds.max() >= 2**53:  # beyond what doubles hold exactly
            if bounds.max() >= 2**62:
                raise OverflowError("scores pass 64 bits")
            kind = np.int64
            bounds = np.stack([asks(b, every) @ impacts[offsets[first[b] : ends[b]]] for b in range(len(blocks))], axis=1)
        left, step = bounds > 0, first_blocks
        had, least = left.sum(axis=1), np.zeros(len(qs), np.int64)
        read, best = np.zeros(len(qs), np.int64), [np.zeros(0, np.int64)] * 3
        while True:
            # a block that can only reach the k-th score may hold a smaller id with it
            left &= bounds >= least[:, None]
            if not left.any():
                break
            order = np.argsort(-np.where(left, bounds, -1), axis=1, kind="stable")[:, :step]
            now = np.zeros_like(left)
            np.put_along_axis(now, order, True, axis=1)
            now &= left
            left &= ~now
            read += now.sum(axis=1)
            found = [best]
            for b in np.flatnonzero(now.any(axis=0)):
                rows, lo, hi = np.flatnonzero(now[:, b]), offsets[first[b]], offsets[ends[b]]
                own, column = np.unique(ids[lo:hi], return_inverse=True)
                held = np.zeros((ends[b] - first[b], len(own)), kind)
                held[np.repeat(np.arange(len(held)), np.diff(offsets[first[b] : ends[b] + 1])), column] = impacts[lo:hi]
                scores = (asks(b, rows) @ held).astype(np.int64)
                r, c = np.nonzero((scores > 0) & (scores >= least[rows][:, None]))
                found.append([rows[r], own[c], scores[r, c]])
            rows, own, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((own, -scores, rows))
            rows, own, scores = rows[order], own[order], scores[order]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            best = [rows[top], own[top], scores[top]]
            n = np.bincount(best[0], minlength=len(qs))
            least[n == k] = best[2][(np.cumsum(n) - 1)[n == k]]
            step *= 2
        rows, own, scores = best
        none = np.zeros(len(rows), np.int64)
        kept = np.flatnonzero(had)
        parts = [[qs[rows], pa.array(own, pa.int64()), scores, none, none], [qs[kept], pa.nulls(len(kept), pa.int64()), np.zeros(len(kept), np.int64), read[kept], had[kept]]]
        return pa.concat_tables([pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, p, strict=True)}) for p in parts])

    return run


def _impact(weight: Column, scale: int) -> Column:
    return F.round(weight.cast("double") * scale).cast("long")


def _inverted(scale: int):
    """The postings of the documents of one block: of each word structs (impact, id), greatest impact first."""

    def run(docs: pa.Table) -> pa.Table:
        maps = docs["weights"].combine_chunks()
        lo, hi = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
        coded = maps.keys.slice(lo, hi - lo).dictionary_encode()
        impact = np.floor(maps.items.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.float64) * scale + 0.5)
        ids = np.repeat(docs["id"].to_numpy(), np.diff(maps.offsets.to_numpy()))
        word = coded.indices.to_numpy()
        kept = impact > 0
        if not np.all(impact[kept] < 2**53):
            raise OverflowError("impacts pass 2^53")
        word, impact, ids = word[kept], impact[kept].astype(np.int64), ids[kept]
        order = np.lexsort((ids, -impact, word))
        words, first = np.unique(word[order], return_index=True)
        entries = pa.StructArray.from_arrays([pa.array(impact[order]), pa.array(ids[order])], ["impact", "id"])
        lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), entries)
        return pa.table({"word": coded.dictionary.take(pa.array(words)), "block": pa.array(np.full(len(words), docs["block"][0].as_py()), pa.int64()), "docs": lists})

    return run


def build(documents: DataFrame, folder: str, *, scale: int = 16, block: int = 64) -> LexicalIndex:
    """Build the index of ``documents(id, weights)`` under ``folder`` and return it as :func:`load` does.

    Impacts are weights times ``scale``, rounded; those of 0 are left out. Null maps have no words; ids are distinct.
    """
    spark = documents.sparkSession
    sized = documents.where("id is not null").select("id", "weights", F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x).alias("size"))
    sized = stored(sized, "weights")  # texts are encoded once
    total, cuts = sized.agg(F.count("*"), F.percentile_approx("size", [i / CLASSES for i in range(1, CLASSES)], 1000)).first()
    each = max(1, -(-total // (block * CLASSES)))
    kind = F.lit(0)
    for cut in cuts or []:
        kind = kind + (F.col("size") > F.lit(float(cut))).cast("int")
    placed = sized.select("id", "weights", (F.coalesce(kind, F.lit(0)) * each + F.pmod(F.xxhash64("id"), F.lit(each))).cast("long").alias("block"))
    # a block has about ``block`` documents, which travel whole, a row each; its lists are made in one group
    lists = placed.where("weights is not null").groupBy("block").applyInArrow(_inverted(scale), "word string, block long, docs array<struct<impact:long,id:long>>")
    lists.write.parquet(f"{folder}/postings")
    held = spark.read.parquet(f"{folder}/postings")
    held.select("word", "block", F.get("docs", F.lit(0))["impact"].alias("bound"), F.size("docs").cast("long").alias("n")).write.parquet(f"{folder}/bounds")
    spark.createDataFrame([(scale, total)], "scale int, documents long").coalesce(1).write.parquet(f"{folder}/about")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> LexicalIndex:
    """An index that :func:`build` wrote; it was finished if its last table is there."""
    about = spark.read.parquet(f"{folder}/about").first()
    return LexicalIndex(spark, folder, about["scale"], about["documents"])
