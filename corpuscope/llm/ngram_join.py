"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. A token (shingle hash) flips one bit of one band of a wide bit
sketch, so the sketches of two sets differ in at most as many bits as their symmetric difference has tokens. For sets of
similar size that difference is bounded: at most D for every pair of a size band whose Jaccard reaches the threshold. With
D + 1 + E bands, at least 1 + E bands of such a pair are equal in every bit (pigeonhole), so each document may leave out
its E emptiest bands, and equal bands still name the pair. Candidates are then sifted by the Hamming distance of short
sketches (a lower bound again) and verified on the shingle sets.

Sets that are equal are one class from the start. Candidates are not paired within a bucket: each bucket is a star around
its leader, and verified stars are merged into components. Only buckets that still hold several components are looked at
again: members outside the bucket's largest component against all members, in blocks bounded in bytes, where pairs that
sketches don't rule out are verified and what comes out is a forest of links, not the pairs of the bucket. No link between
different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import hint_small, input_bytes, join_skewed, slices, written
from corpuscope.llm.components import components
from corpuscope.llm.hashing import MIX_3, mix, window_hashes, word_hashes

#: Size bands grow by this factor; band rows a task gathers before it ships them; rows of one block of keys; bits of a sketch, and how often its short form folds it.
GROWTH, FLUSH_ROWS, BLOCK_ROWS, SHORT_BITS, FOLDS = 1.5, 1_500_000, 1_000_000, 2048, 4
#: More equal keys than this in one shipment are linked to their smallest document on the spot.
LOCAL_STAR = 8
#: Rows of stars that are shipped as one piece, to any block: they need not meet again.
STAR_ROWS = 65_536
#: Members of one block of a bucket at most, and bytes; bytes of texts, pairs and rows that a group of texts gives one task.
BUCKET_BLOCK, BLOCK_BYTES, TASK_BYTES, TASK_PAIRS, TASK_ROWS = 2048, 4_000_000, 24_000_000, 50_000_000, 4_000
#: Pairs sifted at once, and failed pairs a task remembers.
PAIRS, FAILED = 131_072, 1_000_000


def size_bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size bands up to ``most``, and for pairs whose smaller set is in the band: D and E."""
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    small = np.array(low[1:]) - 1
    d = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
    return np.array(low[:-1]), d, np.maximum(1, (d + 1) // 8)


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within a text, and the text each belongs to. A text of fewer than ``n`` words is one shingle."""
    words, ends = word_hashes([t.encode().lower() for t in texts])  # bytes.lower knows A-Z only
    h, text, _ = window_hashes(words, ends, n)
    counts = np.diff(ends)
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        whole = xxhash.xxh3_64_intdigest(words[ends[i] : ends[i + 1]].tobytes(), seed=int(counts[i]))
        h, text = np.append(h, np.uint64(whole)), np.append(text, i)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _split(h: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    at = np.searchsorted(text, np.arange(n + 1))
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = _split(*shingles([t or "" for t in batch.column(2).to_pylist()], n), batch.num_rows)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            prints = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["doc", "row", "n", "f1", "f2"])

    return run


def band_keys(h: np.ndarray, text: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the sets (tokens ``h`` of set ``text``; set i has ``sizes[i]`` tokens) and the set each belongs to."""
    low, d, spare = size_bands(percent, int(sizes.max(initial=1)))
    own = np.searchsorted(low, sizes, side="right") - 1
    keys, owners = [], []
    # a set joins the sets of its own band, and as the larger partner those of the band below
    for scheme, joins in ((own, sizes > 0), (own - 1, (own > 0) & (-(-sizes * percent // 100) < low[own]))):
        joins = joins & (d[scheme] > 0)  # D = 0: only equal sets, which are one class already
        if not joins.any():
            continue
        bands = np.where(joins, d[scheme] + 1 + spare[scheme], 0)
        start = np.concatenate([[0], np.cumsum(bands)])
        mine = joins[text]
        tokens, owner = h[mine], text[mine]
        cell = start[owner] + (tokens >> np.uint64(20)).astype(np.int64) % bands[owner]
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
        parity = np.zeros(start[-1], np.uint64)
        parity[cell[order][edges]] = np.bitwise_xor.reduceat(mix(tokens[order]), edges)
        filled = np.bincount(cell, minlength=start[-1])
        set_of = np.repeat(np.arange(len(sizes)), bands)
        place = np.arange(start[-1]) - start[set_of]
        least = np.zeros(len(sizes), np.int64)
        for i in np.flatnonzero(joins).tolist():
            least[i] = np.partition(filled[start[i] : start[i + 1]], spare[scheme[i]])[spare[scheme[i]]]
        kept = filled >= least[set_of]  # bands with fewer tokens than that are at most E
        salt = mix((scheme[set_of].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + MIX_3)
        keys.append(mix(parity ^ salt)[kept])
        owners.append(set_of[kept])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the number of each row's run, and the runs' lengths."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    return run, np.bincount(run)


def _ship(n: int, percent: int, blocks: int):
    """Tasks ship (key, document) packed by block of keys; long runs of equal keys become stars at once (kind 1)."""

    def flush(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        run, length = _runs(key)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        star = length[run] > LOCAL_STAR
        head = np.zeros(len(key), bool)
        head[first] = True
        out: list[list] = [[], [], [], [], []]
        for kind, mask in ((0, ~star | head), (1, star)):
            k, d, leader = key[mask], doc[mask], doc[first[run[mask]]]
            block = ((k >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            if kind:  # by piece, as all rows of one hot key would be one block
                piece = np.arange(len(k)) // STAR_ROWS * STAR_ROWS
                block = mix(k[piece] ^ doc[mask][piece].view(np.uint64)) % np.uint64(blocks)
                edges = np.append(np.arange(0, len(k), STAR_ROWS), len(k))
            else:
                edges = np.append(np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)), len(k))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for column, value in zip(out, (kind, int(block[a]), k[a:b].tobytes(), d[a:b].tobytes(), leader[a:b].tobytes() if kind else None), strict=True):
                    column.append(value)
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "keys", "docs", "leaders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in slices(batches):
            h, text = shingles(batch.column(1).to_pylist(), n)
            k, owner = band_keys(h, text, np.bincount(text, minlength=batch.num_rows), percent)
            keys.append(k)
            ids.append(batch.column(0).to_numpy()[owner])
            held += len(k)
            if held >= FLUSH_ROWS:
                yield flush(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield flush(keys, ids)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one block: rows of keys that several documents have, with the smallest of these as leader."""
    joined = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    key, doc = joined("keys", np.uint64), joined("docs", np.int64)
    if table["kind"][0].as_py():
        leader = joined("leaders", np.int64)
    else:
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        run, length = _runs(key)
        leader = doc[np.concatenate([[0], np.cumsum(length)[:-1]])][run]
        many = length[run] > 1
        key, doc, leader = key[many], doc[many], leader[many]
    return pa.table({"key": key.view(np.int64), "cid": doc, "leader": leader})


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = _split(*shingles(batch.column(1).to_pylist(), n), batch.num_rows)
            sketches = [np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) % SHORT_BITS, minlength=SHORT_BITS) & 1).tobytes() for s in sets]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "n", "sketch", "tokens"])

    return run


def _sift(percent: int):
    """Drop pairs whose sizes or sketches rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
                bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5)]
                apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)
                ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))
                yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, written."""
    small = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    whole = lambda x: sets.select(F.col("cid").alias(x), F.col("tokens").alias(f"t{x}"))
    sifted = pairs.join(small("a"), "a").join(small("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sift(percent), "a long, b long")
    return written(sifted.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"), "links")


def _joined(percent: int):
    """Of the units of one task: links that join the components its members belong to, each verified on the whole sets.

    A unit (key, i, j) compares block i of a bucket's members with block j of those outside its largest component. Pairs of
    one component, the links found so far included, are not looked at again, so what comes out is a forest of links and
    not the pairs. Pairs are sifted by size, by short and by whole sketches, then the nearest are verified first.
    """

    def run(table: pa.Table) -> pa.Table:
        texts = table.filter(table["tokens"].is_valid())
        ids, at = np.unique(texts["cid"].to_numpy(), return_index=True)
        texts = texts.take(pa.array(at))
        size, sets = texts["n"].to_numpy(), [np.frombuffer(t, np.uint64) for t in texts["tokens"].to_pylist()]
        whole = np.frombuffer(b"".join(texts["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        short = np.bitwise_xor.reduce(whole.reshape(len(ids), FOLDS, -1), axis=1)  # parities add up

        units = table.filter(table["tokens"].is_null())
        key, i, j, side, cid, comp = (units[c].to_numpy() for c in ("key", "i", "j", "side", "cid", "comp"))
        order = np.lexsort((cid, side, j, i, key))
        key, i, j, side, cid, comp = (x[order] for x in (key, i, j, side, cid, comp))
        doc = np.searchsorted(ids, cid)
        _, group = np.unique(comp, return_inverse=True)
        of = np.zeros(len(ids), np.int64)
        of[doc] = group
        parent = np.arange(int(group.max(initial=-1)) + 1)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(new)
        outside = np.add.reduceat(side, first) if len(first) else first
        inside = np.diff(np.append(first, len(key))) - outside
        ends = np.concatenate([[0], np.cumsum(inside * outside)])
        failed = np.zeros(0, np.int64)
        found: list[tuple[int, int]] = []

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for start in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(start, min(start + PAIRS, int(ends[-1])))
            unit = np.searchsorted(ends, pair, side="right") - 1
            pair -= ends[unit]
            a, b = doc[first[unit] + pair % inside[unit]], doc[first[unit] + inside[unit] + pair // inside[unit]]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            n = size[a] + size[b]
            ok = (parent[of[a]] != parent[of[b]]) & (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent)
            a, b, n = a[ok], b[ok], n[ok]
            for bits in (short, whole):
                apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1).astype(np.int64)
                ok = apart * (100 + percent) <= n * (100 - percent)
                a, b, n, apart = a[ok], b[ok], n[ok], apart[ok]
            code = np.minimum(a, b) * len(ids) + np.maximum(a, b)
            code, once = np.unique(code, return_index=True)
            once = once[~np.isin(code, failed)]
            again = []
            for k in once[np.argsort(apart[once], kind="stable")].tolist():
                x, y = int(a[k]), int(b[k])
                rx, ry = root(of[x]), root(of[y])
                if rx == ry:
                    continue
                less, more = sorted((sets[x], sets[y]), key=len)
                both = int((more[np.minimum(np.searchsorted(more, less), len(more) - 1)] == less).sum())
                if 100 * both >= percent * (len(less) + len(more) - both):
                    parent[max(rx, ry)] = min(rx, ry)
                    found.append((int(ids[x]), int(ids[y])))
                else:
                    again.append(min(x, y) * len(ids) + max(x, y))
            failed = np.union1d(failed[-FAILED:], again).astype(np.int64)  # forgetting some costs time only
        links = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": links.min(1), "b": links.max(1)}) if len(links) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def _dealt(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """``named(key, cid, comp)`` -> rows ``task, key, i, j, side, cid, comp`` of all units that buckets of several components need, and the number of tasks.

    Members (side 0) meet those outside their bucket's largest component (side 1), block by block. Blocks and tasks are
    bounded in bytes: the sets of one bucket are of similar size, so its smallest member tells the size of all.
    """
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("cid").alias("first"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps"), F.min("first").alias("first"))
    mixed = mixed.where("comps > 1 and n > 2").select("key", "n", "first", F.col("most.comp").alias("giant"), (F.col("n") - F.col("most.n")).alias("outside"))  # of two, the star is the pair
    width = mixed.join(sets.select(F.col("cid").alias("first"), (8 * F.col("n") + SHORT_BITS // 8 + 64).alias("width")), "first")
    fit = F.greatest(F.lit(1), F.least(F.lit(BUCKET_BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.col("width"))))
    width = written(width.withColumns({"blocks": F.ceil(F.col("n") / fit).cast("int"), "turns": F.ceil(F.col("outside") / fit).cast("int")}), "mixed")
    each = written(join_skewed(named, width, ["key"]), "mixed-members")
    # buckets of one group of texts have few smallest members: sent to the same task, their texts are shipped and compared
    # only once; a large group goes to as many tasks as its texts, pairs or rows ask for
    work = width.groupBy("first").agg(F.max("width").alias("width"), F.sum(F.col("n") * F.col("outside")).alias("pairs"), F.sum(F.col("n") * F.col("turns") + F.col("outside") * F.col("blocks")).alias("rows"))
    work = work.join(each.groupBy("first").agg(F.count_distinct("cid").alias("docs")), "first")
    share = F.greatest(F.col("docs") * F.col("width") / TASK_BYTES, F.col("pairs") / TASK_PAIRS, F.col("rows") / TASK_ROWS)
    work = written(work.select("first", share.alias("share")), "groups")
    tasks = max(96, int(work.agg(F.sum("share")).first()[0] or 0))
    place = lambda of, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(of)).cast("int")
    upto = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    each = each.join(hint_small(work), "first")
    members = each.select("*", place("blocks", "i").alias("i"), F.explode(upto("turns")).alias("j"), F.lit(0).alias("side"))
    outsiders = each.where("comp <> giant").select("*", F.explode(upto("blocks")).alias("i"), place("turns", "j").alias("j"), F.lit(1).alias("side"))
    task = F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("key"), F.ceil("share")), "i", "j"), F.lit(tasks))
    return written(members.unionByName(outsiders).select(task.alias("task"), "key", "i", "j", "side", "cid", "comp"), "units"), tasks


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Enough links between different sets to join every component: all components of links, not all links."""
    tested = written(rows.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    links = _linked(tested, sets, percent)
    # two hops to a smaller linked document name most of a component; what they leave apart, the units join
    least = written(links.groupBy(F.col("b").alias("cid")).agg(F.min("a").alias("near")), "near")
    known = written(least.join(hint_small(least).select(F.col("cid").alias("near"), F.col("near").alias("far")), "near", "left").select("cid", F.coalesce("far", "near").alias("comp")), "hops")
    named = written(rows.select("key", "cid").distinct().join(hint_small(known), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp")), "bucket-members")
    dealt, tasks = _dealt(named, sets)
    texts = dealt.select("task", "cid").distinct().join(sets.select("cid", "n", "sketch", "tokens"), "cid")
    met = dealt.unionByName(texts, allowMissingColumns=True).repartition(tasks, "task")
    return written(links.union(met.groupBy("task").applyInArrow(_joined(percent), "a long, b long")), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per input row: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * intersection >= percent * union of their distinct shingles (of ``shingle`` words, A-Z
    lower-cased). component_id is the smallest doc_id that links reach, the document's own included. A text of fewer words is
    one shingle; a null, empty or blank text has none and links with nothing. Of rows that share a doc_id but not a text,
    the one with the smallest text hash stands for the document; all get its component_id and each its own n_shingles. A
    row whose doc_id is null links with nothing and has a null component_id. An empty table gives an empty table. Other
    columns of ``docs`` don't matter. Sets are held as 64-bit shingle hashes; a very long text is one set like any other, made of
    its whole text, and must fit in a task's memory at 8 bytes a word.
    """
    spark: SparkSession = docs.sparkSession
    n_bytes = input_bytes(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")
    prints = written(keyed.mapInArrow(_fingerprints(shingle), "doc long, row long, n long, f1 long, f2 long"), "prints")
    single = prints.where("doc is not null").groupBy("doc").agg(F.min(F.struct("row", "n", "f1", "f2")).alias("x")).select("doc", "x.*").where("n > 0")
    single = written(single, "single")
    classes = written(single.groupBy("f1", "f2").agg(F.min("doc").alias("cid"), F.count("*").alias("n")), "classes")
    member = written(join_skewed(single.select("doc", "row", "f1", "f2"), classes.where("n > 1"), ["f1", "f2"]).select("doc", "row", "cid"), "member")

    # the text of every class once: all rows but those of other members and those that don't stand for their document
    silent = prints.where("n > 0 and doc is not null").select("doc", "row").distinct().join(single.select("doc", "row"), ["doc", "row"], "left_anti")
    silent = written(silent.union(member.where("doc <> cid").select("doc", "row")), "silent")
    firsts = keyed.where("doc is not null and octet_length(text) > 0").join(hint_small(silent), ["doc", "row"], "left_anti").select("doc", "text")
    blocks = max(24, int(n_bytes / 6 * 0.4) // BLOCK_ROWS)
    shipped = firsts.mapInArrow(_ship(shingle, percent, blocks), "kind int, block long, keys binary, docs binary, leaders binary")
    shipped = shipped.repartition(blocks, "kind", "block")  # a task's share doesn't grow with the input
    rows = written(shipped.groupBy("kind", "block").applyInArrow(_meet, "key long, cid long, leader long"), "buckets")
    wanted = written(rows.select(F.col("cid").alias("doc")).distinct(), "wanted")
    sets = written(firsts.join(hint_small(wanted), "doc", "left_semi").mapInArrow(_sets(shingle), "cid long, n long, sketch binary, tokens binary"), "sets")
    found = components(_links(rows, sets, percent)).withColumnRenamed("id", "cid")

    grouped = member.select("doc", "cid").join(found, "cid", "left").select("doc", F.coalesce("component", "cid").alias("component_id"))
    alone = found.join(member.select("cid").distinct(), "cid", "left_anti").select(F.col("cid").alias("doc"), F.col("component").alias("component_id"))
    named = written(grouped.union(alone), "named")
    return prints.join(hint_small(named), "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document is not the smallest of its near-duplicate group; rows with a null doc_id stay."""
    gone = written(near_duplicates(docs.select("doc_id", "text"), shingle, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__doc")).distinct(), "near-copies")
    return docs.join(hint_small(gone), F.col("doc_id").cast("long") == F.col("__doc"), "left_anti")
