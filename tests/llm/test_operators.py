"""The operators against brute force, on small frames with nulls, ties, repeats, clashing columns and long texts."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscope.llm import embedding_dedup, language_id, line_dedup, ngram_join, packing, pu_quality, quality_rules, sentencepiece_codec, substring_dedup, toxicity
from corpuscope.llm.components import components
from corpuscope.llm.tokenizer_files import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `row` string, component_id string"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages and lines, blanks, nulls, a repeated row, a shared id and a long text."""
    base, shared, line = passage(1, 120), passage(2, 70), "A line that Many documents share  "
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, passage(3, 40) + " " + shared), (4, passage(4, 40) + " " + shared + " " + passage(5, 30)),
        (5, line + "\nown line of five\n" + line), (6, "x\n" + line.lower().strip() + "\ny"), (7, ""), (8, None), (9, " \t\n"), (10, "one two"), (11, "One TWO"),
        (12, " ".join([passage(6, 9)] * 30)), (13, passage(7, 30_000)), (14, base), (14, base), (15, passage(8, 60)), (15, passage(9, 60)),
        (None, base), (None, None), (16, "Äpfel été 日本 " * 20), (17, "### $$$ %%% &&& " * 30),
    ]
    return [(d, t, "en" if d and d % 2 else None, None, None, 7, "row", "c") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def ids(rows):
    return [(d, t) for d, t, *_ in rows]


def test_components_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(6, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 3), (7, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 5 for i in range(5, 40)}, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_counts_and_verdicts(docs, none):
    def brute(t):
        ws = words(t)
        tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        c = Counter(tri)
        covered = {p for i, x in enumerate(tri) if c[x] > 1 for p in (i, i + 1, i + 2)}
        seen, dups = set(), 0
        for x in (t or "").split("\n"):
            if WORD.search(x):
                dups += x in seen
                seen.add(x)
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, len(covered)

    got = quality_rules.score_quality(docs, columns=["doc_id", "text", "n_words"]).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert 0 < r["posterior"] < 1 and not (r["kept"] and r["base_failed"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert verdict[0] and verdict[3] and not verdict[17] and not verdict[7] and not verdict[8]
    assert quality_rules.score_quality(none).count() == 0


def test_quality_accuracies_decide_over_lone_flags(spark):
    """Capitals that other rules contradict are forgiven, flags that agree are not: the verdict is not "no flag"."""
    r = random.Random(11)
    prose = lambda k: " ".join(passage(5000 + k, 90).split()[i] for i in range(90))
    rows = [(k, prose(k)) for k in range(300)]
    rows += [(1000 + k, prose(k + 400).upper()) for k in range(40)]
    rows += [(2000 + k, " ".join(w + r.choice(["###", "%%%"]) for w in prose(k + 500).split())) for k in range(40)]
    got = quality_rules.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["kept"] for r in got if r["doc_id"] < 2000} == {True} and not any(r["kept"] for r in got if r["doc_id"] >= 2000)

    names = ["a", "b", "c"]
    patterns = spark.createDataFrame([(1, 1, 1, 800), (-1, -1, 1, 120), (-1, 1, 1, 10), (1, 1, -1, 150), (0, 0, 0, 5)], "a int, b int, c int, n long")
    belief = quality_rules.fit_accuracies(patterns, names)
    post = {tuple(x[n] for n in names): x["p"] for x in patterns.withColumn("p", 1 / (1 + F.exp(-quality_rules._log_odds(names, belief)))).collect()}
    assert post[1, 1, -1] > 0.5 > post[-1, -1, 1] and belief.on_good[2] < min(belief.on_good[:2]) and abs(post[0, 0, 0] - belief.prior) < 1e-9
    assert all(0 < x < 1 for x in [belief.prior, *belief.on_good, *belief.on_bad])
    many = quality_rules.fit_accuracies(patterns.withColumn("n", F.col("n") * 1000), names)
    assert max(abs(x - y) for x, y in zip(many.on_good + many.on_bad, belief.on_good + belief.on_bad, strict=True)) < 1e-6  # alike at every size


def test_line_dedup(docs, none):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in ids(corpus()):
        if d is not None:
            for x in (t or "").split("\n"):
                holders.setdefault(key(x), set()).add(d)
    want = Counter()
    for d, t in ids(corpus()):
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        want[d, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = line_dedup.dedup_lines(docs)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert out.columns[: len(docs.columns)] == docs.columns
    assert line_dedup.dedup_lines(none).count() == 0
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=50).collect()} == {0}


def test_line_dedup_beyond_a_broadcast_sorts_no_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a line that all share\nown line of document {i}") for i in range(40)] + [(40, None)], "doc_id long, text string")
    small = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    hint = line_dedup.hint_small
    monkeypatch.setattr(line_dedup, "hint_small", lambda table, **more: hint(table, most=0, **more))
    out = line_dedup.dedup_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == small
    assert small[5] == ("own line of document 5", 2, 1) and small[0][2] == 0



def test_substring_dedup(docs, none):
    first = {}
    for d, t in ids(corpus()):
        w = words(t)
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, t in ids(corpus()):
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        want[d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)] += 1
    got = substring_dedup.remove_repeated_passages(docs).collect()
    assert Counter((r["doc_id"], " ".join(words(r["text"])), r["n_words"], r["n_removed"]) for r in got) == want
    assert substring_dedup.remove_repeated_passages(none).count() == 0


def test_substring_sketch_loses_nothing_when_crowded(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELLS_PER_WINDOW", 1e-6)
    monkeypatch.setattr(substring_dedup, "BLOCK_BITS", 3)
    shared = passage(20, 60)
    rows = [(i, passage(30 + i, 30) + " " + shared) for i in range(6)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, **dict.fromkeys(range(1, 6), 60)}


def jaccard_groups(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join_edge_cases(docs, none):
    got = ngram_join.near_duplicates(docs, 4, 85).collect()
    assert len(got) == len(corpus())
    want = jaccard_groups([(d, t) for d, t in ids(corpus()) if d is not None and d != 15], 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] not in (None, 15)} == want
    assert {r["component_id"] for r in got if r["doc_id"] == 15} == {15}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert ngram_join.near_duplicates(none).count() == 0
    assert sorted({r["doc_id"] for r in ngram_join.keep_one_per_group(docs).collect()} - {None}) == [d for d in range(18) if d not in (1, 2, 11, 14)]


def test_ngram_join_chains_and_crowded_buckets(spark, monkeypatch):
    """Edited copies at every distance, and texts that share a passage but aren't near: no link lost, none made up."""
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "LOCAL_STAR", 3)
    r, rows = random.Random(5), []
    for length in (12, 40, 150, 700):
        base = passage(length, length).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, max(1, length // 25))):
                w[r.randrange(len(w))] = passage(r.randrange(10**6), 1)
            rows.append((len(rows), " ".join(w)))
    common = passage(77, 40)
    rows += [(len(rows) + i, common + " " + passage(900 + i, 8)) for i in range(40)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == jaccard_groups(rows, 4, 85)


def test_ngram_join_large_group_is_dealt_evenly(spark, monkeypatch):
    """Thousands of near copies beside outsiders: bounded tasks, a forest of links, and no link lost."""
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 1000)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 256)
    r, rows, base = random.Random(8), [], passage(61, 60).split()
    for i in range(1200):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"w{r.randrange(300)}"
        rows.append((i, " ".join(w)))
    seen = []
    dealt = ngram_join._dealt

    def spy(named, sets):
        units, tasks = dealt(named, sets)
        seen.append([x["count"] for x in units.groupBy("task").count().collect()])
        return units, tasks

    monkeypatch.setattr(ngram_join, "_dealt", spy)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(frame, 4, 85).collect()}
    assert got == jaccard_groups(rows, 4, 85)
    loads = seen[0]
    assert sum(loads) > 4000 and max(loads) < 3 * 1000 + 2 * 256 and max(loads) < 5 * sum(loads) / len(loads)


def test_ngram_join_units_give_a_forest():
    """Members of one component that a task finds come out as a tree, not as pairs; what sketches can't tell apart is verified."""
    import pyarrow as pa

    spread = [np.sort(np.random.default_rng(0).choice(2**62, 400, replace=False).astype(np.uint64))]
    for k in range(1, 60):
        spread.append(np.sort(np.append(spread[0][k % 3 :], np.arange(k, dtype=np.uint64) % np.uint64(5) + np.uint64(7 * k))))
    spread = [np.unique(x) for x in spread]
    sketch = [np.packbits(np.bincount((x >> np.uint64(7)).astype(np.int64) % ngram_join.SHORT_BITS, minlength=ngram_join.SHORT_BITS) & 1).tobytes() for x in spread]
    m = len(spread)
    units = pa.table({"task": [0] * (2 * m), "key": [9] * (2 * m), "i": pa.array([0] * 2 * m, pa.int32()), "j": pa.array([0] * 2 * m, pa.int32()), "side": pa.array([0] * m + [1] * m, pa.int32()), "cid": list(range(m)) * 2, "comp": list(range(m)) * 2})
    texts = pa.table({"task": [0] * m, "cid": list(range(m)), "n": [len(x) for x in spread], "sketch": pa.array(sketch, pa.binary()), "tokens": pa.array([x.tobytes() for x in spread], pa.binary())})
    table = pa.concat_tables([units, texts], promote_options="default")
    links = ngram_join._joined(85)(table)
    assert links.num_rows == m - 1 and set(links["a"].to_pylist()) | set(links["b"].to_pylist()) == set(range(m))


def test_band_keys_share_a_band_whenever_sets_are_near():
    r = random.Random(3)
    for _ in range(60):
        size = r.randint(5, 400)
        a = {r.getrandbits(64) for _ in range(size)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(r.choice(sorted(c)))
            if r.random() < 0.5:
                c.add(r.getrandbits(64))
            if 100 * len(a & c) < 85 * len(a | c):
                break
            b = c
        if a != b:
            h = np.array(sorted(a) + sorted(b), np.uint64)
            keys, owner = ngram_join.band_keys(h, np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), 85)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(400):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3), "x"))
    rows += [(400 + i, rows[i][1], rows[i][2], None) for i in range(20)]
    rows += [(500, None, 1, ""), (501, [], 1, ""), (502, [0.0] * 16, 1, ""), (503, [float("nan")] * 16, 1, ""), (504, rows[0][1], None, ""), (505, [None] * 16, 1, ""), (506, [1.0, 2.0], 1, ""), (507, [float("inf")] * 16, 1, ""), (None, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list string")
    good = [(i, np.array(v, float), c) for i, v, c, _ in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, x, c in good:
        for j, y, e in good:
            if i < j and c == e and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = embedding_dedup.embedding_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], find(r["vec_id"]), find(r["vec_id"]) == r["vec_id"])
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [1e-200, 1e200, 5e-324])
def test_embedding_links_beside_extreme_vectors(spark, odd):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(60)] + [(60, [odd] * 8, 1), (61, (np.full(8, odd) * [1, 1, 1, 1, 1, 1, 1, 2]).tolist(), 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == (59, 0) for i in range(60)) and got[60] == (0, 60) and got[61] == (0, 61)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=256).collect()
    want = Counter(np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in ids(corpus()))
    rows = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in rows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    assert sum(len(k) * n for k, n in want.items()) == sum(4 * r["length"] for r in got)
    whole = [r for r in got if r["start"] == 0 and r["length"] == r["doc_tokens"]]
    assert all(bytes(r["ids"]) in want for r in whole)
    assert packing.pack(none, path).count() == 0


def test_packing_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z <|endoftext", "one\n<|endoftext|> two", "no such token here"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in packing.encode_texts(texts, path)] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(rows, path, size=256).collect()
    parts = {d: b"".join(bytes(r["ids"]) for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] == d) for d in range(len(texts))}
    assert {d: np.frombuffer(i, "<u4").tolist()[:-1] for d, i in parts.items()} == dict(enumerate(want))
    assert all(r["doc_tokens"] == len(want[r["doc_id"]]) + 1 for r in got)


def test_packing_plan_covers_any_histogram():
    r = random.Random(2)
    for size in (8, 64, 100):
        histogram = {n: r.choice([1, 2, 50, 1000]) for n in range(1, size) if r.random() < 0.6}
        made = packing.make_plan(histogram, size)
        used = Counter()
        for pieces, times in made.windows:
            assert sum(pieces) == size and times > 0
            for n in pieces:
                used[n] += times
        for n, count in made.tape:
            used[n] += count
        assert used == Counter(histogram)
        places = packing.Places(made, size, 0)
        filled = Counter()
        for n, count in histogram.items():
            for rank in range(count):
                assert sum(p[0] for p in places.find(n, rank)) == n
                for length, sequence, _ in places.find(n, rank):
                    filled[sequence] += length
        assert all(v == size or v & (v - 1) == 0 for v in filled.values())


def test_sentencepiece_ids_and_spans(docs, none):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in ids(corpus())] + [" a  b ", "▁x ▁", "\U0001f600 <s> \x00", "a▁ b"]
    c = sentencepiece_codec.codec(path)
    assert [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in c.encode(texts)] == sp.encode(texts, add_bos=True, add_eos=True)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_codec.token_digests(docs, path).collect())
    want = Counter()
    for d, t in ids(corpus()):
        i = sp.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(i), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()] += 1
    assert got == want
    for r in sentencepiece_codec.encode_spans(docs.where("doc_id in (0, 10, 16)"), path).collect():
        text = next(t for d, t in ids(corpus()) if d == r["doc_id"]).encode()
        assert b"".join(text[p["begin"] : p["end"]] for p in r["pieces"]) == text
    assert sentencepiece_codec.token_digests(none, path).count() == 0


def test_sentencepiece_query_path_aligns_every_document(docs, spark):
    path = tokenizer_file("piece_bpe_32k.model")
    c = sentencepiece_codec.Codec(path)
    more = [" a  b ", "▁x ▁", "\U0001f600 <s> \x00 é", " ", "a▁ b"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = Counter(t or "" for _, t in ids(corpus())) + Counter(more)
    seen = Counter()
    for r in sentencepiece_codec.encode_ids(rows, path).collect():
        at = np.frombuffer(r["offsets"], "<u4").tolist()
        text = next(t for t in texts if c.encode([t])[0] == bytes(r["ids"]))
        raw, want, byte = text.encode(), [], 0
        # where pieces begin, by walking over characters
        source = [0, 0, 0] * bool(text)
        for ch in text:
            source += [byte] * (3 if ch == " " else len(ch.encode()))
            byte += len(ch.encode())
        k = 0
        for i in np.frombuffer(r["ids"], "<u4")[1:-1].tolist():
            want.append(source[k])
            k += 1 if c.sp.is_byte(i) else len(c.sp.id_to_piece(i).encode())
        assert at == [*want, len(raw)]
        seen[text] += 1
    assert seen == texts
    c.known["one"] = c.encode(["two"])[0][4:-4]
    assert c.encode_aligned(["one"]) == sentencepiece_codec.Codec(path).encode_aligned(["one"])  # pieces that don't spell it count for nothing
    with pytest.raises(ValueError, match="spell"):
        c.align("one", np.asarray(c.sp.encode("two")))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pb.ModelProto()
    proto.ParseFromString(normaliser.serialized_model_proto())
    spec = proto.normalizer_spec
    codec = object.__new__(sentencepiece_codec.Codec)
    codec.map, codec.prefix, codec.trim, codec.escape, codec.suffix, codec.user = sentencepiece_codec.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, False, []
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("aé ①㌔Ａｶﾞ　 \tß…ﬁIİΣé") for _ in range(r.randint(0, 12)))
        normal, source = codec.normalise(text)
        assert normal.decode() == normaliser.normalize(text)
        assert len(source) == len(normal) + 1 and source == sorted(source) and source[-1] == len(text.encode())


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fitted_docs(spark):
    """Two languages, junk and insults, enough to learn from."""
    r, rows, labels = random.Random(4), [], []
    en, de = "the and of with for house tree water green".split(), "der und von mit haus baum wasser nicht ein".split()
    for i in range(400):
        lang = ("en", "de")[i % 2]
        w = [r.choice(en if lang == "en" else de) + r.choice(["", "", "ly" if lang == "en" else "ung"]) for _ in range(80)]
        good, toxic = i % 5 != 1, i % 4 == 0
        if not good:
            w = [x.upper() + "!!" for x in w[:20]] * 4
        if toxic:
            for k in (10, 40, 60):
                w[k] = r.choice(["grobian", "lump"])
        rows.append((i, " ".join(w), lang if i % 7 else None))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "en"), (None, "the house", "en"), (0, rows[0][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_language_id(spark):
    docs, _ = fitted_docs(spark)
    got = language_id.identify_languages(docs, language_id.fit_language_model(docs)).collect()
    assert len(got) == 405
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] and r["held_out"] == held(r["doc_id"]) and 0.5 < r["score"] <= 1
        elif r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    empty = docs.limit(0)
    assert language_id.identify_languages(empty, language_id.fit_language_model(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, language_id.fit_language_model(empty)).collect()} == {"und"}


def test_language_backoff_is_word_first():
    model = language_id.LanguageModel(["a", "b"], [{"known": np.array([1.0, -1.0], np.float32)}, {}, {}, {"kno": np.array([-2.0, 2.0], np.float32)}, {}, {}])
    assert model.word("known!").tolist() == [1.0, -1.0]
    assert model.word("knots").tolist() == [-2.0, 2.0]
    assert model.word("zzz").tolist() == [0.0, 0.0] and model.word("42") is None


def test_language_id_against_brute_force(spark):
    docs, _ = fitted_docs(spark)
    seen = {}
    for r in docs.where("doc_id is not null and text is not null and lang is not null").collect():
        if held(r["doc_id"]):
            continue
        for w in r["text"].split():
            w = "".join(c for c in w if c.isalpha()).lower()
            if w:
                seen.setdefault(0, {}).setdefault(w, []).append(r["lang"])
                for n in range(1, language_id.LONGEST + 1):
                    for i in range(len(w) + 3 - n):
                        seen.setdefault(n, {}).setdefault(f"<{w}>"[i : i + n], []).append(r["lang"])

    def frequency(kind, token):
        table = seen[kind]
        if len(table.get(token, ())) < 2:
            return None
        logs = []
        for lang in ("de", "en"):
            size, kinds = sum(x.count(lang) for x in table.values()), sum(lang in x for x in table.values())
            logs.append(math.log((table[token].count(lang) + 0.5) / (size + 0.5 * kinds + 1)))
        return [x - sum(logs) / 2 for x in logs]

    def brute(text):
        total, size = [0.0, 0.0], 0
        for w in text.split():
            w = "".join(c for c in w if c.isalpha()).lower()
            if not w:
                continue
            size += 1
            found = [frequency(0, w)]
            for n in range(language_id.LONGEST, 0, -1):
                if found[0] is None:
                    found = [f for i in range(len(w) + 3 - n) if (f := frequency(n, f"<{w}>"[i : i + n]))] or [None]
            if found[0] is not None:
                total = [t + sum(f[k] for f in found) / len(found) for k, t in enumerate(total)]
        odds = [math.exp((t - max(total)) / max(1.0, size / 50)) for t in total]
        return ("de", "en")[odds.index(max(odds))], max(odds) / sum(odds)

    model = language_id.fit_language_model(docs)
    texts = ["treely baumung 42 qqq", "houses", "Wasserung, the!", "ein green " * 70, "wit mi no\u00e9 fo\nder", docs.where("doc_id = 5").first()["text"]]
    for got in (model.predict(texts), [model.predict([x])[0] for x in texts]):
        for (lang, score), text in zip(got, texts, strict=True):
            want = brute(text)
            assert lang == want[0] and abs(score - want[1]) < 1e-5


def test_language_memory_changes_nothing(monkeypatch):
    model = language_id.LanguageModel(["a", "b"], [{"known": np.array([1.0, -1.0], np.float32)}, {"k": np.array([0.5, -0.5], np.float32)}, {}, {}, {}, {}])
    texts = [f"known word{i} kin{i % 5} {i}" for i in range(40)] * 2
    want = model.predict(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 3)
    model.forget()
    assert [model.predict([x])[0] for x in texts] == want


def test_scores_of_long_texts_beside_clashing_columns(spark):
    docs, labels = fitted_docs(spark)
    sentence = docs.where("doc_id = 6").first()["text"] + " "
    long = [(2000, sentence * 8000), (2001, "x" * 2_000_000), (2002, "du grobian lump. " * 50_000), (2002, "du grobian lump. " * 50_000)]
    rows = spark.createDataFrame(long, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as score", "1 as predicted", "'q' as lang_pred", "true as held_out", "'l' as quality", "2 as toxic", "'en' as lang")
    clashing = docs.selectExpr("doc_id", "text", "lang", "'x' as score", "'q' as lang_pred", "9 as quality", "9 as toxic", "'n' as n", "'t' as token", "'f' as feature")
    marks = labels.selectExpr("*", "'t' as text", "'l' as lang", "0 as n")
    found = {
        "language": language_id.identify_languages(rows, language_id.fit_language_model(clashing)),
        "quality": pu_quality.score_documents(rows, pu_quality.fit_quality(clashing, marks)),
        "toxicity": toxicity.score_toxicity(rows, toxicity.fit_toxicity(clashing, marks)),
    }
    got = {name: {r["doc_id"]: r for r in df.collect()} for name, df in found.items()}
    assert all(df.count() == 4 and len(df.columns) == 4 for df in found.values())
    assert got["language"][2000]["lang_pred"] == "en" and got["language"][2001]["lang_pred"] in ("de", "en")
    assert [got["toxicity"][i]["predicted"] for i in (2000, 2001, 2002)] == [0, 0, 1]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(i) for rows in got.values() for i, r in rows.items())


def test_pu_quality(spark):
    docs, labels = fitted_docs(spark)
    got = pu_quality.score_documents(docs, pu_quality.fit_quality(docs, labels)).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 1) for r in out) >= 0.95 * len(out)
    assert pu_quality.fit_quality(docs, labels.limit(0)) is None
    assert {r["score"] for r in pu_quality.score_documents(docs, None).collect()} == {0.3}
    assert pu_quality.score_documents(docs.limit(0), None).count() == 0


def test_pu_risk_and_gradient_against_brute_force():
    r = np.random.default_rng(5)
    p, u, prior = r.integers(0, 3, (7, 2)) + [0, 3], r.integers(0, 3, (11, 2)) + [0, 3], 0.9
    logistic = lambda z: math.log1p(math.exp(-z))

    def brute(w):
        z = lambda row: sum(w[k] for k in row) + w[-1]
        plus = prior * sum(logistic(z(x)) for x in p) / len(p)
        return plus, sum(logistic(-z(x)) for x in u) / len(u) - prior * sum(logistic(-z(x)) for x in p) / len(p)

    clipped = 0
    for _ in range(40):
        w = r.normal(size=7) * 3
        plus, minus, g = pu_quality.pu_risk(w, p, u, prior)
        assert np.allclose((plus, minus), brute(w))
        clipped += minus < 0
        for k in range(7):
            step = np.eye(7)[k] * 1e-6
            total = lambda v: sum(brute(v)) if minus >= 0 else -brute(v)[1]
            assert abs((total(w + step) - total(w - step)) / 2e-6 - g[k]) < 1e-4
    assert 0 < clipped < 40


def test_pu_quality_reads_no_label_of_bad_documents(spark):
    docs, labels = fitted_docs(spark)
    one, two = (pu_quality.fit_quality(docs, x) for x in (labels, labels.where("quality = 1")))
    assert np.array_equal(one.weights, two.weights) and one.even == two.even and 0.7 < one.prior < 0.9


def test_pu_prior():
    r = np.random.default_rng(0)
    p = r.normal(2, 1, 4000)
    u = np.concatenate([r.normal(2, 1, 2800), r.normal(-2, 1, 1200)])
    assert abs(pu_quality.estimate_prior(p, u) - 0.7) < 0.08


def test_toxicity(spark):
    docs, labels = fitted_docs(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out)
    assert {r["predicted"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {0}
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).count() == 405


def test_toxicity_grammar():
    model = toxicity.ToxicityModel({"lump": 4.0})
    bare, aimed, behind, said, negated, reported = (model.weigh(t) for t in ("a lump here", "you are a lump", "lump that you are", "this is such a lump", "you are not a lump", "she said you are a lump"))
    assert bare == toxicity.BARE * 4 and aimed == behind == said == 4
    assert abs(negated - toxicity.NEGATED * 4) < 1e-9 and abs(reported - toxicity.REPORTED * 4) < 1e-9
    assert model.weigh("you. lump") == bare and model.weigh("kind words") == 0 and model.weigh("lumps lumped") == 0
    threats = ["I will kill you", "kill them all", "you will be killed", "they should never be forgotten, they should be shot"]
    assert {model.weigh(t) for t in threats} == {toxicity.THREAT_PAYS}
    assert {model.weigh(t) for t in ("he killed them in the play", "the shooting of the film", "killing time")} == {0}
    assert model.weigh("I will not kill you") < 2 and model.weigh("he said he will kill you") < 3
    # best clauses, not a sum over length; a line without marks ends its clauses where all machines rest, and nowhere else
    assert model.weigh("a lump. " * 1000) == toxicity.BEST_CLAUSES * bare == model.weigh("some lump lies on the road " * 5000) and model.weigh("lump " * 5000) == bare
    for k in range(60):
        assert model.weigh("word " * k + "you are a lump") == 4 and model.weigh("word " * k + "you are not a lump") == negated
    assert model.weigh("later in the evening kill them all") == 0  # no command: not the first word of its clause


def test_toxicity_composition_against_machines_run_one_by_one():
    r = random.Random(6)
    model = toxicity.ToxicityModel({})
    machines = [m() for m in toxicity.MACHINES.values()]
    for _ in range(3000):
        clause = [(c := r.choice([x for x in range(toxicity.CLASS_COUNT) if x != toxicity.END]), r.uniform(1, 6) if c == toxicity.INSULT else 0.0) for _ in range(r.randint(1, 14))]
        states, held, best = [m.start for m in machines], 0.0, 0.0
        for cls, weight in clause:
            outs = []
            for k, m in enumerate(machines):
                states[k], out = m.step(states[k], cls)
                outs.append(out)
            factor, lift, extra = math.prod(o[0] for o in outs), any(o[1] for o in outs), sum(o[2] for o in outs)
            if cls == toxicity.INSULT:
                held = weight * factor
                best = max(best, held * (1 if lift else toxicity.BARE))
            elif lift:
                best = max(best, held)
            best = max(best, extra * factor)
        assert model.pays(clause) == best


def test_toxicity_every_machine_decides(spark):
    """On held-out documents of ordinary sentences, taking any machine away changes predictions, and all together are right."""
    r, rows, labels = random.Random(9), [], []
    filler = ["the trees are green", "we went to the house by the water", "it rained again", "there was music in the garden"]
    kinds = [("you are a lump", 1), ("a lump of sugar lay there", 0), ("the teacher said he was a lump", 0), ("they are not a lump", 0), ("I will kill you", 1), ("somebody called her a lump", 0), ("what a day", 0)]
    for i in range(700):
        text, toxic = kinds[i % len(kinds)]
        parts = [r.choice(filler) for _ in range(6)]
        parts.insert(r.randrange(6), text)
        rows.append((i, ". ".join(parts) + ".", "x", 0.0))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (None, "you are a lump", "x", 0.0), (9000, passage(3, 60_000) + " you are a lump", "x", 0.0)], "doc_id long, text string, held_out string, score double")
    model = toxicity.ToxicityModel({"lump": 4.0}, 3.0)
    want = {i: t for i, t in labels if held(i)}

    def wrong(machines):
        got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.ToxicityModel(model.weights, model.middle, model.steep, machines)).where("held_out").collect()}
        return sum(got[i] != t for i, t in want.items())

    every = tuple(toxicity.MACHINES)
    assert wrong(every) == 0
    assert all(wrong(tuple(m for m in every if m != gone)) > 0 for gone in every)
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, model).where("doc_id is null or doc_id = 9000").collect()} == {1}


def test_pipeline_stages(docs, none, spark):
    frame = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "").persist()
        assert frame.columns == corpus_pipeline.COLUMNS, name
    left = {r["doc_id"] for r in frame.collect()}
    assert {0, 3, 4, 13} <= left and not left & {2, 7, 8, 9, 16, 17}
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() >= len(left)
    empty = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "") if "text" in empty.columns else empty
    assert empty.count() == 0


def test_pipeline_against_brute_force(spark):
    """Every stage on all that its predecessor kept, held against plain Python."""
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in dict(ids(corpus())).items() if d is not None]
    rows += [(100 + i, passage(200 + i, 30) + "\nThe same closing line of everybody\n" + passage(300, 60) + " " + passage(400 + i, 20)) for i in range(4)]
    near = passage(500, 200).split()
    rows += [(200 + i, " ".join(w if k != 17 * i else f"new{i}" for k, w in enumerate(near))) for i in range(6)]
    frame = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stages["quality_rules"](spark, frame, "").persist()
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.score_quality(frame).collect()}
    assert texts(kept) == {d: t for d, t in rows if verdict[d]} and all(len(words(t)) >= 50 for t in texts(kept).values())

    before, lined = texts(kept), stages["line_dedup"](spark, kept, "").persist()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in before.items():
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    stays = lambda d, x: len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d
    assert texts(lined) == {d: "\n".join(x for x in t.split("\n") if stays(d, x)) for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    before, alone = texts(lined), stages["ngram_join"](spark, lined, "").persist()
    groups = jaccard_groups(list(before.items()), 5, 80)
    assert texts(alone) == {d: t for d, t in before.items() if groups[d][1] == d} and len(texts(alone)) < len(before)

    before, cut = texts(alone), stages["substring_dedup"](spark, alone, "").persist()
    first = {}
    for d, t in before.items():
        w = words(t)
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    want = {}
    for d, t in before.items():
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        want[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    assert texts(cut) == want != before

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    whole, filled = {}, Counter()
    for r in sorted(stages["packing"](spark, cut, "").collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == whole.get(r["doc_id"], 0)
        ids_ = [*tok.encode(want[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids_) and r["ids_crc32"] == zlib.crc32(np.asarray(ids_[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        whole[r["doc_id"]] = r["start"] + r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert set(whole) == set(want) and all(n == 1024 or n & (n - 1) == 0 for n in filled.values())


def test_sketch_pieces_stay_large_as_the_input_grows():
    """Bytes shipped a window, heads of rows included, at the widths and chunks of 0.5, 30 and 300 GB of text."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**64, substring_dedup.FLUSH_WINDOWS, np.uint64)
    shipped = []
    for gigabytes in (0.5, 30, 300):
        windows = gigabytes * 1e9 / 6
        bits = max(substring_dedup.BLOCK_BITS + 3, int(np.ceil(np.log2(windows * substring_dedup.CELLS_PER_WINDOW))))
        chunk = rng.integers(0, max(24, int(gigabytes * 1e9) // substring_dedup.CHUNK_BYTES), len(h)).astype(np.int32)
        made = substring_dedup._pieces(h, chunk, bits)
        assert made.num_rows <= 2 * 2 ** (bits - substring_dedup.BLOCK_BITS)
        shipped.append((sum(made.column(c).nbytes for c in ("cells", "chunks")) + 64 * made.num_rows) / len(h))
    assert shipped[0] < 8 and max(shipped) < 3 * shipped[0] and shipped[1] < 2 * shipped[0]


def test_sentencepiece_falls_back_to_whole_texts():
    """Words whose pieces differ by themselves, or don't spell their text, never change a result: such texts are encoded whole."""
    path = tokenizer_file("piece_bpe_32k.model")
    texts = ["an odd word", "plain words here", "odd", "", "odd  odd"]
    right = sentencepiece_codec.Codec(path).encode_aligned(texts)

    class Differs:
        def __init__(self, sp):
            self.sp = sp

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def encode(self, text, **options):
            found = self.sp.encode(text, **options)
            return [[*ids, *ids] if t == "odd" else ids for t, ids in zip(text, found, strict=True)] if isinstance(text, list) else found

    c = sentencepiece_codec.Codec(path)
    c.sp = Differs(c.sp)
    assert c.encode_aligned(texts) == right
    c = sentencepiece_codec.Codec(path)
    c.encode(texts)
    c.known["odd"] = c.known["odd"] * 2
    assert c.encode_aligned(texts) == right


def test_embedding_dedup_ships_a_vector_once_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] * 2 + 0.02 * rng.normal(size=(150, 16))
    shipped = {}
    plain = embedding_dedup.written

    def counted(df, name):
        out = plain(df, name)
        shipped[name] = out.count()
        return out

    monkeypatch.setattr(embedding_dedup, "written", counted)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert shipped["routed"] == 300
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300)[None] % 2)
    np.fill_diagonal(linked, False)
    assert got == dict(enumerate(linked.sum(axis=1).tolist())) and linked.sum() > 100
