"""Vector codes, phrases and fingerprints against brute force, on small frames with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscope.llm import fuzzy_hash, phrases, vector_codes

# --- vector codes -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, n string, `__label` int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : p * width + width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                members[p, near(p, x)[1]].append(x)
        for (p, e), xs in members.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = Counter()
    for _, lab, _, err in out:
        total[lab] += err
    return [(i, lab, c, e, total[lab], digest) for i, lab, c, e in out]


@pytest.mark.parametrize("n", [7, 300])
def test_vector_codes_equal_brute_force(spark, n):
    r = random.Random(n)
    grid = [-0.02, -0.004, 0.0, 0.004, 0.02, 1.5]  # few values: many equal entries and equal distances
    rows = [(i, [float(np.float32(r.choice(grid))) for _ in range(32)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] + [0.0] * 31, 1), (n + 2, [float("-inf")] * 32, 1), (n + 3, [None] + [0.0] * 31, 0), (n + 4, [0.0] * 32, None), (n + 5, [], 1)]
    rows += [rows[2], rows[2], (3, [0.02] * 32, 7), (None, [0.5] * 32, 0), (n + 9, [-3e4] * 32, 5)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*row, "clash", "x", 3) for row in rows], VECTORS).repartition(5)
    got = vector_codes.compress_vectors(df)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_codes(rows))


def test_vector_codes_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress_vectors(df).count() == 0
    assert vector_codes.compress_vectors(spark.createDataFrame([(1, None, 2, "", "", 0)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="below"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [3e38] * 16, 2, "", "", 0)], VECTORS)).count()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [0.0] * 17, 2, "", "", 0)], VECTORS))


def test_kd_tree_finds_the_lowest_of_equally_near_entries():
    rng = np.random.default_rng(3)
    for entries, dims, spread in ((1, 4, 3), (64, 4, 2), (64, 4, 300), (200, 3, 4), (64, 1, 9)):
        book = rng.integers(-spread, spread + 1, (entries, dims))
        points = rng.integers(-spread - 2, spread + 3, (2000, dims))
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        found, best = vector_codes.nearest_entries(vector_codes.kd_tree(book), book, points)
        assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_kd_tree_prunes(monkeypatch):
    """Branch and bound looks at a small part of all pairs where entries lie apart."""
    rng = np.random.default_rng(4)
    book, points = rng.integers(-10_000, 10_000, (64, 2)), rng.integers(-10_000, 10_000, (500, 2))
    tree, seen = vector_codes.kd_tree(book), []

    real = vector_codes._bound
    monkeypatch.setattr(vector_codes, "_bound", lambda node, here: seen.append(len(here) if node.halves is None else 0) or real(node, here))
    vector_codes.nearest_entries(tree, book, points)
    leaves = sum(1 for _ in _leaves(tree))
    assert sum(seen) < 0.5 * leaves * len(points)


def _leaves(node):
    if node.halves is None:
        yield node
    else:
        for half in node.halves:
            yield from _leaves(half)


# --- phrases ----------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, most=3, least=10, cover=50, first=2000):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(ws)
            for m in range(1, most + 1):
                f["und" if lang is None else lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= cover * a for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        scored.sort()
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(scored[:first], 1)]
    return out


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "日本", "x\x01y", "a b", "Ü", "ü", "ß"]
    made = []
    for i in range(n):
        ws = [r.choice(vocabulary) + r.choice(["", "", "", ",", ".\n", "\t", "  ", "\x0b"]) for _ in range(r.randint(0, 60))]
        made.append((i, r.choice(["  ", " ", " \t"]).join(ws), r.choice(["en", "de", None, "und", ""])))
    return [*made, (n, None, "en"), (n, "", None), (n, " .,;", "de"), (n + 1, "go go go go go go go go go go go go go", "xx"), (n + 2, "new york city! " * 5000, "en"), made[0], (None, made[1][1], "en")]


@pytest.mark.parametrize("most,first,cover", [(3, 2000, 50), (3, 7, 50), (4, 2000, 80), (2, 2000, 50)])
def test_phrases_equal_brute_force(spark, most, first, cover):
    rows = texts(5, 150)
    df = spark.createDataFrame([(*row, "clash", 5) for row in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    got = phrases.collocations(df, most=most, first=first, cover_percent=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, most=most, first=first, cover=cover)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_phrases_of_nothing(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, None, None), (2, "a b", "en")], [(1, None, "en"), (2, "", None), (3, " ., \n", "de")]):
        assert phrases.collocations(spark.createDataFrame(rows, schema)).count() == 0


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(9)
    cases = [(r.randrange(10, 10**12),) for _ in range(200)]
    cases = [(a, a + r.randrange(10**12), a + r.randrange(10**12)) for (a,) in cases] + [(10**12, 10**12, 10**12), (3, 10**6 - 1, 3)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = df.select("a", "l", "r", F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long"))
    assert all(s == 1_000_000 * a * a // (l * r) for a, l, r, s in got.collect())


def test_suffix_arrays_of_any_shard_size_give_the_same_counts():
    rows = texts(6, 40)
    batch = pa.record_batch([pa.array([t for _, t, _ in rows]), pa.array([x or "und" for _, _, x in rows])], names=["text", "lang"])

    def counted(words):
        total, n = Counter(), 0
        for shard in phrases.shards(iter([batch]), words):
            n += 1
            order, shared = phrases.suffix_array(shard.at, shard.left, 5)
            tails = [tuple(shard.at[i : i + min(5, shard.left[i])].tolist()) for i in order]
            assert tails == sorted(tails)
            common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared.tolist() == [0] + [common(a, b) for a, b in itertools.pairwise(tails)]
            for size, first, counts in shard.grams(5):
                names = shard.words.to_pylist()
                total.update({(shard.langs[shard.at[i]], *(names[shard.at[i + j]] for j in range(size))): int(c) for i, c in zip(first, counts, strict=True)})
        return total, n

    whole, one = counted(10**9)
    small, many = counted(50)
    assert whole == small and one == 1 < many
    lens = Counter(len(k) - 1 for k in whole)
    assert set(lens) == {1, 2, 3, 4, 5}


def test_phrases_survive_a_full_bit_table(spark, monkeypatch):
    rows = texts(7, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == sorted(brute_phrases(rows))


# --- fingerprints -------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    data = text.encode()
    spread, full = 0xD6E8FEB86659FD93, (1 << 64) - 1
    hashes = []
    for i in range(len(data)):
        w = int.from_bytes((bytes(7) + data)[i : i + 8], "little")
        h = w * spread & full
        h = (h ^ h >> 29) * spread & full
        hashes.append(h >> 32)

    def signature(power, most):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if len(out) < most - 1 and h % (1 << power) == (1 << power) - 1:
                out += fuzzy_hash._LETTERS[xxhash.xxh3_64_intdigest(data[start : i + 1]) % 64]
                start = i + 1
        return out + (fuzzy_hash._LETTERS[xxhash.xxh3_64_intdigest(data[start:]) % 64] if start < len(data) else "")

    power = 0
    while 64 << power < len(data):
        power += 1
    while power and sum(h % (1 << power) == (1 << power) - 1 for h in hashes) < 32:
        power -= 1
    return f"{1 << power}:{signature(power, 64)}:{signature(power + 1, 32)}"


def brute_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (sa, a1, a2), (sb, b1, b2) = ((int(s), x, y) for s, x, y in (a.split(":"), b.split(":")))
    for x, y in [(x, y) for s, x in ((sa, a1), (2 * sa, a2)) for t, y in ((sb, b1), (2 * sb, b2)) if s == t]:
        if x == y:
            return 1.0
        run = min(7, len(x), len(y))
        if not run or not any(x[i : i + run] in y for i in range(len(x) - run + 1)):
            continue
        x, y = re.sub(r"(.)\1{3,}", r"\1\1\1", x), re.sub(r"(.)\1{3,}", r"\1\1\1", y)
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, d[0] = d[:], i
            for j, e in enumerate(y, 1):
                d[j] = min(before[j] + 1, d[j - 1] + 1, before[j - 1] + (0 if c == e else 2))
        best = max(best, 1 - d[-1] / (len(x) + len(y)))
    return best


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents():
    base = prose(1, 400)
    made = [base, base, base.replace("a", "b", 3), "", None, "x", "ab", "abc", "aaaa" * 900, prose(2, 3), prose(3, 30), prose(4, 6000), "日本語テキスト" * 50, base[: len(base) // 2], "é", base + prose(5, 40)]
    return [(10 * i, t) for i, t in enumerate(made)] + [(30, prose(6, 50)), (30, prose(7, 50)), (30, prose(7, 50)), (None, prose(8, 20)), (None, None)]


def brute_rows(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        a, b, c = map(brute_fingerprint, (text, changed, after))
        out.append((i, len(text), digest(changed), a, b, round(brute_likeness(a, b), 12), round(brute_likeness(a, c), 12)))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_fingerprints_equal_brute_force(spark, parts):
    rows = documents()
    df = spark.createDataFrame([(*row, 1, "clash", "y") for row in rows], "doc_id long, text string, part int, fingerprint string, hash string").repartition(6)
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r], r[1] is not None, r[1] or ""))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fuzzy_hash.fingerprint_documents(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: tuple(map(repr, r))
    assert sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, got)], key=key) == sorted(brute_rows(ordered), key=key)


def test_fingerprints_of_one_document_and_of_none(spark):
    one = fuzzy_hash.fingerprint_documents(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in one] == [(5, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert fuzzy_hash.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = prose(11, 3000)
    whole = fuzzy_hash.fingerprint(text)
    for block in (7, 64, 1000):
        monkeypatch.setattr(fuzzy_hash, "BLOCK", block)
        assert fuzzy_hash.fingerprint(text) == whole == brute_fingerprint(text)
    assert len(whole) < 110


def test_edited_texts_stay_near_and_others_far():
    marks = [fuzzy_hash.fingerprint(prose(100 + i, 40 + 7 * i)) for i in range(80)]
    changed = [fuzzy_hash.fingerprint(fuzzy_hash.edited(prose(100 + i, 40 + 7 * i), prose(300 + i, 400))) for i in range(80)]
    near = [fuzzy_hash.likeness(a, b) for a, b in zip(marks, changed, strict=True)]
    far = [fuzzy_hash.likeness(a, b) for a, b in itertools.pairwise(marks)]
    # a text of one line over and over has few kinds of chunks, in long runs, and its fingerprint is cut short
    line, other = "words of one line that comes again\n" * 150, "and some of quite another one here\n" * 150
    spam = [fuzzy_hash.fingerprint(t) for t in (line, fuzzy_hash.edited(line, prose(1, 400)), other)]
    assert fuzzy_hash.likeness(spam[0], spam[1]) > 0.5 and fuzzy_hash.likeness(spam[0], spam[2]) == 0
    assert min(near) > 0.5 and max(far) < 0.5 and sum(far) / len(far) < 0.05
