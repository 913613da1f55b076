"""Texts of posts and replies as they are encoded, against the rules spelled out serially."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import scalar
from corpuscope.operators import contexts

BLANK = " \t\n\x0b\x0c\r\xa0  ﻿"


def cleaned(title):
    return re.sub(r"^(Ask|Show) HN:?", "", html.unescape(title or "").strip(BLANK), flags=re.I).strip(BLANK)


def test_trimmed_takes_every_kind_of_white_space(spark):
    rows = [(BLANK + "a \n b" + BLANK,), ("",), (None,), (BLANK,), ("x",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(scalar.trimmed(F.col("t"))).collect()] == ["a \n b", "", None, "", "x"]


def test_roots_of_long_chains_and_lone_items(spark):
    n = 10_000
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + 1, None), (n + 2, 999_999), (n + 3, n + 2)] + [(n + 10 + i, n + 1) for i in range(3000)]
    want = {**dict.fromkeys(range(n), 0), n + 1: n + 1, n + 2: 999_999, n + 3: 999_999, **dict.fromkeys(range(n + 10, n + 3010), n + 1)}
    random.Random(1).shuffle(rows)
    assert {r["id"]: r["root"] for r in contexts.thread_roots(spark.createDataFrame(rows, "id long, parent long")).collect()} == want
    assert contexts.thread_roots(spark.createDataFrame([], "id long, parent long")).count() == 0


@pytest.mark.parametrize("cycle", [[(1, 1)], [(1, 2), (2, 1)], [(i, (i + 1) % 7) for i in range(7)] + [(20, 3), (21, None)]])
def test_cycles_raise(spark, cycle):
    df = spark.createDataFrame(cycle, "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        contexts.ancestors(df).count()
    with pytest.raises(ValueError, match="cycle"):
        contexts.thread_roots(df).count()


def test_ancestors_equal_serial_walks(spark):
    r = random.Random(2)
    parent = {i: r.choice([None, 5000, *range(max(0, i - 4), i)]) if i else None for i in range(400)}
    want = set()
    for i in parent:
        at, up = parent[i], 1
        while at in parent:
            want.add((i, at, up))
            at, up = parent[at], up + 1
    got = contexts.ancestors(spark.createDataFrame(list(parent.items()), "id long, parent long"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_reply_inputs(spark):
    r = random.Random(3)
    posts = [(1, " Ask HN: Q&amp;A ", "a.b/c"), (2, None, None), (3, "show hn plain ", "")]
    items = {i: (r.choice([1, 2, 3, 777, *range(10, i)]), r.choice(["text %d" % i, " two\nlines %d " % i, " \n", "", None])) for i in range(10, 150)}
    titles = {i: (cleaned(t), u or "") for i, t, u in posts}
    want = {}
    for i, (parent, text) in items.items():
        if not (own := (text or "").strip(BLANK)):
            continue
        chain, at, root = ["# Reply", own], parent, None
        while True:
            if at in titles:
                chain, root = ["# Post", *titles[at], *chain], at
                break
            if at not in items:
                break
            chain = ["# Comment", items[at][1] or "", *chain]
            at = items[at][0]
        want[i] = (root, "\n\n".join(chain).strip(BLANK))
    comments = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in items.items()], "id long, parent long, text string, root string")
    got = contexts.reply_inputs(comments, spark.createDataFrame([(*p, 9) for p in posts], "id long, title string, url string, up int"))
    assert {x["id"]: (x["root"], x["text"]) for x in got.collect()} == want
    assert contexts.reply_inputs(comments.limit(0), spark.createDataFrame([], "id long, title string, url string")).count() == 0


def test_post_inputs_against_the_serial_loop(spark):
    r = random.Random(4)
    most = 150
    posts = [(i, r.choice(["T", "Show HN: A &lt; B", None, "y" * 160]), r.choice(["own text", "", None]), r.choice(["a.b/c", "", None]), i == 7, i == 9) for i in range(14)]
    replies = [(r.randint(0, 14), r.randint(0, 40), r.choice(["x" * r.randint(0, 30) + str(k), "", None, " b "]), r.choice([-1, 0, 5, None]), r.random() < 0.1, r.random() < 0.1) for k in range(400)]
    want = {}
    for i, title, text, url, dead, deleted in posts:
        if dead or deleted:
            continue
        parts = [cleaned(title), url, contexts.PAGE_TITLE, contexts.PAGE_DESCRIPTION, contexts.PAGE_TEXT] if url else [cleaned(title), text or ""]
        out, first = "\n\n".join(p for p in parts if p), True
        mine = sorted(((k, t or "") for p, k, t, score, gone, cut in replies if p == i and not gone and not cut and (score or 0) >= 0))
        for _, said in mine:
            if len(out) >= most:
                break
            out += ("\n\n# Comments:\n==========" if first else "\n\n----------") + "\n\n" + said
            first = False
        want[i] = out[:most].strip(BLANK)
    got = contexts.post_inputs(spark.createDataFrame(posts, "id long, title string, text string, url string, dead boolean, deleted boolean"), spark.createDataFrame(replies, "post long, rank int, text string, score int, dead boolean, deleted boolean"), most_chars=most)
    assert {x["id"]: x["text"] for x in got.collect()} == want


def test_pages_fill_marks(spark):
    t, d, x = contexts.PAGE_TITLE, contexts.PAGE_DESCRIPTION, contexts.PAGE_TEXT
    inputs = spark.createDataFrame([(1, f"a\n\n{t}\n\n{d}\n\n{x}"), (2, "plain"), (3, f"{t} {t} {x}"), (4, f"{t}"), (5, f"{t}{d}{x}"), (6, t)], "id long, text string")
    links = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, 12), (5, 13), (6, 14)], "id long, url_id long")
    pages = spark.createDataFrame([(10, "2024-01-01", None, "Title $&", "About", "Body"), (11, "2024-01-01", "timeout", "T", None, "B"), (12, None, None, "T", "D", "B"), (13, "2024-01-01", None, None, None, "B")], "url_id long, fetched string, error string, title string, description string, text string")
    got = {r["id"]: (r["text"], r["missing_page"]) for r in contexts.fill_pages(inputs, links, pages).collect()}
    assert got == {1: ("a\n\nTitle $&\n\nAbout\n\nBody", False), 2: ("plain", None), 3: (f"T {t} B", True), 5: ("B", True)}
