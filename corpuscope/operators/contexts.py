"""Texts that stand for posts and replies when they are encoded: titles, urls, marks for the linked page, chains and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import html, scalar
from corpuscope.operators.stages import cut_lineage, first_of, join_on_hot

#: Fixed values of the text format: what parts join with, headings, separators, and the marks that the linked page replaces.
BLANK_LINE = "\n\n"
POST, COMMENT, REPLY = "# Post", "# Comment", "# Reply"
COMMENTS_HEAD, COMMENTS_NEXT = "\n\n# Comments:\n==========", "\n\n----------"
PAGE_TITLE, PAGE_DESCRIPTION, PAGE_TEXT = "<<<REPLACE_WITH_PAGE_TITLE>>>", "<<<REPLACE_WITH_PAGE_DESCRIPTION>>>", "<<<REPLACE_WITH_PAGE_TEXT>>>"
MOST_CHARS = 65536


def ancestors(items: DataFrame) -> DataFrame:
    """``id, ancestor, up``: every item (id, parent) with each item above it, ``up`` steps away; parents that are no items are left out.

    Pointer doubling on numbers alone: what lies up to n steps above an item is what lies so far above the item n steps up, so
    a chain of n items takes log2(n) rounds. Parents that form a cycle are an error. Ids are unique.
    """
    links = cut_lineage(items.where("parent is not null").select("id", "parent").join(items.select(F.col("id").alias("parent")), "parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("up")))
    reach, found, front, beyond = 1, links, links, links
    while front.limit(1).count():
        if loop := beyond.where("id = ancestor").first():
            raise ValueError(f"parents form a cycle through item {loop['id']}")
        # the front is exactly ``reach`` steps away; behind it lies all that the items there know
        known = found.select(F.col("id").alias("at"), F.col("ancestor").alias("next"), F.col("up").alias("more"))
        beyond = cut_lineage(front.select("id", F.col("ancestor").alias("at")).join(known, "at").select("id", F.col("next").alias("ancestor"), (F.col("more") + reach).alias("up")))
        found, reach = cut_lineage(found.unionByName(beyond)), 2 * reach
        front = beyond.where(F.col("up") == reach)
    return found


def thread_roots(items: DataFrame) -> DataFrame:
    """``id, root``: the topmost item that can be reached by parents; a parent that is no item counts as one, with nothing above it.

    Each round follows pointers of doubled length until none moves, log2(depth) rounds, and drops those that have arrived, so
    that a hot root is not joined again. Parents that form a cycle are an error.
    """
    settled = cut_lineage(items.where("parent is null").select("id", F.col("id").alias("root")))
    jump = cut_lineage(items.where("parent is not null").select("id", F.col("parent").alias("root")))
    most, reach = jump.count(), 1
    while jump.limit(1).count():
        if reach > 2 * most:
            raise ValueError(f"parents form a cycle, for one above item {jump.first()['id']}")
        # what a settled item points to is its root; what is no item is one
        up = settled.withColumn("done", F.lit(True)).unionByName(jump.withColumn("done", F.lit(False))).withColumnsRenamed({"root": "next", "id": "root"})
        moved = cut_lineage(join_on_hot(jump, up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.coalesce("done", F.lit(True)).alias("done")))
        settled = settled.unionByName(moved.where("done").drop("done"))
        jump, reach = moved.where("not done").drop("done"), 2 * reach
    return settled


def reply_inputs(items: DataFrame, posts: DataFrame) -> DataFrame:
    """``id, root, text`` of each comment that has a text of its own: the chain from its post down to itself, under headings.

    ``items(id, parent, text)`` are comments with their plain texts, ``posts(id, title, url)`` have an url without protocol. A post
    gives its heading, its cleaned title and its url, each a part even if empty; a comment above gives its heading and text. A
    chain that ends at a parent that is neither keeps what is known, and has no root. Blank comments get no row, but stand in
    the chains of others.
    """
    plain = items.select("id", "parent", F.coalesce("text", F.lit("")).alias("text"))
    above = F.concat_ws(BLANK_LINE, F.lit(COMMENT), F.col("text"))
    heads = posts.select("id", F.concat_ws(BLANK_LINE, F.lit(POST), scalar.clean_title(html.unescape(F.coalesce("title", F.lit("")))), F.coalesce("url", F.lit(""))).alias("part"))
    parts = cut_lineage(plain.select("id", above.alias("part"), F.lit(False).alias("is_post")).unionByName(heads.withColumn("is_post", F.lit(True))))
    tree = cut_lineage(plain.select("id", "parent").unionByName(posts.select("id", F.lit(None).cast("long").alias("parent"))))
    chain = ancestors(tree).join(plain.where(scalar.trimmed(F.col("text")) != "").select("id"), "id", "left_semi")
    named = join_on_hot(cut_lineage(chain), parts.withColumnRenamed("id", "ancestor"), "ancestor")
    gathered = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "part"))).alias("parts"), F.max(F.when(F.col("is_post"), F.col("ancestor"))).alias("root"))
    own = plain.where(scalar.trimmed(F.col("text")) != "").select("id", F.concat_ws(BLANK_LINE, F.lit(REPLY), scalar.trimmed(F.col("text"))).alias("own"))
    front = F.coalesce(F.transform("parts", lambda p: p["part"]), F.array().cast("array<string>"))
    whole = F.array_join(F.concat(front, F.array("own")), BLANK_LINE)
    return own.join(gathered, "id", "left").select("id", "root", scalar.trimmed(whole).alias("text"))


def post_inputs(posts: DataFrame, replies: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """``id, text`` of each post that is neither dead nor deleted: title, then url and marks for its page or its own text, then replies.

    ``posts(id, title, text, url, dead, deleted)`` have an url without protocol (null or empty if none), ``replies(post, rank, text,
    score, dead, deleted)`` are direct comments. Empty parts are left out. Replies that are dead, deleted or scored below 0 are
    passed over (a null score counts as 0), the others follow in order of their rank, blank ones too, each behind its separator.

    A text ends at ``most_chars`` characters. Each reply brings a separator, so only a bounded number of a post's replies can be
    seen, and of these a running sum of the lengths finds those that would start behind the end; only the others are gathered.
    """
    sound = lambda df: df.where(~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)))
    said = sound(replies).where(F.coalesce("score", F.lit(0)) >= 0).select("post", "rank", F.substring(F.coalesce("text", F.lit("")), 1, most_chars).alias("text"))
    earlier = Window.partitionBy("post").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, -1)
    between = len(COMMENTS_NEXT + BLANK_LINE)
    said = first_of(said, "post", [F.asc("rank"), F.asc("text")], most_chars // between + 1)
    seen = said.withColumn("at", F.coalesce(F.sum(F.length("text") + between).over(earlier), F.lit(0))).where(F.col("at") < most_chars)
    parts = seen.groupBy("post").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]).alias("texts"))
    title, url, text = scalar.clean_title(html.unescape(F.coalesce("title", F.lit("")))), F.coalesce("url", F.lit("")), F.coalesce("text", F.lit(""))
    about = F.when(url != "", F.array(title, url, F.lit(PAGE_TITLE), F.lit(PAGE_DESCRIPTION), F.lit(PAGE_TEXT))).otherwise(F.array(title, text))
    top = sound(posts).select("id", F.array_join(F.filter(about, lambda x: x != ""), BLANK_LINE).alias("top"))
    body = F.concat(F.lit(COMMENTS_HEAD + BLANK_LINE), F.array_join("texts", COMMENTS_NEXT + BLANK_LINE))
    joined = top.join(parts, top["id"] == parts["post"], "left")
    # replies are asked for only while the text is short of its end
    whole = F.when(F.length("top") < most_chars, F.concat("top", F.coalesce(body, F.lit("")))).otherwise(F.col("top"))
    return joined.select("id", scalar.trimmed(F.substring(whole, 1, most_chars)).alias("text"))


def _put(text: Column, mark: str, value: Column) -> Column:
    """``text`` with the first ``mark`` replaced by ``value``, null as empty."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.coalesce(value, F.lit("")), F.substring(text, at + len(mark), F.length(text)))).otherwise(text)


def fill_pages(inputs: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, text, missing_page``: texts of ``inputs(id, text)`` with the marks replaced by what is known of the linked page.

    ``links(id, url_id)`` tell each post's page, ``pages(url_id, fetched, error, title, description, text)``. Texts with marks whose
    page has not been fetched yet (no row, or ``fetched`` null) are left out, to be asked for again. ``missing_page`` is true if
    fetching failed, or the text or all metadata are missing, and null for texts without marks.
    """
    marked = F.col("text").contains(PAGE_TITLE)
    known = pages.where("fetched is not null").select("url_id", F.col("title").alias("page_title"), F.col("description").alias("page_description"), F.col("text").alias("page_text"), (F.col("error").isNotNull() | (F.coalesce("text", F.lit("")) == "") | (F.col("title").isNull() & F.col("description").isNull())).alias("missing_page"))
    waiting = cut_lineage(inputs.where(marked).join(links.select("id", "url_id"), "id"))
    named = join_on_hot(waiting, cut_lineage(known), "url_id")
    text = _put(_put(_put(F.col("text"), PAGE_TITLE, F.col("page_title")), PAGE_DESCRIPTION, F.col("page_description")), PAGE_TEXT, F.col("page_text"))
    plain = inputs.where(~marked).select("id", "text", F.lit(None).cast("boolean").alias("missing_page"))
    return named.select("id", text.alias("text"), "missing_page").unionByName(plain)
