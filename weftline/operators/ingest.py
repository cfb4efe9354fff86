"""Ingest of items in order: each sees the works that earlier items made or changed.

The order is kept without going through the items one by one, and without gathering those
that touch each other. All items are judged at once against what the items before them
are believed to have done, by joins on keys; those that touch a change are judged again,
until nothing changes. An item is judged by earlier ones only, so the first k items are
right after k rounds at the latest, and what no longer changes is what the order gives.
Long chains, in which each item joins the work of the one before, take few rounds: an item
names the item it follows, and pointer doubling finds the work at the chain's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp
from .graph import saved
from .works import edition_keys, merge_works, newest_wins, ranked_value, with_names

#: Before all items.
STORED = -1
_RESULT = ("seq", "work", "step", "used", "stamped")


def _earliest(rows: DataFrame, keys: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first rows of every key; what a task doesn't need is dropped before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)


def _two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, held): the two works that had a key first, as an array of (since, work).

    Whether an item meets none, one or several works is known from these two.
    """
    return _earliest(rows, keys, ["since", "work"], 2).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("since", "work"))).alias("held"))


class _Belief:
    """What the items are believed to have done so far, as tables by key with the item since which something holds."""

    def __init__(self, result: DataFrame, items: DataFrame, stored: DataFrame, own_isbns: DataFrame, more_isbns: DataFrame) -> None:
        found = result.where("work IS NOT NULL").join(items.select("seq", "norm_title", "last", "key"), "seq")
        fills = found.where("last IS NOT NULL").groupBy("work").agg(F.min("seq").alias("at"), F.min_by("last", "seq").alias("filled"))
        stamps = found.where("stamped").groupBy("work").agg(F.min("seq").alias("key_since"), F.min_by("key", "seq").alias("stamped_key"))
        made = found.where("step = 'new'").select("work", F.col("seq").alias("since"), "norm_title", F.lit(None).cast("string").alias("own_last"), F.lit(None).cast("string").alias("own_key"))
        works = stored.select("work", F.lit(STORED).cast("long").alias("since"), "norm_title", F.col("last").alias("own_last"), F.col("work_key").alias("own_key")).union(made)
        works = works.join(fills, "work", "left").join(stamps, "work", "left")
        works = works.select(
            "work", "since", "norm_title", F.coalesce("own_last", "filled").alias("last"), F.when(F.col("own_last").isNotNull(), STORED).otherwise(F.col("at")).alias("last_since"),
            F.coalesce("own_key", "stamped_key").alias("key"), F.when(F.col("own_key").isNotNull(), STORED).otherwise(F.col("key_since")).alias("key_since"),
        )
        works = saved(works)
        #: (work, keyed_since) of works with a key
        self.keyed = works.where("key IS NOT NULL").select("work", F.col("key_since").alias("keyed_since"))
        #: (key, holder, held_since)
        self.keys = works.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("key_since").alias("since"), "work")).alias("h")).select("key", F.col("h.work").alias("holder"), F.col("h.since").alias("held_since"))
        events = own_isbns.join(result.where("work IS NOT NULL").select("seq", "work"), "seq")
        events = events.unionByName(more_isbns.join(result.where("work IS NOT NULL AND used").select("seq", "work"), "seq"))
        events = events.unionByName(stored.select(F.lit(STORED).cast("long").alias("seq"), "work", F.explode("isbn13s").alias("isbn")))
        #: (isbn, work, since)
        self.events = events.where("isbn IS NOT NULL").groupBy("isbn", "work").agg(F.min("seq").alias("since"))
        self.isbns = _two(self.events, ["isbn"])
        titled = works.where("norm_title <> ''")
        self.titled = titled
        self.by_title = _two(titled, ["norm_title"])
        self.by_name = _two(titled.where("last IS NOT NULL"), ["norm_title", "last"])
        # works that had no author for a while. An item that agrees with such a work makes none of its own, so
        # of those that items made only a title's first can be one; of stored ones the two that stay so the
        # longest count, among those with another name in the end: four, with no more than two of a name.
        blank = titled.where("last IS NULL OR last_since > since")
        until = F.col("last_since").desc_nulls_first()
        kept = _earliest(blank.where(F.col("since") == STORED), ["norm_title", "last"], [until, "work"], 2).drop("_n")
        kept = _earliest(kept, ["norm_title"], [until, "work"], 4).drop("_n")
        first = _earliest(titled, ["norm_title"], ["since", "work"], 1).drop("_n").where(f"since > {STORED} AND (last IS NULL OR last_since > since)")
        self.blank = kept.unionByName(first).groupBy("norm_title").agg(F.collect_list(F.struct("since", "work", "last", "last_since")).alias("blank"))


def _before(held: str | Column) -> Column:
    return F.filter(held, lambda x: x["since"] < F.col("seq"))


def _judged(active: DataFrame, own_isbns: DataFrame, belief: _Belief) -> DataFrame:
    """(seq, work, step, used, stamped, follows) of active items; ``follows`` is the item since which the work had the key."""
    asked = own_isbns.join(active.select("seq"), "seq").join(belief.isbns, "isbn")
    hits = asked.select("seq", F.explode(_before("held")).alias("h")).groupBy("seq").agg(F.min("h.work").alias("low"), F.max("h.work").alias("high"), F.min("h.since").alias("isbn_since"))
    rows = active.join(hits, "seq", "left").join(belief.keyed.toDF("low", "low_keyed"), "low", "left")
    many = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    # an edition is only looked up where the ISBNs gave no work with a key
    rows = rows.withColumn("look", F.when(~many & ~F.coalesce(F.col("low_keyed") < F.col("seq"), F.lit(False)), F.col("key")))
    rows = rows.join(belief.keys, "key", "left").withColumn("holder", F.when(F.col("held_since") < F.col("seq"), F.col("holder")))
    rows = rows.withColumn("key_work", F.when(F.col("low").isNull() & F.col("look").isNotNull(), F.col("holder")))
    rows = rows.withColumn("by_title", F.col("low").isNull() & F.col("key_work").isNull() & (F.col("norm_title") != ""))

    named = rows.where("by_title").select("seq", "norm_title", F.col("last").alias("own"))
    free = named.where("own IS NULL").join(belief.by_title, "norm_title").select("seq", _before("held").alias("found"))
    same = named.where("own IS NOT NULL").join(belief.by_name.withColumnRenamed("last", "own"), ["norm_title", "own"]).select("seq", _before("held").alias("found"))
    blank = named.where("own IS NOT NULL").join(belief.blank, "norm_title")
    fits = lambda x: (x["since"] < F.col("seq")) & (x["last"].isNull() | ((x["last"] != F.col("own")) & (x["last_since"] >= F.col("seq"))))
    blank = blank.select("seq", F.transform(F.filter("blank", fits), lambda x: F.struct(x["since"], x["work"])).alias("found"))
    titles = free.union(same).union(blank).select("seq", F.explode("found").alias("f"))
    titles = titles.groupBy("seq").agg(F.min("f.work").alias("title_low"), F.max("f.work").alias("title_high"), F.min("f.since").alias("title_since"))
    rows = rows.join(titles, "seq", "left")

    title_many = F.coalesce(F.col("title_low") != F.col("title_high"), F.lit(False))
    step = F.when(F.col("low").isNotNull(), F.when(many, "ambiguous_isbn").otherwise("isbn")).when(F.col("key_work").isNotNull(), "work_key")
    step = step.when(F.col("title_low").isNotNull(), F.when(title_many, "ambiguous_title_author").otherwise("title_author")).otherwise("new")
    rows = rows.withColumn("step", step)
    found = F.coalesce("low", "key_work", "title_low", -1 - F.col("seq"))
    rows = rows.withColumn("work", F.when(~F.col("step").startswith("ambiguous"), found))
    rows = rows.withColumn("follows", F.when(F.col("work").isNotNull(), F.coalesce(F.when(F.col("low").isNotNull(), F.col("isbn_since")), F.when(F.col("key_work").isNotNull(), F.col("held_since")), "title_since")))
    rows = rows.withColumn("used", F.col("work").isNotNull() & F.col("look").isNotNull())
    # a key is stamped only while no other work holds it and the work has none
    rows = rows.join(belief.keyed, "work", "left")
    stamped = F.col("used") & F.col("holder").isNull() & ~F.coalesce(F.col("keyed_since") < F.col("seq"), F.lit(False))
    return rows.select("seq", "work", "step", "used", stamped.alias("stamped"), F.when(F.col("follows") > STORED, F.col("follows")).alias("follows"))


def _followed(judged: DataFrame, most: int = 64) -> DataFrame:
    """Items that follow others judged in the same round take the work at the start of their chain."""
    told = judged.select(F.col("seq").alias("follows"), F.col("work").alias("told"), F.col("follows").alias("then"))
    if judged.join(told, "follows").where("told IS DISTINCT FROM work").isEmpty():
        return judged
    # (seq, at): the item at the end of the jumps made so far, among those judged in this round
    at = saved(judged.where("follows IS NOT NULL").select("seq", F.col("follows").alias("at")).join(judged.select(F.col("seq").alias("at")), "at", "left_semi").select("seq", "at"))
    for _ in range(most):
        ahead = at.toDF("at", "next")
        jumped = saved(at.join(ahead, "at", "left").select("seq", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")))
        at = jumped.select("seq", "at")
        if jumped.where("moved").isEmpty():
            break
    starts = at.join(judged.select(F.col("seq").alias("at"), F.col("work").alias("first")), "at").select("seq", "first")
    out = judged.join(starts, "seq", "left")
    return out.withColumn("work", F.when(F.col("work").isNotNull(), F.coalesce("first", "work"))).drop("first")


def ingest_items(items: DataFrame, works: DataFrame, editions: DataFrame) -> DataFrame:
    """(seq, work, step, created, used, stamped_key) of items taken in order; see the module.

    ``items(seq, title, author, isbn13s)``, ``works(work, title, author, isbn13s,
    work_key)`` with ids from 0 up, ``editions(isbn, work_key, isbn13s)``; a new work
    gets the id -1 - seq of the item that made it. Steps: a shared ISBN; unless that
    gave a work with a key, the key of the edition of the item's first ISBN that has
    one; normalised title and last name, where a missing name agrees with all. A step
    that finds several works is ambiguous and leaves nothing. ``used`` tells whether the
    edition was looked up, so that its ISBNs and cover count; ``stamped_key`` is the key
    that the item gave its work.

    Keys that many items share cost a joined row each: a key's works are reduced to the
    two that had it first before items meet them.
    """
    items = saved(with_names(items).withColumns({"item": F.col("seq"), "isbn13s": F.array_distinct(F.coalesce("isbn13s", F.array().cast("array<string>")))}).select("seq", "item", "isbn13s", "norm_title", "last"))
    first = edition_keys(items, editions, "isbn13s").toDF("seq", "key", "more")
    items = saved(items.join(first, "seq", "left").drop("item"))
    stored = saved(with_names(works).withColumn("isbn13s", F.coalesce("isbn13s", F.array().cast("array<string>"))).select("work", "isbn13s", "norm_title", "last", "work_key"))
    own_isbns = items.select("seq", F.explode("isbn13s").alias("isbn")).where("isbn IS NOT NULL")
    more_isbns = items.select("seq", F.explode("more").alias("isbn")).where("isbn IS NOT NULL")

    tagged = lambda tag, c: F.concat(F.lit(tag), c).alias("k")
    keys = own_isbns.union(more_isbns).select("seq", tagged("i:", "isbn")).union(items.select("seq", tagged("k:", "key"))).union(items.where("norm_title <> ''").select("seq", tagged("t:", "norm_title")))
    keys = saved(keys.where("k IS NOT NULL").distinct())
    work_keys = stored.select("work", F.explode("isbn13s").alias("isbn")).select("work", tagged("i:", "isbn")).union(stored.select("work", tagged("k:", "work_key"))).union(stored.where("norm_title <> ''").select("work", tagged("t:", "norm_title")))

    result = items.select("seq", F.lit(None).cast("long").alias("work"), F.lit(None).cast("string").alias("step"), F.lit(False).alias("used"), F.lit(False).alias("stamped"))
    active, everyone = items, True
    while True:
        belief = _Belief(result, items, stored, own_isbns, more_isbns)
        judged = _followed(saved(_judged(active, own_isbns, belief))).select(*_RESULT)
        before = result.toDF("seq", *[f"old_{c}" for c in _RESULT[1:]])
        both = saved(before.join(judged.withColumn("new", F.lit(True)), "seq", "left"))
        differs = F.lit(False)
        for c in _RESULT[1:]:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        changed = both.where("new").where(differs)
        if changed.isEmpty():
            break
        result = both.select("seq", *[F.when(F.col("new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in _RESULT[1:]])
        if everyone:  # nothing was believed before, so all is new
            everyone = False
            continue
        # whoever shares a key with a changed item, or with a work that one left or joined, is judged again
        moved = changed.select("seq", F.explode(F.array_distinct(F.array("work", "old_work"))).alias("work"))
        touched = moved.select("work").where("work IS NOT NULL").distinct()
        company = result.join(touched, "work", "left_semi").select("seq").union(moved.select("seq")).distinct()
        hot = keys.join(company, "seq", "left_semi").select("k").union(work_keys.join(touched, "work", "left_semi").select("k")).distinct()
        active = items.join(keys.join(hot, "k", "left_semi").select("seq").union(moved.select("seq")).distinct(), "seq", "left_semi")
    out = result.join(items.select("seq", "key"), "seq")
    return out.select("seq", "work", "step", (F.col("step") == "new").alias("created"), "used", F.when(F.col("stamped"), F.col("key")).alias("stamped_key"))


def candidates(items: DataFrame, works: DataFrame, editions: DataFrame, assigned: DataFrame) -> DataFrame:
    """(seq, work): every work that an ambiguous item fitted when its turn came; ``assigned`` is the result of ``ingest_items``."""
    items = with_names(items).withColumn("isbn13s", F.array_distinct("isbn13s")).withColumn("item", F.col("seq"))
    first = edition_keys(items, editions, "isbn13s").toDF("seq", "key", "more")
    items = items.join(first, "seq", "left")
    stored = with_names(works)
    own = items.select("seq", F.explode("isbn13s").alias("isbn"))
    result = assigned.select("seq", "work", "step", "used", F.col("stamped_key").isNotNull().alias("stamped"))
    belief = _Belief(result, items, stored, own, items.select("seq", F.explode("more").alias("isbn")))
    open_items = items.select("seq", "norm_title", F.col("last").alias("own")).join(assigned.where("step LIKE 'ambiguous%'").select("seq", "step"), "seq")
    by_isbn = own.join(open_items.where("step = 'ambiguous_isbn'").select("seq"), "seq").join(belief.events, "isbn").where("since < seq").select("seq", "work")
    agree = F.col("own").isNull() | F.col("last").isNull() | (F.col("last") == F.col("own")) | (F.col("last_since") >= F.col("seq"))
    by_title = open_items.where("step = 'ambiguous_title_author'").join(belief.titled, "norm_title").where(F.col("since") < F.col("seq")).where(agree).select("seq", "work")
    return by_isbn.union(by_title).distinct()


MEMBER = ("rank", "weeks_on_list", "review_url", "metadata")


def ingest_batch(items: DataFrame, works: DataFrame, editions: DataFrame, memberships: DataFrame) -> dict[str, DataFrame]:
    """What a batch of items leaves behind: assigned, works, ages, memberships, ambiguous and candidates.

    ``items`` has (seq, title, author, year, isbn13s, cover_url, description, min_age,
    min_age_source, list_source, list_key, as_of_date, rank, weeks_on_list, review_url,
    metadata), ``works`` (work, title, author, year, isbn13s, cover_url, description,
    work_key, min_age, min_age_source), ``editions`` (isbn, work_key, isbn13s,
    cover_url), ``memberships`` (work, list_source, list_key, as_of_date, rank,
    weeks_on_list, review_url, metadata). ``assigned`` is the result of ``ingest_items``.

    Works are merged in the order of their items, a stored work first, each item's own
    values before those of the edition that was looked up for it: the first value
    counts, ISBNs are united, and a key is stamped where none was. An age counts with a
    source of its own only, the best source's latest; of a list's memberships the newest
    stays with all its fields. ``ambiguous`` (seq, title, list_source, list_key, step)
    are the items that fit several works and leave nothing else, ``candidates`` (seq,
    work, title) all the works they fitted, worked out when asked for.
    """
    assigned = saved(ingest_items(items.select("seq", "title", "author", "isbn13s"), works.select("work", "title", "author", "isbn13s", "work_key"), editions))
    own = items.join(assigned.select("seq", "work", "step", "used", "stamped_key"), "seq")
    looked = edition_keys(items.withColumn("item", F.col("seq")), editions, "isbn13s", "cover_url").toDF("seq", "_key", "_isbns", "_cover")
    found = own.where("work IS NOT NULL").join(looked, "seq", "left")
    none = F.array().cast("array<string>")
    found = found.withColumns(
        {
            "isbn13s": F.concat(F.coalesce("isbn13s", none), F.when(F.col("used"), F.coalesce("_isbns", none)).otherwise(none)),
            "cover_url": F.coalesce("cover_url", F.when(F.col("used"), F.col("_cover"))),
            "work_key": F.col("stamped_key"),
            "title": clamp(F.col("title"), 255),
            "author": clamp(F.col("author"), 255),
        }
    )
    found = saved(found.drop("_key", "_isbns", "_cover"))
    facts = ["title", "author", "year", "isbn13s", "cover_url", "description", "work_key"]
    stored = F.lit(STORED).cast("long").alias("seq")
    merged = merge_works(works.select("work", stored, *facts).union(found.select("work", "seq", *facts)), fill=("author", "year", "cover_url", "description", "work_key"))
    ages = works.select("work", stored, "min_age", "min_age_source").union(found.select("work", "seq", "min_age", "min_age_source"))
    listed = ["work", "list_source", "list_key", "as_of_date", *MEMBER]
    member = memberships.select(*listed, stored).union(found.where("list_source <> '' AND list_key <> ''").select(*listed, "seq"))
    names = merged.select("work", "title")
    fitted = candidates(items.select("seq", "title", "author", "isbn13s"), works.select("work", "title", "author", "isbn13s", "work_key"), editions, assigned)
    return {
        "assigned": assigned,
        "works": merged,
        "ages": ranked_value(ages, "work", "min_age", "min_age_source", "seq"),
        "memberships": newest_wins(member, ["work", "list_source", "list_key"], "as_of_date", "seq").select(*listed),
        "ambiguous": own.where("work IS NULL").select("seq", "title", "list_source", "list_key", "step"),
        "candidates": fitted.join(names, "work", "left").select("seq", "work", "title"),
    }
