"""Enrichment that fills what is missing and never overwrites, and budgets for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_title
from .graph import saved
from .works import stamp_unique


def enrich_fill_null(rows: DataFrame, lookup: DataFrame, key: str, cols: list[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Fills nulls of ``cols`` from the lookup row with the same key; ``stamp`` is set on every row, found or not.

    Several lookup rows of a key count by their smallest values, so rows never multiply.
    """
    known = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("_found"))
    out = rows.join(known, key, "left")
    values = {c: F.coalesce(F.col(c), F.col(f"_found.{c}")) for c in cols}
    if stamp:
        values[stamp] = now
    return out.withColumns(values).select(*dict.fromkeys([*rows.columns, *([stamp] if stamp else [])]))


def lookup_volumes(works: DataFrame, volumes: DataFrame, found: DataFrame) -> DataFrame:
    """(work, volume): by the first of the work's first three ISBNs that has a volume, else by its search result.

    ``volumes(isbn, volume)`` are trusted; ``found(work, rank, volume, title)`` holds search
    results, of which the top one counts if the normalised titles are equal and not blank.
    """
    asked = works.select("work", F.posexplode(F.slice("isbn13s", 1, 3)).alias("pos", "isbn"))
    by_isbn = asked.join(volumes.where("volume IS NOT NULL"), "isbn").groupBy("work").agg(F.min_by("volume", F.struct("pos", "volume")).alias("by_isbn"))
    top = found.groupBy("work").agg(F.min_by(F.struct("volume", "title"), F.struct("rank", "volume")).alias("top"))
    out = works.select("work", normalize_title(F.col("title")).alias("norm")).join(by_isbn, "work", "left").join(top, "work", "left")
    same = (F.col("norm") != "") & (F.col("norm") == normalize_title(F.col("top.title")))
    return out.select("work", F.coalesce("by_isbn", F.when(same, F.col("top.volume"))).alias("volume")).where("volume IS NOT NULL")


def key_index(listings: DataFrame, pages: int = 2) -> DataFrame:
    """(work_key, isbn13s, cover_url) of the first ``pages`` edition pages of every key, in their order.

    ``listings(work_key, page, pos, isbn13s, cover_url)``: page counts from 0, pos within it.
    A page's place is known from the listing, so a key's editions are filtered and
    never sorted as a whole; what is left per key is bounded by the size of two pages.
    The cover is the first there is.
    """
    rows = listings.where(F.col("work_key").isNotNull() & (F.col("page") < pages))
    place = F.struct("page", "pos")
    each = rows.select("work_key", place.alias("at"), F.posexplode("isbn13s").alias("nth", "isbn")).where("isbn IS NOT NULL")
    each = each.groupBy("work_key", "isbn").agg(F.min(F.struct("at", "nth")).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "isbn"))), lambda x: x["isbn"])
    covers = rows.groupBy("work_key").agg(F.min_by("cover_url", F.when(F.col("cover_url").isNotNull(), place)).alias("cover_url"))
    return covers.join(each.groupBy("work_key").agg(ordered.alias("isbn13s")), "work_key", "left").select("work_key", "isbn13s", "cover_url")


def stamp_editions(works: DataFrame, editions: DataFrame, listings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(works, collisions): works without a key take that of their first ISBN with an edition; then keys give ISBNs and covers.

    ``works(work, work_key, isbn13s, cover_url)``, ``editions(isbn, work_key, isbn13s,
    cover_url)``, ``listings`` as of ``key_index``. A work without a key takes its
    edition's ISBNs and, where it has none, its cover; a key that another work holds, or
    that an earlier work takes, isn't stamped and is reported in collisions(work,
    work_key). A work that has a key, now or before, takes the ISBNs and cover that the
    first pages of the key's listing hold, whatever its own ISBNs are.
    """
    open_works = works.where("work_key IS NULL")
    asked = open_works.select("work", F.posexplode("isbn13s").alias("pos", "isbn"))
    known = editions.where("work_key IS NOT NULL").groupBy("isbn").agg(F.min(F.struct("work_key", "isbn13s", "cover_url")).alias("e"))
    first = asked.join(known, "isbn").groupBy("work").agg(F.min_by("e", "pos").alias("e"))
    stamped = stamp_unique(first.select("work", F.col("e.work_key").alias("work_key"), F.col("work").alias("seq")), works)
    taken = stamped.where("accepted").select("work", F.col("work_key").alias("new_key"))
    none = F.array().cast("array<string>")
    out = works.join(first, "work", "left").join(taken, "work", "left").withColumn("work_key", F.coalesce("work_key", "new_key"))
    isbns, cover = [F.coalesce("isbn13s", none), F.coalesce("e.isbn13s", none)], [F.col("cover_url"), F.col("e.cover_url")]
    if listings is not None:
        out = out.join(key_index(listings).toDF("work_key", "key_isbns", "key_cover"), "work_key", "left")
        isbns, cover = [*isbns, F.coalesce("key_isbns", none)], [*cover, F.col("key_cover")]
    out = out.withColumns({"isbn13s": F.array_distinct(F.concat(*isbns)), "cover_url": F.coalesce(*cover)})
    return out.select(*works.columns), stamped.where("NOT accepted").select("work", "work_key")


def running_totals(rows: DataFrame, order: str, costs: dict[str, str], parts: int | None = None) -> DataFrame:
    """The rows with the sums of columns over all rows before them in a unique order; ``costs`` maps a new column to the summed one.

    Running totals need the rows in order but not in one task: rows are range-partitioned into
    ``parts``, by default as many as a shuffle has, written, and each part adds the sums
    of the parts before, one small row for each part.
    """
    filled = {f"_cost_{c}": F.coalesce(F.col(c), F.lit(0)) for c in costs.values()}
    spent = saved(rows.withColumns(filled).repartitionByRange(*([parts] if parts else []), order).withColumn("_part", F.spark_partition_id()))
    sums = spent.groupBy("_part").agg(*[F.sum(c).alias(c) for c in filled])
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    base = sums.select("_part", *[F.expr(f"coalesce(sum(`{c}`) OVER (ORDER BY _part {before}), 0)").alias(f"_base{c}") for c in filled])
    out = spent.withColumns({f"_own{c}": F.expr(f"coalesce(sum(`{c}`) OVER (PARTITION BY _part ORDER BY {order} {before}), 0)") for c in filled})
    out = out.join(F.broadcast(base), "_part")
    return out.select(*rows.columns, *[(F.col(f"_own_cost_{c}") + F.col(f"_base_cost_{c}")).alias(new) for new, c in costs.items()])


def budgeted_prefix(rows: DataFrame, order: str, cost: str, budget: int, parts: int | None = None) -> DataFrame:
    """The rows, in the order of a unique column, before which less than ``budget`` has been spent; the last may overshoot."""
    return running_totals(rows, order, {"spent_before": cost}, parts).where(F.col("spent_before") < budget)


def soft_delete(titles: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """Marks titles deleted whose lookup by a positive outside id said not found; ``status(title_id, not_found)``."""
    gone = status.where("not_found").select("title_id").distinct().withColumn("_gone", F.lit(True))
    out = titles.join(gone, "title_id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("tmdb_id") > 0)
    return out.withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).select(*titles.columns)


def chain_walk(pages: DataFrame, lists: DataFrame, budget: int, limit: int | None = None, resume: tuple[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(walk, stop) of a run through ``lists(list, seq)`` in order, each from its newest page along the pointers to previous ones.

    ``pages(list, published, previous)`` are the landed pages. A list starts at its newest
    page; ``resume`` (list, published) leaves out the lists before and starts that one
    there. A pointer to a page that wasn't landed, or a list without pages, costs a
    call and ends the list. The run stops before the call that would go over ``budget``
    calls or ``limit`` pages, both counted over the run. ``walk`` has a row per
    call: list, published (null: the list's newest, which isn't there), call (from 0),
    found. ``stop`` has the first call not made, as (list, published, call), or no row.

    Pages are reached by pointer doubling: with jumps of 2^k pages the pages known to be
    on the chain double each round, so a run takes rounds in the logarithm of its budget.
    A pointer that isn't older than its page ends the chain, as does none. Of pages with
    the same list and date the one with the latest previous counts; pages without list or
    date, and lists without seq, don't.
    """
    spark, kind = pages.sparkSession, pages.schema["published"].dataType
    lists = lists.where("list IS NOT NULL AND seq IS NOT NULL").groupBy("list").agg(F.min("seq").alias("seq"))
    start = F.lit(None).cast(kind)
    if resume:
        first = lists.where(F.col("list") == resume[0]).select(F.col("seq").alias("first"))
        lists = lists.join(F.broadcast(first), F.col("seq") >= F.col("first")).drop("first")
        start = F.when(F.col("list") == resume[0], F.lit(resume[1]).cast(kind))
    lists = saved(lists)
    nodes = pages.where("list IS NOT NULL AND published IS NOT NULL").join(lists, "list", "left_semi").groupBy("list", "published").agg(F.max("previous").alias("previous"))
    nodes = saved(nodes.withColumn("previous", F.when(F.col("previous") < F.col("published"), F.col("previous"))))

    most = budget if limit is None else min(budget, limit)
    newest = nodes.groupBy("list").agg(F.max("published").alias("newest"))
    begin = lists.join(newest, "list", "left").select("list", F.coalesce(start, "newest").alias("published"))
    on_chain = saved(begin.withColumn("pos", F.lit(0).cast("long")))
    jumps = nodes.select("list", "published", F.col("previous").alias("to")).where("to IS NOT NULL")
    step = 1
    while step <= most:
        ahead = on_chain.join(jumps, ["list", "published"]).select("list", F.col("to").alias("published"), (F.col("pos") + step).alias("pos")).where(F.col("pos") <= most)
        grown = saved(on_chain.union(ahead))
        if grown.count() == on_chain.count():
            break
        on_chain, step = grown, step * 2
        second = jumps.toDF("list", "to", "then")
        jumps = saved(jumps.join(second, ["list", "to"]).select("list", "published", F.col("then").alias("to")))

    there = nodes.select("list", "published", F.lit(True).alias("found"))
    calls = on_chain.join(there, ["list", "published"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    spent = calls.groupBy("list").agg(F.count("*").alias("calls"), F.count_if("found").alias("pages"))
    before = running_totals(lists.join(spent, "list"), "seq", {"calls_before": "calls", "pages_before": "pages"})
    calls = calls.join(before.select("list", "calls_before", "pages_before"), "list")
    made = F.col("call") < budget
    if limit is not None:
        made = made & (F.col("pages_before") + F.col("pos") < limit)
    calls = saved(calls.withColumn("call", F.col("calls_before") + F.col("pos")).withColumn("made", made))
    left = calls.where("NOT made").agg(F.min(F.struct("call", "list", "published")).alias("s")).where("s IS NOT NULL")
    return calls.where("made").select("list", "published", "call", "found"), left.select("s.list", "s.published", "s.call")


def pending(rows: DataFrame, stamp: str, order: str, force: bool = False, also: Column | None = None) -> DataFrame:
    """Rows not stamped yet (all with ``force``) that meet a further condition, in the order of an id."""
    todo = F.lit(True) if force else F.col(stamp).isNull()
    return rows.where(todo if also is None else todo & also).orderBy(order)
