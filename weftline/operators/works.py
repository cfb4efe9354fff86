"""Resolution of incoming items to works, and the ordered merges that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, last_name, names_agree, normalize_author, normalize_title
from .tables import join_null_safe

#: Trust in sources of an age, the highest first; others count 0.
AGE_RANKS = {"csm": 4, "pluggedin": 3, "wkar": 2, "nyt": 1}


def with_names(rows: DataFrame) -> DataFrame:
    """Title and author cut to 255 characters, with their normalised forms and the last name."""
    rows = rows.withColumn("title", clamp(F.col("title"), 255)).withColumn("author", clamp(F.col("author"), 255))
    rows = rows.withColumn("norm_title", normalize_title(F.col("title"))).withColumn("norm_author", normalize_author(F.col("author")))
    return rows.withColumn("last", last_name(F.col("norm_author")))


def isbn_matches(items: DataFrame, works: DataFrame) -> DataFrame:
    """(item, low, high): the smallest and largest work that shares an ISBN with the item; ambiguous where they differ.

    Works of an ISBN are reduced to their smallest and largest first, so an ISBN that
    many works carry costs one row.
    """
    held = works.select("work", F.explode(F.array_distinct("isbn13s")).alias("isbn")).groupBy("isbn").agg(F.min("work").alias("low"), F.max("work").alias("high"))
    asked = items.select("item", F.explode(F.array_distinct("isbn13s")).alias("isbn"))
    return asked.join(held, "isbn").groupBy("item").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def edition_keys(items: DataFrame, editions: DataFrame, *more: str) -> DataFrame:
    """(item, work_key, *more): the key of the first of the item's ISBNs that an edition has; editions(isbn, work_key, *more)."""
    asked = items.select("item", F.posexplode("isbn13s").alias("pos", "isbn"))
    known = editions.where("work_key IS NOT NULL").groupBy("isbn").agg(F.min(F.struct("work_key", *more)).alias("e"))
    return asked.join(known, "isbn").groupBy("item").agg(F.min_by("e", "pos").alias("e")).select("item", "e.*")


def title_author_matches(items: DataFrame, works: DataFrame) -> DataFrame:
    """(item, low, high): works with the same normalised title and no conflicting last name. Blank titles match nothing.

    Works of a (title, last name) are reduced to smallest and largest first.
    """
    held = with_names(works).where("norm_title <> ''").groupBy("norm_title", "last").agg(F.min("work").alias("low"), F.max("work").alias("high"))
    asked = with_names(items).where("norm_title <> ''").select("item", "norm_title", F.col("last").alias("own"))
    both = asked.join(held, "norm_title").where(names_agree(F.col("own"), F.col("last")))
    return both.groupBy("item").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def resolve_works(items: DataFrame, works: DataFrame, editions: DataFrame) -> DataFrame:
    """(item, work, step, ambiguous, work_key) of items taken one by one against the stored works.

    Steps: a shared ISBN; unless that gave a work with a key, the key of the item's
    edition; normalised title and last name. A step that finds several works is
    ambiguous and ends the search; no work at all means a new one.
    """
    by_isbn = isbn_matches(items, works).toDF("item", "isbn_low", "isbn_high")
    keys = edition_keys(items, editions)
    held = works.where("work_key IS NOT NULL").groupBy("work_key").agg(F.min("work").alias("key_work"))
    by_key = keys.join(held, "work_key", "left").select("item", "work_key", "key_work")
    by_name = title_author_matches(items, works).toDF("item", "name_low", "name_high")
    out = items.select("item").join(by_isbn, "item", "left").join(by_key, "item", "left").join(by_name, "item", "left")
    c = F.col
    isbn_many = F.coalesce(c("isbn_low") != c("isbn_high"), F.lit(False))
    by_isbn_only = c("isbn_low").isNotNull()
    name_many = F.coalesce(c("name_low") != c("name_high"), F.lit(False))
    step = F.when(by_isbn_only, "isbn").when(c("key_work").isNotNull(), "work_key").when(c("name_low").isNotNull(), "title_author").otherwise("new")
    ambiguous = F.when(by_isbn_only, isbn_many).when(c("key_work").isNotNull(), False).otherwise(name_many)
    work = F.when(~ambiguous, F.coalesce("isbn_low", "key_work", "name_low"))
    return out.select("item", work.alias("work"), step.alias("step"), ambiguous.alias("ambiguous"), "work_key")


def merge_works(rows: DataFrame, key: str = "work", seq: str = "seq", fill: tuple[str, ...] = ("author", "year", "cover_url", "description")) -> DataFrame:
    """One row per work: the first non-null value of each column, and all ISBNs, distinct, in order of appearance.

    ISBNs are made distinct per work before they are gathered, so a work with many rows
    gathers only its own list.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in ("title", *fill)]
    merged = rows.groupBy(key).agg(*first)
    isbns = rows.select(key, seq, F.posexplode("isbn13s").alias("pos", "isbn")).where("isbn IS NOT NULL")
    isbns = isbns.groupBy(key, "isbn").agg(F.min(F.struct(seq, "pos")).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "isbn"))), lambda x: x["isbn"])
    lists = isbns.groupBy(key).agg(ordered.alias("isbn13s"))
    return merged.join(lists, key, "left").withColumn("isbn13s", F.coalesce("isbn13s", F.array().cast("array<string>")))


def ranked_value(rows: DataFrame, key: str, value: str, source: str, seq: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """(key, value, source): of values with a source the one with the highest rank, of equal ranks the latest.

    A stored value takes part as a row with the lowest seq.
    """
    rank = F.lit(0)
    for name, n in (AGE_RANKS if ranks is None else ranks).items():
        rank = F.when(F.col(source) == name, n).otherwise(rank)
    rows = rows.where(F.col(value).isNotNull() & F.col(source).isNotNull()).withColumn("_rank", rank)
    best = rows.groupBy(key).agg(F.max_by(F.struct(value, source), F.struct("_rank", seq)).alias("_best"))
    return best.select(key, f"_best.{value}", f"_best.{source}")


def newest_wins(rows: DataFrame, keys: list[str], date: str, seq: str) -> DataFrame:
    """The surviving row of every key when rows come in the order of ``seq`` (the stored row first).

    A row replaces the one before unless both have dates and its own is older. So
    only what follows the last undated row counts; of that the latest date wins, of
    equal dates the later row, and without any the undated row itself.
    """
    reset = rows.where(F.col(date).isNull()).groupBy(*keys).agg(F.max(seq).alias("_reset"))
    after = join_null_safe(rows, reset, keys, "left").where(F.col("_reset").isNull() | (F.col(seq) >= F.col("_reset")))
    rest = [c for c in rows.columns if c not in keys]
    # an undated row sorts before every date
    best = after.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(date).isNotNull(), F.col(date), F.col(seq))).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def contenders(rows: DataFrame, keys: list[str], date: str, seq: str, first: str | None = None) -> DataFrame:
    """The rows of every key that can still win by ``newest_wins``, whatever comes after: the last undated one and those later in date than all that follow them.

    Of rows with the same seq the one with the lowest ``first`` counts as the later.
    """
    behind = Window.partitionBy(*keys).orderBy(F.col(seq).desc_nulls_last(), *([first] if first else [])).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_late": F.max(date).over(behind), "_reset": F.coalesce(F.bool_or(F.col(date).isNull()).over(behind), F.lit(False))})
    return out.where(~F.col("_reset") & (F.col(date).isNull() | F.col("_late").isNull() | (F.col(date) > F.col("_late")))).select(*rows.columns)


def stamp_unique(candidates: DataFrame, holders: DataFrame, key: str = "work_key", row: str = "work", seq: str = "seq") -> DataFrame:
    """(row, key, accepted): a key goes to the first candidate by seq, and to none if another row holds it."""
    first = candidates.groupBy(key).agg(F.min_by(row, F.struct(seq, row)).alias("_winner"))
    held = holders.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_holder"))
    out = candidates.join(first, key).join(held, key, "left")
    free = F.col("_holder").isNull() & (F.col(row) == F.col("_winner"))
    return out.select(row, key, (free | F.coalesce(F.col("_holder") == F.col(row), F.lit(False))).alias("accepted"))
