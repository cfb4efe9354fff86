"""Column expressions shared by the operators: names, identifiers, dates, predicates. All native, entity decoding apart."""

from __future__ import annotations

import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that become more than one.
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij"))
_STROKES = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ı": "i", "ŋ": "n", "ĸ": "k", "ſ": "s"}
FAR_FUTURE = "9999-12-31 23:59:59"


def _accents() -> tuple[str, str]:
    """Lower-case letters of Latin-1 and Latin Extended-A with their base letters, by canonical decomposition."""
    pairs = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xDF, 0x180)) if c.lower() == c}
    pairs = {c: b for c, b in pairs.items() if b != c and b.isascii() and b.isalpha()} | _STROKES
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _accents()


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def to_ascii(c: Column) -> Column:
    """Lower-case Latin letters without their marks; letters of other scripts stay."""
    out = F.translate(c, _ACCENTED, _BASE)
    for old, new in _LIGATURES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalize_name(c: Column) -> Column:
    """Lower case, no accents, apostrophes dropped, every other mark a space, single spaces; null stays null."""
    out = to_ascii(F.lower(F.trim(c)))
    out = F.regexp_replace(out, "['’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_title(c: Column) -> Column:
    """A normalised name without one leading article."""
    return F.regexp_replace(normalize_name(c), r"^(a|an|the) ", "")


def normalize_author(c: Column) -> Column:
    return blank_to_null(normalize_name(c))


def last_name(normalized: Column) -> Column:
    """The last word of a normalised author; the word ``0`` counts as none."""
    return F.nullif(F.element_at(F.split(normalized, " "), -1), F.lit("0"))


def names_agree(a: Column, b: Column) -> Column:
    """False only where both last names are there and differ."""
    return F.coalesce(a == b, F.lit(True))


def squash(c: Column) -> Column:
    """ASCII letters and digits only, lower case."""
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda x: x != "")


def isbn13(c: Column) -> Column:
    """An ISBN-13 from 13 digits (taken as they are) or from an ISBN-10 (its own check digit isn't verified); else null."""
    digits = F.regexp_replace(c, r"[\s-]", "")
    first = F.concat(F.lit("978"), F.substring(digits, 1, 9))
    odd_even = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(first, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 1).otherwise(3)),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    made = F.concat(first, ((10 - odd_even % 10) % 10).cast("string"))
    return F.when(digits.rlike("^[0-9]{13}$"), digits).when(digits.rlike("^[0-9]{9}[0-9Xx]$"), made)


def leading_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "^([0-9]{4})", 1), F.lit("")).cast("int")


def leading_age(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*([0-9]{1,2})", 1), F.lit("")).cast("int")


def clamp_epoch(seconds: Column) -> Column:
    """Epoch seconds as a timestamp, no later than the end of the year 9999; null stays null."""
    return F.when(seconds.isNotNull(), F.timestamp_seconds(F.least(seconds, F.lit(253402300799))))


def minutes_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60, 1)


def video_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, "/title/([0-9]+)", 1), F.lit("")).cast("long")


def split_type_id(c: Column) -> tuple[Column, Column]:
    """``type/id`` at the first slash: both null without one, the id null unless it is all digits."""
    at = F.instr(c, "/")
    rest = F.when(at > 0, F.substring(c, at + 1, F.length(c)))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)), F.when(rest.rlike("^[0-9]+$"), rest.try_cast("long"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def decode_entities(c: Column) -> Column:
    """Character references to characters, those that end in a semicolon: the one Python function, on short extracted strings only."""
    known = lambda m: html.entities.html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0])

    @F.pandas_udf("string")
    def decode(part: pd.Series) -> pd.Series:
        return part.map(lambda text: _REFERENCE.sub(known, text), na_action="ignore")

    return decode(c)


def unescape(c: Column) -> Column:
    """The references that escaping makes of markup's own characters, and no others, back to these."""
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def host(url: Column) -> Column:
    """The host of an absolute url in lower case; empty without one."""
    return F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def clamp(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def list_age(slug: Column) -> Column:
    """The youngest readers of a bestseller list by its slug."""
    return (
        F.when(slug.isin("picture-books", "childrens-chapter-books", "chapter-books"), 4)
        .when(slug.startswith("childrens-middle-grade"), 8)
        .when(slug.startswith("young-adult"), 12)
    )


def band_age(band: Column) -> Column:
    """The youngest readers of a grade band."""
    return F.when(band == "K-2", 5).when(band == "3-5", 8).when(band == "6-8", 11).when(band == "9-12", 14)


def playable(now: Column, service: str = "netflix", region: str = "US") -> Column:
    """An offer that can be watched now, by a link to a title page."""
    open_ = F.col("available_from").isNull() | (F.col("available_from") <= now)
    return (F.col("service_id") == service) & (F.col("region") == region) & F.col("link").contains("/title/") & open_ & (F.col("expires_on").isNull() | (F.col("expires_on") > now))


def subscription_offer(service: str = "netflix", region: str = "US") -> Column:
    return (F.col("service_id") == service) & (F.col("region") == region) & (F.col("type") == "subscription")


def tracked_title() -> Column:
    return (F.col("imdb_id") != "") & F.col("deleted_at").isNull()


def stale_or_never(checked_at: Column, now: Column, days: int = 14, force: bool = False) -> Column:
    if force:
        return F.lit(True)
    return checked_at.isNull() | (checked_at < now - F.make_interval(days=F.lit(days)))


def lookback(ts: Column, now: Column, hours: int) -> Column:
    """Within the last ``hours``, from 1 to 720."""
    if not isinstance(hours, int) or not 1 <= hours <= 720:
        raise ValueError("hours must be a whole number from 1 to 720")
    return ts.between(now - F.make_interval(hours=F.lit(hours)), now)


def classified(level: Column, hit: Column, ceiling: int) -> Column:
    """Surfaced or not: null without a level, false above the ceiling, else whether it was found."""
    return F.when(level.isNull(), F.lit(None).cast("boolean")).when(level > ceiling, False).otherwise(F.coalesce(hit, F.lit(False)))


def any_null(*names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.col(name).isNull()
    return out


def certification(movie: Column, tv: Column) -> tuple[Column, Column]:
    """(movie, tv) certifications of landed release dates and content ratings.

    Movie: of the first US entry the first theatrical one (type 3) if it has text, else
    the first with text, else NR. TV: the first US rating, else NR.
    """
    dates = F.get(F.filter(movie, lambda x: x["iso_3166_1"] == "US"), F.lit(0))["release_dates"]
    theatrical = F.get(F.filter(dates, lambda x: x["type"] == 3), F.lit(0))["certification"]
    some = F.get(F.filter(dates, lambda x: x["certification"] != ""), F.lit(0))["certification"]
    rating = F.get(F.filter(tv, lambda x: x["iso_3166_1"] == "US"), F.lit(0))["rating"]
    return F.coalesce(F.nullif(theatrical, F.lit("")), some, F.lit("NR")), F.coalesce(F.nullif(rating, F.lit("")), F.lit("NR"))


def trailer_url(videos: Column) -> Column:
    """The first official trailer on YouTube, else any trailer there, else any video there."""
    tube = F.filter(videos, lambda v: v["site"] == "YouTube")
    trailers = F.filter(tube, lambda v: v["type"] == "Trailer")
    official = F.filter(trailers, lambda v: v["official"])
    key = F.coalesce(*[F.get(x, F.lit(0))["key"] for x in (official, trailers, tube)])
    return F.concat(F.lit("https://www.youtube.com/watch?v="), key)


def on_provider(us: Column, ids: tuple[int, ...] = (8, 1796)) -> Column:
    """Whether any of the provider ids is in the flat-rate, ad-funded or combined buckets."""
    none = F.array().cast("array<struct<provider_id:int>>")
    buckets = [F.coalesce(us[b], none) for b in ("flatrate", "ads", "flatrate_and_buy")]
    return F.exists(F.concat(*buckets), lambda p: p["provider_id"].isin(*ids))
