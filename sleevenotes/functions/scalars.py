"""Column expressions of the documents. All native, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import ascii_label

# The addresses and patterns the documents are defined with.
COVER_ART_URL = "https://coverartarchive.org/release/"
IMAGE_CACHE_URL = "https://images.lidarr.audio/cache/"
URL_HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2,}(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/?#:\\]*)"
FULL_STOPS = "\u3002\uff0e\uff61"  # separate labels like a dot
WORD_RUNS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
DEFAULT_ALBUM_TYPE = "Other"


def status(ended: Column) -> Column:
    """``ended`` only for true; false and null are ``active``."""
    return F.when(ended, F.lit("ended")).otherwise(F.lit("active"))


def rating(count: Column, value: Column) -> Column:
    """Votes default to 0, the mark is out of ten and stays null when absent."""
    return F.struct(
        F.coalesce(count, F.lit(0)).cast("int").alias("Count"),
        (value.cast("double") / F.lit(10.0)).alias("Value"),
    )


def full_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three parts; null when a part is missing or the date does not exist."""
    in_range = year.between(1, 32767) & month.between(1, 12) & day.between(1, 31)
    text = F.concat_ws(
        "-",
        F.when(year > 9999, year.cast("string")).otherwise(F.lpad(year.cast("string"), 4, "0")),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    return F.when(in_range, text.try_cast("date"))


def filled_date(year: Column, month: Column, day: Column) -> Column:
    """As :func:`full_date`, with 1 for each missing part."""
    one = F.lit(1)
    return full_date(F.coalesce(year, one), F.coalesce(month, one), F.coalesce(day, one))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """The full date if there is one, else the filled one; no part at all gives 0001-01-01."""
    return F.coalesce(full_date(year, month, day), filled_date(year, month, day))


def date_text(date: Column) -> Column:
    """The date as text; years of five digits have no sign."""
    return F.ltrim(date.cast("string"), F.lit("+"))


def initcap_words(text: Column) -> Column:
    """Upper-case the start of every alphanumeric run (``hip-hop`` -> ``Hip-Hop``).

    The built-in ``initcap`` starts a word only after a space.
    """
    runs = F.regexp_extract_all(text, F.lit(WORD_RUNS), F.lit(1))
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(r.substr(1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    )
    return F.array_join(capital, "")


def link_type(url: Column) -> Column:
    """First label of the host in its ASCII form, without one leading ``www.``; null if there is no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(""))
    dotted = F.translate(host, FULL_STOPS, "." * len(FULL_STOPS))
    return ascii_label(F.split_part(F.regexp_replace(dotted, r"^www\.", ""), F.lit("."), F.lit(1)))


def cover_url(release_id: Column, image_id: Column) -> Column:
    return F.concat(F.lit(COVER_ART_URL), release_id, F.lit("/"), image_id.cast("string"))


def image(cover_type: str, release_id: Column, image_id: Column) -> Column:
    remote = cover_url(release_id, image_id)
    return F.struct(
        F.lit(cover_type).alias("CoverType"),
        F.concat(F.lit(IMAGE_CACHE_URL), remote).alias("Url"),
        remote.alias("remoteUrl"),
    )


def is_plain_alias(type_: Column) -> Column:
    """Aliases without a type and those of type 1 (a name, not a search hint)."""
    return type_.isNull() | (type_ == 1)
