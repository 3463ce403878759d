"""Spelling keys: how identifiers, tags and city names are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def trimmed(c: Column) -> Column:
    """``c`` without surrounding white space; blank strings become null."""
    t = F.trim(c, F.lit(BLANKS))
    return F.when(t != "", t)


def folded(c: Column) -> Column:
    """Trimmed lower-case form (identifiers, tags, sources); blank becomes null."""
    return F.lower(trimmed(c))


def letters(c: Column) -> Column:
    """The lower-case letters a-z of a place name; none left becomes null."""
    t = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(t != "", t)


# ASCII punctuation.
PUNCTUATION = r"""[\s!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def bare_tag(c: Column) -> Column:
    """Lower-case tag without white space and punctuation; null if nothing is left."""
    t = F.lower(F.regexp_replace(c, PUNCTUATION, ""))
    return F.when(t != "", t)


def title_parts(c: Column) -> Column:
    """struct(title, tags): a title without the hashtags at its end, and these; the whole title if it ends otherwise."""
    tail = F.regexp_extract(c, r"((?:\s*#[^\s#]+)+)\s*$", 1)
    title = F.when(tail == "", c).otherwise(F.trim(F.regexp_replace(c, r"(?:\s*#[^\s#]+)+\s*$", "")))
    tags = F.filter(F.split(F.regexp_replace(tail, "#", " "), r"\s+"), lambda t: t != "")
    return F.struct(title.alias("title"), F.when(tail == "", F.array().cast("array<string>")).otherwise(tags).alias("tags"))


def machine_tags(c: Column, namespace: str) -> Column:
    """struct(tags, venue): words without a colon, and the value of the first ``namespace``:venue= word."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    plain = F.filter(words, lambda w: ~w.contains(":"))
    venue = F.filter(words, lambda w: w.contains(":") & w.contains(namespace) & w.contains("venue"))
    return F.struct(plain.alias("tags"), F.element_at(F.split(F.get(venue, 0), "="), -1).alias("venue"))


def trailing_url(c: Column, blocked: list[str] | None = None, longest: int = 23) -> Column:
    """The last word of a message if it is a short link of no blocked host, else null."""
    word = F.element_at(F.split(trimmed(c), r"\s+"), -1)
    host = F.regexp_extract(word, r"^[a-z]+://([^/]*)", 1)
    ok = word.startswith("htt") & (F.length(word) <= longest) & ~F.coalesce(host.isin(blocked or ["-"]), F.lit(False))
    return F.when(ok, word)


def last_path_part(c: Column) -> Column:
    """What follows the last slash of a URL."""
    return F.element_at(F.split(c, "/"), -1)


def id_and_signature(c: Column) -> Column:
    """struct(id, signature) of a check-in link .../checkin/<id>?s=<signature>; nulls where they are missing."""
    i, s = F.regexp_extract(c, r"checkin/([0-9a-f]+)", 1), F.regexp_extract(c, r"[?&]s=([^&]+)", 1)
    return F.struct(F.nullif(i, F.lit("")).alias("id"), F.nullif(s, F.lit("")).alias("signature"))


def photo_url(base: str, farm: Column, server: Column, photo: Column, secret: Column, size: str = "z") -> Column:
    """The address of a photo's image file of one size."""
    return F.format_string(f"https://farm%s.{base}/%s/%s_%s_{size}.jpg", farm, server, photo, secret)


def synthetic_id(*parts: Column) -> Column:
    """A 24-digit id that depends on the given parts alone."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)
