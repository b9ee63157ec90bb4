"""Text helpers, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymeter import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tail(text: Column, n: int) -> Column:
    """Last ``n`` characters (the whole text when shorter)."""
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def last_match(text: Column, pattern: str) -> Column:
    """First group of the last match, null when nothing matches."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def head(text: Column | str, n: int = fixed.HEAD_CHARS) -> Column:
    return F.substring(col(text), 1, n)


def untruncate(text: Column | str) -> Column:
    """Drop one trailing ``...`` left by log truncation."""
    return F.regexp_replace(col(text), r"\.\.\.\z", "")


def answer_cut(content: Column | str, n: int = fixed.ANSWER_CHARS) -> Column:
    return F.substring(F.coalesce(col(content), F.lit("")), 1, n)


def gold_split(text: Column | str) -> Column:
    """Gold number: text after the last ``####``, trimmed, without commas."""
    after = F.substring_index(col(text), "####", -1)
    return F.regexp_replace(F.regexp_replace(after, r"^\s+|\s+$", ""), ",", "")


def sha1_key(text: Column | str) -> Column:
    return F.sha1(F.encode(col(text), "UTF-8"))


def content_key(text: Column | str) -> Column:
    """Fixed-size join key for long texts."""
    return F.sha2(F.encode(col(text), "UTF-8"), 256)


def ts_ms(text: Column | str, epoch_millis: bool = False) -> Column:
    """ISO text (``Z`` accepted, UTC assumed when no zone) to epoch milliseconds, else null.

    With ``epoch_millis`` a bare number is taken as milliseconds already.
    """
    t = col(text)
    iso = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"),
        F.unix_micros(F.try_to_timestamp(F.regexp_replace(t, ",", "."))) / F.lit(1000.0),
    )
    if epoch_millis:
        return F.coalesce(iso, F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")))
    return iso


def bucket(text: Column | str, modulus: int = 100) -> Column:
    """Sticky bucket of a text: SHA-1, first two bytes as a signed big-endian number."""
    unsigned = F.conv(F.substring(sha1_key(text), 1, 4), 16, 10).cast("int")
    signed = F.when(unsigned >= 32768, unsigned - 65536).otherwise(unsigned)
    return F.pmod(signed, F.lit(modulus))


def draw(text: Column | str, seed: int | str = 0, at: int = 1) -> Column:
    """A replayable uniform draw in [0, 1) from a text key and a seed.

    ``at`` picks which 7 hex digits of the digest to use (1-based start position).
    """
    digest = F.sha1(F.concat(F.encode(col(text), "UTF-8"), F.encode(F.lit(f"|{seed}"), "UTF-8")))
    return F.conv(F.substring(digest, at, 7), 16, 10).cast("double") / F.lit(float(16**7))


def norm_label(text: Column | str) -> Column:
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words(text: Column | str) -> Column:
    """Whitespace-separated words, a stand-in token count."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(r"[^ \n\t\r]+")).cast("long")
