"""Column functions for dirty text: white space, placeholders, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, as a class body for Java patterns: ASCII, the separators U+001C to U+001F and every Unicode space.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def folded(c: Column) -> Column:
    """``c`` stripped and in lower case."""
    return F.lower(strip(c))


def nonblank(c: Column) -> Column:
    """Null where ``c`` is the empty string."""
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, ends are stripped, case is folded."""
    return F.lower(F.trim(F.regexp_replace(c, f"[{SPACE}]+", " ")))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; a null part counts as the empty string."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def informative_hash(c: Column) -> Column:
    """A content hash in lower case; null if blank, all zeros, all f, or the hash of no bytes."""
    h = folded(c)
    return F.when(~h.rlike("^(0*|f*)$") & (h != EMPTY_SHA256), h)


def perceptual_hash(c: Column) -> Column:
    """A 64-bit perceptual hash as 16 hexadecimal digits; lost leading zeros come back.

    Null if blank, all zeros, all f, longer than 16 digits or not hexadecimal.
    """
    h = folded(c)
    return F.when(h.rlike("^[0-9a-f]{1,16}$") & ~h.rlike("^(0+|f+)$"), F.lpad(h, 16, "0"))


def hex64(c: Column) -> Column:
    """16 hexadecimal digits as the long with the same 64 bits."""
    hi = F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(c, 9, 8), 16, 10).cast("long")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))
