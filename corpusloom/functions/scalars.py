"""Scalar expressions of the catalogue and manifest operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, nonblank, strip

#: Fixed value: how a missing value is counted.
MISSING = "(missing)"


def locator(repository: Column, revision: Column, shard: Column, row: Column) -> Column:
    """``repository@revision:shard:row``; null if a part is."""
    return F.concat(repository, F.lit("@"), revision, F.lit(":"), shard, F.lit(":"), row.cast("string"))


def present(c: Column) -> Column:
    """The stripped value, or ``(missing)`` if null or blank."""
    return F.coalesce(nonblank(strip(c.cast("string"))), F.lit(MISSING))


def tri_state(c: Column) -> Column:
    """A boolean from ``true/1/yes`` and ``false/0/no`` in any case; null for all else."""
    v = F.lower(strip(c))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def text_hash(c: Column, blank: Column) -> Column:
    """SHA-256 of the text with white space collapsed and case folded; of the row's own marker if that leaves nothing, so that blanks never merge."""
    v = collapse(c)
    return F.sha2(F.when(F.coalesce(v, F.lit("")) != "", v).otherwise(F.concat(F.lit("blank:"), blank)), 256)


def geometry(width: Column, height: Column) -> Column:
    """``WxH`` of two positive whole numbers, else ``(invalid)``."""
    ok = width.rlike("^[1-9][0-9]*\\z") & height.rlike("^[1-9][0-9]*\\z")
    return F.when(ok, F.concat(width, F.lit("x"), height)).otherwise("(invalid)")


def pair_of_name(name: Column) -> tuple[Column, Column]:
    """Parent and caption number of ``<parent>_<caption>.jpg``; nulls if the name has another form."""
    pattern = r"^([1-9][0-9]*)_([1-9][0-9]*)\.jpg\z"
    return tuple(nonblank(F.regexp_extract(name, pattern, k)).try_cast("long") for k in (1, 2))


def alias_key(c: Column) -> Column:
    """Lower case without anything but letters and digits of ASCII."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def crop_fraction(seed: Column, group: Column, part: int) -> Column:
    """One of two numbers in 0 to 1 from the SHA-256 of ``seed:group``: part 0 or 1 of its 64-bit words over the greatest such word; both ends can occur."""
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), F.coalesce(group.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 16 * part, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)


def crop_offset(seed: Column, group: Column, part: int, slack: Column) -> Column:
    """An offset in 0 to ``slack``, the fraction of it rounded half to even."""
    return F.rint(crop_fraction(seed, group, part) * slack).cast("int")
