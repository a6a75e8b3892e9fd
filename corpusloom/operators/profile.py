"""Column-level data quality profile of a table that arrives in loads.

Values are generalised to masks of character classes.  The masks of a column
over all loads give its dominant patterns; what stands under rare masks is
reported, and so is how far the mix of masks moved from load to load.  Where
something is expected of a column, its allowed values have masks too: what
stands under any other mask is invalid at once, and only values under one of
theirs are looked at themselves.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE
from corpusloom.scratch import Scratch

#: Spellings of a missing value, in lower case and stripped.
MISSING = ("", "na", "n/a", "none", "null", "nan", "unknown", "?", "-")
#: Mask of a null.
NULL_MASK = "(null)"
#: Mask of all missing values where masks are counted; no value has it, as letters never stay.
MISSING_MASK = "(missing)"
#: A run of hexadecimal digits that counts as a hash in ``whole_mask``, in small letters or capitals.
_HEX = "|".join(f"(?<![0-9{x}])(?=[0-9]*+[{x}])(?=[{x}]*+[0-9])[0-9{x}]{{16,}}+" for x in ("a-f", "A-F"))


def whole_mask(c: Column) -> Column:
    """The mask of the whole value, nothing cut off, with hexadecimal runs as one class.

    Runs of capitals are ``A``, of small letters ``a``, of other letters ``x``,
    of digits ``9``, of white space ``_``; other characters stay.  A run of 16
    or more hexadecimal digits of one case, with a letter and a digit among
    them, is ``h{n}`` or ``H{n}``, n its length: hashes share a mask, and one too
    long, too short or with a foreign character has another.  Null gives
    ``(null)``, the empty string the empty mask.
    """

    def hashes(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(_HEX), 0)
        sign = lambda r: F.concat(F.when(r.rlike("[a-f]"), "h").otherwise("H"), F.lit("{"), F.length(r).cast("string"), F.lit("}"))
        return F.array_join(F.transform(F.split(t, _HEX), lambda part, k: F.concat(_runs(part), F.coalesce(_once(F.get(runs, k), sign), F.lit("")))), "")

    return F.coalesce(F.when(c.rlike(_HEX), hashes(c)).otherwise(_runs(c)), F.lit(NULL_MASK))


def _runs(c: Column) -> Column:
    """The runs of character classes of a value, all of them; null for null."""
    letters = string.ascii_uppercase + string.ascii_lowercase + string.digits + " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

    def general(t: Column) -> Column:
        wide = t
        for pattern, sign in ((r"\p{Lu}", "\u0001"), (r"\p{Ll}", "\u0002"), (r"\p{L}", "\u0003"), (r"\p{Nd}", "\u0004"), (r"[\x85\p{Z}]", "\u0005")):
            wide = F.regexp_replace(wide, pattern, sign)
        return F.when(t.rlike("[^\u0001-\u007f]"), wide).otherwise(t)

    m = _once(F.translate(c, letters, "\u0001" * 26 + "\u0002" * 26 + "\u0004" * 10 + "\u0005" * 10), general)
    return F.translate(F.regexp_replace(m, "([\u0001-\u0005])\\1+", "$1"), "\u0001\u0002\u0003\u0004\u0005", "Aax9_")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def is_missing(c: Column) -> Column:
    """Null, or one of ``MISSING`` whatever the case and the white space around it."""
    words = "|".join(re.escape(m) for m in MISSING if m)
    return c.isNull() | c.rlike(f"(?iu)^[{SPACE}]*({words})?[{SPACE}]*$")


def masked(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """``(load_no, column_name, value, n, mask)``: every distinct value of a load with its rows and its ``whole_mask``.

    All missing values of a load are null under ``(missing)``.  Rows with a null
    load count as a load of their own, null.  Rows are reduced to distinct
    values before anything is looked at, so each value is masked once a load.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)]))
    values = df.select(F.col(load).alias("load_no"), cells.alias("x")).groupBy("load_no", "x.k", "x.value").agg(F.count(F.lit(1)).alias("n"))
    known = values.select("load_no", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1).alias("column_name"), F.when(~is_missing(F.col("value")), F.col("value")).alias("value"), "n")
    return known.withColumn("mask", F.when(F.col("value").isNull(), MISSING_MASK).otherwise(whole_mask(F.col("value"))))


def classified(values: DataFrame, expectations: DataFrame) -> DataFrame:
    """``masked`` values with ``kind`` (missing, valid, outside, invalid), ``numeric`` and ``valid``, by which shares of valid values are followed: the value, or the band of a number.

    ``expectations(column_name, allowed_values, min_value, max_value)`` is a
    table of a row a column; where it has none, or a row without values and
    bounds, all three are null.  The mask decides first: a value under none of
    the masks of the allowed values, or of a plain number, is invalid.
    """
    e = F.broadcast(expectations.select("column_name", F.split("allowed_values", r"\|").alias("allowed"), "min_value", "max_value"))
    bounded = F.col("min_value").isNotNull() | F.col("max_value").isNotNull()
    masks = F.coalesce(F.transform("allowed", whole_mask), F.when(bounded, F.array(F.lit("9"))))
    e = e.withColumn("masks", masks)
    number = F.col("value").rlike("^(0|[1-9][0-9]*)\\z")
    inside = F.when(number, F.expr("try_cast(value as decimal(38,0))")).between(F.col("min_value"), F.col("max_value"))
    kind = (
        F.when(F.col("masks").isNull(), None)
        .when(F.col("mask") == MISSING_MASK, "missing")
        .when(~F.array_contains("masks", F.col("mask")), "invalid")
        .when(F.col("allowed").isNotNull(), F.when(F.array_contains("allowed", F.col("value")), "valid").otherwise("invalid"))
        .when(~number, "invalid")
        .otherwise(F.when(F.coalesce(inside, F.lit(False)), "valid").otherwise("outside"))
    )
    numeric = F.when(F.col("masks").isNotNull(), F.col("allowed").isNull())
    out = values.join(e, "column_name", "left").withColumns({"kind": kind, "numeric": numeric})
    return out.select(*values.columns, "kind", "numeric", F.when(F.col("kind") == "valid", F.when(F.col("numeric"), band(F.col("value"))).otherwise(F.col("value"))).alias("valid"))


def band(value: Column) -> Column:
    """The band in which a number's share is followed: below 512, 512, 513-1023, 1024, above."""
    n = value.try_cast("decimal(38,0)")
    return F.when(n < 512, "<512").when(n == 512, "512").when(n < 1024, "513-1023").when(n == 1024, "1024").otherwise(">1024")


def findings(
    kinds: DataFrame,
    missing_change: float = 0.10,
    invalid_share: float = 0.05,
    outside_share: float = 0.02,
    shift: float = 0.25,
    new_share: float = 0.03,
) -> DataFrame:
    """``(load_no, column_name, finding)`` from ``classified`` rows of the columns that something is expected of.

    ``missing``, ``invalid``, ``range``, ``shift`` and ``new_value`` as their thresholds say; the load before is the one
    next below in number, and the first load has none.  A load without valid values has no shares, so neither it nor the
    load after it shifts.
    """
    cells = kinds.where("kind is not null and load_no is not null").groupBy("load_no", "column_name", "kind", "numeric", "valid").agg(F.sum("n").alias("n"))
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    loads = cells.groupBy("column_name", "load_no").agg(
        F.first("numeric").alias("numeric"), F.sum("n").alias("rows"), part("missing").alias("missing"), part("invalid").alias("invalid"), part("outside").alias("outside"), part("valid").alias("valid")
    )
    order = Window.partitionBy("column_name").orderBy("load_no")  # a row a load
    loads = loads.select(
        "column_name",
        "load_no",
        "numeric",
        "rows",
        "valid",
        (F.col("missing") / F.col("rows")).alias("missing"),
        (F.col("invalid") / F.col("rows")).alias("invalid"),
        (F.col("outside") / F.col("rows")).alias("outside"),
    ).withColumns({"missing_before": F.lag("missing").over(order), "valid_before": F.lag("valid").over(order), "no": F.row_number().over(order)})
    # Valid values a load: their number is bounded by the expectations.
    shares = cells.where("kind = 'valid'").groupBy("column_name", "load_no", "valid").agg(F.sum("n").alias("n")).withColumnRenamed("valid", "v")
    base = loads.select("column_name", "load_no", "no", "valid")
    now = shares.join(base, ["column_name", "load_no"]).select("column_name", "no", "v", (F.col("n") / F.col("valid")).alias("share"))
    before = now.select("column_name", (F.col("no") + 1).alias("no"), "v", F.col("share").alias("share_before"))
    moved = (
        now.join(before, ["column_name", "no", "v"], "full")
        .groupBy("column_name", "no")
        .agg((F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("share_before", F.lit(0.0)))) / 2).alias("shift"))
    )
    seen = Window.partitionBy("column_name", "v").orderBy("no")
    fresh = now.withColumn("turn", F.row_number().over(seen)).where((F.col("turn") == 1) & (F.col("no") > 1) & (F.col("share") >= new_share)).select("column_name", "no").distinct().withColumn("new", F.lit(True))
    all_ = loads.join(moved, ["column_name", "no"], "left").join(fresh, ["column_name", "no"], "left")
    # Shares are compared with a margin for rounding, so that a share that equals a threshold is not above it.
    above = lambda c, t: F.col(c) > t + 1e-12
    found = F.array(
        F.when(F.abs(F.col("missing") - F.col("missing_before")) > missing_change + 1e-12, "missing"),
        F.when(above("invalid", invalid_share), "invalid"),
        F.when(F.col("numeric") & above("outside", outside_share), "range"),
        F.when((F.col("no") > 1) & (F.col("valid") > 0) & (F.col("valid_before") > 0) & above("shift", shift), "shift"),
        F.when(~F.col("numeric") & F.col("new"), "new_value"),
    )
    return all_.select("load_no", "column_name", F.explode(found).alias("finding")).where("finding is not null")


def mask_counts(values: DataFrame) -> DataFrame:
    """``(load_no, column_name, mask, n, distinct_values, lo, hi, lo_n, hi_n)`` from ``masked`` values, and what ``classified`` made of them: the rows of a load and column under each mask.

    Distinct values are counted exactly, missing ones don't count as such;
    ``lo`` and ``hi`` are the ends in string order, ``lo_n`` and ``hi_n`` those of
    numbers up to 64 bits.
    """
    number = F.when(F.col("value").rlike(r"^[0-9]+\z"), F.expr("try_cast(value as bigint)"))
    keys = ["load_no", "column_name", "mask", *[c for c in ("kind", "numeric", "valid") if c in values.columns]]
    return values.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("value").alias("distinct_values"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(number).alias("lo_n"), F.max(number).alias("hi_n")
    )


def with_dominance(masks: DataFrame, dominant_share: float) -> DataFrame:
    """``mask_counts`` with ``dominant``: whether ``dominant_share`` of the column's non-missing rows over all loads bear the mask.

    A column of free text has as many masks as values, so sums are joined back and no task holds a column.
    """
    there = masks.where(F.col("mask") != MISSING_MASK)
    of_mask = there.groupBy("column_name", "mask").agg(F.sum("n").alias("__m"))
    of_column = there.groupBy("column_name").agg(F.sum("n").alias("__c"))  # a row a column
    often = of_mask.join(F.broadcast(of_column), "column_name").where(F.col("__m") / F.col("__c") >= dominant_share).select("column_name", "mask", F.lit(True).alias("dominant"))
    return masks.join(often, ["column_name", "mask"], "left").withColumn("dominant", F.coalesce("dominant", F.lit(False)))


def rare_masks(df: DataFrame, load: str, columns: Sequence[str], scratch: Scratch, dominant_share: float = 0.01) -> DataFrame:
    """``(load_no, column_name, mask, rows, distinct_values, example)``: what of each load and column stands under masks that are not dominant; the example is the least value."""
    masks = scratch.save(mask_counts(masked(df, load, columns)), "masks")
    rare = with_dominance(masks, dominant_share).where((F.col("mask") != MISSING_MASK) & ~F.col("dominant"))
    return rare.select("load_no", "column_name", "mask", F.col("n").alias("rows"), "distinct_values", F.col("lo").alias("example"))


def column_profile(df: DataFrame, load: str, columns: Sequence[str], scratch: Scratch, expectations: DataFrame | None = None, dominant_share: float = 0.01) -> DataFrame:
    """A row a load and column: rows, missing share, distinct values, range, masks, dominant and rare ones, divergence, findings.

    One reading of the table, reduced to distinct values and then to counts a
    (load, column, mask).  ``distinct_values`` is exact, the range is that of the
    values in string order and, for values that are plain numbers of up to 64
    bits, in ``min_number`` and ``max_number``.  Masks are those of whole values.  A
    mask is *dominant* if ``dominant_share`` of the column's non-missing rows
    over all loads bear it; ``rare_share`` is the share of a load's non-missing
    rows under other masks, ``rare_example`` the commonest of these masks.
    ``divergence`` is half the sum of absolute differences of mask shares from
    the load before.  ``findings`` joins what ``findings`` says in alphabetical order; it is
    null where nothing is expected of the column.  An empty table has no profile.
    """
    names = [c for c in columns if c != load]
    values = masked(df, load, names)
    if expectations is not None:
        values = classified(values, expectations)
    # Small beside the table and read several times from here on.
    counts = scratch.save(mask_counts(values), "masks")
    masks = counts.groupBy("load_no", "column_name", "mask").agg(
        F.sum("n").alias("n"), F.sum("distinct_values").alias("distinct_values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_n").alias("lo_n"), F.max("hi_n").alias("hi_n")
    )
    there = F.col("mask") != MISSING_MASK
    marked = with_dominance(masks, dominant_share)
    rare = there & ~F.col("dominant")
    per = marked.groupBy("load_no", "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(there, F.col("n")).otherwise(0)).alias("present"),
        F.sum("distinct_values").alias("distinct_values"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
        F.min(F.when(F.col("mask") == "9", F.col("lo_n"))).alias("min_number"),
        F.max(F.when(F.col("mask") == "9", F.col("hi_n"))).alias("max_number"),
        F.count_if(there).alias("masks"),
        F.max_by(F.when(there, F.col("mask")), F.when(there, F.struct("n", "mask"))).alias("top_mask"),
        F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rare"),
        F.max_by(F.when(rare, F.col("mask")), F.when(rare, F.struct("n", "mask"))).alias("rare_example"),
    )
    order = Window.partitionBy("column_name").orderBy("load_no")  # a row a load
    per = scratch.save(per.withColumn("no", F.row_number().over(order)), "loads")
    now = masks.where(there).join(F.broadcast(per.select(F.col("load_no").alias("l"), F.col("column_name").alias("c"), "no", "present")), F.col("load_no").eqNullSafe(F.col("l")) & (F.col("column_name") == F.col("c")))
    now = now.select("column_name", "no", "mask", (F.col("n") / F.col("present")).alias("share"))
    before = now.select("column_name", (F.col("no") + 1).alias("no"), "mask", F.col("share").alias("was"))
    moved = now.join(before, ["column_name", "no", "mask"], "full").groupBy("column_name", "no").agg((F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("divergence"))
    out = per.join(moved, ["column_name", "no"], "left")
    if expectations is None:
        out = out.withColumn("findings", F.lit(None).cast("string"))
    else:
        said = findings(counts).groupBy("load_no", "column_name").agg(F.array_join(F.array_sort(F.collect_list("finding")), "+").alias("said"))
        expected = counts.where("numeric is not null").select("column_name", F.lit(True).alias("expected")).distinct()
        out = out.join(said, ["load_no", "column_name"], "left").join(expected, "column_name", "left").withColumn("findings", F.when(F.col("expected"), F.coalesce("said", F.lit(""))))
    return out.select(
        "load_no",
        "column_name",
        "rows",
        F.round(1 - F.col("present") / F.col("rows"), 6).alias("missing_share"),
        "distinct_values",
        "min_value",
        "max_value",
        "min_number",
        "max_number",
        "masks",
        "top_mask",
        F.round(F.when(F.col("present") > 0, F.col("rare") / F.col("present")).otherwise(0.0), 6).alias("rare_share"),
        "rare_example",
        F.when(F.col("no") > 1, F.round("divergence", 6)).alias("divergence"),
        "findings",
    )
