"""Catalogue statistics: frequencies, completeness, duplicates, gates, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalars import present


def _n() -> Column:
    return F.count(F.lit(1))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: rows a label, fractions, their difference and minority to majority; null ratios if there is no labelled row."""
    a = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), _n().alias("rows"))
    n = F.nullif(F.col("n0") + F.col("n1"), F.lit(0))
    return a.select(
        "rows", "n0", "n1", (F.col("n0") / n).alias("share0"), (F.col("n1") / n).alias("share1"), (F.abs(F.col("n0") - F.col("n1")) / n).alias("difference"),
        (F.least("n0", "n1") / F.nullif(F.greatest("n0", "n1"), F.lit(0))).alias("minority_to_majority"),
    )


def gates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``(gate, accepted, rejected)`` for each condition and for all of them; a null condition rejects."""
    named = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    whole = F.lit(True)
    for c in named.values():
        whole = whole & c
    named["all"] = whole
    one = df.agg(_n().alias("rows"), *[F.count_if(c).alias(f"g_{k}") for k, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(f"g_{k}").alias("accepted"), (F.col("rows") - F.col(f"g_{k}")).alias("rejected")) for k in named])).alias("x")).select("x.*")


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, rows)`` with nulls and blanks as ``(missing)``."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), present(F.col(c)).alias("value")) for c in columns]))
    return df.select(cells.alias("x")).groupBy("x.column_name", "x.value").agg(_n().alias("rows"))


def cell_counts(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows for every combination in each of the column sets, in one pass; columns outside a set are null and ``level`` numbers the sets."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    level = F.lit(-1)
    for k, s in enumerate(sets):
        bits = sum((c not in s) << (len(columns) - 1 - i) for i, c in enumerate(columns))
        level = F.when(F.grouping_id() == bits, k).otherwise(level)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(_n().alias("rows"), level.alias("level")).select("level", *columns, "rows")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, present, missing)``; blank counts as missing."""
    one = df.agg(_n().alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(f"c{k}") for k, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{k}").alias("present"), (F.col("rows") - F.col(f"c{k}")).alias("missing")) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[object]) -> DataFrame:
    """Rows a value of ``row``, one count column for each of ``values``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def duplicate_statistics(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row: distinct and repeated values of a key, rows in them and beyond the first, the largest group, values and rows that cross labels, blanks."""
    v = F.trim(F.col(key))
    rows = df.select(F.when(v != "", v).alias("k"), F.col(label).alias("l"))
    per = rows.groupBy("k").agg(_n().alias("n"), F.min("l").alias("lo"), F.max("l").alias("hi"))
    real, dup = F.col("k").isNotNull(), F.col("k").isNotNull() & (F.col("n") > 1)
    cross = dup & (F.col("lo") != F.col("hi"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(
        F.count_if(real).alias("distinct_values"), F.count_if(dup).alias("duplicate_values"), (total(dup) - F.count_if(dup)).alias("rows_beyond_first"), total(dup).alias("rows_in_duplicates"),
        F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("largest_group"), F.count_if(cross).alias("cross_label_values"), total(cross).alias("cross_label_rows"), total(~real).alias("blank_rows"),
    )


def joined_set(c: str) -> Column:
    """The distinct values of a group in order, joined by bars; meant for columns of few values."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")


def duplicate_groups(df: DataFrame, key: str, sets: Sequence[str]) -> DataFrame:
    """Every value of ``key`` with two rows or more: the rows and the joined sets of the named columns of few values."""
    return df.where(F.trim(F.col(key)) != "").groupBy(key).agg(_n().alias("rows"), *[joined_set(c).alias(f"{c}_set") for c in sets]).where("rows > 1")


def duplicate_signatures(df: DataFrame, key: str, sets: Sequence[str]) -> DataFrame:
    """How many duplicate groups have each signature (their size and joined sets)."""
    return duplicate_groups(df, key, sets).groupBy("rows", *[f"{c}_set" for c in sets]).agg(_n().alias("groups"))


def overlap_rows(df: DataFrame, key: str, split: str) -> DataFrame:
    """All rows whose key stands in more than one split; null keys never overlap."""
    crossing = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo < hi").select(key)
    return df.join(crossing, key, "left_semi")


def isolation_report(df: DataFrame, keys: Sequence[str], split: str, examples: int = 3) -> DataFrame:
    """``(key, crossing_values, examples)`` a key: how many values stand in several splits, with the first few in order."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys]))
    per = df.select(F.col(split).alias("s"), cells.alias("x")).where("x.v is not null").groupBy("x.key", "x.v").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    few = per.where("lo < hi")
    counted = few.groupBy("key").agg(_n().alias("crossing_values"))
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("v"))).where(F.col("r") <= examples).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("examples"))
    return df.sparkSession.createDataFrame([(k,) for k in keys], "key string").join(counted.join(first, "key"), "key", "left").select("key", F.coalesce("crossing_values", F.lit(0)).alias("crossing_values"), "examples")


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(_n().alias("rows"), F.count_distinct(label).alias("labels")).where("labels > 1")


def support_sets(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """The values of each column of few values a label, joined, and whether all labels have the same."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), present(F.col(c)).alias("value")) for c in columns]))
    per = df.select(F.col(label).alias("label"), cells.alias("x")).groupBy("label", "x.column_name").agg(F.array_join(F.array_sort(F.collect_set("x.value")), "|").alias("support"))
    same = per.groupBy("column_name").agg((F.min("support") == F.max("support")).alias("same"))
    return per.join(same, "column_name")


def reconcile(declared: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose declared and observed values differ or that only one side has; ``(key, declared, observed)``."""
    a, b = declared.select(key, F.col(value).alias("declared")), observed.select(key, F.col(value).alias("observed"))
    return a.join(b, key, "full").where(~F.col("declared").eqNullSafe(F.col("observed")))


def index_gaps(df: DataFrame, group: str, index: str) -> DataFrame:
    """Groups whose index is not 0, 1, 2, ... each once: rows, distinct, least, greatest, missing."""
    per = df.groupBy(group).agg(_n().alias("rows"), F.count_distinct(index).alias("distinct_indexes"), F.min(index).alias("least"), F.max(index).alias("greatest"))
    return per.where("least != 0 or greatest + 1 != rows or distinct_indexes != rows").withColumn("missing_indexes", F.col("greatest") + 1 - F.col("distinct_indexes"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on both sides, only left, only right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(check, rows)``: how many rows break each check; a check that is null is broken."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c_{k}") for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c_{k}").alias("rows")) for k in checks])).alias("x")).select("x.*")


def verified_identity(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(check, rows)``: rows of ``left`` that ``right`` lacks, and rows that differ in each column; nulls equal nulls."""
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    j = left.join(other, key, "left")
    found = F.col("__there").isNotNull()
    return violations(j, {"found": found} | {c: ~found | F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns})


def outside_requests(observed: DataFrame, index: str, offset: str, length: str) -> DataFrame:
    """Observations that don't lie in the range they were requested in; a null bound or index lies in none."""
    inside = (F.col(index) >= F.col(offset)) & (F.col(index) < F.col(offset) + F.col(length))
    return observed.where(~F.coalesce(inside, F.lit(False)))


def frame_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, column_name, left, right)``: every cell in which two tables with the same unique key differ; a missing row differs in all its cells."""
    columns = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    b = right.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("b"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a.{c}").alias("left"), F.col(f"b.{c}").alias("right")) for c in columns]))
    whole = a.join(b, key, "full").withColumn("x", cells)
    return whole.where(~F.col("x.left").eqNullSafe(F.col("x.right")) | F.col("a").isNull() | F.col("b").isNull()).select(key, "x.*")


def gate_reasons(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``(reasons, rows)``: rows by the gates that they fail, in order and joined by bars; the empty string for those that pass all."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in sorted(conditions.items())]
    return df.groupBy(F.concat_ws("|", *failed).alias("reasons")).agg(_n().alias("rows"))


def resolution_counts(df: DataFrame, cell: str, width: str, height: str) -> DataFrame:
    """``(cell, resolution, rows)`` and the rows of each resolution over all cells, under a null cell."""
    rows = df.select(F.col(cell).alias("cell"), F.concat_ws("x", F.col(width).cast("string"), F.col(height).cast("string")).alias("resolution"))
    return rows.groupingSets([[F.col("cell"), F.col("resolution")], [F.col("resolution")]], "cell", "resolution").agg(_n().alias("rows"), F.grouping("cell").alias("g")).select(F.when(F.col("g") == 0, F.coalesce("cell", F.lit("(null)"))).alias("cell"), "resolution", "rows")


def incomplete_parents(df: DataFrame, parent: str, cell: str, real: str, fakes: Sequence[str], good: Column) -> DataFrame:
    """``(parent, real_rows, fake_rows, fake_cells, bad_rows)`` of the parents that don't have exactly one good real row and one good row of each fake cell."""
    is_real = F.col(cell) == real
    per = df.groupBy(parent).agg(F.count_if(is_real & good).alias("real_rows"), F.count_if(~is_real).alias("fake_rows"), F.count_distinct(F.when(F.col(cell).isin(*fakes), F.col(cell))).alias("fake_cells"), F.count_if(~is_real & ~F.coalesce(good, F.lit(False))).alias("bad_rows"))
    return per.where((F.col("real_rows") != 1) | (F.col("fake_rows") != len(fakes)) | (F.col("fake_cells") != len(fakes)) | (F.col("bad_rows") > 0))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, rows, least, median, greatest)`` of a value; the exact median, nulls left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(_n().alias("rows"), F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("greatest"))


def compared_to(df: DataFrame, key: str, base: str, value: str) -> DataFrame:
    """``df`` with ``ratio``, the base key's value over the row's (a speed-up where values are times), and ``delta``, the row's less the base's; nulls without a base."""
    b = df.where(F.col(key) == base).agg(F.first(value).alias("__base"))  # one row
    return df.crossJoin(F.broadcast(b)).withColumns({"ratio": F.try_divide("__base", value), "delta": F.col(value) - F.col("__base")}).drop("__base")


def confusion_rates(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, actual, predicted, rows, rate)`` from ``tp, fp, fn, tn``: each row of the matrix sums to 1, or is null without rows."""
    cells = [(0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn")]
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("rows"), F.try_divide(F.col(c), F.col(c) + F.col(o)).alias("rate")) for a, p, c, o in cells])).alias("x")).select(*keys, "x.*")


def with_optional(runs: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """``runs`` with the value that ``results`` has for them, and ``missing`` where it has none."""
    found = results.select(key, F.col(value).alias("__v"), F.lit(True).alias("__there"))
    return runs.join(found, key, "left").select(*runs.columns, F.col("__v").alias(value), F.col("__there").isNull().alias("missing"))


def consistent_lookup(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, variants, <column>...)``: how many different combinations of the columns a key has over all rows, and the one where there is just one."""
    per = df.where(F.col(key).isNotNull()).select(key, F.struct(*columns).alias("v")).groupBy(key).agg(F.count_distinct("v").alias("variants"), F.min("v").alias("v"))
    return per.select(key, "variants", *[F.when(F.col("variants") == 1, F.col(f"v.{c}")).alias(c) for c in columns])


def lineage(left: DataFrame, right: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``left`` with columns (new name: column) of the row of ``right`` that has its key; a key that comes twice on either side, or has no partner, raises when it is read."""
    once = lambda df: df.groupBy(key).agg(_n().alias("__n"))
    other = right.select(key, *[F.col(c).alias(n) for n, c in columns.items()]).join(once(right).withColumnRenamed("__n", "__r"), key)
    j = left.join(once(left), key).join(other, key, "full")
    good = (F.col("__n") == 1) & (F.col("__r") == 1)
    return j.withColumn("__n", F.when(F.coalesce(good, F.lit(False)), 1).otherwise(F.raise_error(F.lit("rows don't pair one to one")))).where("__n = 1").select(*left.columns, *columns)
