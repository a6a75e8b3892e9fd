"""Gates as tables of violations: an empty table passes, and what can't be shown to hold doesn't."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.catalog import violations
from corpusloom.operators.contracts import ContractError

ISOLATION = "key string, problem string, values long, rows long, examples string"


def isolation_gate(df: DataFrame, split: str, required: Sequence[str], optional: Sequence[str] = (), examples: int = 3) -> DataFrame:
    """``(key, problem, values, rows, examples)``: why the table can't be shown to keep every key within one split.

    A required key whose column is *missing*, or that is null or blank
    somewhere (*blank*), fails; so does a value of any key that stands in two
    splits (*crossing*).  Optional keys may be missing and blank.  A null split is a split of its own.
    """
    spark = df.sparkSession
    gone = spark.createDataFrame([(k, "missing", None, None, None) for k in required if k not in df.columns], ISOLATION)
    keys = [k for k in (*required, *optional) if k in df.columns]
    if not keys:
        return gone
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v"), F.lit(k in required).alias("required")) for k in keys]))
    rows = df.select(F.coalesce(F.col(split).cast("string"), F.lit("(null)")).alias("s"), cells.alias("x")).select("s", "x.key", "x.v", "x.required")
    empty = F.coalesce(strip(F.col("v")), F.lit("")) == ""
    per = rows.groupBy("key", "required", F.when(~empty, F.col("v")).alias("v")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n"))
    blank = per.where("v is null and required").select("key", F.lit("blank").alias("problem"), F.lit(None).cast("long").alias("values"), F.col("n").alias("rows"), F.lit(None).cast("string").alias("examples"))
    crossing = per.where("v is not null and lo < hi")
    counted = crossing.groupBy("key").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    first = crossing.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("v"))).where(F.col("r") <= examples)  # Spark keeps the first few of each task
    shown = first.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("examples"))
    return gone.unionByName(blank).unionByName(counted.join(shown, "key").select("key", F.lit("crossing").alias("problem"), "values", "rows", "examples"))


def require_isolation(df: DataFrame, split: str, required: Sequence[str], optional: Sequence[str] = ()) -> None:
    """Raise ``ContractError`` with what ``isolation_gate`` found, if anything."""
    bad = isolation_gate(df, split, required, optional).orderBy("key", "problem").collect()  # two rows a key at most
    if bad:
        raise ContractError("; ".join(f"{r['key']}: {r['problem']}" + (f" ({r['values']} values in {r['rows']} rows, e.g. {r['examples']})" if r["problem"] == "crossing" else "") for r in bad))


def row_semantics(df: DataFrame, cells: Mapping[str, tuple[int, str, str]], splits: Sequence[str], extent: int) -> DataFrame:
    """``(check, rows)`` of materialised rows: cell, split, geometry, hashes and paths."""
    known = F.lit(False)
    for cell, (label, model, kind) in cells.items():
        known = known | ((F.col("cell") == cell) & (F.col("label") == label) & (F.col("model") == model) & (F.col("gen_type") == kind))
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}\\z")
    path = F.col("materialized_path")
    return violations(
        df,
        {
            "cell": F.col("cell").isin(*cells),
            "cell says label, model and kind": known,
            "split": F.col("split").isin(*splits),
            "geometry": (F.col("decoded_width") == extent) & (F.col("decoded_height") == extent),
            "encoded hash": sha("encoded_sha256"),
            "pixel hash": sha("decoded_pixel_sha256_rgb"),
            "perceptual hash": F.col("decoded_phash_rgb").rlike("^[0-9a-f]{16}\\z"),
            "path": ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."),
        },
    )


def candidate_checks(df: DataFrame, index: str, index_hash: Column, repository: str, revision: str) -> DataFrame:
    """``(check, rows)`` of selected candidates: ids, indexes, their hashes, labels, source, and how many ids and indexes come again."""
    one = violations(
        df,
        {
            "id": F.coalesce(strip(F.col("selection_id")), F.lit("")) != "",
            "index": F.col(index).rlike("^(0|[1-9][0-9]*)\\z"),
            "index hash": F.col("source_index_hash") == index_hash,
            "repository": F.col("repository_id") == repository,
            "revision": F.col("revision") == revision,
            "label": F.col("label").isin(0, 1),
        },
    )
    again = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(name).alias("check"), "rows")
    return one.union(again("selection_id", "ids again")).union(again(index, "indexes again"))


def contexts(df: DataFrame, label: str, generator: str, columns: Sequence[str]) -> DataFrame:
    """``(generator, n, <column>...)`` of the fakes: the one value of each context column, null where a generator has several, a null or a blank one."""
    v = lambda c: strip(F.col(c).cast("string"))
    bad = lambda c: F.count_if(F.coalesce(v(c), F.lit("")) == "")
    return df.where(F.col(label) == 1).groupBy(generator).agg(F.count(F.lit(1)).alias("n"), *[F.when((F.min(v(c)) == F.max(v(c))) & (bad(c) == 0), F.min(v(c))).alias(c) for c in columns])


def plan_problems(selected: DataFrame, plan: DataFrame, shard: str, count: str, order: str) -> DataFrame:
    """``(check, rows)``: shards whose planned count isn't what is selected of them, ids selected twice, and places that the order 1, 2, ... skips or repeats."""
    per = selected.groupBy(shard).agg(F.count(F.lit(1)).alias("__n"))
    counts = per.join(plan.select(shard, F.col(count).alias("__p")), shard, "full").agg(F.count_if(~F.col("__n").eqNullSafe(F.col("__p"))).alias("rows")).select(F.lit("shard counts").alias("check"), "rows")
    twice = selected.groupBy("selection_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit("ids again").alias("check"), "rows")
    # n distinct whole numbers between 1 and n are 1 to n.
    n = plan.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col(order) >= 1, F.col(order))).alias("d"), F.max(order).alias("m"))
    places = n.select(F.lit("order").alias("check"), F.greatest(F.col("n") - F.col("d"), F.coalesce(F.col("m"), F.lit(0)) - F.col("n"), F.lit(0)).cast("long").alias("rows"))
    return counts.union(twice).union(places)


def row_counts(df: DataFrame, split: str) -> DataFrame:
    """``(split, rows)`` with the total under null: what a launch records of its manifest beside the file's hash."""
    return df.rollup(split).agg(F.count(F.lit(1)).alias("rows"), F.grouping(split).alias("total")).select(F.when(F.col("total") == 0, F.coalesce(F.col(split), F.lit("(null)"))).alias("split"), "rows")


def dry_run(df: DataFrame, contract, split: str) -> DataFrame:
    """``(check, rows)``: the violations of a contract and the rows a split, without reading anything but the manifest."""
    return contract.report(df).select("check", "rows").unionByName(row_counts(df, split).select(F.concat(F.lit("rows of "), F.coalesce("split", F.lit("all"))).alias("check"), "rows"))


def check_record(record: Mapping, rules: Mapping[str, object]) -> list[str]:
    """What an evidence object lacks: each rule names a field (dots lead into objects) and the value, the set of values, or the test that it must meet."""
    out = []
    for path, want in rules.items():
        value: object = record
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        ok = want(value) if callable(want) else value in want if isinstance(want, (set, frozenset)) and not isinstance(value, (list, dict)) else value == want and type(value) is type(want)
        if not ok:
            out.append(f"{path} is {value!r}")
    return out
