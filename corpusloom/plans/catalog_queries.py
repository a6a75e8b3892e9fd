"""Catalogue statistics over the project's tables, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars
from corpusloom.functions.text import folded, stable_hash
from corpusloom.operators import catalog
from corpusloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space at either end, for DuckDB.
STRIP = r"regexp_replace({c}, '^[\s\x1c-\x1f\x85\p{{Z}}]+|[\s\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


def sql_strip(c: str) -> str:
    return STRIP.format(c=c)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_catalog").withColumn("label", F.when(F.col("label").isin("0", "1"), F.col("label").cast("int")))


_CATALOG = "(SELECT * REPLACE (CASE WHEN label IN ('0', '1') THEN label::INT END AS label) FROM source_catalog)"


@query(f"""
SELECT count(*) AS rows, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, round(count(*) FILTER (label = 0) / count(label), 6) AS share0,
  round(count(*) FILTER (label = 1) / count(label), 6) AS share1, round(abs(count(*) FILTER (label = 0) - count(*) FILTER (label = 1)) / count(label), 6) AS difference,
  round(least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) / greatest(count(*) FILTER (label = 0), count(*) FILTER (label = 1)), 6) AS minority_to_majority FROM {_CATALOG}""")
def catalog_class_balance(spark: SparkSession, d: str) -> DataFrame:
    return _round(catalog.class_balance(_catalog(spark, d), "label"), "share0", "share1", "difference", "minority_to_majority")


def _gates() -> dict[str, Column]:
    return {
        "exact_512": scalars.geometry(F.col("source_width"), F.col("source_height")) == "512x512",
        "png": F.col("format") == "PNG",
        "rgb": F.col("mode") == "RGB",
        "safe": scalars.tri_state(F.col("nsfw_flag")) == F.lit(False),
        "label": F.col("label").isNotNull(),
    }


@query(f"""
WITH g AS (SELECT coalesce(source_width = '512' AND source_height = '512', false) AS exact_512, coalesce(format = 'PNG', false) AS png, coalesce(mode = 'RGB', false) AS rgb,
  coalesce(lower({sql_strip("nsfw_flag")}) IN ('false', '0', 'no'), false) AS safe, label IS NOT NULL AS label FROM {_CATALOG}),
u AS (UNPIVOT (SELECT *, exact_512 AND png AND rgb AND safe AND label AS "all" FROM g) ON COLUMNS(*) INTO NAME gate VALUE ok)
SELECT gate, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM u GROUP BY gate""")
def catalog_quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gates(_catalog(spark, d), _gates())


@query(f"""
SELECT column_name, coalesce(nullif({sql_strip("v")}, ''), '(missing)') AS value, count(*) AS rows FROM (
  SELECT 'format' AS column_name, format AS v FROM source_catalog UNION ALL SELECT 'mode', mode FROM source_catalog UNION ALL SELECT 'real_source', real_source FROM source_catalog) GROUP BY 1, 2""")
def catalog_frequency(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frequencies(table(spark, d, "source_catalog"), ["format", "mode", "real_source"])


@query("""
SELECT CASE grouping(split, label, cell, official_coco_license_id) WHEN 3 THEN 0 WHEN 13 THEN 1 ELSE 2 END AS level, split, label, cell, official_coco_license_id, count(*) AS rows
FROM selection_catalog GROUP BY GROUPING SETS ((split, label), (cell), (label, official_coco_license_id))""")
def catalog_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.cell_counts(table(spark, d, "selection_catalog"), [("split", "label"), ("cell",), ("label", "official_coco_license_id")])


_COLUMNS = (
    "locator", "repository_id", "revision", "shard_path", "row_index", "image_name", "format", "source_width", "source_height", "mode", "model_name", "nsfw_flag", "prompt_hash", "prompt_present", "content_group_id",
    "real_source", "subset", "source_split", "label", "architecture", "load_no", "loaded_at",
)


@query("SELECT column_name, count(*) FILTER (trim(v) != '') AS present, count(*) - count(*) FILTER (trim(v) != '') AS missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS v FROM source_catalog" for c in _COLUMNS) + ") GROUP BY 1")
def catalog_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Of every column."""
    rows = table(spark, d, "source_catalog")
    return catalog.completeness(rows, rows.columns)


@query("SELECT generator, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1 FROM selection_catalog GROUP BY 1")
def catalog_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return catalog.crosstab(table(spark, d, "selection_catalog"), "generator", "label", [0, 1])


@query(f"""
WITH k AS (SELECT nullif(trim(content_group_id), '') AS k, count(*) AS n, min(label) AS lo, max(label) AS hi FROM {_CATALOG} GROUP BY 1)
SELECT count(k) AS distinct_values, count(*) FILTER (k IS NOT NULL AND n > 1) AS duplicate_values, coalesce(sum(n - 1) FILTER (k IS NOT NULL AND n > 1), 0) AS rows_beyond_first,
  coalesce(sum(n) FILTER (k IS NOT NULL AND n > 1), 0) AS rows_in_duplicates, coalesce(max(n) FILTER (k IS NOT NULL), 0) AS largest_group,
  count(*) FILTER (k IS NOT NULL AND n > 1 AND lo != hi) AS cross_label_values, coalesce(sum(n) FILTER (k IS NOT NULL AND n > 1 AND lo != hi), 0) AS cross_label_rows, coalesce(sum(n) FILTER (k IS NULL), 0) AS blank_rows FROM k""")
def duplicate_statistics(spark: SparkSession, d: str) -> DataFrame:
    return catalog.duplicate_statistics(_catalog(spark, d), "content_group_id", "label")


_GROUPS = "SELECT content_group_id, count(*) AS rows, string_agg(DISTINCT subset, '|' ORDER BY subset) AS subset_set, coalesce(string_agg(DISTINCT label::VARCHAR, '|' ORDER BY label::VARCHAR), '') AS label_set FROM source_catalog WHERE trim(content_group_id) != '' GROUP BY 1 HAVING count(*) > 1"


@query(_GROUPS)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return catalog.duplicate_groups(table(spark, d, "source_catalog"), "content_group_id", ["subset", "label"])


@query(f"SELECT rows, subset_set, label_set, count(*) AS groups FROM ({_GROUPS}) GROUP BY 1, 2, 3")
def duplicate_signatures(spark: SparkSession, d: str) -> DataFrame:
    return catalog.duplicate_signatures(table(spark, d, "source_catalog"), "content_group_id", ["subset", "label"])


def _highres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "highres_manifest").withColumn("split", folded(F.col("split")))


_HIGHRES = f"(SELECT * REPLACE (lower({sql_strip('split')}) AS split) FROM highres_manifest)"


@query(f"SELECT source_id, group_id, split FROM {_HIGHRES} WHERE group_id IN (SELECT group_id FROM {_HIGHRES} GROUP BY 1 HAVING min(split) < max(split))")
def split_overlap_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overlap_rows(_highres(spark, d).select("source_id", "group_id", "split"), "group_id", "split")


@query(f"""
WITH c AS (SELECT 'group_id' AS key, group_id AS v, split FROM {_HIGHRES} UNION ALL SELECT 'pixel_sha256', pixel_sha256, split FROM {_HIGHRES} UNION ALL SELECT 'path', path, split FROM {_HIGHRES}),
x AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY v) AS r FROM c WHERE v IS NOT NULL GROUP BY key, v HAVING min(split) < max(split))
SELECT k.key, coalesce(n, 0) AS crossing_values, examples FROM (VALUES ('group_id'), ('pixel_sha256'), ('path')) k(key)
LEFT JOIN (SELECT key, count(*) AS n, string_agg(v, '|' ORDER BY v) FILTER (r <= 3) AS examples FROM x GROUP BY 1) USING (key)""")
def split_isolation(spark: SparkSession, d: str) -> DataFrame:
    return catalog.isolation_report(_highres(spark, d), ["group_id", "pixel_sha256", "path"], "split")


@query("SELECT content_group_id, count(*) AS rows, count(DISTINCT label) AS labels FROM source_catalog WHERE content_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1")
def cross_label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.conflicts(table(spark, d, "source_catalog"), "content_group_id", "label")


@query(f"""
WITH c AS (SELECT label, 'decoded_format' AS column_name, coalesce(nullif({sql_strip("decoded_format")}, ''), '(missing)') AS v FROM training_manifest UNION ALL
  SELECT label, 'decoded_mode', coalesce(nullif({sql_strip("decoded_mode")}, ''), '(missing)') FROM training_manifest),
s AS (SELECT label, column_name, string_agg(DISTINCT v, '|' ORDER BY v) AS support FROM c GROUP BY 1, 2)
SELECT label, column_name, support, same FROM s JOIN (SELECT column_name, min(support) = max(support) AS same FROM s GROUP BY 1) USING (column_name)""")
def label_support_sets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.support_sets(table(spark, d, "training_manifest"), "label", ["decoded_format", "decoded_mode"])


@query("SELECT shard_path, max(row_index) + 1 AS declared, count(*) AS observed FROM source_catalog GROUP BY 1 HAVING max(row_index) + 1 != count(*)")
def shard_reconcile(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "source_catalog").groupBy("shard_path").agg((F.max("row_index") + 1).alias("declared_rows"), F.count(F.lit(1)).alias("rows"))
    return catalog.reconcile(per.select("shard_path", F.col("declared_rows").alias("n")), per.select("shard_path", F.col("rows").alias("n")), "shard_path", "n")


@query("""
SELECT shard_path, count(*) AS rows, count(DISTINCT row_index) AS distinct_indexes, min(row_index) AS least, max(row_index) AS greatest, max(row_index) + 1 - count(DISTINCT row_index) AS missing_indexes
FROM source_catalog GROUP BY 1 HAVING min(row_index) != 0 OR max(row_index) + 1 != count(*) OR count(DISTINCT row_index) != count(*)""")
def row_index_gaps(spark: SparkSession, d: str) -> DataFrame:
    return catalog.index_gaps(table(spark, d, "source_catalog"), "shard_path", "row_index")


@query("""
SELECT cell, a.n AS declared, b.n AS observed FROM (SELECT cell, count(DISTINCT selection_id) AS n FROM selection_catalog GROUP BY 1) a
FULL JOIN (SELECT cell, count(DISTINCT selection_id) AS n FROM training_manifest GROUP BY 1) b USING (cell) WHERE a.n IS DISTINCT FROM b.n""")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t: table(spark, d, t).groupBy("cell").agg(F.count_distinct("selection_id").alias("n"))
    return catalog.reconcile(n("selection_catalog"), n("training_manifest"), "cell", "n")


@query("""
SELECT unnest(['locator', 'revision', 'prompt_hash', 'label', 'row_index']) AS "check", unnest([
  count(*) FILTER (NOT coalesce(locator = repository_id || '@' || revision || ':' || shard_path || ':' || row_index::VARCHAR, false)), count(*) FILTER (NOT coalesce(regexp_full_match(revision, '[0-9a-f]{40}'), false)),
  count(*) FILTER (NOT coalesce(regexp_full_match(prompt_hash, '[0-9a-f]{64}'), false)), count(*) FILTER (NOT coalesce(label IN ('0', '1'), false)), count(*) FILTER (NOT coalesce(row_index >= 0, false))]) AS rows FROM source_catalog""")
def row_provenance_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.violations(
        table(spark, d, "source_catalog"),
        {
            "locator": F.col("locator") == scalars.locator(F.col("repository_id"), F.col("revision"), F.col("shard_path"), F.col("row_index")),
            "revision": F.col("revision").rlike("^[0-9a-f]{40}\\z"),
            "prompt_hash": F.col("prompt_hash").rlike("^[0-9a-f]{64}\\z"),
            "label": F.col("label").isin("0", "1"),
            "row_index": F.col("row_index") >= 0,
        },
    )


@query("""
SELECT count(*) FILTER (a.selection_id IS NOT NULL AND b.selection_id IS NOT NULL) AS "both", count(*) FILTER (b.selection_id IS NULL) AS only_left, count(*) FILTER (a.selection_id IS NULL) AS only_right
FROM (SELECT DISTINCT selection_id FROM selection_catalog) a FULL JOIN (SELECT DISTINCT selection_id FROM training_manifest) b ON a.selection_id = b.selection_id""")
def coverage_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(table(spark, d, "selection_catalog"), table(spark, d, "training_manifest"), "selection_id")


_SAME = ("label", "model", "gen_type", "cell", "parent_coco_image_id")


@query(
    "WITH a AS (SELECT selection_id, "
    + ", ".join(f"min({c}) AS {c}" for c in _SAME)
    + " FROM selection_catalog GROUP BY 1), b AS (SELECT selection_id, "
    + ", ".join(f"min({c}) AS {c}" for c in _SAME)
    + ' FROM training_manifest GROUP BY 1), j AS (SELECT a.*, '
    + ", ".join(f"b.{c} AS {c}_b" for c in _SAME)
    + ' FROM a JOIN b USING (selection_id)) '
    + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER ({c} IS DISTINCT FROM {c}_b) AS rows FROM j" for c in _SAME)
)
def one_to_one_equal(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, end: table(spark, d, t).groupBy("selection_id").agg(*[F.min(c).alias(c + end) for c in _SAME])
    return catalog.violations(one("selection_catalog", "").join(one("training_manifest", "_b"), "selection_id"), {c: F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in _SAME})


@query("""
SELECT locator, sha256('image-catalog:' || coalesce(image_name, '')) AS name_hash, locator = repository_id || '@' || revision || ':' || shard_path || ':' || row_index::VARCHAR AS stable,
  CASE WHEN regexp_full_match(source_width, '[1-9][0-9]*') AND regexp_full_match(source_height, '[1-9][0-9]*') THEN source_width || 'x' || source_height ELSE '(invalid)' END AS geometry,
  regexp_replace(lower(model_name), '[^a-z0-9]+', '', 'g') AS model_key FROM source_catalog""")
def locator_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_catalog")
    return t.select(
        "locator",
        stable_hash(F.lit("image-catalog"), F.col("image_name")).alias("name_hash"),
        (F.col("locator") == scalars.locator(F.col("repository_id"), F.col("revision"), F.col("shard_path"), F.col("row_index"))).alias("stable"),
        F.when(F.col("source_width").isNull() | F.col("source_height").isNull(), "(invalid)").otherwise(scalars.geometry(F.col("source_width"), F.col("source_height"))).alias("geometry"),
        scalars.alias_key(F.col("model_name")).alias("model_key"),
    )


@query(r"""
SELECT selection_id, batch_no, TRY_CAST(nullif(regexp_extract(image_path_basename, '^([1-9][0-9]*)_([1-9][0-9]*)\.jpg$', 1), '') AS BIGINT) AS parent,
  TRY_CAST(nullif(regexp_extract(image_path_basename, '^([1-9][0-9]*)_([1-9][0-9]*)\.jpg$', 2), '') AS BIGINT) AS caption FROM selection_catalog""")
def parse_lineage(spark: SparkSession, d: str) -> DataFrame:
    parent, caption = scalars.pair_of_name(F.col("image_path_basename"))
    return table(spark, d, "selection_catalog").select("selection_id", "batch_no", parent.alias("parent"), caption.alias("caption"))


_KINDS = {"JPEG": "is_jpeg", "PNG": "is_png", "WEBP": "is_webp"}
_MODES = {"RGB": "is_rgb", "L": "is_grey", "RGBA": "is_rgba"}


@query(
    "SELECT selection_id, loaded_at, round(ln(1 + decoded_width), 6) AS log_width, round(ln(1 + decoded_height), 6) AS log_height, round(ln(1 + encoded_size_bytes), 6) AS log_bytes, round(decoded_width / greatest(decoded_height, 1), 6) AS ratio, "
    + ", ".join(f"({c} = '{v}')::INT AS {n}" for c, of in (("f", _KINDS), ("m", _MODES)) for v, n in of.items())
    + ", ".join(["", *(f"({c} NOT IN ({', '.join(repr(v) for v in of)}))::INT AS {n}" for c, of, n in (("f", _KINDS, "is_other_format"), ("m", _MODES, "is_other_mode")))])
    + " FROM (SELECT *, coalesce(upper(decoded_format), 'OTHER') AS f, coalesce(upper(decoded_mode), '') AS m FROM training_manifest)"
)
def file_features(spark: SparkSession, d: str) -> DataFrame:
    """The twelve control features of a file: logarithms of its extent and bytes, its ratio, and one-hot format and mode; nothing of what it shows."""
    w, h = F.col("decoded_width"), F.col("decoded_height")
    f, m = F.coalesce(F.upper("decoded_format"), F.lit("OTHER")), F.coalesce(F.upper("decoded_mode"), F.lit(""))
    hot = [(c == v).cast("int").alias(n) for c, of in ((f, _KINDS), (m, _MODES)) for v, n in of.items()]
    return table(spark, d, "training_manifest").select(
        "selection_id", "loaded_at", F.round(F.log1p(w), 6).alias("log_width"), F.round(F.log1p(h), 6).alias("log_height"), F.round(F.log1p("encoded_size_bytes"), 6).alias("log_bytes"), F.round(w / F.greatest(h, F.lit(1)), 6).alias("ratio"),
        *hot, (~f.isin(*_KINDS)).cast("int").alias("is_other_format"), (~m.isin(*_MODES)).cast("int").alias("is_other_mode"),
    )
