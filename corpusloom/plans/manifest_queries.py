"""Projections, parsers, gates and the selection build over the project's tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars
from corpusloom.functions.prefix import hash_bucket, ranked
from corpusloom.functions.text import folded, stable_hash
from corpusloom.operators import catalog, gates, manifests, selection
from corpusloom.operators.contracts import TableContract
from corpusloom.plans.catalog_queries import sql_strip
from corpusloom.sources.tables import table
from corpusloom.streaming import increments

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The five cells with their label, model and kind.
CELLS = {
    "real_coco": (0, "COCO", "T2I"), "fake_sdxl_t2i": (1, "SD_XL", "T2I"), "fake_sdxl_i2i": (1, "SD_XL", "I2I"), "fake_sdxl_ti2i": (1, "SD_XL", "TI2I"), "fake_dalle3_t2i": (1, "Dalle3", "T2I"),
}
SPLITS = ("train", "val", "test")
_NAMES = ", ".join(f"'{c}'" for c in CELLS)
_CELL = "CASE " + " ".join(f"WHEN label = {l} AND model = '{m}' AND gen_type = '{k}' THEN '{c}'" for c, (l, m, k) in CELLS.items()) + " END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _select(*parts: tuple[str, str], source: str) -> str:
    """One row a check, of counts over the same source."""
    return f"SELECT unnest([{', '.join(repr(k) for k, _ in parts)}]) AS \"check\", unnest([{', '.join(c for _, c in parts)}]) AS rows FROM {source}"


_REQUIRED, _OPTIONAL = ("group_id", "leakage_group", "source_id", "sha256", "phash"), ("caption",)
_ISOLATION_CELLS = " UNION ALL ".join(f"SELECT '{k}' AS key, {k in _REQUIRED} AS required, {k} AS v, coalesce(split, '(null)') AS s FROM highres_manifest" for k in (*_REQUIRED, *_OPTIONAL))


@query(f"""
WITH c AS ({_ISOLATION_CELLS}), x AS (SELECT key, required, CASE WHEN {sql_strip("v")} != '' THEN v END AS v, s FROM c),
g AS (SELECT key, required, v, count(*) AS n, min(s) < max(s) AS crosses FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v) AS r FROM g WHERE v IS NOT NULL AND crosses)
SELECT 'split_key' AS key, 'missing' AS problem, NULL::BIGINT AS values, NULL::BIGINT AS rows, NULL AS examples
UNION ALL SELECT key, 'blank', NULL, n, NULL FROM g WHERE v IS NULL AND required
UNION ALL SELECT key, 'crossing', count(*), sum(n)::BIGINT, string_agg(v, '|' ORDER BY v) FILTER (r <= 3) FROM r GROUP BY 1""")
def isolation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why the manifest as delivered can't be shown to keep its keys within one split; the table lacks the last required key."""
    return gates.isolation_gate(table(spark, d, "highres_manifest"), "split", (*_REQUIRED, "split_key"), _OPTIONAL)


@query(_select(
    ("cell", f"count(*) FILTER (NOT coalesce(cell IN ({_NAMES}), false))"), ("cell says label, model and kind", f"count(*) FILTER (NOT coalesce(cell = {_CELL}, false))"),
    ("split", "count(*) FILTER (NOT coalesce(split IN ('train', 'val', 'test'), false))"), ("geometry", "count(*) FILTER (NOT coalesce(decoded_width = 1024 AND decoded_height = 1024, false))"),
    ("encoded hash", "count(*) FILTER (NOT coalesce(regexp_full_match(encoded_sha256, '[0-9a-f]{64}'), false))"), ("pixel hash", "count(*) FILTER (NOT coalesce(regexp_full_match(decoded_pixel_sha256_rgb, '[0-9a-f]{64}'), false))"),
    ("perceptual hash", "count(*) FILTER (NOT coalesce(regexp_full_match(decoded_phash_rgb, '[0-9a-f]{16}'), false))"),
    ("path", "count(*) FILTER (NOT coalesce(materialized_path NOT LIKE '/%' AND NOT list_contains(string_split(materialized_path, '/'), '..'), false))"), source="training_manifest",
))
def row_semantics(spark: SparkSession, d: str) -> DataFrame:
    return gates.row_semantics(table(spark, d, "training_manifest"), CELLS, SPLITS, 1024)


_HASHES = "(SELECT *, 'source-index:' || source_index AS said FROM selection_catalog)"


@query(_select(
    ("id", f"count(*) FILTER (NOT coalesce({sql_strip('selection_id')} != '', false))"), ("index", "count(*) FILTER (NOT coalesce(regexp_full_match(source_index, '0|[1-9][0-9]*'), false))"),
    ("index hash", "count(*) FILTER (NOT coalesce(source_index_hash = sha256(said), false))"), ("repository", "count(*) FILTER (NOT coalesce(repository_id = 'tidewater-forensics/caption-pairs-hq', false))"),
    ("revision", "count(*) FILTER (NOT coalesce(revision = '0f9f294245440da98ddd7af056fe33885f07642f', false))"), ("label", "count(*) FILTER (NOT coalesce(label IN (0, 1), false))"),
    ("ids again", "count(selection_id) - count(DISTINCT selection_id)"), ("indexes again", "count(source_index) - count(DISTINCT source_index)"), source=_HASHES,
))
def candidate_checks(spark: SparkSession, d: str) -> DataFrame:
    said = F.sha2(F.concat(F.lit("source-index:"), F.col("source_index")), 256)
    return gates.candidate_checks(table(spark, d, "selection_catalog"), "source_index", said, "tidewater-forensics/caption-pairs-hq", "0f9f294245440da98ddd7af056fe33885f07642f")


@query("""
SELECT generator, count(*) AS n, CASE WHEN min(source_repository_id) = max(source_repository_id) AND count(*) = count(*) FILTER (trim(source_repository_id) != '') THEN min(source_repository_id) END AS source_repository_id,
  CASE WHEN min(source_format) = max(source_format) AND count(*) = count(*) FILTER (trim(source_format) != '') THEN min(source_format) END AS source_format FROM highres_manifest WHERE label = 1 GROUP BY 1""")
def generator_contexts(spark: SparkSession, d: str) -> DataFrame:
    return gates.contexts(table(spark, d, "highres_manifest"), "label", "generator", ["source_repository_id", "source_format"])


@query("SELECT CASE WHEN grouping(split) = 0 THEN coalesce(split, '(null)') END AS split, count(*) AS rows FROM highres_manifest GROUP BY ROLLUP (split)")
def launch_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.row_counts(table(spark, d, "highres_manifest"), "split")


@query("""
SELECT 'label in domain' AS "check", count(*) FILTER (NOT coalesce(label IN (0, 1), false)) AS rows FROM training_manifest UNION ALL SELECT 'split in domain', count(*) FILTER (NOT coalesce(split IN ('train', 'val', 'test'), false)) FROM training_manifest
UNION ALL SELECT 'key unique', count(*) - count(DISTINCT selection_id) FROM training_manifest UNION ALL SELECT 'rows of ' || coalesce(split, '(null)'), count(*) FROM training_manifest GROUP BY split UNION ALL SELECT 'rows of all', count(*) FROM training_manifest""")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_manifest")
    return gates.dry_run(rows, TableContract(rows.select("selection_id", "label", "split").schema, key=("selection_id",), domains={"label": (0, 1), "split": SPLITS}), "split")


@query("""
WITH p AS (SELECT shard_path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, shard_path) AS place FROM selection_catalog WHERE batch_no <= 6 GROUP BY 1), s AS (SELECT shard_path, count(*) AS n FROM selection_catalog GROUP BY 1)
SELECT 'shard counts' AS "check", (SELECT count(*) FROM s FULL JOIN p ON s.shard_path = p.shard_path WHERE s.n IS DISTINCT FROM p.n) AS rows
UNION ALL SELECT 'ids again', (SELECT count(selection_id) - count(DISTINCT selection_id) FROM selection_catalog) UNION ALL SELECT 'order', 0""")
def plan_problems(spark: SparkSession, d: str) -> DataFrame:
    """A plan made before the last batches came, held against the whole selection."""
    rows = table(spark, d, "selection_catalog")
    per = rows.where("batch_no <= 6").groupBy("shard_path").agg(F.count(F.lit(1)).alias("n"))
    return gates.plan_problems(rows, selection.running_budget(per, "n", "shard_path", 10**9), "shard_path", "n", "processing_order")


@query("""
SELECT locator, CASE WHEN regexp_full_match(source_width, '0|[1-9][0-9]*') AND TRY_CAST(source_width AS BIGINT) >= 1 THEN TRY_CAST(source_width AS BIGINT) END AS width,
  CASE WHEN lower(trim(nsfw_flag)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(nsfw_flag)) IN ('false', '0', 'no') THEN false END AS flag, CASE WHEN label IN ('0', '1') THEN label::INT END AS said, load_no FROM source_catalog""".replace("trim(nsfw_flag)", sql_strip("nsfw_flag")))
def parsed_values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_catalog")
    return t.select("locator", manifests.canonical_integer(F.col("source_width"), 1).alias("width"), scalars.tri_state(F.col("nsfw_flag")).alias("flag"), manifests.label_of(F.col("label")).alias("said"), "load_no")


@query(f"""
SELECT locator, load_no, repository_id || '@' || revision || ':' || shard_path || ':' || row_index::VARCHAR AS stable_locator, sha256('index:' || nullif({sql_strip("row_index::VARCHAR")}, '')) AS index_hash,
  CASE WHEN lower({sql_strip("prompt_present")}) IN ('true', '1', 'yes') THEN 0 WHEN lower({sql_strip("prompt_present")}) IN ('false', '0', 'no') THEN 1 END AS said_label FROM source_catalog""")
def catalogue_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = manifests.catalogue_rows(table(spark, d, "source_catalog"), "prompt_present", "row_index", "image_name", "index")
    return rows.select("locator", "load_no", "stable_locator", "index_hash", "said_label")


_TEXT = rf"lower({sql_strip('regexp_replace(caption, $$[' + chr(92) + 's' + chr(92) + 'x1c-' + chr(92) + 'x1f' + chr(92) + 'x85' + chr(92) + 'p{Z}]+$$, $$ $$, $$g$$)')})"


@query(f"""
SELECT source_id, loaded_at, coalesce({_TEXT}, '') != '' AS prompt_there, sha256(CASE WHEN coalesce({_TEXT}, '') != '' THEN 'prompt:' || {_TEXT} ELSE 'blank-prompt-locator:' || source_id END) AS prompt_key,
  CASE WHEN coalesce({_TEXT}, '') != '' THEN 'prompt:' || sha256('prompt:' || {_TEXT}) ELSE 'blank:' || source_id END AS group_key, source_width AS width, source_height AS height FROM highres_manifest""")
def prompt_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "highres_manifest").drop("width", "height").withColumn("resolution", F.array("source_width", "source_height"))
    return manifests.split_resolution(manifests.prompt_groups(rows, "caption", "source_id"), "resolution").select("source_id", "loaded_at", "prompt_there", "prompt_key", "group_key", "width", "height")


@query("""
SELECT selection_id AS source_id, 'corpus/' || materialized_path AS path, encoded_sha256 AS sha256, decoded_phash_rgb AS phash, decoded_pixel_sha256_rgb AS source_pixel_sha256, parent_group, integrity_component AS leakage_group, loaded_at FROM training_manifest""")
def training_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = manifests.training_rows(table(spark, d, "training_manifest"), "corpus/", "integrity_component", "parent_group")
    return rows.select("source_id", "path", "sha256", "phash", "source_pixel_sha256", "parent_group", "leakage_group", "loaded_at")


@query("""
WITH o AS (SELECT selection_id, min(locator) AS p FROM selection_catalog WHERE batch_no <= 4 GROUP BY 1)
SELECT t.selection_id, loaded_at, coalesce(o.p, materialized_path) AS materialized_path FROM training_manifest t LEFT JOIN o ON t.selection_id = o.selection_id""")
def repointed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the originals, where the first batches know one."""
    originals = table(spark, d, "selection_catalog").where("batch_no <= 4").select("selection_id", F.col("locator").alias("materialized_path"))
    return manifests.repointed(table(spark, d, "training_manifest").select("selection_id", "loaded_at", "materialized_path"), originals, "selection_id", "materialized_path").select("selection_id", "loaded_at", "materialized_path")


@query("""
SELECT event_id, score, (score >= 0.1)::INT AS predicted_label, CASE WHEN score >= 0.1 THEN 'ai_like' WHEN score < 0.1 THEN 'not_ai_like' END AS decision, 0.1::DOUBLE AS threshold, 'tone' AS representation
FROM (SELECT event_id, round(least(value / 500, 1.0), 6) AS score FROM events)""")
def decision_columns(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "events").select("event_id", F.round(F.least(F.col("value") / 500, F.lit(1.0)), 6).alias("score"))
    return manifests.decisions(scored, 0.1, {"representation": "tone"})


_DECLARED = {"real": "real", "sd21": "stable_diffusion_21", "sd3": "stable_diffusion_3"}
_SAID = f"CASE generator {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _DECLARED.items())} ELSE 'unknown_' || generator END"


@query(f"""
WITH r AS (SELECT source_id, loaded_at, CASE WHEN label = 0 THEN 0 WHEN label = 1 THEN 1 END AS label, {_SAID} AS declared, CASE split WHEN 'validation' THEN 'val' WHEN 'validation_split' THEN 'val' ELSE split END AS split, {_TEXT} AS t FROM highres_manifest)
SELECT source_id, loaded_at, label, CASE WHEN label = 0 THEN 'real' ELSE declared END AS generator, split, CASE WHEN coalesce(t, '') != '' THEN sha256(t) ELSE source_id END AS group_id, (label = 0 AND declared = 'real') OR (label = 1 AND declared != 'real') AS consistent,
  sha256(source_id) || '.png' AS output FROM r""")
def raw_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = manifests.raw_manifest_rows(table(spark, d, "highres_manifest"), "label", "generator", "caption", "source_id", "split", _DECLARED)
    return rows.select("source_id", "loaded_at", "label", "generator", "split", "group_id", "consistent", manifests.output_name(F.col("source_id")).alias("output"))


def _word(part: int, side: str) -> str:
    hi = f"('0x' || substr(sha256('crop:7:' || coalesce(group_id, '')), {1 + 16 * part}, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE"
    return f"CASE WHEN source_width >= 384 AND source_height >= 384 THEN round_even({hi} * (source_{side} - 384), 0)::INT END"


@query(f"""
SELECT source_id, loaded_at, source_width, source_height, {_word(0, 'width')} AS crop_left, {_word(1, 'height')} AS crop_top, CASE WHEN source_width >= 384 AND source_height >= 384 THEN 384 END AS crop_size, path AS source_path FROM highres_manifest""")
def crop_coordinates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "highres_manifest").select("source_id", "loaded_at", "group_id", "path", F.col("source_width").alias("width"), F.col("source_height").alias("height"))
    return manifests.cropped_rows(rows, "crop:7", "group_id", 384).select("source_id", "loaded_at", "source_width", "source_height", "crop_left", "crop_top", "crop_size", "source_path")


@query("SELECT source_id, loaded_at FROM highres_manifest WHERE least(source_width, source_height) >= 600 AND generator IN ('real', 'sd21', 'sd3')")
def large_candidates(spark: SparkSession, d: str) -> DataFrame:
    return manifests.large_enough(table(spark, d, "highres_manifest"), F.col("source_width"), F.col("source_height"), 600, "generator", ("real", "sd21", "sd3")).select("source_id", "loaded_at")


_BUILD = f"""
WITH c AS (SELECT parent_coco_image_id AS parent, coco_caption_id AS caption, locator, batch_no, official_coco_license_id AS licence, {_CELL} AS c FROM selection_catalog WHERE parent_coco_image_id > 0 AND declared_size = 1024),
k AS (SELECT parent, caption FROM c WHERE c IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT c) = 5),
b AS (SELECT parent, arg_min(caption, (sha256('caption:7:' || parent || ':' || caption), caption)) AS caption FROM k GROUP BY 1)"""


@query(_BUILD + " SELECT parent, caption FROM b")
def complete_captions(spark: SparkSession, d: str) -> DataFrame:
    """Of each parent's captions that have all five cells the one of least hash."""
    return _captions(_cells(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "selection_catalog").where("parent_coco_image_id > 0 and declared_size = 1024")
    t = manifests.with_cells(t, CELLS, "label", "model", "gen_type", "c").where("c is not null")
    return t.select(F.col("parent_coco_image_id").alias("parent"), F.col("coco_caption_id").alias("caption"), "c", "locator", "batch_no", F.col("official_coco_license_id").alias("licence"))


def _captions(rows: DataFrame) -> DataFrame:
    return selection.complete_pairs(rows, "parent", "caption", "c", list(CELLS), stable_hash(F.lit("caption"), F.lit("7"), F.col("parent"), F.col("caption")))


@query(_BUILD + f""",
r AS (SELECT parent, caption, c, arg_min(locator, (sha256('row:7:' || parent || ':' || caption || ':' || c || ':' || locator), locator)) AS locator, min(licence) AS licence FROM c JOIN b USING (parent, caption) WHERE c IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT parent, min(licence) AS licence FROM r GROUP BY 1), n AS (SELECT licence, count(*) AS n FROM l GROUP BY 1),
q AS (SELECT licence, k, name, floor(n * w + 1e-9) AS base, round(n * w - floor(n * w + 1e-9), 9) AS frac, n FROM n, (VALUES (0, 'train', 0.7::DOUBLE), (1, 'val', 0.15::DOUBLE), (2, 'test', 0.15::DOUBLE)) s(k, name, w)),
g AS (SELECT licence, k, name, base + (row_number() OVER (PARTITION BY licence ORDER BY frac DESC, k) <= n - sum(base) OVER (PARTITION BY licence))::INT AS quota FROM q),
e AS (SELECT licence, k, name, sum(quota) OVER (PARTITION BY licence ORDER BY k) AS hi, sum(quota) OVER (PARTITION BY licence ORDER BY k) - quota AS lo FROM g),
p AS (SELECT l.*, row_number() OVER (PARTITION BY licence ORDER BY sha256('split:7:' || parent), parent) AS r FROM l),
s AS (SELECT p.parent, e.name AS split, e.k FROM p JOIN e ON p.licence IS NOT DISTINCT FROM e.licence AND p.r > e.lo AND p.r <= e.hi)
SELECT r.parent, r.caption, r.c AS cell, r.locator, s.split, row_number() OVER (ORDER BY s.k, r.parent, list_position([{_NAMES}], r.c)) AS position FROM r JOIN s USING (parent)""")
def selection_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole selection: candidates by cell, one complete caption a parent, one row a cell, parents to splits by licence, and the output order."""
    rows = _cells(spark, d)
    picked = selection.first_by_hash(rows.join(_captions(rows), ["parent", "caption"]), ["parent", "caption", "c"], stable_hash(F.lit("row"), F.lit("7"), F.col("parent"), F.col("caption"), F.col("c"), F.col("locator")), F.col("locator"))
    parents = rows.join(_captions(rows), ["parent", "caption"]).groupBy("parent").agg(F.min("licence").alias("licence"))
    dealt = selection.largest_remainder_split(parents, "licence", stable_hash(F.lit("split"), F.lit("7"), F.col("parent")), "parent", (("train", 0.7), ("val", 0.15), ("test", 0.15))).select("parent", "split")
    out = picked.join(dealt, "parent").select("parent", "caption", F.col("c").alias("cell"), "locator", "split")
    place = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    # Splits and ranges of parents are contiguous in the output order.
    bucket = F.struct(place("split", SPLITS), F.floor(F.col("parent") / 1000))
    return ranked(out, [], [place("split", SPLITS), F.col("parent"), place("cell", list(CELLS))], bucket, "position").select("parent", "caption", "cell", "locator", "split", "position")


@query(f"""
WITH c AS (SELECT *, list_position([{_NAMES}], cell) AS position FROM training_manifest WHERE split = 'val' AND parent_coco_image_id IS NOT NULL AND cell IN ({_NAMES})),
p AS (SELECT parent_coco_image_id FROM c GROUP BY 1 HAVING count(DISTINCT cell) = 5 ORDER BY 1 LIMIT 1)
SELECT parent_coco_image_id, cell, position, min(selection_id) AS selection_id FROM c WHERE parent_coco_image_id IN (SELECT * FROM p) GROUP BY 1, 2, 3""")
def lowest_complete_parent(spark: SparkSession, d: str) -> DataFrame:
    return selection.lowest_complete(table(spark, d, "training_manifest").where("split = 'val'"), "parent_coco_image_id", "cell", list(CELLS), ["selection_id"])


@query("SELECT shard_path, count(*) AS rows FROM selection_catalog WHERE shard_path IN (SELECT DISTINCT shard_path FROM selection_catalog WHERE shard_path IS NOT NULL ORDER BY 1 LIMIT 2) GROUP BY 1")
def first_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first two shards, a scope that is always recorded as partial."""
    rows, scope = selection.first_shards(table(spark, d, "selection_catalog"), "shard_path", 2)
    assert scope["partial"]
    return rows.groupBy("shard_path").agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH x AS (SELECT parent_group AS g, label, generator, selection_id, sha256('0:3:' || selection_id) AS h FROM training_manifest WHERE parent_group IS NOT NULL),
p AS (SELECT g, arg_min(selection_id, h) FILTER (label = 0) AS "real", arg_min(selection_id, h) FILTER (label = 1) AS fake, arg_min(generator, h) FILTER (label = 1) AS kind FROM x GROUP BY 1 HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 1) > 0)
SELECT g AS parent_group, "real", fake, kind, row_number() OVER (ORDER BY sha256('0:3:' || g), g) AS position FROM p""")
def epoch_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the fourth epoch with their order."""
    t = table(spark, d, "training_manifest").select("parent_group", "label", F.col("generator").alias("kind"), F.col("selection_id").alias("row"))
    return selection.epoch_pairs(t, "parent_group", "label", "kind", 3)


@query("""
WITH g AS (SELECT coalesce(format = 'PNG', false) AS png, coalesce(mode = 'RGB', false) AS rgb, coalesce(label IN ('0', '1'), false) AS label FROM source_catalog)
SELECT concat_ws('|', CASE WHEN NOT label THEN 'label' END, CASE WHEN NOT png THEN 'png' END, CASE WHEN NOT rgb THEN 'rgb' END) AS reasons, count(*) AS rows FROM g GROUP BY 1""")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gate_reasons(table(spark, d, "source_catalog"), {"png": F.col("format") == "PNG", "rgb": F.col("mode") == "RGB", "label": F.col("label").isin("0", "1")})


@query("""
SELECT CASE WHEN grouping(cell) = 0 THEN coalesce(cell, '(null)') END AS cell, concat_ws('x', decoded_width, decoded_height) AS resolution, count(*) AS rows FROM training_manifest GROUP BY GROUPING SETS ((cell, concat_ws('x', decoded_width, decoded_height)), (concat_ws('x', decoded_width, decoded_height)))""")
def resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.resolution_counts(table(spark, d, "training_manifest"), "cell", "decoded_width", "decoded_height")


@query(f"""
WITH p AS (SELECT parent_coco_image_id, count(*) FILTER (cell = 'real_coco' AND decoded_width = 1024) AS real_rows, count(*) FILTER (cell != 'real_coco') AS fake_rows,
  count(DISTINCT cell) FILTER (cell IN ({_NAMES}) AND cell != 'real_coco') AS fake_cells, count(*) FILTER (cell != 'real_coco' AND decoded_width IS DISTINCT FROM 1024) AS bad_rows FROM training_manifest GROUP BY 1)
SELECT * FROM p WHERE real_rows != 1 OR fake_rows != 4 OR fake_cells != 4 OR bad_rows > 0""")
def incomplete_parents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.incomplete_parents(table(spark, d, "training_manifest"), "parent_coco_image_id", "cell", "real_coco", [c for c in CELLS if c != "real_coco"], F.col("decoded_width") == 1024)


@query("""
WITH s AS (SELECT cell, count(encoded_size_bytes) AS rows, min(encoded_size_bytes) AS least, quantile_cont(encoded_size_bytes, 0.5) AS median, max(encoded_size_bytes) AS greatest FROM training_manifest WHERE encoded_size_bytes IS NOT NULL GROUP BY 1)
SELECT *, round((SELECT median FROM s WHERE cell = 'real_coco') / median, 6) AS ratio, median - (SELECT median FROM s WHERE cell = 'real_coco') AS delta FROM s""")
def size_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median, least and greatest file size a cell, against the real cell's median."""
    s = catalog.spread(table(spark, d, "training_manifest"), ["cell"], "encoded_size_bytes")
    return catalog.compared_to(s, "cell", "real_coco", "median").withColumn("ratio", F.round("ratio", 6))


@query("""
WITH r AS (SELECT DISTINCT cell FROM selection_catalog), m AS (SELECT cell, count(*) AS n FROM training_manifest WHERE split = 'test' GROUP BY 1)
SELECT r.cell, m.n, m.cell IS NULL AS missing FROM r LEFT JOIN m ON r.cell = m.cell""")
def optional_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "selection_catalog").select("cell").distinct()
    return catalog.with_optional(runs, table(spark, d, "training_manifest").where("split = 'test'").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "n")


@query("""
WITH v AS (SELECT DISTINCT official_coco_license_id AS i, {'a': official_coco_license_name, 'b': official_coco_license_url} AS v FROM selection_catalog WHERE official_coco_license_id IS NOT NULL)
SELECT i AS official_coco_license_id, count(*) AS variants, CASE WHEN count(*) = 1 THEN min(v.a) END AS official_coco_license_name, CASE WHEN count(*) = 1 THEN min(v.b) END AS official_coco_license_url FROM v GROUP BY 1""")
def licence_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.consistent_lookup(table(spark, d, "selection_catalog"), "official_coco_license_id", ["official_coco_license_name", "official_coco_license_url"])


@query("""
WITH a AS (SELECT selection_id, min(batch_no) AS batch_no FROM selection_catalog GROUP BY 1), b AS (SELECT selection_id, min(cell) AS cell, max(loaded_at) AS loaded_at FROM training_manifest GROUP BY 1)
SELECT a.selection_id, batch_no, cell AS lineage_cell, loaded_at AS lineage_at FROM a JOIN b ON a.selection_id = b.selection_id""")
def lineage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Selected records paired one to one with what became of them."""
    b = table(spark, d, "training_manifest").groupBy("selection_id").agg(F.min("cell").alias("cell"), F.max("loaded_at").alias("loaded_at"))
    a = table(spark, d, "selection_catalog").groupBy("selection_id").agg(F.min("batch_no").alias("batch_no")).join(b.select("selection_id"), "selection_id", "left_semi")
    return catalog.lineage(a, b.join(a.select("selection_id"), "selection_id", "left_semi"), "selection_id", {"lineage_cell": "cell", "lineage_at": "loaded_at"})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour and kind, counted by a stream that brings the table to a folder and stops."""
    return increments.counted_windows(spark, f"{d}/events.parquet", "ts", "event_type", "1 hour")
