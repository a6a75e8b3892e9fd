"""Selection, de-duplication and component queries, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, hex64, informative_hash, perceptual_hash, stable_hash
from corpusloom.operators import components, dedup, selection
from corpusloom.plans import audits
from corpusloom.plans.catalog_queries import sql_strip
from corpusloom.scratch import Scratch
from corpusloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""
SELECT parent_coco_image_id, cell, selection_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_coco_image_id, cell ORDER BY sha256('7:' || selection_id), locator, batch_no) AS r FROM selection_catalog) WHERE r = 1""")
def argmin_by_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "selection_catalog").select("parent_coco_image_id", "cell", "selection_id", "locator", "batch_no")
    return selection.first_by_hash(t, ["parent_coco_image_id", "cell"], stable_hash(F.lit("7"), F.col("selection_id")), F.struct("locator", "batch_no")).select("parent_coco_image_id", "cell", "selection_id")


#: The five cells.
_CELLS = ("real_coco", "fake_sdxl_t2i", "fake_sdxl_i2i", "fake_sdxl_ti2i", "fake_dalle3_t2i")


@query(f"SELECT parent_coco_image_id, count(DISTINCT cell) FILTER (cell IN {_CELLS}) AS cells, count(DISTINCT cell) FILTER (cell IN {_CELLS}) = 5 AS complete FROM selection_catalog GROUP BY 1")
def complete_parents(spark: SparkSession, d: str) -> DataFrame:
    return selection.complete_groups(table(spark, d, "selection_catalog"), ["parent_coco_image_id"], "cell", _CELLS)


_SHARES = (("train", 0.7), ("val", 0.15), ("test", 0.15))


@query("""
WITH p AS (SELECT DISTINCT parent_coco_image_id AS parent, min(official_coco_license_id) AS licence FROM selection_catalog WHERE parent_coco_image_id > 0 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY licence ORDER BY sha256('7:' || parent::VARCHAR), parent) AS r FROM p),
q AS (SELECT licence, s.k, s.name, floor(n * w + 1e-9) AS base, round(n * w - floor(n * w + 1e-9), 9) AS frac, n FROM (SELECT licence, count(*) AS n FROM p GROUP BY 1) CROSS JOIN (VALUES (0, 'train', 0.7::DOUBLE), (1, 'val', 0.15::DOUBLE), (2, 'test', 0.15::DOUBLE)) s(k, name, w)),
g AS (SELECT licence, k, name, base + (row_number() OVER (PARTITION BY licence ORDER BY frac DESC, k) <= n - sum(base) OVER (PARTITION BY licence))::INT AS quota FROM q),
e AS (SELECT licence, name, sum(quota) OVER (PARTITION BY licence ORDER BY k) AS hi, sum(quota) OVER (PARTITION BY licence ORDER BY k) - quota AS lo FROM g)
SELECT r.parent, r.licence, e.name AS split FROM r JOIN e ON r.licence = e.licence AND r.r > e.lo AND r.r <= e.hi""")
def largest_remainder_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "selection_catalog").where("parent_coco_image_id > 0").groupBy(F.col("parent_coco_image_id").alias("parent")).agg(F.min("official_coco_license_id").alias("licence"))
    return selection.largest_remainder_split(p, "licence", stable_hash(F.lit("7"), F.col("parent")), "parent", _SHARES)


@query("""
WITH g AS (SELECT DISTINCT group_id FROM highres_manifest), r AS (SELECT group_id, row_number() OVER (ORDER BY sha256('7:' || group_id), group_id) - 1 AS position FROM g)
SELECT group_id, position, ['sd21', 'sd3', 'sdxl'][position % 3 + 1] AS assigned FROM r""")
def round_robin_assignment(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "highres_manifest").select("group_id").distinct()
    return selection.round_robin(g, stable_hash(F.lit("7"), F.col("group_id")), "group_id", ["sd21", "sd3", "sdxl"])


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT l_orderkey, max(l_linenumber) AS last FROM x GROUP BY 1 HAVING count(*) = 4 AND count(*) FILTER (gap != 1) = 0""")
def stride_check(spark: SparkSession, d: str) -> DataFrame:
    return selection.stride_groups(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 4, 1)


@query("""
WITH f AS (SELECT selection_id, max(encoded_size_bytes) AS size FROM training_manifest GROUP BY 1), r AS (SELECT *, sum(size) OVER (ORDER BY size DESC, selection_id ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT selection_id, size, row_number() OVER (ORDER BY size DESC, selection_id) AS processing_order, (total - size)::BIGINT AS before, (total + size)::BIGINT AS peak, total <= 500000000 AS within FROM r""")
def running_budget_peak(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "training_manifest").groupBy("selection_id").agg(F.max("encoded_size_bytes").alias("size"))
    return selection.running_budget(f, "size", "selection_id", 500_000_000)


@query("SELECT selection_id, count(*) AS rows FROM selection_catalog WHERE selection_id NOT IN (SELECT selection_id FROM training_manifest WHERE selection_id IS NOT NULL) GROUP BY 1")
def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    return selection.missing_rows(table(spark, d, "selection_catalog"), table(spark, d, "training_manifest"), "selection_id").groupBy("selection_id").agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT shard_path, row_index FROM selection_catalog WHERE shard_path IS NOT NULL AND row_index IS NOT NULL),
r AS (SELECT shard_path, min(row_index) AS first FROM d GROUP BY 1 UNION ALL SELECT r.shard_path, min(d.row_index) FROM r JOIN d ON d.shard_path = r.shard_path AND d.row_index >= r.first + 100 GROUP BY r.shard_path, r.first)
SELECT r.shard_path, r.first, max(d.row_index) - r.first + 1 AS length FROM r JOIN d ON d.shard_path = r.shard_path AND d.row_index >= r.first AND d.row_index < r.first + 100 GROUP BY 1, 2""")
def range_packing(spark: SparkSession, d: str) -> DataFrame:
    return selection.pack_ranges(table(spark, d, "selection_catalog"), "shard_path", "row_index", 100)


@query("""
WITH x AS (SELECT parent_group AS g, label, generator, selection_id, sha256('7:' || selection_id) AS h FROM training_manifest)
SELECT g AS parent_group, arg_min(selection_id, h) FILTER (label = 0) AS "real", arg_min(selection_id, h) FILTER (label = 1) AS fake, arg_min(generator, h) FILTER (label = 1) AS kind
FROM x GROUP BY 1 HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 1) > 0""")
def paired_sampler(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "training_manifest").select("parent_group", "label", F.col("generator").alias("kind"), F.col("selection_id").alias("row"))
    return selection.paired_sampler(t, "parent_group", "label", "kind", stable_hash(F.lit("7"), F.col("row")))


@query("""
WITH x AS (SELECT parent_group AS g, label, generator, selection_id, sha256('7:' || selection_id) AS h FROM training_manifest WHERE parent_group IS NOT NULL),
n AS (SELECT list(DISTINCT generator ORDER BY generator) AS names FROM x WHERE label = 1 AND generator IS NOT NULL),
c AS (SELECT g FROM x GROUP BY 1 HAVING count(*) FILTER (label = 0) > 0 AND count(DISTINCT generator) FILTER (label = 1) = (SELECT len(names) FROM n)),
p AS (SELECT g, row_number() OVER (ORDER BY sha256('7:' || g), g) - 1 AS position FROM c), a AS (SELECT g, names[(position % len(names) + 1)::INT] AS kind FROM p, n)
SELECT g AS parent_group, arg_min(selection_id, h) FILTER (label = 0) AS "real", arg_min(selection_id, h) FILTER (label = 1 AND generator = kind) AS fake, kind FROM a JOIN x USING (g) GROUP BY g, kind""")
def balanced_paired_sampler(spark: SparkSession, d: str) -> DataFrame:
    """A pair of every group that holds a real row and every generator, generators dealt from a balanced cycle; other groups can't be paired."""
    t = table(spark, d, "training_manifest").select("parent_group", "label", F.col("generator").alias("kind"), F.col("selection_id").alias("row")).where("parent_group is not null")
    names = sorted(r[0] for r in t.where("label = 1 and kind is not null").select("kind").distinct().collect())
    cells = F.when(F.col("label") == 0, "").otherwise(F.col("kind"))
    whole = selection.complete_groups(t.withColumn("cell", cells), ["parent_group"], "cell", ["", *names]).where("complete").select("parent_group")
    return selection.balanced_pairs(t.join(whole, "parent_group"), "parent_group", "label", "kind", names, stable_hash(F.lit("7"), F.col("parent_group")), stable_hash(F.lit("7"), F.col("row")))


def _hash_sql(c: str) -> str:
    h = f"lower({sql_strip(c)})"
    return f"CASE WHEN NOT regexp_full_match({h}, '0*|f*') AND {h} != 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' THEN {h} END"


@query(f"""
WITH h AS (SELECT source_id, lower({sql_strip("split")}) AS split, {_hash_sql("pixel_sha256")} AS pixel_sha256 FROM highres_manifest)
SELECT a.source_id AS left_id, b.source_id AS right_id, pixel_sha256, count(*) AS rows FROM h a JOIN h b USING (pixel_sha256) WHERE a.split = 'train' AND b.split = 'test' GROUP BY 1, 2, 3""")
def exact_hash_matches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "highres_manifest").select("source_id", folded(F.col("split")).alias("split"), informative_hash(F.col("pixel_sha256")).alias("pixel_sha256"))
    return dedup.exact_matches(t.where("split = 'train'"), t.where("split = 'test'"), "pixel_sha256", "source_id", "source_id").groupBy("left_id", "right_id", "pixel_sha256").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""
WITH h AS (SELECT source_id, lower({sql_strip("split")}) AS split, {_hash_sql("pixel_sha256")} AS k FROM highres_manifest),
c AS (SELECT k, split, min(source_id) AS first, count(DISTINCT source_id) AS n FROM h WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT a.k AS pixel_sha256, a.first AS left_first, a.n AS left_records, b.first AS right_first, b.n AS right_records FROM c a JOIN c b USING (k) WHERE a.split = 'train' AND b.split = 'test'""")
def exact_hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same with a row a hash, copies counted."""
    t = table(spark, d, "highres_manifest").select("source_id", folded(F.col("split")).alias("split"), informative_hash(F.col("pixel_sha256")).alias("pixel_sha256"))
    return dedup.exact_classes(t.where("split = 'train'"), t.where("split = 'test'"), "pixel_sha256", "source_id", "source_id")


_P = f"lower({sql_strip('decoded_phash_rgb')})"


@query(f"""
WITH m AS (SELECT DISTINCT selection_id AS id, parent_group AS g, ('0x' || substr(h, 1, 8))::BIGINT AS hi, ('0x' || substr(h, 9, 8))::BIGINT AS lo FROM (
  SELECT selection_id, parent_group, lpad({_P}, 16, '0') AS h FROM training_manifest WHERE regexp_full_match({_P}, '[0-9a-f]{{1,16}}') AND NOT regexp_full_match({_P}, '0+|f+')))
SELECT DISTINCT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS differing
FROM m a JOIN m b ON a.id < b.id AND a.g IS DISTINCT FROM b.g AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4""")
def near_hash_links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "training_manifest").select("selection_id", "parent_group", hex64(perceptual_hash(F.col("decoded_phash_rgb"))).alias("x"))
    return dedup.near_links(t, "selection_id", "parent_group", "x", 4)


@query(f"""
WITH m AS (SELECT DISTINCT selection_id AS id, parent_group AS g, ('0x' || substr(h, 1, 8))::BIGINT AS hi, ('0x' || substr(h, 9, 8))::BIGINT AS lo FROM (
  SELECT selection_id, parent_group, lpad({_P}, 16, '0') AS h FROM training_manifest WHERE regexp_full_match({_P}, '[0-9a-f]{{1,16}}') AND NOT regexp_full_match({_P}, '0+|f+'))),
c AS (SELECT g, hi, lo, min(id) AS c, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT DISTINCT least(a.c, b.c) AS left_class, greatest(a.c, b.c) AS right_class, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS differing, a.n * b.n AS pairs
FROM c a JOIN c b ON (a.hi, a.lo) <= (b.hi, b.lo) AND a.g IS DISTINCT FROM b.g AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4""")
def near_hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Near links between classes of records of one group and hash, with the pairs behind each."""
    t = table(spark, d, "training_manifest").select("selection_id", "parent_group", hex64(perceptual_hash(F.col("decoded_phash_rgb"))).alias("x"))
    return dedup.near_classes(t, "selection_id", "parent_group", "x", 4)[0]


_KEYS = ("group_id", "pixel_sha256", "source_sha256")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "highres_manifest").select("source_id", "group_id", *[informative_hash(F.col(c)).alias(c) for c in _KEYS[1:]], folded(F.col("split")).alias("split"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows, s = _records(spark, d), Scratch(spark, "components")
    return s.save(components.components(rows, "source_id", components.key_edges(rows, "source_id", _KEYS), s), "members")


_COMPONENTS = f"""
WITH RECURSIVE r AS (SELECT source_id AS id, group_id, {_hash_sql("pixel_sha256")} AS p, {_hash_sql("source_sha256")} AS s, lower({sql_strip("split")}) AS split FROM highres_manifest),
k AS (SELECT id, 'g' || group_id AS k FROM r WHERE group_id IS NOT NULL UNION SELECT id, 'p' || p FROM r WHERE p IS NOT NULL UNION SELECT id, 's' || s FROM r WHERE s IS NOT NULL),
e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM k a JOIN (SELECT k, min(id) AS id FROM k GROUP BY 1) b USING (k)),
d AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
w(id, root) AS (SELECT DISTINCT id, id FROM r UNION SELECT d.v, w.root FROM w JOIN d ON d.u = w.id),
m AS (SELECT id, min(root) AS root FROM w GROUP BY 1)"""


@query(_COMPONENTS + " , n AS (SELECT root, 'component:' || substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 24) AS component, count(*) AS members FROM m GROUP BY 1) SELECT m.id, n.component, n.members FROM m JOIN n USING (root)")
def leakage_components(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return m.join(components.member_names(m, "component:"), "root").select("id", "component", "members")


@query(_COMPONENTS + " SELECT root, count(*) AS rows, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM r JOIN m USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def component_split_crossings(spark: SparkSession, d: str) -> DataFrame:
    return components.crossings(_members(spark, d), _records(spark, d), "source_id", "split")


@query(_COMPONENTS + """ , kinds AS (SELECT source_id AS id, generator FROM highres_manifest), v0 AS (SELECT root, coalesce(generator, '') AS g, count(*) AS n FROM kinds JOIN m USING (id) GROUP BY 1, 2),
v AS (SELECT root, sum(n)::BIGINT AS n, string_agg(g || '=' || n, '|' ORDER BY g || '=' || n) AS vector FROM v0 GROUP BY 1), o AS (SELECT vector FROM v GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT root, CASE WHEN o.vector IS NOT NULL THEN v.vector ELSE 'size ' || floor(log2(n))::BIGINT END AS stratum FROM v LEFT JOIN o ON v.vector = o.vector),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(root), root) AS r FROM s), c AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT stratum, k, name, floor(n * w + 1e-9) AS base, round(n * w - floor(n * w + 1e-9), 9) AS frac, n FROM c, (VALUES (0, 'train', 0.7::DOUBLE), (1, 'val', 0.15::DOUBLE), (2, 'test', 0.15::DOUBLE)) s(k, name, w)),
g AS (SELECT stratum, k, name, base + (row_number() OVER (PARTITION BY stratum ORDER BY frac DESC, k) <= n - sum(base) OVER (PARTITION BY stratum))::INT AS quota FROM q),
e2 AS (SELECT stratum, name, sum(quota) OVER (PARTITION BY stratum ORDER BY k) AS hi, sum(quota) OVER (PARTITION BY stratum ORDER BY k) - quota AS lo FROM g)
SELECT p.root, p.stratum, e2.name AS split FROM p JOIN e2 ON p.stratum = e2.stratum AND p.r > e2.lo AND p.r <= e2.hi""")
def component_allocation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "highres_manifest").select("source_id", "generator")
    return components.allocate(_members(spark, d), rows, "source_id", "generator", _SHARES)


@query(_COMPONENTS + " , n AS (SELECT split, root, count(*) AS n FROM r JOIN m USING (id) GROUP BY 1, 2) SELECT split, count(*) AS components, sum(n)::BIGINT AS rows, max(n) AS largest FROM n GROUP BY 1")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.sizes_by_split(_members(spark, d), _records(spark, d), "source_id", "split")


@query(_COMPONENTS + " SELECT root, count(*) AS rows, count(DISTINCT r.group_id) AS captions, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM r JOIN m USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def excluded_components(spark: SparkSession, d: str) -> DataFrame:
    """Components that stand in several splits, with the caption groups they take along."""
    return components.excluded_components(_members(spark, d), _records(spark, d), "source_id", "split", "group_id")


@query(_COMPONENTS + " , x AS (SELECT root FROM r JOIN m USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1) SELECT r.id AS source_id, root, split, count(*) AS rows FROM r JOIN m USING (id) WHERE root NOT IN (SELECT root FROM x) GROUP BY 1, 2, 3")
def single_role_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the components of one split."""
    kept, _ = audits.single_role(_records(spark, d), _members(spark, d), "source_id", "split")
    return kept.groupBy("source_id", "root", "split").agg(F.count(F.lit(1)).alias("rows"))


_ONE = "(SELECT * FROM highres_manifest QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at, path) = 1)"
_NAMES = ("sd21", "sd3", "sdxl")


def _crop(part: int, side: str) -> str:
    return f"round_even(('0x' || substr(sha256('7:crop:' || l.group_id), {1 + 16 * part}, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE * (source_{side} - 384), 0)::INT"


_CORPUS = f"""
WITH RECURSIVE l AS (SELECT *, CASE WHEN label = 0 AND generator = 'real' THEN 'real' WHEN label = 1 AND generator != 'real' THEN generator END AS role FROM {_ONE} WHERE least(source_width, source_height) >= 512 AND generator IN ('real', 'sd21', 'sd3', 'sdxl')),
h AS (SELECT group_id FROM l WHERE role IS NOT NULL AND group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role) = 4),
a AS (SELECT group_id, ['sd21', 'sd3', 'sdxl'][((row_number() OVER (ORDER BY sha256('7:allocation:' || group_id), group_id) - 1) % 3 + 1)::INT] AS kind FROM h),
t AS (SELECT group_id, role, arg_min(source_id, (sha256('7:row:' || group_id || ':' || role || ':' || source_id), source_id)) AS id FROM l JOIN a USING (group_id) WHERE role = 'real' OR role = kind GROUP BY 1, 2),
r AS (SELECT l.source_id AS id, l.group_id AS group_id, l.role AS role, official_split AS split, {_hash_sql("pixel_sha256")} AS p, {_hash_sql("source_sha256")} AS s, {_crop(0, "width")} AS crop_left, {_crop(1, "height")} AS crop_top,
  CASE WHEN regexp_full_match({_P.replace("decoded_phash_rgb", "phash")}, '[0-9a-f]{{1,16}}') AND NOT regexp_full_match({_P.replace("decoded_phash_rgb", "phash")}, '0+|f+') THEN lpad({_P.replace("decoded_phash_rgb", "phash")}, 16, '0') END AS x FROM l JOIN t ON l.source_id = t.id AND l.role = t.role),
k AS (SELECT id, 'g' || group_id AS k FROM r UNION SELECT id, 'p' || p FROM r WHERE p IS NOT NULL UNION SELECT id, 's' || s FROM r WHERE s IS NOT NULL),
n AS (SELECT id, group_id, ('0x' || substr(x, 1, 8))::BIGINT AS hi, ('0x' || substr(x, 9, 8))::BIGINT AS lo FROM r WHERE x IS NOT NULL),
d0 AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b USING (k) WHERE a.id != b.id UNION SELECT a.id, b.id FROM n a JOIN n b ON a.group_id != b.group_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8),
w(id, root) AS (SELECT id, id FROM r UNION SELECT d0.v, w.root FROM w JOIN d0 ON d0.u = w.id), m AS (SELECT id, min(root) AS root FROM w GROUP BY 1),
z AS (SELECT root, count(*) AS rows, count(DISTINCT group_id) AS captions, string_agg(DISTINCT split, '+' ORDER BY split) AS splits, count(DISTINCT split) AS s, 'corpus:' || substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 24) AS component FROM r JOIN m USING (id) GROUP BY 1)"""


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    rows = table(spark, d, "highres_manifest")
    one = selection.first_by_hash(rows, ["source_id"], F.col("loaded_at"), F.col("path"))
    return audits.corpus_build(one, _NAMES, Scratch(spark, "corpus"))


@query(_CORPUS + " SELECT r.id AS source_id, group_id, role, split, component, crop_left, crop_top FROM r JOIN m USING (id) JOIN z USING (root) WHERE z.s = 1")
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole build of a paired corpus: filter, complete groups, dealt generators, crops, components, source splits kept."""
    return _corpus(spark, d)[0].select("source_id", "group_id", "role", "split", "component", "crop_left", "crop_top")


@query(_CORPUS + " SELECT root, rows, captions, splits FROM z WHERE s > 1")
def corpus_left_out(spark: SparkSession, d: str) -> DataFrame:
    """The components that the build leaves out."""
    return _corpus(spark, d)[1]


_SHA = "regexp_full_match({}, '[0-9a-f]{{64}}')"
_PARTS = {
    "label": "label IN (0, 1)", "real has label 0": "(generator = 'real') = (label = 0)", "split": "split IN ('train', 'val', 'test')", "extent": "width = crop_size AND height = crop_size",
    "crop lies inside": "crop_left >= 0 AND crop_top >= 0 AND crop_left + crop_size <= source_width AND crop_top + crop_size <= source_height", "file hash": _SHA.format("sha256"), "pixel hash": _SHA.format("pixel_sha256"),
    "perceptual hash": "regexp_full_match(phash, '[0-9a-f]{16}')",
}
_KEYED = " UNION ALL ".join(f"SELECT '{k}' AS key, {r} AS required, CASE WHEN {sql_strip(k)} != '' THEN {k} END AS v, coalesce(split, '(null)') AS s FROM highres_manifest" for k, r in (("leakage_group", True), ("group_id", True), ("sha256", False), ("pixel_sha256", False)))


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (NOT coalesce({c}, false)) AS rows FROM highres_manifest" for k, c in _PARTS.items())
    + "".join(f" UNION ALL SELECT '{c} again', count({c}) - count(DISTINCT {c}) FROM highres_manifest" for c in ("source_id", "path"))
    + f" UNION ALL SELECT key || ' blank', count(*) FROM ({_KEYED}) WHERE v IS NULL AND required GROUP BY key"
    + f" UNION ALL SELECT key || ' crossing', sum(n)::BIGINT FROM (SELECT key, v, count(*) AS n FROM ({_KEYED}) WHERE v IS NOT NULL GROUP BY 1, 2 HAVING min(s) < max(s)) GROUP BY key"
)
def corpus_problems(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the delivered manifest from being a finished corpus."""
    return audits.corpus_problems(table(spark, d, "highres_manifest"))
