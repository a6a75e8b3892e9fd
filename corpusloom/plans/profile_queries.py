"""Queries of the column profile, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import profile
from corpusloom.scratch import Scratch
from corpusloom.sources.tables import table

#: The columns that the table column_expectations describes.
EXPECTED = ("format", "mode", "nsfw_flag", "source_width")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every load against the expectations and the load before."""
    values = profile.masked(table(spark, d, "source_catalog"), "load_no", EXPECTED)
    return profile.findings(profile.classified(values, table(spark, d, "column_expectations")))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of all columns of every load, with its findings."""
    rows = table(spark, d, "source_catalog")
    return profile.column_profile(rows, "load_no", rows.columns, Scratch(spark, "profile"), table(spark, d, "column_expectations"))


def p2_rare_masks(spark: SparkSession, d: str) -> DataFrame:
    """Values of all columns a load under masks that less than 1 % of the column's non-missing rows bear."""
    rows = table(spark, d, "source_catalog")
    return profile.rare_masks(rows, "load_no", [c for c in rows.columns if c != "load_no"], Scratch(spark, "profile"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_profile, p2_rare_masks)}

_MISSING = "('', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', '?', '-')"
_STRIP = r"lower(regexp_replace(value, '^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$', '', 'g'))"

#: All columns of the catalogue but the load's number.
_COLUMNS = (
    "locator", "repository_id", "revision", "shard_path", "row_index", "image_name", "format", "source_width", "source_height", "mode", "model_name", "nsfw_flag", "prompt_hash", "prompt_present", "content_group_id",
    "real_source", "subset", "source_split", "label", "architecture", "loaded_at",
)
_FINDINGS = rf"""cells4 AS (
  SELECT load_no, 'format' AS column_name, format AS value FROM source_catalog
  UNION ALL SELECT load_no, 'mode', mode FROM source_catalog
  UNION ALL SELECT load_no, 'nsfw_flag', nsfw_flag FROM source_catalog
  UNION ALL SELECT load_no, 'source_width', source_width FROM source_catalog),
kinds AS (
  SELECT c.load_no, c.column_name, c.value, e.allowed_values IS NULL AS num,
    CASE WHEN c.value IS NULL OR {_STRIP} IN {_MISSING} THEN 'missing'
         WHEN e.allowed_values IS NOT NULL THEN CASE WHEN list_contains(string_split(e.allowed_values, '|'), c.value) THEN 'valid' ELSE 'invalid' END
         WHEN NOT regexp_full_match(c.value, '0|[1-9][0-9]*') THEN 'invalid'
         WHEN CAST(c.value AS HUGEINT) BETWEEN e.min_value AND e.max_value THEN 'valid' ELSE 'outside' END AS kind
  FROM cells4 c JOIN column_expectations e ON c.column_name = e.column_name),
loads AS (
  SELECT column_name, load_no, bool_and(num) AS num, count(*) AS n, count(*) FILTER (kind = 'missing') / count(*) AS missing, count(*) FILTER (kind = 'invalid') / count(*) AS invalid,
    count(*) FILTER (kind = 'outside') / count(*) AS outside, count(*) FILTER (kind = 'valid') AS valid
  FROM kinds GROUP BY 1, 2),
shares AS (
  SELECT k.column_name, k.load_no,
    CASE WHEN NOT k.num THEN k.value WHEN CAST(k.value AS HUGEINT) < 512 THEN 'a' WHEN CAST(k.value AS HUGEINT) = 512 THEN 'b' WHEN CAST(k.value AS HUGEINT) < 1024 THEN 'c' WHEN CAST(k.value AS HUGEINT) = 1024 THEN 'd' ELSE 'e' END AS v,
    count(*) / any_value(l.valid) AS share
  FROM kinds k JOIN loads l USING (column_name, load_no) WHERE kind = 'valid' GROUP BY 1, 2, 3),
moved AS (
  SELECT coalesce(a.column_name, b.column_name) AS column_name, coalesce(a.load_no, b.load_no + 1) AS load_no, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 AS shift
  FROM shares a FULL JOIN shares b ON a.column_name = b.column_name AND a.v = b.v AND a.load_no = b.load_no + 1 GROUP BY 1, 2),
fresh AS (
  SELECT DISTINCT column_name, load_no FROM shares s
  WHERE share >= 0.03 AND load_no > 1 AND column_name != 'source_width'
    AND NOT EXISTS (SELECT 1 FROM shares t WHERE t.column_name = s.column_name AND t.v = s.v AND t.load_no < s.load_no))"""
_FOUND = """SELECT a.load_no, a.column_name, 'missing' AS finding FROM loads a JOIN loads b ON a.column_name = b.column_name AND a.load_no = b.load_no + 1 WHERE abs(a.missing - b.missing) > 0.10
UNION ALL SELECT load_no, column_name, 'invalid' FROM loads WHERE invalid > 0.05
UNION ALL SELECT load_no, column_name, 'range' FROM loads WHERE num AND outside > 0.02
UNION ALL SELECT m.load_no, m.column_name, 'shift' FROM moved m JOIN loads l ON m.column_name = l.column_name AND m.load_no = l.load_no WHERE m.load_no > 1 AND shift > 0.25 AND l.valid > 0
UNION ALL SELECT load_no, column_name, 'new_value' FROM fresh"""
# Classes are single signs below U+0006 until runs are collapsed; what may be a hash stands between two U+000E.
_CLASSES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\p{Lu}', chr(1), 'g'), '\p{Ll}', chr(2), 'g'), '\p{L}', chr(3), 'g'), '\p{Nd}', chr(4), 'g'), '[\s\x1c-\x1f\x85\p{Z}]', chr(5), 'g')"
_HASH = "regexp_full_match(p, '[0-9{0}]{{16,}}') AND regexp_matches(p, '[{0}]') AND regexp_matches(p, '[0-9]')"
_MARK = f"CASE WHEN {_HASH.format('a-f')} THEN 'h{{' || length(p) || '}}' WHEN {_HASH.format('A-F')} THEN 'H{{' || length(p) || '}}' ELSE {_CLASSES} END"
_MASKS = (
    "cells AS (" + " UNION ALL ".join(f"SELECT load_no, '{c}' AS column_name, {c}::VARCHAR AS value FROM source_catalog" for c in _COLUMNS) + "),\n"
    + f"v AS (SELECT load_no, column_name, CASE WHEN {_STRIP} NOT IN {_MISSING} THEN value END AS value, count(*) AS n FROM cells GROUP BY ALL),\n"
    + rf"w AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(value, '([0-9a-f]{{16,}}|[0-9A-F]{{16,}})', chr(14) || '\1' || chr(14), 'g'), chr(14)), lambda p: {_MARK}), '') AS m FROM v)," + "\n"
    + "u AS (SELECT *, CASE WHEN value IS NULL THEN '(missing)' ELSE translate(" + "regexp_replace(" * 5 + "m" + "".join(f", chr({k}) || '+', chr({k}), 'g')" for k in range(1, 6)) + ", chr(1) || chr(2) || chr(3) || chr(4) || chr(5), 'Aax9_') END AS mask FROM w),\n"
    + "g AS (SELECT load_no, column_name, mask, sum(n)::BIGINT AS n, count(value) AS distinct_values, min(value) AS lo, max(value) AS hi, min(TRY_CAST(value AS BIGINT)) AS lo_n, max(TRY_CAST(value AS BIGINT)) AS hi_n FROM u GROUP BY 1, 2, 3),\n"
    + "k AS (SELECT *, mask != '(missing)' AS there, coalesce(sum(n) FILTER (mask != '(missing)') OVER (PARTITION BY column_name, mask) / sum(n) FILTER (mask != '(missing)') OVER (PARTITION BY column_name) >= 0.01, false) AS dominant FROM g)"
)

SQL: dict[str, str] = {
    "p2_found": f"WITH {_FINDINGS}\n{_FOUND}",
    "p2_profile": f"""WITH {_FINDINGS},
found AS ({_FOUND}),
said AS (SELECT load_no, column_name, string_agg(finding, '+' ORDER BY finding) AS said FROM found GROUP BY 1, 2),
{_MASKS},
per AS (SELECT load_no, column_name, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (there), 0)::BIGINT AS present, sum(distinct_values)::BIGINT AS distinct_values, min(lo) AS min_value, max(hi) AS max_value,
  min(lo_n) FILTER (mask = '9') AS min_number, max(hi_n) FILTER (mask = '9') AS max_number, count(*) FILTER (there) AS masks, arg_max(mask, (n, mask)) FILTER (there) AS top_mask,
  coalesce(sum(n) FILTER (there AND NOT dominant), 0)::BIGINT AS rare, arg_max(mask, (n, mask)) FILTER (there AND NOT dominant) AS rare_example, row_number() OVER (PARTITION BY column_name ORDER BY load_no NULLS FIRST) AS no FROM k GROUP BY 1, 2),
s AS (SELECT k.column_name, no, mask, n / present AS share FROM k JOIN per ON k.column_name = per.column_name AND k.load_no IS NOT DISTINCT FROM per.load_no WHERE there),
d AS (SELECT coalesce(a.column_name, b.column_name) AS column_name, coalesce(a.no, b.no + 1) AS no, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 AS divergence
  FROM s a FULL JOIN s b ON a.column_name = b.column_name AND a.mask = b.mask AND a.no = b.no + 1 GROUP BY 1, 2)
SELECT per.load_no, per.column_name, rows, round(1 - present / rows, 6) AS missing_share, distinct_values, min_value, max_value, min_number, max_number, masks, top_mask,
  round(CASE WHEN present > 0 THEN rare / present ELSE 0 END, 6) AS rare_share, rare_example, CASE WHEN no > 1 THEN round(divergence, 6) END AS divergence,
  CASE WHEN per.column_name IN (SELECT column_name FROM column_expectations) THEN coalesce(said, '') END AS findings
FROM per LEFT JOIN d USING (column_name, no) LEFT JOIN said ON said.load_no = per.load_no AND said.column_name = per.column_name""",
    "p2_rare_masks": f"WITH {_MASKS} SELECT load_no, column_name, mask, n AS rows, distinct_values, lo AS example FROM k WHERE there AND NOT dominant",
}
