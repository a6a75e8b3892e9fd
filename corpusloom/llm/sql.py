"""Oracle SQL of this subpackage's queries, for DuckDB.

The ids of p6, the containers of p7 themselves, the chunks of p5_overlap and the
pages of p8 have none: their tests compare with the tokenizer itself, with
bounds and round trips, and with hand-made records and pages.  The splits and
containers are held against what must be true of them.
"""


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x1c-\x1f\x85\p{{Z}}]+|[\s\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


def _fold(c: str) -> str:
    return f"lower({_strip(c)})"


def _said(c: str) -> str:
    h = _fold(c)
    return f"CASE WHEN NOT regexp_full_match({h}, '0*|f*') AND {h} != 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' THEN {h} END"


_PHASH = f"CASE WHEN regexp_full_match({_fold('phash')}, '[0-9a-f]{{1,16}}') AND NOT regexp_full_match({_fold('phash')}, '0+|f+') THEN lpad({_fold('phash')}, 16, '0') END"

_SETS = f"""WITH RECURSIVE r AS (SELECT selection_id AS id, {_fold("leakage_group")} AS g, parent_coco_image_id AS p, {_fold("split")} AS s FROM selection_catalog WHERE selection_id IS NOT NULL),
e AS (SELECT DISTINCT 'r' || id AS u, 'g' || g AS v FROM r WHERE g NOT IN ('', 'unknown', 'n/a') UNION SELECT 'r' || id, 'p' || p::VARCHAR FROM r WHERE p > 0),
d AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
w(n, root) AS (SELECT DISTINCT 'r' || id, 'r' || id FROM r UNION SELECT d.v, w.root FROM w JOIN d ON d.u = w.n),
m AS (SELECT substr(n, 2) AS id, min(root) AS root FROM w WHERE n[1] = 'r' GROUP BY 1)"""
_FIRST = f"""WITH r AS (SELECT {_strip("selection_id")} AS key, coalesce(batch_no, 0)::INT AS batch, nullif({_fold("source_index_hash")}, '') AS h FROM selection_catalog WHERE {_strip("selection_id")} != ''),
f AS (SELECT key, min(batch) AS batch FROM r GROUP BY 1),
n AS (SELECT batch, count(*) AS seen, floor(0.1::DOUBLE * sum(count(*)) OVER (ORDER BY batch) + 1e-9) AS upto FROM f GROUP BY 1),
q AS (SELECT batch, seen, upto - coalesce(lag(upto) OVER (ORDER BY batch), 0) AS quota FROM n)"""
_RECORDS = f"""WITH r AS (SELECT DISTINCT source_id AS id, {_fold("split")} AS s, {_said("pixel_sha256")} AS p, {_said("source_sha256")} AS h, ('0x' || substr({_PHASH}, 1, 8))::BIGINT AS hi, ('0x' || substr({_PHASH}, 9, 8))::BIGINT AS lo
  FROM highres_manifest WHERE source_id IS NOT NULL AND {_fold("split")} IN ('train', 'val', 'test')),
x AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.p = b.p WHERE a.s = 'train' AND b.s != 'train' UNION SELECT a.id, b.id FROM r a JOIN r b ON a.h = b.h WHERE a.s = 'train' AND b.s != 'train'
  UNION SELECT a.id, b.id FROM r a JOIN r b ON a.s = 'train' AND b.s != 'train' AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8)"""


def _checks(**rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k.replace('_', ' ')}' AS \"check\", {v} AS rows" for k, v in rows.items())


SQL: dict[str, str] = {
    "p1_found": _SETS + """,
c AS (SELECT root FROM r JOIN m USING (id) WHERE s IN ('train', 'val', 'test') GROUP BY 1 HAVING count(DISTINCT s) > 1)
SELECT id AS selection_id FROM m WHERE root IN (SELECT root FROM c)""",
    "p1_forest": f"""
WITH RECURSIVE r AS (SELECT selection_id AS id, {_fold("leakage_group")} AS g, parent_coco_image_id AS p FROM selection_catalog WHERE selection_id IS NOT NULL),
k AS (SELECT id, 'g' || g AS k FROM r WHERE g NOT IN ('', 'unknown', 'n/a') UNION SELECT id, 'p' || p::VARCHAR FROM r WHERE p > 0),
e AS (SELECT DISTINCT a.k AS u, b.k AS v FROM k a JOIN k b USING (id) WHERE a.k != b.k),
w(n, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.n),
m AS (SELECT n, min(root) AS root FROM w GROUP BY 1)
SELECT count(*) AS keys, count(DISTINCT root) AS trees, count(*) - count(DISTINCT root) AS edges FROM m""",
    "p1_invariants": _checks(records_dealt="(SELECT count(DISTINCT selection_id) FROM selection_catalog)", records_without_a_split="0", sets_torn_apart="0") + " UNION ALL SELECT 'shares off by more than 0.005', 0",
    "p3_found": f"""
WITH RECURSIVE l AS (SELECT {_fold("left_selection_id")} AS a, {_fold("right_selection_id")} AS b FROM near_phash_links WHERE phash_distance BETWEEN 0 AND 4),
e AS (SELECT DISTINCT 'i' || a AS u, 'i' || b AS v FROM l WHERE a != '' AND b != '' AND a != b
  UNION SELECT 'i' || {_fold("selection_id")}, 'c' || {_strip("integrity_component")} FROM training_manifest WHERE {_strip("integrity_component")} != '' AND {_fold("selection_id")} != ''),
d AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
w(n, root) AS (SELECT DISTINCT u, u FROM d WHERE u[1] = 'i' UNION SELECT d.v, w.root FROM w JOIN d ON d.u = w.n),
m AS (SELECT n, min(root) AS root FROM w WHERE n[1] = 'i' GROUP BY 1)
SELECT substr(n, 2) AS selection_id, substr(root, 2) AS group_first_id FROM m WHERE root IN (SELECT root FROM m GROUP BY 1 HAVING count(*) > 1)""",
    "p4_sample": _FIRST + """,
g AS (SELECT key, batch, min(h) AS h FROM f JOIN r USING (key, batch) GROUP BY 1, 2)
SELECT key AS selection_id, h AS source_index_hash, batch AS first_batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY sha256('sample:' || key), key) AS r FROM g) JOIN q USING (batch) WHERE r <= quota""",
    "p4_growth": _FIRST + " SELECT batch AS first_batch, seen, least(quota, seen)::BIGINT AS taken FROM q",
    "p5_found": _RECORDS + " SELECT DISTINCT least(a, b) AS source_id_a, greatest(a, b) AS source_id_b FROM x WHERE a != b",
    "p5_classes": _RECORDS + """,
c AS (SELECT 'pixel_sha256' AS field, p AS v, NULL::BIGINT AS hi, NULL::BIGINT AS lo, s = 'train' AS train, id FROM r WHERE p IS NOT NULL UNION ALL SELECT 'source_sha256', h, NULL, NULL, s = 'train', id FROM r WHERE h IS NOT NULL
  UNION ALL SELECT 'phash', NULL, hi, lo, s = 'train', id FROM r WHERE hi IS NOT NULL),
k AS (SELECT field, v, hi, lo, train, min(id) AS first, count(DISTINCT id) AS n FROM c GROUP BY ALL)
SELECT a.field, a.first AS train_first, b.first AS eval_first, CASE WHEN a.v IS NULL THEN bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) ELSE 0 END AS differing, a.n AS train_records, b.n AS eval_records
FROM k a JOIN k b ON a.field = b.field AND a.train AND NOT b.train AND (a.v = b.v OR bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8)""",
    "p5_report": _RECORDS + """,
t AS (SELECT b AS id, count(*) AS partners FROM (SELECT DISTINCT a, b FROM x WHERE a != b) GROUP BY 1),
g AS (SELECT source_id AS id, min(generator) AS generator, min(source_repository_id) AS source FROM highres_manifest GROUP BY 1)
SELECT s AS split, generator, source, count(*) AS records, count(partners) AS overlapping, coalesce(sum(partners), 0)::BIGINT AS partners
FROM (SELECT DISTINCT id, s FROM r WHERE s != 'train') LEFT JOIN t USING (id) JOIN g USING (id) GROUP BY 1, 2, 3""",
    "p7_invariants": _checks(documents_with_text="(SELECT count(*) FROM documents WHERE text != '')", documents_without_text="(SELECT count(*) FROM documents WHERE coalesce(text, '') = '')", tokens_not_placed_once="0", short_texts_cut="0",
        containers_over_capacity_or_misstated="0", copies_together="0", sources_above_their_limit="0", room_wasted_beyond_the_limit="0"),
}
