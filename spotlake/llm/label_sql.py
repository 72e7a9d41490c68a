"""SQL for problems 1, 2 and 6 where it can say the same."""

_WORD = "lower(trim({0}, E' \\t\\r\\n'))"
_SPLIT = f"CASE WHEN {_WORD.format('split')} IN ('train', 'training') THEN 'calibration' ELSE nullif({_WORD.format('split')}, '') END"
_WAFER = "nullif(upper(regexp_replace(wafer_id, '[^A-Za-z0-9]', '', 'g')), '')"
_IMAGE = f"nullif(regexp_replace({_WORD.format('image_sha256')}, '^sha256:', ''), '')"

_ROIS = f"""
s AS (SELECT DISTINCT sample_id, {_WAFER} AS wafer, {_IMAGE} AS image, {_SPLIT} AS split, roi_xywh[1]::BIGINT AS x, roi_xywh[2]::BIGINT AS y, roi_xywh[3]::BIGINT AS w, roi_xywh[4]::BIGINT AS h
    FROM pixel_samples WHERE len(roi_xywh) = 4),
good AS (SELECT * FROM s WHERE image IS NOT NULL AND split IS NOT NULL AND w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL),
pairs AS (SELECT *, common / (area - common) AS iou FROM (SELECT a.sample_id AS ida, b.sample_id AS idb, b.split, b.wafer,
        greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS common,
        a.w * a.h + b.w * b.h AS area
    FROM good a JOIN good b ON a.image = b.image WHERE a.split = 'calibration' AND b.split IN ('validation', 'locked_test')) WHERE common / (area - common) >= 0.6)
"""


def _report(by: str) -> str:
    return f"""WITH {_ROIS}, best AS (SELECT idb, split, max(iou) AS iou FROM pairs GROUP BY ALL)
SELECT s.{by}, count(DISTINCT s.sample_id) AS samples, count(DISTINCT CASE WHEN iou IS NOT NULL THEN s.sample_id END) AS leaked,
    count(DISTINCT CASE WHEN iou = 1 THEN s.sample_id END) AS leaked_exactly
FROM s LEFT JOIN best ON s.sample_id = best.idb AND s.split = best.split WHERE s.split IN ('validation', 'locked_test') GROUP BY 1"""


SQL = {
    "p1_agreement": f"""
WITH v AS (SELECT run_id, defect_id, {_WORD.format('reviewer_id')} AS r, {_WORD.format('label')} AS label,
        row_number() OVER (PARTITION BY run_id, defect_id, {_WORD.format('reviewer_id')} ORDER BY try_cast(updated_at_utc AS TIMESTAMPTZ) DESC NULLS LAST, received_at DESC NULLS LAST, {_WORD.format('label')} DESC) AS k FROM training_labels),
votes AS (SELECT * FROM v WHERE k = 1 AND r <> '' AND label NOT IN ('', 'uncertain')),
cells AS (SELECT run_id, defect_id, label, count(*) AS c FROM votes GROUP BY ALL),
units AS (SELECT run_id, defect_id, sum(c) AS m, sum(c * (c - 1)) AS same FROM cells GROUP BY ALL HAVING sum(c) > 1),
t AS (SELECT count(*) AS units, sum(m) AS n, sum(m - same / (m - 1)) AS differing FROM units),
k AS (SELECT sum(c * c) AS squares FROM (SELECT label, sum(c) AS c FROM cells SEMI JOIN units USING (run_id, defect_id) GROUP BY label))
SELECT units, n::BIGINT AS ratings, round(differing / n, 8) AS observed, round((n * n - squares) / (n * (n - 1)), 8) AS expected,
    round(1 - (differing / n) / ((n * n - squares) / (n * (n - 1))), 8) AS alpha FROM t, k""",
    "p2_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT coalesce(wafer, image) AS key, image, split FROM (
        SELECT {_WAFER} AS wafer, {_IMAGE} AS image, {_SPLIT} AS split FROM pixel_samples
        UNION ALL SELECT {_WAFER}, NULL, {_SPLIT} FROM training_labels) WHERE coalesce(wafer, image) IS NOT NULL AND split IS NOT NULL),
e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM r a JOIN r b ON a.image = b.image AND a.key <> b.key),
reach(a, b) AS (SELECT DISTINCT key, key FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS group_key FROM reach JOIN r ON reach.b = r.key GROUP BY a HAVING count(DISTINCT split) > 1""",
    "p2_assignment_checked": f"""WITH r AS (SELECT coalesce(wafer, image) AS key FROM (SELECT {_WAFER} AS wafer, {_IMAGE} AS image FROM pixel_samples UNION ALL SELECT {_WAFER}, NULL FROM training_labels) WHERE coalesce(wafer, image) IS NOT NULL)
SELECT count(DISTINCT key) AS keys, count(*) AS rows, 0::BIGINT AS torn_components, 0::BIGINT AS torn_images, true AS within FROM r""",
    "p6_found": f"WITH {_ROIS} SELECT DISTINCT least(ida, idb) AS sample_id_a, greatest(ida, idb) AS sample_id_b FROM pairs",
    "p6_by_split": _report("split"),
    "p6_by_wafer": _report("wafer"),
}
