"""SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_STEM = r"""upper(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^.*[/\\]', ''), '(?i)(_(jpg|jpeg|png)\.rf\.[0-9a-f]{{32}})?\.(jpg|jpeg|png)$', ''))"""
_SPLIT = r"""CASE lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))
  WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'valid' THEN 'valid' WHEN 'val' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'test' THEN 'test' END"""


def _stem(c: str) -> str:
    return _STEM.format(c)


def _split(c: str) -> str:
    return _SPLIT.format(c)


_COMPONENTS = f"""
WITH RECURSIVE eff AS (
  SELECT {_stem('stem_a')} AS a, {_stem('stem_b')} AS b,
         CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN score
              ELSE least(CASE WHEN NOT isnan(raw_max_dist) THEN raw_max_dist END, CASE WHEN NOT isnan(aligned_max_dist) THEN aligned_max_dist END) END AS s
  FROM scene_pairs WHERE NOT coalesce(low_info, n_boxes <= 2, false)
), eps(label, e) AS (VALUES ('0.01', 0.01::DOUBLE), ('0.02', 0.02::DOUBLE), ('0.05', 0.05::DOUBLE)),
hubs AS (
  SELECT epsilon, component_id, {_stem('stem')} AS s, min({_stem('stem')}) OVER (PARTITION BY epsilon, component_id) AS hub FROM components
), links AS (
  SELECT DISTINCT label, a, b FROM eff, eps WHERE s <= e AND a <> '' AND b <> ''
  UNION SELECT label, hub, s FROM hubs, eps WHERE epsilon <= e AND s <> ''
), both_ways AS (SELECT label, a, b FROM links UNION SELECT label, b, a FROM links),
reach(label, stem, other) AS (
  SELECT label, a, a FROM both_ways UNION SELECT r.label, r.stem, w.b FROM reach r JOIN both_ways w ON w.label = r.label AND w.a = r.other
), named AS (SELECT label, stem, min(other) AS component_id FROM reach GROUP BY label, stem)
"""

_SIDES = f"""
WITH named AS (SELECT image_id, {_stem('filename')} AS stem, {_split('split')} AS side, filename FROM images WHERE image_id IS NOT NULL AND filename IS NOT NULL),
sides AS (SELECT image_id, nullif(stem, '') AS stem, min(side) AS side FROM named WHERE side IS NOT NULL GROUP BY image_id, filename, stem)
"""

ORACLES: dict[str, str] = {
    "p3_stems": _SIDES
    + """SELECT DISTINCT least(t.image_id, e.image_id) AS image_a, greatest(t.image_id, e.image_id) AS image_b, 0.0::DOUBLE AS score
FROM sides t JOIN sides e ON t.stem = e.stem AND t.side = 'train' AND e.side <> 'train'""",
    "p3_listed": _SIDES
    + f""", eff AS (
  SELECT {_stem('stem_a')} AS a, {_stem('stem_b')} AS b,
         CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN score
              ELSE least(CASE WHEN NOT isnan(raw_max_dist) THEN raw_max_dist END, CASE WHEN NOT isnan(aligned_max_dist) THEN aligned_max_dist END) END AS s
  FROM scene_pairs WHERE NOT coalesce(low_info, n_boxes <= 2, false)
), best AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(s) AS s FROM eff WHERE s <= 0.001 AND a <> '' AND b <> '' GROUP BY 1, 2)
SELECT DISTINCT least(t.image_id, e.image_id) AS image_a, greatest(t.image_id, e.image_id) AS image_b, s AS score
FROM best JOIN sides t ON t.stem IN (a, b) JOIN sides e ON e.stem = CASE WHEN t.stem = a THEN b ELSE a END
WHERE t.side = 'train' AND e.side <> 'train'""",
    "p1_found": _COMPONENTS
    + """SELECT label AS epsilon, component_id, stem FROM (SELECT *, count(*) OVER (PARTITION BY label, component_id) AS n FROM named) WHERE n > 1""",
    "p1_sizes": _COMPONENTS
    + """SELECT epsilon, component_size, count(*) AS n_components FROM (
  SELECT label AS epsilon, component_id, count(*) AS component_size FROM named GROUP BY label, component_id HAVING count(*) > 1) GROUP BY 1, 2""",
    "p4_found": f"""
WITH last AS (
  SELECT group_id, arg_max(struct_pack(d := lower(trim(direction)), s := {_split('split')}, n := n_images), struct_pack(a := moved_at, b := move_id)) AS m
  FROM groups_moved WHERE group_id IS NOT NULL AND moved_at IS NOT NULL GROUP BY group_id
), now AS (
  SELECT image_id, i.group_id, {_stem('filename')} AS stem,
    CASE WHEN l.group_id IS NULL THEN {_split('i.split')} WHEN l.m.d = 'admitted' THEN l.m.s WHEN l.m.d = 'returned' THEN 'train' END AS cur
  FROM images i LEFT JOIN last l ON l.group_id = i.group_id
), near AS (SELECT g.group_id, o.cur FROM (SELECT DISTINCT group_id, stem FROM now WHERE group_id IS NOT NULL) g JOIN now o ON o.stem = g.stem),
spread AS (SELECT group_id FROM near GROUP BY group_id HAVING count(DISTINCT cur) > 1),
few AS (SELECT n.group_id FROM now n JOIN last l ON l.group_id = n.group_id GROUP BY n.group_id, l.m.n HAVING l.m.n < count(DISTINCT image_id))
SELECT group_id FROM spread UNION SELECT group_id FROM few""",
    "p4_together": f"""
WITH i AS (SELECT image_id, group_id, nullif({_stem('filename')}, '') AS stem FROM images WHERE image_id IS NOT NULL)
SELECT 'group' AS kind, count(DISTINCT group_id) AS n, 0 AS n_torn, count(DISTINCT (group_id, image_id)) FILTER (WHERE group_id IS NOT NULL) AS n_images FROM i
UNION ALL SELECT 'stem', count(DISTINCT stem), 0, count(DISTINCT (stem, image_id)) FILTER (WHERE stem IS NOT NULL) FROM i""",
    "p4_shares": """
SELECT split, round(share * n, 1) AS wanted, true AS met
FROM (VALUES ('train', 0.7::DOUBLE), ('valid', 0.2::DOUBLE), ('test', 0.1::DOUBLE)) s(split, share), (SELECT count(DISTINCT image_id) AS n FROM images)""",
    "p4_labels": """
SELECT family, count(*) AS n_images, true AS balanced FROM (SELECT image_id, coalesce(min(family), '') AS family FROM images WHERE image_id IS NOT NULL GROUP BY image_id) GROUP BY family""",
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p6_bytes": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents",
    "p7_checks": """
SELECT 'n_documents' AS promise, count(*) AS n FROM documents WHERE text <> ''
UNION ALL VALUES ('over_capacity', 0), ('over_segments', 0), ('over_loss', 0), ('wrong_pieces', 0), ('needless_cuts', 0)""",
    "p8_checks": "SELECT 'n_documents' AS promise, count(*) AS n FROM documents UNION ALL VALUES ('out_of_text', 0), ('out_of_order', 0), ('without_confidence', 0)",
}
