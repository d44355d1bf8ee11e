"""SQL for DuckDB of the core's pN_ queries: plain brute force over the whole tables."""

from __future__ import annotations

_SITES = "SELECT site_id, lat, lon FROM institutions_geocoded_precise WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"

P2 = f"""
WITH s AS ({_SITES}),
near AS (
  SELECT a.site_id, 'site' AS near_kind, b.site_id AS near_id FROM s a JOIN s b ON a.site_id < b.site_id
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 75),
rings AS (SELECT zone_id, unnest(regexp_extract_all(boundary_wkt, '\\(([^()]+)\\)', 1)) AS ring FROM catchments),
corners AS (SELECT zone_id, ring, string_split(ring, ',') AS p FROM rings),
steps AS (SELECT zone_id, p, unnest(range(1, len(p))) AS i FROM corners),
ends AS (SELECT zone_id, trim(p[i]) AS a, trim(p[i + 1]) AS b FROM steps),
edges AS (
  SELECT zone_id, split_part(a, ' ', 1)::DOUBLE AS x1, split_part(a, ' ', 2)::DOUBLE AS y1,
         split_part(b, ' ', 1)::DOUBLE AS x2, split_part(b, ' ', 2)::DOUBLE AS y2 FROM ends),
held AS (
  SELECT s.site_id, 'zone' AS near_kind, e.zone_id AS near_id FROM s JOIN edges e
  ON (e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lon < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY s.site_id, e.zone_id HAVING count(*) % 2 = 1)
SELECT * FROM near UNION ALL SELECT * FROM held
"""

_QUOTED = '"(?:[^"]|"")*"'


_NAMES = "basis confidence counted_city current_institution current_title_verbatim evidence_url in_city independent moved_to_city name notes primary_city still_there".split()
_COLUMNS = ", ".join(f"v[list_position(names, '{c}')] AS {c}" for c in _NAMES)
_TRIM = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _whole(d: str) -> str:
    field = f'(?:{_QUOTED}|[^"{d}]*)'
    return f"^{field}(?:{d}{field})*$"


_PARSED = f"""
WITH r AS (
  SELECT raw_id, coalesce(raw_record, '') AS rec, delimiter AS d, header_text AS h FROM rulings_raw JOIN rulings_files USING (source_file)),
shaped AS (
  SELECT *, CASE d WHEN ',' THEN regexp_full_match(rec, '{_whole(",")}') WHEN ';' THEN regexp_full_match(rec, '{_whole(";")}')
                   ELSE regexp_full_match(rec, '{_whole(chr(92) + "t")}') END AS quotes_ok,
         CASE d WHEN ',' THEN regexp_extract_all(rec || d, '({_QUOTED}|[^",]*),', 1) WHEN ';' THEN regexp_extract_all(rec || d, '({_QUOTED}|[^";]*);', 1)
                ELSE regexp_extract_all(rec || d, '({_QUOTED}|[^"\\t]*)\\t', 1) END AS f,
         string_split(h, d) AS names FROM r),
plain AS (
  SELECT *, CASE WHEN NOT quotes_ok THEN 'quoting' WHEN len(f) <> len(names) THEN 'column_count' END AS shape,
         list_transform(f, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM shaped),
named AS (
  SELECT raw_id, shape, {_COLUMNS} FROM plain),
tried AS (
  SELECT *, lower(trim(confidence)) NOT IN ('high', 'medium', 'low', '') AS bad_c,
         trim(evidence_url) <> '' AND NOT regexp_full_match(trim(evidence_url), '(?i)https?://[^\\s/?#:]*[^\\s/?#:.]\\.[^\\s/?#:.][^\\s/?#:]*(:\\d*)?([/?#]\\S*)?') AS bad_u
  FROM named)
"""

P3 = _PARSED + """
SELECT raw_id, shape AS reason FROM tried WHERE shape IS NOT NULL
UNION ALL SELECT raw_id, 'bad_confidence' FROM tried WHERE shape IS NULL AND bad_c
UNION ALL SELECT raw_id, 'bad_evidence_url' FROM tried WHERE shape IS NULL AND bad_u
"""

_LOADED = {"confidence": f"lower({_TRIM.format('confidence')}) AS confidence", "evidence_url": f"{_TRIM.format('evidence_url')} AS evidence_url"}
P3_LOADED = _PARSED + f"""
SELECT raw_id, {", ".join(_LOADED.get(c, c) for c in _NAMES)} FROM tried WHERE shape IS NULL AND NOT bad_c AND NOT bad_u
"""

SQL = {"p2_found": P2, "p3_found": P3, "p3_loaded": P3_LOADED}
