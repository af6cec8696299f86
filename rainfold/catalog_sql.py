"""DuckDB SQL that gives the rows of the catalog's queries in plain, brute-force terms."""

from __future__ import annotations

from rainfold.functions import geodesy

DAILY = "daily AS (SELECT l_shipdate::DATE AS day, count(*)::DOUBLE AS rain_mm FROM lineitem GROUP BY 1)"
PART = "cells AS (SELECT 'part' AS survey, (p_partkey // 40)::INTEGER AS row, (p_partkey % 40)::INTEGER AS col, p_retailprice AS z, p_size > 3 AS valid FROM part)"
TILE = "cells AS (SELECT vec_id AS survey, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, floor(embedding[i + 1]::DOUBLE * 20) AS z, TRUE AS valid FROM embeddings, range(64) t(i))"
DIRS = "dirs(ord, code, dr, dc) AS (VALUES (0, 1, 0, 1), (1, 2, 1, 1), (2, 4, 1, 0), (3, 8, 1, -1), (4, 16, 0, -1), (5, 32, -1, -1), (6, 64, -1, 0), (7, 128, -1, 1))"

# rain and runoff
RAIN_TOTALS = f"""WITH {DAILY}
SELECT year(day)::INTEGER AS year, any_value(make_date(year(day) + 1, 1, 1) - make_date(year(day), 1, 1))::INTEGER AS days_expected, count(*)::BIGINT AS days_present,
  count(*) = any_value(make_date(year(day) + 1, 1, 1) - make_date(year(day), 1, 1)) AS complete, sum(rain_mm) AS annual_mm
FROM daily GROUP BY year(day)"""
RAIN_GAPS = "SELECT d::DATE AS day FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d) WHERE d::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem)"
_SUMMARY = f"""{DAILY}, years AS (SELECT year(day) AS y, count(*) AS n, sum(rain_mm) AS mm FROM daily WHERE year(day) BETWEEN 1996 AND 2000 GROUP BY 1),
summary AS (SELECT coalesce(count(*) FILTER (n = CASE WHEN y IN (1996, 2000) THEN 366 ELSE 365 END) = 5, FALSE) AS fine, avg(mm) AS mean FROM years)"""
RAIN_SUMMARY = f"WITH {_SUMMARY} SELECT CASE WHEN fine THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN fine THEN mean END AS mean_annual_mm FROM summary"
RAIN_JSON = "SELECT DISTINCT event_type, ts::DATE AS day, day(ts)::DOUBLE AS rain_mm FROM events"
RUNOFF = f"""WITH {_SUMMARY}, sites AS (
  SELECT s_suppkey AS site_id, round(abs(s_acctbal), 6) + 0.0 AS area_m2, s_nationkey % 4 = 0 AS boundary_truncated, ((s_suppkey % 9) / 8.0)::DOUBLE AS routing_sensitivity_fraction FROM supplier)
SELECT site_id, area_m2, boundary_truncated, routing_sensitivity_fraction, round(CASE WHEN fine THEN mean END, 6) AS mean_annual_mm,
  round(CASE WHEN fine THEN mean END / 1000 * area_m2 * 0.3::DOUBLE, 6) AS annual_m3,
  concat_ws(',', CASE WHEN boundary_truncated THEN 'catchment_truncated' END, CASE WHEN routing_sensitivity_fraction > 0.5 THEN 'routing_sensitive' END) AS reasons,
  CASE WHEN NOT fine THEN 'unavailable' WHEN boundary_truncated OR routing_sensitivity_fraction > 0.5 THEN 'provisional' ELSE 'estimated' END AS status
FROM sites, summary"""

# storage
PONDS = "ponds AS (SELECT p_partkey AS design_id, (20 + p_partkey % 100)::DOUBLE AS length_m, (15 + p_size)::DOUBLE AS width_m, (1 + p_partkey % 5 * 0.5)::DOUBLE AS depth_m, (p_partkey * 7 % 360)::DOUBLE AS bearing FROM part)"
POND_GEOMETRY = f"""WITH {PONDS}, g AS (SELECT *, depth_m - 0.5::DOUBLE AS dw, length_m - 4 * depth_m AS bl, width_m - 4 * depth_m AS bw, length_m - 2.0::DOUBLE AS wl, width_m - 2.0::DOUBLE AS ww FROM ponds)
SELECT design_id, length_m, width_m, depth_m, bearing, dw AS water_depth_m, bl AS bottom_length_m, bw AS bottom_width_m, length_m * width_m AS footprint_area_m2, wl * ww AS water_area_m2,
  CASE WHEN dw > 0 AND bl > 0 AND bw > 0 THEN round(dw / 6 * (bl * bw + 4 * (bl + 2 * dw) * (bw + 2 * dw) + wl * ww), 6) END AS capacity_m3, (length_m + 10) * (width_m + 10) AS clearance_m2 FROM g"""
POND_CORNERS = f"""WITH {PONDS}, c(corner, sx, sy) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)),
a AS (SELECT *, sx * (width_m / 2 + 5) AS across, sy * (length_m / 2 + 5) AS along, radians(bearing) AS t FROM ponds, c)
SELECT design_id, corner, round(100.0::DOUBLE + across * cos(t) + along * sin(t), 4) + 0.0 AS x, round(200.0::DOUBLE - across * sin(t) + along * cos(t), 4) + 0.0 AS y FROM a"""
_GRID = """made AS (
  SELECT l::DOUBLE AS length_m, w::DOUBLE AS width_m, d::DOUBLE AS depth_m, d::DOUBLE - 0.5::DOUBLE AS deep, l::DOUBLE - 4 * d::DOUBLE AS bl, w::DOUBLE - 4 * d::DOUBLE AS bw
  FROM (VALUES (30), (45), (60)) a(l), (VALUES (20), (30), (40)) b(w), (VALUES (1.5), (2.5)) c(d)),
sized AS (SELECT *, round_even(deep / 6 * (bl * bw + 4 * (bl + 2 * deep) * (bw + 2 * deep) + (length_m - 2) * (width_m - 2)), 2) AS capacity_m3 FROM made),
grid AS (SELECT *, (row_number() OVER (ORDER BY capacity_m3, length_m, width_m, depth_m) - 1)::INTEGER AS candidate FROM sized)"""
_SITES = """sites AS (SELECT p_partkey AS site, 30 + p_size % 40 AS max_length_m, 19 + p_partkey % 25 AS max_width_m, round(p_retailprice::DOUBLE, 2) AS target_m3 FROM part),
fits AS (SELECT site, target_m3, length_m, width_m, depth_m, capacity_m3, (row_number() OVER (PARTITION BY site ORDER BY capacity_m3, length_m, width_m, depth_m) - 1)::INTEGER AS candidate
  FROM sites JOIN grid ON length_m <= max_length_m AND width_m <= max_width_m)"""
CAPACITY_GRID = f"WITH {_GRID}, {_SITES} SELECT site, candidate, length_m, width_m, depth_m, capacity_m3 FROM fits"
SIZE_TARGET = f"""WITH {_GRID}, {_SITES}, n AS (SELECT *, lead(capacity_m3) OVER (PARTITION BY site ORDER BY capacity_m3, candidate) AS up FROM fits),
best AS (SELECT * FROM n WHERE capacity_m3 >= target_m3 QUALIFY row_number() OVER (PARTITION BY site ORDER BY capacity_m3, candidate) = 1),
most AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY site ORDER BY capacity_m3 DESC, candidate DESC) = 1)
SELECT m.site, m.target_m3, b.site IS NOT NULL AS meets_target, coalesce(b.candidate, m.candidate) AS candidate, coalesce(b.capacity_m3, m.capacity_m3) AS capacity_m3, b.up AS next_capacity_m3,
  CASE WHEN b.site IS NULL THEN printf('no size that fits holds %.2f m3; the largest has %.2f m3', m.target_m3, m.capacity_m3)
    WHEN b.up IS NULL THEN printf('%.2f m3 is the least size that holds %.2f m3; there is none above it', b.capacity_m3, m.target_m3)
    ELSE printf('%.2f m3 is the least size that holds %.2f m3; the next one up has %.2f m3', b.capacity_m3, m.target_m3, b.up) END AS reasoning
FROM most m LEFT JOIN best b ON b.site = m.site"""
SIZE_TOO_LARGE = f"WITH {_GRID}, {_SITES} SELECT site, arg_max(candidate, (capacity_m3, candidate)) AS candidate, max(capacity_m3) AS capacity_m3 FROM fits GROUP BY site HAVING max(capacity_m3) < any_value(target_m3) * 100"
SIZE_TIERS = f"""WITH {_GRID}, {_SITES}, n AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM fits),
l AS (SELECT *, CASE WHEN candidate = 0 THEN 'small' WHEN candidate = least(round_even(n / 3.0::DOUBLE, 0), n - 1) THEN 'intermediate' WHEN candidate = least(round_even(2 * n / 3.0::DOUBLE, 0), n - 1) THEN 'large' END AS label FROM n)
SELECT site, candidate, label, capacity_m3 FROM l WHERE label IS NOT NULL"""


def _balance(losses: bool, demand: float = 20.0, initial: float = 0.25) -> str:
    """The daily balance as recursion over days; with losses the water surface comes from 40 bisections."""
    if losses:
        volume = "bl * bw * ((a.lo + a.hi) / 2) + 2 * (bl + bw) * ((a.lo + a.hi) / 2) ** 2 + 16 * ((a.lo + a.hi) / 2) ** 3 / 3"
        h = f"list_reduce(list_prepend({{'lo': 0.0::DOUBLE, 'hi': deep, 'h': 0.0::DOUBLE, 's': s1}}, list_transform(range(40), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 'h': 0.0::DOUBLE, 's': bl * 0 + bw * 0 + s1}})), lambda a, x: CASE WHEN {volume} < a.s THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi, 'h': (a.lo + a.hi) / 2, 's': a.s}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2, 'h': (a.lo + a.hi) / 2, 's': a.s}} END).h"
        area = f"CASE WHEN s1 > 0 THEN (bl + 4 * {h}) * (bw + 4 * {h}) ELSE 0.0::DOUBLE END"
        evaporation, seepage = "least(s1, 0.004::DOUBLE * area)", "least(s1 - evap, 0.001::DOUBLE * area)"
    else:
        area, evaporation, seepage = "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE"
    return f"""{DAILY}, days AS (SELECT day, rain_mm, row_number() OVER (ORDER BY day) AS n FROM daily WHERE year(day) BETWEEN 1996 AND 2000), {_GRID},
bal AS (
  SELECT candidate::BIGINT AS design_id, 0::BIGINT AS n, NULL::DATE AS day, capacity_m3 AS cap, deep, bl, bw, length_m * width_m AS fp, 0.0::DOUBLE AS rain, 0.0::DOUBLE AS runoff, 0.0::DOUBLE AS direct, 0.0::DOUBLE AS over,
    0.0::DOUBLE AS start_s, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS evap, 0.0::DOUBLE AS seep, 0.0::DOUBLE AS sup, {initial}::DOUBLE * capacity_m3 AS end_s FROM grid
  UNION ALL
  SELECT design_id, n, day, cap, deep, bl, bw, fp, rain, runoff, direct, over, start_s, s1, evap, seep, least(s1 - evap - seep, {demand}::DOUBLE), s1 - evap - seep - least(s1 - evap - seep, {demand}::DOUBLE) FROM (
    SELECT *, {seepage} AS seep FROM (SELECT *, {evaporation} AS evap FROM (SELECT *, {area} AS area FROM (
      SELECT *, greatest(0, start_s + runoff + direct - cap) AS over, least(cap, start_s + runoff + direct) AS s1 FROM (
        SELECT b.design_id, d.n, d.day, b.cap, b.deep, b.bl, b.bw, b.fp, d.rain_mm AS rain, d.rain_mm / 1000 * (4000 - b.fp) * 0.3::DOUBLE AS runoff, d.rain_mm / 1000 * b.fp AS direct, b.end_s AS start_s
        FROM bal b JOIN days d ON d.n = b.n + 1)))))),
flows AS (SELECT *, runoff + direct AS inflow, (s1 >= cap - 1e-8)::INTEGER AS is_full, (end_s <= 1e-8)::INTEGER AS is_empty, strftime(day, '%Y-%m') AS month, year(day)::INTEGER AS year,
  CASE WHEN month(day) IN (6, 7, 8, 9) THEN 'monsoon' WHEN month(day) IN (10, 11) THEN 'post_monsoon' ELSE 'dry' END AS season FROM bal WHERE n > 0)"""


_BAL = _balance(False)
BALANCE_DAILY = f'WITH RECURSIVE {_BAL} SELECT design_id, day, round(over, 6) + 0.0 AS overflow_m3, round(sup, 6) + 0.0 AS supplied_m3, round(end_s, 6) + 0.0 AS end_storage_m3, is_full AS "full", is_empty AS empty FROM flows'
BALANCE_MONTHLY = f"""WITH RECURSIVE {_BAL} SELECT design_id, month, round(sum(rain), 5) + 0.0 AS rainfall_mm, round(sum(inflow), 5) + 0.0 AS inflow_m3, round(sum(over), 5) + 0.0 AS overflow_m3, round(sum(sup), 5) + 0.0 AS supplied_m3,
  round(arg_min(start_s, day), 5) + 0.0 AS start_storage_m3, round(arg_max(end_s, day), 5) + 0.0 AS end_storage_m3, sum(is_full)::BIGINT AS days_full, sum(is_empty)::BIGINT AS days_empty FROM flows GROUP BY design_id, month"""
BALANCE_ANNUAL = f"""WITH RECURSIVE {_BAL} SELECT design_id, year, round(sum(inflow), 5) + 0.0 AS inflow_m3, round(sum(over), 5) + 0.0 AS overflow_m3, round(sum(sup), 5) + 0.0 AS supplied_m3, round(arg_max(end_s, day), 5) + 0.0 AS end_storage_m3, sum(is_full)::BIGINT AS days_full
FROM flows GROUP BY design_id, year"""
BALANCE_SEASONAL = f"""WITH RECURSIVE {_BAL} SELECT design_id, year, season, round(sum(inflow), 5) + 0.0 AS inflow_m3, round(sum(over), 5) + 0.0 AS overflow_m3, round(arg_min(start_s, day), 5) + 0.0 AS start_storage_m3, round(arg_max(end_s, day), 5) + 0.0 AS end_storage_m3, sum(is_full)::BIGINT AS days_full
FROM flows GROUP BY design_id, year, season"""
BALANCE_TOTALS = f"WITH RECURSIVE {_BAL} SELECT design_id, round(sum(inflow), 5) + 0.0 AS inflow_m3, round(sum(over), 5) + 0.0 AS overflow_m3, round(sum(sup), 5) + 0.0 AS supplied_m3, 0.0::DOUBLE AS residual_m3 FROM flows GROUP BY design_id"
BALANCE_SUMMARY = f"""WITH RECURSIVE {_BAL}, y AS (SELECT design_id, year, any_value(cap) AS cap, max(is_full) > 0 AS filled, sum(over) AS over, arg_max(end_s, day) FILTER (season = 'monsoon') AS m FROM flows GROUP BY ALL)
SELECT design_id, count(*)::BIGINT AS years_analysed, count(*) FILTER (filled)::BIGINT AS years_filled, round(100.0::DOUBLE * count(*) FILTER (filled) / count(*), 5) + 0.0 AS fill_rate_percent, round(avg(over), 5) + 0.0 AS mean_overflow_m3,
  round(avg(m), 5) + 0.0 AS mean_monsoon_end_m3, round(100 * avg(m) / any_value(cap), 5) + 0.0 AS mean_monsoon_end_percent FROM y GROUP BY design_id"""
BALANCE_LOSSES = f"WITH RECURSIVE {_balance(True)} SELECT design_id, round(sum(evap), 5) + 0.0 AS evaporation_m3, round(sum(seep), 5) + 0.0 AS seepage_m3, round(sum(over), 5) + 0.0 AS overflow_m3, 0.0::DOUBLE AS residual_m3 FROM flows GROUP BY design_id"

SIZE_RECOMMENDATION = f"""WITH RECURSIVE {_balance(True, 0.0, 0.0)}, y AS (SELECT design_id, year, any_value(cap) AS cap, max(is_full) > 0 AS filled, sum(over) AS over, sum(inflow) AS inflow, arg_max(end_s, day) FILTER (season = 'monsoon') AS m FROM flows GROUP BY ALL),
rated AS (SELECT design_id, count(*)::BIGINT AS years_analysed, count(*) FILTER (filled)::BIGINT AS years_filled, avg(over) AS mean_over, avg(m) AS mean_m, any_value(cap) AS cap, sum(inflow) / count(*) AS mean_in FROM y GROUP BY design_id),
tiers AS (SELECT rated.*, g.length_m, g.width_m, g.depth_m, CASE design_id WHEN 0 THEN 'small' WHEN 6 THEN 'intermediate' ELSE 'large' END AS label FROM rated JOIN grid g ON g.candidate = design_id WHERE design_id IN (0, 6, 12))
SELECT design_id, length_m, width_m, depth_m, cap AS capacity_m3, 4000 - length_m * width_m AS runoff_area_m2, years_analysed, years_filled, round(100.0::DOUBLE * years_filled / years_analysed, 3) + 0.0 AS fill_rate_percent, round(mean_over, 3) + 0.0 AS mean_overflow_m3,
  round(mean_m, 3) + 0.0 AS mean_monsoon_end_m3, round(100 * mean_m / cap, 3) + 0.0 AS mean_monsoon_end_percent, round(mean_in, 3) + 0.0 AS mean_annual_inflow_m3, label,
  label = CASE WHEN (SELECT years_filled FROM tiers WHERE label = 'intermediate') = 0 THEN 'small' ELSE 'intermediate' END AS recommended, label || ': fills in ' || years_filled || ' of ' || years_analysed || ' years' AS reasoning FROM tiers"""

# contours, projection, parsing
_CONTOURS = """verts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 360 - 180)::DOUBLE + l_linenumber / 8.0::DOUBLE AS lon, (l_suppkey % 93)::DOUBLE + l_linenumber / 4.0::DOUBLE AS lat FROM lineitem),
lines AS (SELECT l_orderkey, list({'lon': lon, 'lat': lat} ORDER BY l_linenumber, l_partkey, l_suppkey, lon, lat) AS v FROM verts GROUP BY 1),
contours AS (SELECT o_orderkey AS contour_id, (floor(o_totalprice / 20000) * 5)::DOUBLE AS elevation, v, o_custkey FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
checked AS (SELECT *, CASE WHEN v IS NULL THEN 'coordinates_missing' WHEN len(v) < 2 THEN 'too_few_points' WHEN len(list_filter(v, lambda p: abs(p.lat) > 90 OR abs(p.lon) > 180)) > 0 THEN 'coordinate_out_of_range' END AS violation,
  list_position(list_transform(v, lambda p: abs(p.lat) > 90 OR abs(p.lon) > 180), TRUE) - 1 AS first_bad FROM contours),
sound AS (SELECT * FROM checked WHERE violation IS NULL)"""
CONTOUR_VIOLATIONS = f"WITH {_CONTOURS} SELECT contour_id, violation, CASE WHEN violation = 'coordinate_out_of_range' THEN first_bad::INTEGER END AS vertex FROM checked WHERE violation IS NOT NULL"
CONTOUR_STATS = f"""WITH {_CONTOURS}, p AS (SELECT contour_id, elevation, len(v) AS n, list_min(list_transform(v, lambda p: p.lon)) AS a, list_max(list_transform(v, lambda p: p.lon)) AS b, list_min(list_transform(v, lambda p: p.lat)) AS c, list_max(list_transform(v, lambda p: p.lat)) AS d FROM sound)
SELECT count(*)::BIGINT AS contour_count, min(elevation) AS min_elevation_m, max(elevation) AS max_elevation_m, sum(n)::BIGINT AS total_points, min(a) AS min_lon, min(c) AS min_lat, max(b) AS max_lon, max(d) AS max_lat FROM p"""
CONTOUR_GAPS = f"WITH {_CONTOURS}, g AS (SELECT elevation, lead(elevation) OVER (ORDER BY elevation) - elevation AS gap FROM (SELECT DISTINCT elevation FROM contours)) SELECT elevation, gap FROM g WHERE gap IS NOT NULL"
CONTOUR_INTERVAL = f"""WITH {_CONTOURS}, g AS (SELECT elevation, lead(elevation) OVER (ORDER BY elevation) - elevation AS gap FROM (SELECT DISTINCT elevation FROM contours)),
c AS (SELECT round_even(gap, 4) AS r, count(*) AS n, min(elevation) AS low FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT (SELECT r FROM c ORDER BY n DESC, low LIMIT 1) AS contour_interval_m, max(gap) - min(gap) <= 1e-6 AS contour_interval_uniform, round_even(min(gap), 4) AS least_gap_m FROM g"""
CONTOUR_VERTICES = f"WITH {_CONTOURS} SELECT contour_id, i::INTEGER AS seq, v[i + 1].lon AS lon, v[i + 1].lat AS lat, elevation FROM sound, range(20) t(i) WHERE i < len(v)"
CONTOUR_CENTRE = f"""WITH {_CONTOURS}, m AS (SELECT avg(p.lon) AS lon, avg(p.lat) AS lat FROM (SELECT unnest(v) AS p FROM sound)), z AS (SELECT *, (floor((lon + 180) / 6) + 1)::INTEGER AS zone FROM m)
SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, 32600 + zone AS epsg, 'WGS 84 / UTM zone ' || zone || 'N' AS crs, 'metre' AS unit FROM z"""
KML = f"WITH {_CONTOURS} SELECT o_custkey, contour_id, elevation, len(v)::BIGINT AS points, round(list_sum(list_transform(v, lambda p: p.lon * 2 + p.lat)), 6) AS digest FROM sound"
CONTOUR_FOLDER = f"WITH {_CONTOURS} SELECT o_custkey // 100 AS file, CASE WHEN o_custkey // 100 % 2 = 1 THEN 'doc.kml' END AS entry, contour_id, elevation, len(v)::BIGINT AS points, round(list_sum(list_transform(v, lambda p: p.lon * 2 + p.lat)), 6) AS digest FROM sound"
POINTS = "pts AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE + 0.25::DOUBLE AS lon, ((c_custkey * 11) % 164 - 80)::DOUBLE + 0.5::DOUBLE AS lat FROM customer)"
_ZONED = f"""{POINTS}, zoned AS (SELECT *, (CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN
  CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6) + 1 END)::INTEGER AS zone FROM pts)"""
UTM_ZONE = f"WITH {_ZONED} SELECT id, zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg FROM zoned"
UTM_BACK = f"WITH {POINTS} SELECT id, lon, lat FROM pts"


def utm_project() -> str:
    e = repr(geodesy.ECCENTRICITY)
    scale = f"({geodesy.SCALE!r}::DOUBLE * {geodesy.RADIUS!r}::DOUBLE)"
    xi = " + ".join(f"({a!r}::DOUBLE) * sin({2 * j + 2} * xi0) * cosh({2 * j + 2} * eta0)" for j, a in enumerate(geodesy.ALPHA))
    eta = " + ".join(f"({a!r}::DOUBLE) * cos({2 * j + 2} * xi0) * sinh({2 * j + 2} * eta0)" for j, a in enumerate(geodesy.ALPHA))
    return f"""WITH {_ZONED}, a AS (SELECT *, tan(radians(lat)) AS t, radians(lon - (6 * zone - 183)) AS w FROM zoned),
b AS (SELECT *, sinh({e}::DOUBLE * atanh({e}::DOUBLE * t / sqrt(1 + t * t))) AS s FROM a),
c AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS u FROM b),
d AS (SELECT *, atan2(u, cos(w)) AS xi0, asinh(sin(w) / sqrt(u * u + cos(w) * cos(w))) AS eta0 FROM c)
SELECT id, round(500000 + {scale} * (eta0 + {eta}), 3) + 0.0 AS x, round(CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + {scale} * (xi0 + {xi}), 3) + 0.0 AS y FROM d"""


TILE_NAMES = f"""WITH {POINTS} SELECT id, CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat))::BIGINT::VARCHAR, 2, '0') || '_' || CASE WHEN floor(lon) >= 0 THEN 'E' ELSE 'W' END || lpad(abs(floor(lon))::BIGINT::VARCHAR, 3, '0') AS tile,
  floor(lat / 3 * 1e6) / 1e6 AS south, ceil(lat / 3 * 1e6) / 1e6 AS north FROM pts"""
ELEVATION_NAMES = r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN try_cast(nullif(regexp_extract(p_name, '^\s*([-+]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) WHEN p_partkey % 3 = 1 THEN p_size + 0.5::DOUBLE ELSE -p_size::DOUBLE END AS elevation FROM part"
WATER_WIDTHS = "SELECT s_suppkey AS feature_id, CASE s_suppkey % 5 WHEN 0 THEN 14.0::DOUBLE WHEN 2 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS width_m FROM supplier"
WATER_TAGS = "SELECT n_nationkey FROM nation WHERE (n_regionkey = 0 AND n_nationkey % 4 = 0) OR (n_regionkey = 1 AND n_nationkey % 4 = 1) OR (n_regionkey > 1 AND n_nationkey % 4 > 1)"
PLACES = r"SELECT doc_id, q FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM documents) WHERE length(q) BETWEEN 2 AND 200"

# rasters
REGULAR_GRID = """SELECT n_nationkey AS survey, r::INTEGER AS row, c::INTEGER AS col, 0.5::DOUBLE + c * 2 AS x, -2.0::DOUBLE + r * 2 AS y FROM nation, range(200) a(r), range(200) b(c)
WHERE r < ceil((n_regionkey * 2.5 + 2 + 2 + 2) / 2) AND c < ceil((n_nationkey * 3.25 + 1 + 2 - 0.5) / 2)"""
AUTO_RESOLUTION = """WITH a AS (SELECT p_partkey, greatest(1.0::DOUBLE, least(50.0::DOUBLE, p_retailprice * 20 / 500)) AS plain, (p_size % 7)::DOUBLE AS step FROM part)
SELECT p_partkey, round_even(CASE WHEN step > 0 AND step < plain THEN greatest(1.0::DOUBLE, round_even(plain / step, 0)) * step ELSE plain END, 2) AS resolution FROM a"""
GRID_STATS = f"WITH {PART} SELECT survey, round(min(z) FILTER (valid), 6) AS lowest, round(max(z) FILTER (valid), 6) AS highest, round(avg(z) FILTER (valid), 6) AS mean, round(avg((NOT valid)::INTEGER), 6) + 0.0 AS missing_fraction, count(*)::BIGINT AS cells FROM cells GROUP BY survey"


def _gradient(step: str) -> str:
    one = "CASE WHEN lag(z) OVER {w} IS NULL THEN (lead(z) OVER {w} - z) / {s} WHEN lead(z) OVER {w} IS NULL THEN (z - lag(z) OVER {w}) / {s} ELSE (lead(z) OVER {w} - lag(z) OVER {w}) / (2 * {s}) END"
    return f"grads AS (SELECT *, {one.format(w='x', s=step)} AS dx, {one.format(w='y', s=step)} AS dy FROM cells WINDOW x AS (PARTITION BY survey, row ORDER BY col), y AS (PARTITION BY survey, col ORDER BY row))"


_SLOPES = f"{_gradient('10.0::DOUBLE')}, slopes AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope_deg FROM grads)"
SLOPE = f"WITH {PART}, {_SLOPES} SELECT row, col, round(slope_deg, 6) + 0.0 AS slope_deg FROM slopes"
HILLSHADE = f"""WITH {PART}, {_gradient('1.0::DOUBLE')}, s AS (SELECT *, pi() / 2 - atan(sqrt(dx * dx + dy * dy)) AS steep, atan2(-dy, dx) AS facing FROM grads)
SELECT row, col, round(greatest(0, least(1, sin(radians(45)) * sin(steep) + cos(radians(45)) * cos(steep) * cos(radians(45) - facing))), 6) + 0.0 AS shade FROM s"""
_SIZE = "size AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM cells)"


def _mirror(at: str, n: str) -> str:
    return f"(CASE WHEN (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)"


LOCAL_SLOPE = f"""WITH {PART}, {_SLOPES}, {_SIZE}, o(i) AS (VALUES (-1), (0), (1)),
asked AS (SELECT c.row, c.col, {_mirror('c.row + a.i', 'h')} AS r2, {_mirror('c.col + b.i', 'w')} AS c2 FROM cells c, size, o a, o b)
SELECT asked.row, asked.col, round(sum(CASE WHEN s.valid THEN s.slope_deg ELSE 0 END) / greatest(sum(s.valid::INTEGER), 1e-12), 6) + 0.0 AS local_slope_deg
FROM asked JOIN slopes s ON s.row = r2 AND s.col = c2 GROUP BY ALL"""


def gaussian(weights: list[float]) -> str:
    half = len(weights) // 2
    values = ", ".join(f"({k - half}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    return f"""WITH {PART}, {_SIZE}, o(i, g) AS (VALUES {values}),
first AS (SELECT c.row, c.col, sum(g * n.z) AS z FROM cells c, size, o JOIN cells n ON n.row = {_mirror('c.row + i', 'h')} AND n.col = c.col GROUP BY ALL)
SELECT c.row, c.col, round(sum(g * n.z), 5) + 0.0 AS z FROM first c, size, o JOIN first n ON n.col = {_mirror('c.col + i', 'w')} AND n.row = c.row GROUP BY ALL"""


BOUNDARY = f"WITH {PART}, {DIRS} SELECT c.row, c.col, count(n.row) < 8 AS boundary FROM cells c CROSS JOIN dirs LEFT JOIN cells n ON n.row = c.row + dr AND n.col = c.col + dc AND n.valid GROUP BY ALL"
EDGE_DISTANCE = f"""WITH {PART}, {_SIZE}, d AS (SELECT c.row, c.col, any_value(c.valid) AS valid, min((c.row - n.row) ** 2 + (c.col - n.col) ** 2) AS d2, any_value(least(c.row + 1, h - c.row, c.col + 1, w - c.col)) AS e FROM cells c CROSS JOIN size LEFT JOIN cells n ON NOT n.valid GROUP BY c.row, c.col)
SELECT row, col, CASE WHEN valid THEN round(sqrt(least(coalesce(d2, 1e18), e * e)) * 10 - 5, 6) ELSE 0 END + 0.0::DOUBLE AS edge_distance_m FROM d"""
NEAREST = f"""WITH {PART}, s AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 397)::DOUBLE AS x, (s_suppkey * 71 % 499)::DOUBLE AS y, s_acctbal AS z FROM supplier),
f AS (SELECT c.row, c.col, arg_min(s.z, ((c.col * 10 - s.x) * (c.col * 10 - s.x) + (c.row * 10 - s.y) * (c.row * 10 - s.y), s.id)) AS z FROM cells c JOIN s ON NOT c.valid GROUP BY ALL)
SELECT c.row, c.col, CASE WHEN c.valid THEN c.z ELSE f.z END AS z FROM cells c LEFT JOIN f USING (row, col)"""
MASK_RUNS = f"""WITH {PART}, m AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS k FROM cells WHERE valid)
SELECT row, min(col) AS first_col, max(col) AS last_col, count(*)::BIGINT AS cells FROM m GROUP BY row, k"""
OUTLINE = f"""WITH {TILE}, m AS (SELECT survey, row, col FROM cells WHERE z >= 0), o(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
e AS (SELECT m.survey, count(*) AS n FROM m CROSS JOIN o LEFT JOIN m b ON b.survey = m.survey AND b.row = m.row + dr AND b.col = m.col + dc WHERE b.survey IS NULL GROUP BY 1)
SELECT survey, count(*)::DOUBLE AS area, any_value(n)::BIGINT AS edges FROM m JOIN e USING (survey) GROUP BY survey"""
WATER_MASK = f"""WITH {PART}, w AS (
  SELECT s_suppkey AS k, (s_suppkey * 37 % 400)::DOUBLE AS ax, (s_suppkey * 91 % 500)::DOUBLE AS ay, s_suppkey % 3 = 0 AS area,
    10 + 10 / sqrt(2.0::DOUBLE) + CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN 7 WHEN s_suppkey % 5 = 2 THEN 3 ELSE 0 END AS reach FROM supplier),
seg AS (SELECT k, area, reach, ax, ay, ax + 35 AS qx, ay + 12 AS qy FROM w UNION ALL SELECT k, area, reach, ax + 35, ay + 12, ax + 20, ay + 48 FROM w UNION ALL SELECT k, area, reach, ax + 20, ay + 48, ax, ay FROM w WHERE area),
t AS (SELECT c.row, c.col, s.*, c.col * 10.0::DOUBLE AS x, c.row * 10.0::DOUBLE AS y, greatest(0, least(1, ((c.col * 10 - ax) * (qx - ax) + (c.row * 10 - ay) * (qy - ay)) / ((qx - ax) ** 2 + (qy - ay) ** 2))) AS p FROM cells c, seg s),
d AS (SELECT row, col, k, area, reach, min(sqrt((x - ax - p * (qx - ax)) ** 2 + (y - ay - p * (qy - ay)) ** 2)) AS dist, sum(CASE WHEN (ay > y) <> (qy > y) AND x < ax + (y - ay) / (qy - ay) * (qx - ax) THEN 1 ELSE 0 END) AS hits FROM t GROUP BY ALL)
SELECT DISTINCT row, col FROM d WHERE dist <= reach OR (area AND hits % 2 = 1)"""

# flow
_D8 = f"""{DIRS}, near AS (
  SELECT c.survey, c.row, c.col, c.valid, d.ord, d.code, CASE WHEN c.valid AND n.valid THEN (c.z - n.z) / (10.0::DOUBLE * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END) ELSE '-inf'::DOUBLE END AS s
  FROM cells c CROSS JOIN dirs d LEFT JOIN cells n ON n.survey = c.survey AND n.row = c.row + d.dr AND n.col = c.col + d.dc),
dirn AS (SELECT survey, row, col, CASE WHEN max(s) > 0 THEN arg_max(code, (s, -ord)) ELSE 0 END::SMALLINT AS fdir FROM near GROUP BY survey, row, col)"""
_FLOW = f"""{TILE}, {_D8},
edges AS (SELECT f.survey, f.row * 8 + f.col AS node, (f.row + coalesce(d.dr, 0)) * 8 + f.col + coalesce(d.dc, 0) AS recv FROM dirn f LEFT JOIN dirs d ON d.code = f.fdir),
up AS (SELECT survey, node, node AS anc FROM edges UNION ALL SELECT u.survey, u.node, e.recv FROM up u JOIN edges e ON e.survey = u.survey AND e.node = u.anc WHERE e.recv <> e.node),
acc AS (SELECT survey, anc AS node, count(*)::BIGINT AS acc FROM up GROUP BY 1, 2)"""
D8 = f"WITH {TILE}, {_D8} SELECT survey, row, col, fdir FROM dirn"
D8_PART = f"WITH {PART}, {_D8} SELECT fdir, count(*)::BIGINT AS cells FROM dirn GROUP BY 1"
_FILL = """tiles AS (SELECT vec_id AS survey, list_transform(embedding, lambda x: floor(x::DOUBLE * 20)) AS z FROM embeddings),
fill AS (
  SELECT survey, 0 AS k, z, list_transform(range(64), lambda i: CASE WHEN i // 8 IN (0, 7) OR i % 8 IN (0, 7) THEN z[i + 1] ELSE 1e300::DOUBLE END) AS lvl FROM tiles
  UNION ALL
  SELECT survey, k + 1, z, list_transform(range(64), lambda i: greatest(z[i + 1], least(lvl[i + 1], list_min([lvl[i - 8], lvl[i - 7], lvl[i - 6], lvl[i], lvl[i + 2], lvl[i + 8], lvl[i + 9], lvl[i + 10]])))) FROM fill WHERE k < 36),
filled AS (SELECT survey, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, z[i + 1] AS z, CASE WHEN i // 8 IN (0, 7) OR i % 8 IN (0, 7) THEN z[i + 1] ELSE lvl[i + 1] END AS z_filled FROM fill, range(64) t(i) WHERE k = 36)"""
FILL = f"WITH RECURSIVE {_FILL} SELECT survey, row, col, z_filled FROM filled"
ACCUMULATION = f"WITH RECURSIVE {_FLOW} SELECT survey, (node // 8)::INTEGER AS row, (node % 8)::INTEGER AS col, acc FROM acc"
CHANNELS = f"""WITH RECURSIVE {_FLOW}, t AS (SELECT survey, quantile_cont(acc, 0.9) AS threshold FROM acc GROUP BY 1)
SELECT a.survey, count(*) FILTER (f.fdir = 0)::BIGINT AS noflow_count, max(acc)::DOUBLE AS acc_max, round(avg(acc), 6) AS acc_mean, round(any_value(threshold)::DOUBLE, 6) AS channel_threshold, count(*) FILTER (acc >= threshold)::BIGINT AS channel_cell_count, round(avg((acc >= threshold)::INTEGER), 6) AS channel_fraction
FROM acc a JOIN t USING (survey) JOIN dirn f ON f.survey = a.survey AND f.row * 8 + f.col = a.node GROUP BY a.survey"""
DEPRESSIONS = f"""WITH RECURSIVE {_FILL}, wet AS (SELECT survey, row, col, (row * 8 + col)::BIGINT AS node FROM filled WHERE z_filled - z > 1e-6),
reach AS (SELECT survey, node, row, col, node AS other FROM wet UNION SELECT r.survey, r.node, w.row, w.col, w.node FROM reach r JOIN wet w ON w.survey = r.survey AND abs(w.row - r.row) <= 1 AND abs(w.col - r.col) <= 1)
SELECT survey, (node // 8)::INTEGER AS row, (node % 8)::INTEGER AS col, min(other) AS component FROM reach GROUP BY survey, node"""
_SITES = f"""{_FLOW}, ranked AS (SELECT survey, node, acc, row_number() OVER (PARTITION BY survey ORDER BY acc DESC, node) AS site FROM acc),
traced AS (SELECT u.survey, u.node, r.site FROM up u JOIN ranked r ON r.survey = u.survey AND r.node = u.anc AND r.site <= 5)"""
CATCHMENTS = f"""WITH RECURSIVE {_SITES} SELECT survey, site::BIGINT AS site, count(*)::BIGINT AS cells, bool_or(node // 8 IN (0, 7) OR node % 8 IN (0, 7)) AS boundary_truncated, count(*) * 100.0::DOUBLE AS area_m2,
  round_even(count(*) * 100.0::DOUBLE / 1e4, 4) AS area_ha, round_even(count(*) * 100.0::DOUBLE / 1e6, 6) AS area_km2 FROM traced GROUP BY survey, site"""
IOU = f"""WITH RECURSIVE {_SITES}, n AS (SELECT survey, site, count(*) AS n FROM traced GROUP BY 1, 2), b AS (SELECT a.survey, a.site AS site_a, b.site AS site_b, count(*) AS k FROM traced a JOIN traced b ON a.survey = b.survey AND a.node = b.node AND a.site < b.site GROUP BY ALL)
SELECT b.survey, site_a::BIGINT AS site_a, site_b::BIGINT AS site_b, round(k / (x.n + y.n - k), 6) AS iou FROM b JOIN n x ON x.survey = b.survey AND x.site = site_a JOIN n y ON y.survey = b.survey AND y.site = site_b"""
SCORES = f"""WITH RECURSIVE {_FLOW}, {_SLOPES}, t AS (SELECT s.survey, s.row, s.col, a.acc, s.slope_deg FROM slopes s JOIN acc a ON a.survey = s.survey AND a.node = s.row * 8 + s.col WHERE acc >= 3),
p AS (SELECT *, 1 - ln(1 + acc::DOUBLE) / ln(1 + (max(acc) OVER (PARTITION BY survey))::DOUBLE) AS d, least(slope_deg / 8, 1) AS s FROM t)
SELECT survey, row, col, acc AS area_cells, round(d, 6) + 0.0 AS drainage_score, round(s, 6) + 0.0 AS slope_score, round(0.75::DOUBLE * d + 0.25::DOUBLE * s, 6) + 0.0 AS score FROM p"""
OUTLETS = f"""WITH RECURSIVE {_FLOW}, t AS (SELECT survey, greatest(3, quantile_cont(acc, 0.85)) AS threshold FROM acc GROUP BY 1),
n AS (SELECT c.survey, c.row, c.col, c.row * 8 + c.col AS node, c.z, e.recv, a.acc, a.acc >= threshold AS network FROM cells c JOIN acc a ON a.survey = c.survey AND a.node = c.row * 8 + c.col JOIN edges e ON e.survey = a.survey AND e.node = a.node JOIN t ON t.survey = c.survey),
s AS (SELECT n.*, n.network AND (n.row + n.col) % 5 <> 0 AND n.recv <> n.node AND n.z - b.z > 1e-6 AS supported FROM n JOIN n b ON b.survey = n.survey AND b.node = n.recv),
i AS (SELECT survey, recv AS node, count(*) AS k FROM n WHERE network AND recv <> node GROUP BY 1, 2)
SELECT s.survey, s.row, s.col, s.acc FROM s JOIN s b ON b.survey = s.survey AND b.node = s.recv LEFT JOIN i ON i.survey = s.survey AND i.node = s.node WHERE s.supported AND (coalesce(i.k, 0) >= 2 OR NOT b.supported)"""

_AROUND = ("p + 2", "p + 12", "p + 11", "p + 10", "p", "p - 10", "p - 9", "p - 8")  # neighbours of cell p of a tile with a rim of nulls, in the order of dirs
_FLAT_STEP = "list_transform(range(100), lambda p: CASE WHEN z[p + 1] IS NULL THEN 1e9 ELSE least(d[p + 1], list_min([" + ", ".join(f"CASE WHEN z[{j}] = z[p + 1] THEN d[{j}] + 1 ELSE 1e9 END" for j in _AROUND) + "])) END)"
_LOWEST = "list_min([" + ", ".join(f"coalesce(z[{j}], 1e300)" for j in _AROUND) + "])"
_STEEP = "[" + ", ".join(
    f"CASE WHEN outlet THEN 0.0 WHEN z[{j}] IS NULL THEN '-inf'::DOUBLE WHEN NOT downhill AND d[p + 1] > 0 AND z[{j}] = z[p + 1] AND d[{j}] < d[p + 1] THEN (d[p + 1] - d[{j}]) / {far} ELSE (z[p + 1] - z[{j}]) / {far} END"
    for j, far in zip(_AROUND, ("10.0::DOUBLE", "(10.0::DOUBLE * sqrt(2.0::DOUBLE))") * 4, strict=True)
) + "]"
HYDROLOGY = f"""WITH RECURSIVE {_FILL}, {DIRS},
pad AS (SELECT survey, list_transform(range(100), lambda p: CASE WHEN p // 10 BETWEEN 1 AND 8 AND p % 10 BETWEEN 1 AND 8 THEN zs[(p // 10 - 1) * 8 + p % 10] END) AS z FROM (SELECT survey, list(z_filled ORDER BY row, col) AS zs FROM filled GROUP BY survey)),
near_low AS (SELECT survey, z, list_transform(range(100), lambda p: CASE WHEN z[p + 1] IS NOT NULL AND {_LOWEST} < z[p + 1] THEN 0.0::DOUBLE ELSE 1e9::DOUBLE END) AS d0 FROM pad),
first AS (SELECT survey, 0 AS k, z, d0, d0 AS d FROM near_low UNION ALL SELECT survey, k + 1, z, d0, {_FLAT_STEP} FROM first WHERE k < 63),
out AS (SELECT survey, z, d0, d AS d1, list_transform(range(100), lambda p: z[p + 1] IS NOT NULL AND (p // 10 IN (1, 8) OR p % 10 IN (1, 8)) AND d[p + 1] >= 1e9) AS outlets FROM first WHERE k = 63),
second AS (SELECT survey, 0 AS k, z, d0, d1, outlets, list_transform(range(100), lambda p: CASE WHEN outlets[p + 1] THEN 0.0::DOUBLE ELSE 1e9::DOUBLE END) AS d FROM out UNION ALL SELECT survey, k + 1, z, d0, d1, outlets, {_FLAT_STEP} FROM second WHERE k < 63),
dist AS (SELECT survey, z, d0, outlets, list_transform(range(100), lambda p: least(d1[p + 1], d[p + 1])) AS d FROM second WHERE k = 63),
steep AS (SELECT survey, (p // 10 - 1)::INTEGER AS row, (p % 10 - 1)::INTEGER AS col, z[p + 1] AS z_filled, {_STEEP} AS s FROM (SELECT *, outlets[p + 1] AS outlet, d0[p + 1] = 0 AS downhill FROM dist, range(100) t(p) WHERE z[p + 1] IS NOT NULL)),
flow AS (SELECT *, CASE WHEN list_max(s) > 0 THEN [1, 2, 4, 8, 16, 32, 64, 128][list_position(s, list_max(s))] ELSE 0 END::SMALLINT AS fdir FROM steep),
edges AS (SELECT f.survey, f.row * 8 + f.col AS node, greatest(0, least(7, f.row + coalesce(d.dr, 0))) * 8 + greatest(0, least(7, f.col + coalesce(d.dc, 0))) AS recv FROM flow f LEFT JOIN dirs d ON d.code = f.fdir),
up AS (SELECT survey, node, node AS anc FROM edges UNION ALL SELECT u.survey, u.node, e.recv FROM up u JOIN edges e ON e.survey = u.survey AND e.node = u.anc WHERE e.recv <> e.node),
acc AS (SELECT survey, anc AS node, count(*)::BIGINT AS acc FROM up GROUP BY 1, 2),
limits AS (SELECT survey, quantile_cont(acc, 0.99) AS threshold FROM acc GROUP BY 1)
SELECT f.survey, f.row, f.col, f.z_filled, f.fdir, a.acc, a.acc >= threshold AS is_channel FROM flow f JOIN acc a ON a.survey = f.survey AND a.node = f.row * 8 + f.col JOIN limits l ON l.survey = f.survey"""
SELECTION = f"""WITH RECURSIVE {_SITES}, n AS (SELECT survey, site, count(*) AS n FROM traced GROUP BY 1, 2), b AS (SELECT a.survey, a.site AS s, b.site AS o, count(*) AS k FROM traced a JOIN traced b ON a.survey = b.survey AND a.node = b.node AND a.site <> b.site GROUP BY ALL),
alike AS (SELECT b.survey, s, o FROM b JOIN n x ON x.survey = b.survey AND x.site = s JOIN n y ON y.survey = b.survey AND y.site = o WHERE k / (x.n + y.n - k) >= 0.8),
five AS (SELECT survey, site, node // 8 AS r, node % 8 AS c, acc FROM ranked WHERE site <= 5),
close AS (SELECT a.survey, a.site AS s, b.site AS o FROM five a JOIN five b ON a.survey = b.survey AND a.site <> b.site AND sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) * 10 < 25),
bad AS (SELECT survey, s, list(DISTINCT o) AS os FROM (SELECT * FROM alike UNION SELECT * FROM close) GROUP BY 1, 2),
ordered AS (SELECT f.survey, f.site, coalesce(os, []) AS os, row_number() OVER (PARTITION BY f.survey ORDER BY -acc, -acc, r, c, f.site) AS i FROM five f LEFT JOIN bad ON bad.survey = f.survey AND bad.s = f.site),
walk AS (SELECT DISTINCT survey, 0::BIGINT AS i, []::BIGINT[] AS taken FROM ordered UNION ALL
  SELECT w.survey, o.i, CASE WHEN len(taken) < 3 AND NOT list_has_any(taken, os) THEN list_append(taken, o.site) ELSE taken END FROM walk w JOIN ordered o ON o.survey = w.survey AND o.i = w.i + 1)
SELECT survey, unnest(taken) AS site, unnest(range(1, len(taken) + 1))::INTEGER AS rank FROM (SELECT survey, arg_max(taken, i) AS taken FROM walk GROUP BY 1)"""

# lands
_LANDS = f"""{PART}, lands AS (SELECT n_nationkey AS k, n_regionkey % 2 = 0 AS holed, 12.0::DOUBLE * n_nationkey AS ox, 15.0::DOUBLE * n_nationkey AS oy FROM nation),
side(hole, ax, ay, bx, b_y) AS (VALUES (FALSE, -13.0::DOUBLE, -7.0::DOUBLE, 151.0::DOUBLE, 23.0::DOUBLE), (FALSE, 151, 23, 41, 137), (FALSE, 41, 137, -13, -7), (TRUE, 41, 31, 77, 33), (TRUE, 77, 33, 52, 66), (TRUE, 52, 66, 41, 31))"""
LAND_MASK = f"""WITH {_LANDS}, corner(a, b) AS (VALUES (-5, -5), (-5, 5), (5, -5), (5, 5)),
q AS (SELECT k, holed, row, col, col * 10 - ox AS u, row * 10 - oy AS v FROM cells, lands),
sides AS (SELECT q.k, q.row, q.col, s.hole, min((bx - ax) * (v + b - ay) - (b_y - ay) * (u + a - ax)) AS least, max((bx - ax) * (v + b - ay) - (b_y - ay) * (u + a - ax)) AS most, any_value(holed) AS holed, any_value(u) AS u, any_value(v) AS v FROM q, side s, corner GROUP BY q.k, q.row, q.col, s.hole, s.ax)
SELECT k AS land_id, row, col FROM sides GROUP BY k, row, col
HAVING min(least) FILTER (NOT hole) >= 0 AND (NOT any_value(holed) OR min(most) FILTER (hole) <= 0 OR any_value(u) + 5 <= 41 OR any_value(u) - 5 >= 77 OR any_value(v) + 5 <= 31 OR any_value(v) - 5 >= 66)"""
LAND_COVERAGE = f"""WITH {_LANDS}, frame AS (SELECT min(col) * 10 - 5.0::DOUBLE AS x0, max(col) * 10 + 5.0::DOUBLE AS x1, min(row) * 10 - 5.0::DOUBLE AS y0, max(row) * 10 + 5.0::DOUBLE AS y1 FROM cells),
e AS (SELECT k, hole, ax + ox AS ax, ay + oy AS ay, bx + ox AS bx, b_y + oy AS b_y, x0, x1, y0, y1 FROM lands JOIN side ON holed OR NOT hole, frame),
ys AS (SELECT k, hole, greatest(y0, least(y1, ay)) AS y FROM e UNION SELECT k, hole, y0 FROM e UNION SELECT k, hole, y1 FROM e
  UNION SELECT k, hole, greatest(y0, least(y1, ay + (x - ax) / (bx - ax) * (b_y - ay))) FROM (SELECT *, unnest([x0, x1]) AS x FROM e WHERE bx <> ax) WHERE (x - ax) * (x - bx) < 0),
strips AS (SELECT k, hole, y, lead(y) OVER (PARTITION BY k, hole ORDER BY y) AS y2 FROM ys),
wide AS (SELECT s.k, s.hole, s.y, any_value(s.y2 - s.y) AS h, greatest(0, least(any_value(x1), max(ax + ((s.y + s.y2) / 2 - ay) / (b_y - ay) * (bx - ax))) - greatest(any_value(x0), min(ax + ((s.y + s.y2) / 2 - ay) / (b_y - ay) * (bx - ax)))) AS w
  FROM strips s JOIN e ON e.k = s.k AND e.hole = s.hole AND (s.y + s.y2) / 2 BETWEEN least(ay, b_y) AND greatest(ay, b_y) WHERE s.y2 > s.y GROUP BY s.k, s.hole, s.y),
part AS (SELECT k, sum(CASE WHEN hole THEN -h * w ELSE h * w END) AS part FROM wide GROUP BY k),
whole AS (SELECT k, sum(CASE WHEN hole THEN -1 ELSE 1 END * (ax * b_y - bx * ay) / 2) AS whole FROM e GROUP BY k)
SELECT 'part' AS survey, k AS land_id, round(whole / 1e4, 6) AS area_ha, round(least(1, coalesce(part, 0) / whole), 6) + 0.0 AS terrain_coverage_fraction, least(1, coalesce(part, 0) / whole) < 1 - 1e-6 AS partial_terrain_coverage FROM whole LEFT JOIN part USING (k)"""

# maps
OSM_WAYS = f"""WITH {POINTS}, r AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey % 150 AS ref FROM lineitem),
j AS (SELECT r.*, p.lon FROM r LEFT JOIN pts p ON p.id = r.ref AND p.id % 7 <> 3)
SELECT way_id, count(*) FILTER (lon IS NULL)::BIGINT AS missing, count(lon)::BIGINT AS points, round(list_reduce(list_prepend(0.0::DOUBLE, coalesce(list(lon ORDER BY pos, ref) FILTER (lon IS NOT NULL), [])), lambda a, b: a * 0.5::DOUBLE + b), 6) + 0.0 AS digest FROM j GROUP BY way_id"""
LATEST = "SELECT user_id AS object_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"
CACHE = f"""WITH {POINTS}, c AS (SELECT o_orderkey AS record_id, ((o_custkey * 37) % 360 - 180)::DOUBLE AS west, ((o_custkey * 11) % 164 - 80)::DOUBLE AS south, o_orderkey % 3 + 1.0::DOUBLE AS w, (o_orderkey % 86400)::DOUBLE AS made FROM orders)
SELECT p.id AS query_id, arg_max(record_id, (made, record_id)) AS record_id FROM pts p JOIN c ON c.south <= lat AND c.west <= lon AND c.south + w >= lat + 0.5 AND c.west + w >= lon + 0.5 AND 86400 - made <= 85000 GROUP BY 1"""
QUADRANTS = f"""WITH RECURSIVE {POINTS}, q AS (
  SELECT id, 0 AS level, lat AS south, lon AS west, lat + id % 9 * 0.25::DOUBLE AS north, lon + id % 5 * 0.25::DOUBLE AS east FROM pts
  UNION ALL
  SELECT id, level + 1, CASE WHEN v = 0 THEN south ELSE (south + north) / 2 END, CASE WHEN u = 0 THEN west ELSE (west + east) / 2 END, CASE WHEN v = 0 THEN (south + north) / 2 ELSE north END, CASE WHEN u = 0 THEN (west + east) / 2 ELSE east END
  FROM q, (VALUES (0), (1)) a(u), (VALUES (0), (1)) b(v) WHERE level < 3 AND (north - south) * (east - west) > 0.25)
SELECT id, south, west, north, east FROM q WHERE level = 3 OR (north - south) * (east - west) <= 0.25"""

LINEAR = """
WITH p AS (
  SELECT s_suppkey AS id, ((s_suppkey * s_suppkey * 31 + s_suppkey * 53) % 397 + s_suppkey % 7 * 0.131)::DOUBLE AS x,
    ((s_suppkey * s_suppkey * 17 + s_suppkey * 71) % 499 + s_suppkey % 11 * 0.077)::DOUBLE AS y, s_acctbal::DOUBLE AS z FROM supplier),
three AS (
  SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS bx, b.y - a.y AS b_y, b.z AS bz, c.x - a.x AS cx, c.y - a.y AS cy, c.z AS cz, a.id AS i, b.id AS j, c.id AS k,
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS w
  FROM p a JOIN p b ON a.id < b.id JOIN p c ON b.id < c.id),
circles AS (
  SELECT *, ax + (cy * (bx * bx + b_y * b_y) - b_y * (cx * cx + cy * cy)) / (2 * w) AS mx, ay + (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_y * b_y)) / (2 * w) AS my
  FROM three WHERE w <> 0),
empty AS (
  SELECT * FROM circles t WHERE NOT EXISTS (
    SELECT 1 FROM p WHERE id NOT IN (t.i, t.j, t.k) AND (p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my) < (ax - mx) * (ax - mx) + (ay - my) * (ay - my))),
places AS (SELECT n_nationkey::INTEGER AS row, c::INTEGER AS col, c * 20.0::DOUBLE + 1.7::DOUBLE AS x, n_nationkey * 20.0::DOUBLE + 2.3::DOUBLE AS y FROM nation, range(20) r(c)),
weighed AS (
  SELECT row, col, az, bz, cz, ((x - ax) * cy - (y - ay) * cx) / w AS u, (bx * (y - ay) - b_y * (x - ax)) / w AS v FROM places, empty)
SELECT row, col, round(any_value(az * (1 - u - v) + bz * u + cz * v), 3) + 0.0 AS z FROM weighed WHERE u >= 0 AND v >= 0 AND u + v <= 1 GROUP BY row, col
"""

RELATIONS = """
SELECT s_suppkey AS relation_id, CASE WHEN e IS NULL THEN 1 ELSE 0 END::BIGINT AS shells, CASE WHEN e IS NULL AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS holes,
  CASE WHEN e IS NULL THEN (s_suppkey % 5 + 4) * (s_suppkey % 7 + 5) - CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 0 END ELSE 0 END::DOUBLE AS area, e AS error
FROM (SELECT *, CASE WHEN s_suppkey % 7 = 0 THEN 'incomplete_outer' WHEN s_suppkey % 11 = 0 THEN 'incomplete_inner' END AS e FROM supplier)
"""
