"""DuckDB SQL for the queries of `catalog_land`, in plain, brute-force terms."""

from __future__ import annotations

from rainfold.catalog_sql import _FILL, _FLOW, _SITES, _SLOPES, PART, POINTS, TILE

# ponds: everything in a pond's own frame, where its rectangle is the box |u| <= hw, |v| <= hl
FEASIBLE = """WITH d AS (
  SELECT *, width_m / 2 + margin_m AS hw, length_m / 2 + margin_m AS hl, cos(radians(bearing)) AS c, sin(radians(bearing)) AS s,
    CASE WHEN length_m NOT BETWEEN 5 AND 500 THEN 'length_m' WHEN width_m NOT BETWEEN 5 AND 500 THEN 'width_m' WHEN depth_m NOT BETWEEN 0.5 AND 3 THEN 'depth_m' WHEN freeboard_m NOT BETWEEN 0.1 AND 1 THEN 'freeboard_m'
      WHEN margin_m NOT BETWEEN 1 AND 30 THEN 'margin_m' WHEN freeboard_m >= depth_m THEN 'freeboard_too_large' WHEN least(length_m, width_m) - 4 * depth_m <= 0 THEN 'no_bottom' END AS error
  FROM (SELECT p_partkey AS id, p_partkey % 27 AS land, (p_partkey % 27 * 9.0 + 60 + p_partkey % 13 * 7)::DOUBLE AS x, (p_partkey % 27 * 11.0 + 50 + p_partkey % 11 * 6)::DOUBLE AS y, (3 + p_partkey % 40)::DOUBLE AS length_m,
    (5 + p_size % 30)::DOUBLE AS width_m, (1 + p_partkey % 4 * 0.5)::DOUBLE AS depth_m, (p_partkey * 7 % 360)::DOUBLE AS bearing, (0.25 + p_partkey % 3 * 0.375)::DOUBLE AS freeboard_m, (1 + p_partkey % 5)::DOUBLE AS margin_m, p_partkey % 6 <> 0 AS known FROM part)),
corner(cu, cv) AS (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)),
edge(hole, ax, ay, bx, b_y) AS (VALUES (FALSE, -20.0::DOUBLE, -10.0::DOUBLE, 240.0::DOUBLE, 40.0::DOUBLE), (FALSE, 240, 40, 70, 220), (FALSE, 70, 220, -20, -10), (TRUE, 150, 60, 170, 62), (TRUE, 170, 62, 160, 80), (TRUE, 160, 80, 150, 60)),
turned AS (
  SELECT id, hw, hl, hole, (ax + ox - x) * c - (ay + oy - y) * s AS au, (ax + ox - x) * s + (ay + oy - y) * c AS av, (bx + ox - x) * c - (b_y + oy - y) * s AS bu, (bx + ox - x) * s + (b_y + oy - y) * c AS bv
  FROM d JOIN (SELECT n_nationkey AS land, n_regionkey % 2 = 0 AS holed, n_nationkey * 9.0::DOUBLE AS ox, n_nationkey * 11.0::DOUBLE AS oy FROM nation) n USING (land) JOIN edge ON holed OR NOT hole),
sides AS (SELECT id, hole, au, av, any_value(hw) AS hw, any_value(hl) AS hl, min((bu - au) * (cv * hl - av) - (bv - av) * (cu * hw - au)) AS least, max((bu - au) * (cv * hl - av) - (bv - av) * (cu * hw - au)) AS most FROM turned, corner GROUP BY id, hole, au, av),
fits AS (
  SELECT id, min(least) FILTER (NOT hole) >= 0 AND (count(*) FILTER (hole) = 0 OR min(most) FILTER (hole) <= 0 OR min(au) FILTER (hole) >= any_value(hw) OR max(au) FILTER (hole) <= -any_value(hw) OR min(av) FILTER (hole) >= any_value(hl) OR max(av) FILTER (hole) <= -any_value(hl)) AS ok
  FROM sides GROUP BY id),
w AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 400)::DOUBLE AS px, (s_suppkey * 91 % 500)::DOUBLE AS py, s_suppkey % 3 = 0 AS area, 12 + CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN 7 WHEN s_suppkey % 5 = 2 THEN 3 ELSE 0 END::DOUBLE AS reach FROM supplier),
seg AS (SELECT k, area, reach, px AS ax, py AS ay, px + 35 AS bx, py + 12 AS b_y FROM w UNION ALL SELECT k, area, reach, px + 35, py + 12, px + 20, py + 48 FROM w UNION ALL SELECT k, area, reach, px + 20, py + 48, px, py FROM w WHERE area),
local AS (
  SELECT id, k, area, reach, hw, hl, (ax - x) * c - (ay - y) * s AS au, (ax - x) * s + (ay - y) * c AS av, (bx - x) * c - (b_y - y) * s AS bu, (bx - x) * s + (b_y - y) * c AS bv
  FROM d JOIN fits USING (id) JOIN seg ON error IS NULL AND ok AND known),
apart AS (
  SELECT id, k, area, reach, au, av, bu, bv,
    -- a segment meets the box unless the box's sides or the segment's own line part them
    greatest(au, bu) >= -hw AND least(au, bu) <= hw AND greatest(av, bv) >= -hl AND least(av, bv) <= hl AND min((bu - au) * (cv * hl - av) - (bv - av) * (cu * hw - au)) <= 0 AND max((bu - au) * (cv * hl - av) - (bv - av) * (cu * hw - au)) >= 0 AS meets,
    least(sqrt(greatest(abs(au) - hw, 0) ** 2 + greatest(abs(av) - hl, 0) ** 2), sqrt(greatest(abs(bu) - hw, 0) ** 2 + greatest(abs(bv) - hl, 0) ** 2),
      min(sqrt((cu * hw - au - t * (bu - au)) ** 2 + (cv * hl - av - t * (bv - av)) ** 2))) AS far
  FROM (SELECT *, greatest(0, least(1, ((cu * hw - au) * (bu - au) + (cv * hl - av) * (bv - av)) / ((bu - au) ** 2 + (bv - av) ** 2))) AS t FROM local, corner) GROUP BY id, k, area, reach, hw, hl, au, av, bu, bv),
wet AS (SELECT DISTINCT id FROM (SELECT id, k, bool_or(meets OR far <= reach) OR (any_value(area) AND sum(CASE WHEN (av > 0) <> (bv > 0) AND 0 < au + (0 - av) / (bv - av) * (bu - au) THEN 1 ELSE 0 END) % 2 = 1) AS wet FROM apart GROUP BY id, k) WHERE wet),
made AS (SELECT d.id, error, CASE WHEN error IS NULL THEN coalesce(ok, FALSE) END AS inside, known, wet.id IS NOT NULL AS wet FROM d LEFT JOIN fits ON fits.id = d.id LEFT JOIN wet ON wet.id = d.id)
SELECT id AS design_id, error, inside AS within_selected_land, CASE WHEN inside AND known THEN NOT wet END AS avoids_mapped_water,
  CASE WHEN error IS NOT NULL THEN 'invalid' WHEN NOT inside THEN 'does_not_fit' WHEN NOT known THEN 'unverified' WHEN wet THEN 'does_not_fit' ELSE 'passes_checks' END AS screening_status FROM made"""
RUNOFF_AREA = f"""WITH RECURSIVE {_SITES}, five AS (SELECT survey, site, node % 8 * 10 + 2.5::DOUBLE AS x, node // 8 * 10 - 1.25::DOUBLE AS y, (20 + site * 6)::DOUBLE AS l FROM ranked WHERE site <= 5),
box AS (SELECT *, CASE WHEN site % 2 = 0 THEN l / 2 ELSE 7 END AS hx, CASE WHEN site % 2 = 0 THEN 7 ELSE l / 2 END AS hy FROM five)
SELECT t.survey, t.site::BIGINT AS site, t.site::BIGINT * 10 AS design_id, count(*) * 100.0::DOUBLE AS catchment_m2,
  round(sum(greatest(0, least(x + hx, node % 8 * 10 + 5) - greatest(x - hx, node % 8 * 10 - 5)) * greatest(0, least(y + hy, node // 8 * 10 + 5) - greatest(y - hy, node // 8 * 10 - 5))), 4) + 0.0 AS covered_m2,
  round(count(*) * 100.0::DOUBLE - sum(greatest(0, least(x + hx, node % 8 * 10 + 5) - greatest(x - hx, node % 8 * 10 - 5)) * greatest(0, least(y + hy, node // 8 * 10 + 5) - greatest(y - hy, node // 8 * 10 - 5))), 4) + 0.0 AS runoff_area_m2
FROM traced t JOIN box USING (survey, site) GROUP BY t.survey, t.site"""

# terrain
WINDOWS = """WITH a AS (SELECT c_custkey AS land_id, (c_custkey * 37.25)::DOUBLE AS min_x, (c_custkey * 11.5 - 900)::DOUBLE AS min_y, (c_custkey * 37.25 + 40 + c_custkey % 17 * 1000)::DOUBLE AS max_x, (c_custkey * 11.5 - 900 + 60 + c_custkey % 5 * 700)::DOUBLE AS max_y FROM customer),
b AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area_m2, floor((min_x - 2000) / 30) * 30 AS l, floor((min_y - 2000) / 30) * 30 AS b, ceil((max_x + 2000) / 30) * 30 AS r, ceil((max_y + 2000) / 30) * 30 AS t FROM a),
e AS (SELECT *, CASE WHEN area_m2 > 25000000 OR max_x - min_x > 15000 OR max_y - min_y > 15000 THEN 'too_large' WHEN (r - l) / 30 * ((t - b) / 30) > 1000000 THEN 'too_many_cells' END AS error FROM b)
SELECT land_id, min_x, min_y, max_x, max_y, area_m2, error, CASE WHEN error IS NULL THEN l END AS "left", CASE WHEN error IS NULL THEN b END AS bottom, CASE WHEN error IS NULL THEN r END AS "right", CASE WHEN error IS NULL THEN t END AS top,
  CASE WHEN error IS NULL THEN ((r - l) / 30)::BIGINT END AS width, CASE WHEN error IS NULL THEN ((t - b) / 30)::BIGINT END AS height FROM e"""
TILES = f"""WITH {POINTS}, w AS (SELECT id, lat - 0.25::DOUBLE AS south, lon - 0.5::DOUBLE AS west, lat + id % 3 * 0.25::DOUBLE AS north, lon + id % 4 * 0.25::DOUBLE AS east FROM pts), a(t) AS (SELECT * FROM range(-90, 90)), o(g) AS (SELECT * FROM range(-180, 180))
SELECT id, t::INTEGER AS tile_lat, g::INTEGER AS tile_lon, CASE WHEN t >= 0 THEN 'N' ELSE 'S' END || lpad(abs(t)::VARCHAR, 2, '0') || '_' || CASE WHEN g >= 0 THEN 'E' ELSE 'W' END || lpad(abs(g)::VARCHAR, 3, '0') AS tile
FROM w JOIN a ON t + 1 > south - 3 / 3600.0::DOUBLE AND t <= north + 3 / 3600.0::DOUBLE JOIN o ON g + 1 > west - 3 / 3600.0::DOUBLE AND g <= east + 3 / 3600.0::DOUBLE"""
BILINEAR = f"""WITH {PART}, q AS (SELECT s_suppkey AS point, (s_suppkey * 13 % 40 / 8.0 + s_suppkey % 7 * 0.125)::DOUBLE AS r, (s_suppkey * 29 % 300 / 8.0)::DOUBLE AS c FROM supplier),
n AS (SELECT q.point, sum((1 - abs(q.r - k.row)) * (1 - abs(q.c - k.col)) * z) / sum((1 - abs(q.r - k.row)) * (1 - abs(q.c - k.col))) AS z FROM q JOIN cells k ON valid AND abs(q.r - k.row) < 1 AND abs(q.c - k.col) < 1 GROUP BY q.point)
SELECT q.point, q.r, q.c, round(z, 6) + 0.0 AS z FROM q LEFT JOIN n USING (point)"""
POLYGONS = f"""WITH RECURSIVE {TILE}, m AS (SELECT survey, row, col, row * 8 + col AS node FROM cells WHERE z >= 0),
reach AS (SELECT survey, node, row, col, node AS other FROM m UNION SELECT r.survey, r.node, w.row, w.col, w.node FROM reach r JOIN m w ON w.survey = r.survey AND abs(w.row - r.row) + abs(w.col - r.col) = 1),
part AS (SELECT survey, node // 8 AS row, node % 8 AS col, min(other) AS part FROM reach GROUP BY survey, node),
counted AS (
  SELECT p.survey, p.part, count(*) AS cells, count(e.row) AS across, count(n.row) AS along, count(e.row) FILTER (n.row IS NOT NULL AND d.row IS NOT NULL) AS squares
  FROM part p LEFT JOIN part e ON e.survey = p.survey AND e.part = p.part AND e.row = p.row AND e.col = p.col + 1 LEFT JOIN part n ON n.survey = p.survey AND n.part = p.part AND n.row = p.row + 1 AND n.col = p.col
    LEFT JOIN part d ON d.survey = p.survey AND d.part = p.part AND d.row = p.row + 1 AND d.col = p.col + 1 GROUP BY p.survey, p.part),
-- the ground about a part, met from outside the tile over sides and corners, is what its shell leaves out
frame AS (SELECT DISTINCT survey, part FROM part), spot AS (SELECT r::INTEGER AS row, c::INTEGER AS col FROM range(-1, 9) a(r), range(-1, 9) b(c)),
ground AS (SELECT f.survey, f.part, s.row, s.col FROM frame f CROSS JOIN spot s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.survey = f.survey AND p.part = f.part AND p.row = s.row AND p.col = s.col)),
outside AS (SELECT survey, part, -1::INTEGER AS row, -1::INTEGER AS col FROM frame UNION SELECT g.survey, g.part, g.row, g.col FROM outside o JOIN ground g ON g.survey = o.survey AND g.part = o.part AND abs(g.row - o.row) <= 1 AND abs(g.col - o.col) <= 1)
SELECT k.survey, (k.part // 8)::INTEGER AS row, (k.part % 8)::INTEGER AS col, (1 - (cells - across - along + squares))::BIGINT AS holes, cells::DOUBLE AS area, (100 - (SELECT count(*) FROM outside o WHERE o.survey = k.survey AND o.part = k.part))::DOUBLE AS shell_area FROM counted k"""

# maps
_LAKES = """rel AS (SELECT s_suppkey AS k, s_suppkey % 50 * 160.0::DOUBLE AS ox, s_suppkey % 31 * 160.0::DOUBLE AS oy, (s_suppkey % 5 + 4) * 16.0::DOUBLE AS w, (s_suppkey % 7 + 5) * 16.0::DOUBLE AS h,
  CASE WHEN s_suppkey % 7 = 0 THEN 'incomplete_outer' WHEN s_suppkey % 11 = 0 THEN 'incomplete_inner' END AS e FROM supplier)"""
MAP_WATER = f"""WITH {PART}, {_LAKES},
raw AS (
  SELECT k, TRUE AS lake, FALSE AS isle, 4 + 10 / sqrt(2.0::DOUBLE) AS reach, ox, oy, unnest([{{'ax': 0.0::DOUBLE, 'ay': 0.0::DOUBLE, 'bx': w, 'b_y': 0.0::DOUBLE}}, {{'ax': w, 'ay': 0.0::DOUBLE, 'bx': w, 'b_y': h}}, {{'ax': w, 'ay': h, 'bx': 0.0::DOUBLE, 'b_y': h}}, {{'ax': 0.0::DOUBLE, 'ay': h, 'bx': 0.0::DOUBLE, 'b_y': 0.0::DOUBLE}}]) AS s FROM rel WHERE e IS NULL
  UNION ALL
  SELECT k, TRUE, TRUE, 4 + 10 / sqrt(2.0::DOUBLE), ox, oy, unnest([{{'ax': 16.0::DOUBLE, 'ay': 16.0::DOUBLE, 'bx': 48.0::DOUBLE, 'b_y': 16.0::DOUBLE}}, {{'ax': 48.0::DOUBLE, 'ay': 16.0::DOUBLE, 'bx': 48.0::DOUBLE, 'b_y': 64.0::DOUBLE}}, {{'ax': 48.0::DOUBLE, 'ay': 64.0::DOUBLE, 'bx': 16.0::DOUBLE, 'b_y': 16.0::DOUBLE}}]) FROM rel WHERE e IS NULL AND k % 3 = 0
  UNION ALL
  SELECT k, FALSE, FALSE, 4 + 10 / sqrt(2.0::DOUBLE) + 3, ox, oy, unnest([{{'ax': 0.0::DOUBLE, 'ay': 0.0::DOUBLE, 'bx': w, 'b_y': 0.0::DOUBLE}}, {{'ax': w, 'ay': 0.0::DOUBLE, 'bx': w, 'b_y': h}}]) FROM rel WHERE k % 4 = 0),
seg AS (SELECT k, lake, isle, reach, ox, oy, ox + s.ax AS ax, oy + s.ay AS ay, ox + s.bx AS bx, oy + s.b_y AS b_y FROM raw),
t AS (SELECT c.row, c.col, s.*, c.col * 10.0::DOUBLE AS x, c.row * 10.0::DOUBLE AS y, greatest(0, least(1, ((c.col * 10 - ax) * (bx - ax) + (c.row * 10 - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) AS p FROM cells c JOIN seg s ON abs(c.col * 10 - s.ox) < 300 AND abs(c.row * 10 - s.oy) < 300),
d AS (SELECT row, col, k, lake, isle, any_value(reach) AS reach, min(sqrt((x - ax - p * (bx - ax)) ** 2 + (y - ay - p * (b_y - ay)) ** 2)) AS dist, sum(CASE WHEN (ay > y) <> (b_y > y) AND x < ax + (y - ay) / (b_y - ay) * (bx - ax) THEN 1 ELSE 0 END) % 2 = 1 AS within FROM t GROUP BY row, col, k, lake, isle)
SELECT row, col FROM d GROUP BY row, col, k, lake HAVING min(dist - reach) <= 0 OR (lake AND coalesce(bool_or(within) FILTER (NOT isle), FALSE) AND NOT coalesce(bool_or(within) FILTER (isle), FALSE))"""
MAP_WATER = f"SELECT DISTINCT row, col FROM ({MAP_WATER})"
MAP_ERRORS = f"""WITH {_LAKES} SELECT coalesce(e, 'none') AS error, TRUE AS area, count(*)::BIGINT AS features FROM rel GROUP BY 1 UNION ALL SELECT 'none', FALSE, count(*)::BIGINT FROM rel WHERE k % 4 = 0 HAVING count(*) > 0"""
OSM_RELATIONS = f"""WITH {POINTS}, m AS (SELECT l_orderkey AS relation_id, l_linenumber AS n, CASE WHEN l_partkey % 5 = 0 THEN 'node' ELSE 'way' END AS type, l_partkey % 150 AS ref, CASE WHEN l_suppkey % 2 = 0 THEN 'outer' ELSE 'inner' END AS role FROM lineitem),
j AS (SELECT m.*, p.lon FROM m LEFT JOIN pts p ON p.id = m.ref AND p.id % 7 <> 3 WHERE type = 'way')
SELECT relation_id, count(*) FILTER (lon IS NULL)::BIGINT AS missing, count(lon)::BIGINT AS members, round(list_reduce(list_prepend(0.0::DOUBLE, coalesce(list(lon ORDER BY n, type, ref, role) FILTER (lon IS NOT NULL), [])), lambda a, b: a * 0.5::DOUBLE + b), 6) + 0.0 AS digest FROM j GROUP BY relation_id"""

SLOPE_STATISTICS = f"WITH {PART}, {_SLOPES} SELECT survey, round(min(slope_deg), 6) + 0.0 AS slope_min, round(max(slope_deg), 6) + 0.0 AS slope_max, round(avg(slope_deg), 6) + 0.0 AS slope_mean, round(avg((NOT valid)::INTEGER), 6) + 0.0 AS extrapolated_fraction FROM slopes GROUP BY survey"

# sites
ALLOWED = f"""WITH {PART} SELECT row, col FROM cells WHERE valid AND row % 7 <> 0 AND col % 11 <> 0 AND row % 5 * 10 >= 10 AND col % 13 <> 0 AND col % 10 <= 8 AND row >= 1 AND row <= (SELECT max(row) FROM cells) - 1 AND col >= 1 AND col <= (SELECT max(col) FROM cells) - 1"""
POOLS = f"""WITH RECURSIVE {_FILL}, wet AS (SELECT survey, row, col, (row * 8 + col)::BIGINT AS node, z, z_filled FROM filled WHERE z_filled - z > 1e-6),
reach AS (SELECT survey, node, row, col, node AS other FROM wet UNION SELECT r.survey, r.node, w.row, w.col, w.node FROM reach r JOIN wet w ON w.survey = r.survey AND abs(w.row - r.row) <= 1 AND abs(w.col - r.col) <= 1),
comp AS (SELECT survey, node, min(other) AS component FROM reach GROUP BY survey, node),
m AS (SELECT w.*, component, (w.row + w.col) % 3 <> 0 AS allowed, (w.survey + w.row) % 9 <> 0 AS land, (w.survey * 3 + w.col) % 8 = 0 AS water, w.row * w.col % 5 AS clearance FROM wet w JOIN comp USING (survey, node)),
low AS (SELECT *, min(z) FILTER (allowed) OVER (PARTITION BY survey, component) AS l FROM m)
SELECT survey, component, arg_max(node, (clearance, -node)) FILTER (allowed AND z <= l + 1e-6) AS node, count(*)::BIGINT AS cells, min(z) AS bottom FROM low GROUP BY survey, component
HAVING count(*) >= 3 AND NOT bool_or(water) AND bool_and(land) AND bool_or(allowed) AND max(z_filled) - min(z_filled) <= 1e-5"""
LIMITS = f"""WITH RECURSIVE {_FLOW}, {_SLOPES}, t AS (SELECT s.survey, s.row, s.col, a.acc, s.slope_deg FROM slopes s JOIN acc a ON a.survey = s.survey AND a.node = s.row * 8 + s.col WHERE acc * 100.0::DOUBLE / 1e4 >= 0.03 AND acc * 100.0::DOUBLE / 1e4 <= 0.2)
SELECT survey, row, col, acc AS area_cells, round(0.75::DOUBLE * (1 - ln(1 + acc::DOUBLE) / ln(1 + (max(acc) OVER (PARTITION BY survey))::DOUBLE)) + 0.25::DOUBLE * least(slope_deg / 8, 1), 6) + 0.0 AS score FROM t"""
ASSESSED = f"""WITH RECURSIVE {_SITES}, t AS (SELECT *, (node + site) % 4 <> 0 AS plain, node % 5 = 0 AS raised, node % 17 = 0 AS water, node // 8 IN (0, 7) OR node % 8 IN (0, 7) AS rim FROM traced)
SELECT survey, site::BIGINT AS site, count(*)::BIGINT AS filled_cells, round(count(*) FILTER (raised) / count(*), 6) + 0.0 AS catchment_filled_fraction, max(CASE WHEN raised THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END) AS catchment_max_fill_m, round(count(*) FILTER (NOT plain) / count(*), 6) + 0.0 AS additional_area_fraction,
  round(count(*) FILTER (NOT plain) / count(*), 6) + 0.0 AS routing_sensitivity_fraction, bool_or(water) AS upstream_water_overlap, round(count(*) FILTER (water) / count(*), 6) + 0.0 AS upstream_water_fraction, bool_or(rim) AS boundary_truncated FROM t GROUP BY survey, site"""
SITE_CENTRE = f"WITH {POINTS} SELECT round(avg(lon), 6) + 0.0 AS lon, round(avg(lat), 6) + 0.0 AS lat FROM pts"

# lands and rain
LAND_ERRORS = f"""WITH {POINTS} SELECT id AS land_id, CASE id % 8 WHEN 0 THEN 'not_closed' WHEN 1 THEN 'self_intersecting' WHEN 2 THEN 'too_wide' WHEN 3 THEN 'no_area' WHEN 4 THEN 'missing' WHEN 5 THEN 'out_of_range' END AS error FROM pts"""
CENTROIDS = "SELECT n_nationkey AS land_id, round(12.0::DOUBLE * n_nationkey + (-13 + 151 + 41) / 3.0::DOUBLE, 6) AS x, round(15.0::DOUBLE * n_nationkey + (-7 + 23 + 137) / 3.0::DOUBLE, 6) AS y FROM nation"
LOCAL = f"WITH {POINTS} SELECT id, lat - 1 >= -80 AND lat + id % 4 <= 84 AND id % 5 <= 3 AS local FROM pts"
USABLE_RAIN = "SELECT s_suppkey, s_suppkey % 6 > 3 AND s_acctbal >= 0 AND s_acctbal <> -999 AS usable FROM supplier"
YEAR_WINDOWS = "SELECT o_orderkey, (year(o_orderdate::DATE) - 10)::INTEGER AS first_year, (year(o_orderdate::DATE) - 1)::INTEGER AS last_year FROM orders"
RASTER_FILES = f"WITH {TILE} SELECT survey % 4 AS survey, count(*)::BIGINT AS cells, sum(z) AS z FROM cells WHERE survey % 4 IN (1, 2) GROUP BY 1"
RESPONSE_FILES = f"WITH {PART} SELECT 'survey,z' AS columns, count(*)::BIGINT AS rows, round(sum(z::DECIMAL(20, 2)), 2)::DOUBLE AS z FROM cells"
