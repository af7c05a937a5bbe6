"""Registered queries: positions, climate lookup, distance groups, neighbourhoods."""

from __future__ import annotations

from pelagia.functions import geo
from pelagia.operators import neighborhood, spatial
from pelagia.plans.common import F, rel, rounded, table
from pelagia.plans.registry import query

# Rows to match: genome positions shifted off the cell edges, so no two cells are equally near.
ROWS_SQL = "rw AS (SELECT genome, lat + 0.3 AS lat, lon + 0.2 AS lon, depth_m FROM facts)"


def _hav(lat1: str, lat2: str, dlon: str, radius: str) -> str:
    return f"2*{radius}*asin(sqrt(least(1.0, pow(sin(radians({lat2}-{lat1})/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({dlon})/2),2))))"


WRAP = "(({x}+180.0) - 360.0*floor(({x}+180.0)/360.0) - 180.0)"
MATCH_SQL = f"""{ROWS_SQL}, o AS (SELECT *, floor(lat)+0.5 AS olat, floor({WRAP.format(x='lon')})+0.5 AS olon FROM rw WHERE lat IS NOT NULL AND lon IS NOT NULL AND depth_m IS NOT NULL),
    us AS (SELECT DISTINCT cell_lat, cell_lon FROM climate_grid WHERE value IS NOT NULL),
    cand AS (SELECT o.*, greatest(abs(i), abs(j)) AS ring, cell_lat, cell_lon, {_hav('lat', 'cell_lat', 'cell_lon-lon', '6371.0')} AS km
             FROM o, generate_series(-3, 3) a(i), generate_series(-3, 3) b(j), us
             WHERE us.cell_lat = olat + i AND us.cell_lon = {WRAP.format(x='(olon + j)')}),
    pick AS (SELECT * FROM cand QUALIFY ROW_NUMBER() OVER (PARTITION BY genome ORDER BY ring, km, cell_lat, cell_lon) = 1),
    lv AS (SELECT p.*, depth, value FROM pick p JOIN climate_grid g ON g.cell_lat = p.cell_lat AND g.cell_lon = p.cell_lon WHERE value IS NOT NULL),
    lim AS (SELECT genome, any_value(depth_m) AS x, max(depth) FILTER (depth <= depth_m) AS d0, min(depth) FILTER (depth >= depth_m) AS d1,
              arg_max(value, depth) FILTER (depth <= depth_m) AS v0, arg_min(value, depth) FILTER (depth >= depth_m) AS v1 FROM lv GROUP BY genome),
    itp AS (SELECT genome, CASE WHEN d0 IS NULL THEN v1 WHEN d1 IS NULL OR d0 = x THEN v0 ELSE v0 + (x-d0)/(d1-d0)*(v1-v0) END AS climate_value,
              coalesce(d0, d1) AS depth_lower, coalesce(d1, d0) AS depth_upper, coalesce(v0, v1) AS value_lower, coalesce(v1, v0) AS value_upper,
              CASE WHEN d0 = x THEN 'exact_depth' WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN 'depth_interpolated' ELSE 'nearest_depth_outside_available_range' END AS depth_method FROM lim)"""


@query(
    "jn17_nearest_climate_cell",
    f"""WITH {MATCH_SQL} SELECT r.genome, p.cell_lat, p.cell_lon, round(p.km, 4) AS distance_km,
        CASE WHEN r.lat IS NULL OR r.lon IS NULL OR r.depth_m IS NULL THEN 'missing_lat_lon_or_depth' WHEN p.ring IS NULL THEN 'no_value_within_3deg'
             WHEN p.ring = 0 THEN 'matched_exact_1deg_cell' ELSE 'matched_neighbor_within_' || p.ring || 'deg' END AS match_status
        FROM rw r LEFT JOIN pick p ON p.genome = r.genome""",
    ("facts", "climate_grid"),
)
def jn17(spark, sf):
    out = _matched(spark, sf).select("genome", "cell_lat", "cell_lon", "distance_km", "match_status")
    return rounded(out, "distance_km", digits=4)


def _matched(spark, sf):
    rows = rel(spark, sf, "facts").select(
        "genome", (F.col("lat") + 0.3).alias("lat"), (F.col("lon") + 0.2).alias("lon"), "depth_m"
    )
    return spatial.match_climate(rows, rel(spark, sf, "climate_grid"))


@query(
    "jn18_value_at_depth",
    f"""WITH {MATCH_SQL} SELECT genome, round(climate_value, 8) AS climate_value, depth_lower, depth_upper, value_lower, value_upper, depth_method FROM itp""",
    ("facts", "climate_grid"),
)
def jn18(spark, sf):
    out = _matched(spark, sf).where("depth_method IS NOT NULL")
    out = out.select("genome", "climate_value", "depth_lower", "depth_upper", "value_lower", "value_upper", "depth_method")
    return rounded(out, "climate_value", digits=8)


PLACES = [("North Ridge", 40.0, -30.0), ("South Basin", -45.5, 60.5), ("West Trench", 11.0, 142.0), ("Twin Trench", 12.0, 143.0)]
PLACES_SQL = "(VALUES ('North Ridge', 40.0::DOUBLE, -30.0::DOUBLE), ('South Basin', -45.5, 60.5), ('West Trench', 11.0, 142.0), ('Twin Trench', 12.0, 143.0)) v(name, plat, plon)"


@query(
    "jn19_nearest_named_place",
    f"""WITH r AS (SELECT s_suppkey, CAST(s_suppkey % 6 AS DOUBLE) * 0.7 + 10 AS lat, CAST(s_suppkey % 9 AS DOUBLE) * 0.61 + 140 AS lon FROM supplier),
        d AS (SELECT r.*, name, sqrt(pow(lat-plat, 2) + pow(lon-plon, 2)) AS dd, round(lat, 1) = plat AND round(lon, 1) = plon AS ex FROM r, {PLACES_SQL}),
        b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s_suppkey ORDER BY ex DESC, dd, name) AS rn FROM d)
        SELECT s_suppkey, lat, lon, CASE WHEN ex OR dd < 2.0 THEN name ELSE 'trench' END AS place FROM b WHERE rn = 1""",
)
def jn19(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CAST(s_suppkey % 6 AS DOUBLE) * CAST(0.7 AS DOUBLE) + 10 AS lat", "CAST(s_suppkey % 9 AS DOUBLE) * CAST(0.61 AS DOUBLE) + 140 AS lon"
    )
    return spatial.nearest_place(rows, PLACES, 2.0, "trench")


@query(
    "jn15_site_distance_matrix",
    f"""WITH s AS (SELECT sample_id AS site, avg(lat) AS lat, avg(lon) AS lon FROM facts WHERE lat IS NOT NULL GROUP BY 1)
        SELECT a.site AS site_a, b.site AS site_b, round({_hav('a.lat', 'b.lat', 'b.lon-a.lon', '6371.0088')}, 4) AS km FROM s a JOIN s b ON a.site < b.site""",
    ("facts",),
)
def jn15(spark, sf):
    sites = rel(spark, sf, "facts").where("lat IS NOT NULL").groupBy(F.col("sample_id").alias("site"))
    sites = sites.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return rounded(spatial.geographic_distances(sites), "km", digits=4)


@query(
    "jn15_neighbours_within_radius",
    f"""SELECT a.genome AS genome_a, b.genome AS genome_b, round({_hav('a.lat', 'b.lat', 'b.lon-a.lon', '6371.0088')}, 4) AS km
        FROM facts a JOIN facts b ON a.genome < b.genome AND {_hav('a.lat', 'b.lat', 'b.lon-a.lon', '6371.0088')} <= 300""",
    ("facts",),
)
def jn15_neighbours(spark, sf):
    found = spatial.neighbours_within(rel(spark, sf, "facts"), "genome", 300.0)
    return rounded(found.withColumnsRenamed({"id_a": "genome_a", "id_b": "genome_b"}), "km", digits=4)


@query(
    "jn16_groups_within_distance",
    f"""WITH RECURSIVE p AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat, CAST((s_suppkey * 53) % 361 - 180 AS DOUBLE) AS lon FROM supplier),
        e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND {_hav('a.lat', 'b.lat', 'b.lon-a.lon', '6371.0088')} < 1100),
        r(node, comp) AS (SELECT id, id FROM p UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node)
        SELECT id, lat, lon, component FROM p JOIN (SELECT node, min(comp) AS component FROM r GROUP BY node) ON node = id""",
)
def jn16(spark, sf):
    points = table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS id", "CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat", "CAST((s_suppkey * 53) % 361 - 180 AS DOUBLE) AS lon"
    )
    return spatial.distance_groups(points, "id", 1100.0)


BASIN_SQL = """CASE WHEN lat <= -60 THEN 'Southern Ocean' WHEN lat >= 66 THEN 'Arctic Ocean'
    WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 42 THEN 'Mediterranean/Black Sea' WHEN lon BETWEEN -70 AND 20 THEN 'Atlantic Ocean'
    WHEN lon > 20 AND lon <= 120 THEN 'Indian Ocean' WHEN lat IS NOT NULL THEN 'Pacific Ocean' END"""


@query("f6_ocean_basin", f"SELECT genome, {BASIN_SQL} AS basin FROM facts", ("facts",))
def f6(spark, sf):
    return rel(spark, sf, "facts").select("genome", geo.ocean_basin(F.col("lat"), F.col("lon")).alias("basin"))


@query(
    "f5_depth_zone",
    """SELECT genome, CASE WHEN depth_m IS NULL THEN '' WHEN greatest(depth_m, 0) < 50 THEN '0-50m' WHEN depth_m < 200 THEN '50-200m'
       WHEN depth_m < 1000 THEN '200-1000m' WHEN depth_m < 4000 THEN '1000-4000m' ELSE '>4000m' END AS zone FROM facts""",
    ("facts",),
)
def f5(spark, sf):
    return rel(spark, sf, "facts").select("genome", geo.depth_zone(F.col("depth_m")).alias("zone"))


@query(
    "f7_haversine",
    f"""SELECT genome, round({_hav('lat', '10.0', '20.0-lon', '6371.0088')}, 4) AS km, round({_hav('lat', '10.0', '20.0-lon', '6371.0')}, 4) AS km_rounded_radius FROM facts""",
    ("facts",),
)
def f7(spark, sf):
    there = (F.lit(10.0), F.lit(20.0))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), *there)
    rough = geo.haversine_km(F.col("lat"), F.col("lon"), *there, geo.EARTH_RADIUS_ROUNDED_KM)
    return rounded(rel(spark, sf, "facts").select("genome", km.alias("km"), rough.alias("km_rounded_radius")), "km", "km_rounded_radius", digits=4)


@query(
    "f8_cells_and_wrapping",
    f"""SELECT genome, {WRAP.format(x='(lon*2.5)')} AS wrapped, floor(lat + 0.3) + 0.5 AS centre, CAST(floor(lon/15)*15 AS INT) AS cell FROM facts""",
    ("facts",),
)
def f8(spark, sf):
    return rel(spark, sf, "facts").select(
        "genome",
        geo.wrap_longitude(F.col("lon") * 2.5).alias("wrapped"),
        geo.cell_centre(F.col("lat") + 0.3).alias("centre"),
        geo.grid_cell(F.col("lon"), 15).alias("cell"),
    )


GENES_SQL = """genes AS (SELECT user_id AS scaffold, event_id AS gene_id, event_type, value,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""


def genes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("scaffold"), F.col("event_id").alias("gene_id"), "event_type", "value", "ts")
    return neighborhood.gene_positions(rows, "scaffold", ["ts", "gene_id"], F.date_trunc("day", "ts")).drop("ts")


@query("wn3_gene_positions", f"WITH {GENES_SQL} SELECT * FROM genes")
def wn3(spark, sf):
    return genes(spark, sf)


@query(
    "wn2_neighbourhood_windows",
    f"""WITH {GENES_SQL}, w AS (SELECT *, max((event_type = 'error' AND value > 60)::INT) OVER (PARTITION BY scaffold ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM genes)
        SELECT scaffold, gene_id, event_type, value, pos FROM w WHERE near = 1""",
)
def wn2(spark, sf):
    anchor = (F.col("event_type") == "error") & (F.col("value") > 60)
    return neighborhood.neighbourhood_windows(genes(spark, sf), anchor, "scaffold", 3)


STRIP = "regexp_replace(text, '[*X]$', '')"


@query(
    "jn8_anchor_match",
    f"""WITH d AS (SELECT doc_id, lang, text || CASE WHEN doc_id % 3 = 0 THEN '*' WHEN doc_id % 3 = 1 THEN 'X' ELSE '' END AS text FROM documents)
        SELECT doc_id AS gene_id, lang AS genome FROM d WHERE EXISTS (SELECT 1 FROM d a WHERE a.doc_id % 7 = 0 AND a.lang = d.lang AND {STRIP.replace('text', 'a.text')} = {STRIP.replace('text', 'd.text')})""",
)
def jn8(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS gene_id", "lang AS genome", "text || CASE WHEN doc_id % 3 = 0 THEN '*' WHEN doc_id % 3 = 1 THEN 'X' ELSE '' END AS sequence"
    )
    anchors = rows.where("gene_id % 7 = 0").select("genome", "sequence")
    return neighborhood.match_anchors(rows, anchors).select("gene_id", "genome")


@query(
    "st6_first_genome_per_gene",
    """SELECT gene_id, genome, value FROM (SELECT user_id * 100 + event_id % 37 AS gene_id, event_type AS genome, value,
         ROW_NUMBER() OVER (PARTITION BY user_id * 100 + event_id % 37 ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
)
def st6(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id * 100 + event_id % 37 AS gene_id", "event_type AS genome", "value", "event_id")
    return neighborhood.first_genome_per_gene(rows, ["event_id"]).drop("event_id")


@query(
    "wn9_copies_in_order",
    """SELECT o_custkey, o_orderkey, scaffold_no, gene_index, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CAST(scaffold_no AS INT), gene_index) AS ordinal
       FROM (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 113 AS VARCHAR) AS scaffold_no, o_orderkey AS gene_index FROM orders)""",
)
def wn9(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "CAST(o_orderkey % 113 AS STRING) AS scaffold_no", "o_orderkey AS gene_index")
    return neighborhood.copies_in_order(rows, "o_custkey", "scaffold_no", "gene_index")


@query(
    "opg15_recovery_status",
    f"""WITH {GENES_SQL}, w AS (SELECT *, max((event_type = 'error' AND value > 60)::INT) OVER (PARTITION BY scaffold ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM genes),
        g AS (SELECT scaffold AS genome, count(*) AS n_genes, count(*) FILTER (event_type = 'error' AND value > 60) AS n_anchors, count(*) FILTER (near = 1) AS n_window_genes FROM w GROUP BY 1)
        SELECT c_custkey AS genome, coalesce(n_genes, 0) AS n_genes, coalesce(n_anchors, 0) AS n_anchors, coalesce(n_window_genes, 0) AS n_window_genes,
               CASE WHEN n_genes IS NULL THEN 'download_failed' WHEN n_anchors = 0 THEN 'no_anchors' ELSE 'ok' END AS status
        FROM customer LEFT JOIN g ON g.genome = c_custkey""",
)
def opg15(spark, sf):
    placed = genes(spark, sf).withColumn("genome", F.col("scaffold"))
    anchor = (F.col("event_type") == "error") & (F.col("value") > 60)
    windows = neighborhood.neighbourhood_windows(placed, anchor, "scaffold", 3)
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("genome"))
    return neighborhood.recovery_status(wanted, placed, placed.where(anchor), windows)
