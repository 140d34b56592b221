"""Queries over grids: terrain, roads, emissions, wind-directional sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.operators import daily, grid, metrics
from fillwise.plans.fixtures import fixture, with_fixtures
from fillwise.plans.registry import register
from fillwise.plans.station_days import _DAILY
from fillwise.scratch import scratch
from fillwise.sources import tables

NX, NY = 52, 42


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_grid")


def _tpi_box(size: int):
    return lambda spark, sf_dir: metrics.rounded(grid.tpi_box(_field(spark, sf_dir), "elev", size))


def _tpi_box_sql(size: int) -> str:
    h = size // 2
    return with_fixtures("fx_grid", f""", b AS (SELECT max(xi) AS nx, max(yi) AS ny FROM fx_grid),
o AS (SELECT x.range AS dx, y.range AS dy FROM range({-h}, {h + 1}) x, range({-h}, {h + 1}) y)
SELECT c.xi, c.yi, round(c.elev, 6) AS elev, round(c.elev - avg(n.elev), 6) + 0 AS tpi
FROM fx_grid c CROSS JOIN o CROSS JOIN b JOIN fx_grid n ON n.xi = greatest(0, least(nx, c.xi + dx)) AND n.yi = greatest(0, least(ny, c.yi + dy))
GROUP BY c.xi, c.yi, c.elev""")


for _size in (3, 7, 15):
    register(f"tpi_box_{_size}", _tpi_box(_size), _tpi_box_sql(_size))


def _disk_sql(radius: int, name: str) -> str:
    return f"""{name} AS (SELECT c.xi, c.yi, c.elev, c.elev - avg(n.elev) AS tpi FROM fx_grid c
  JOIN fx_grid n ON (n.xi - c.xi) * (n.xi - c.xi) + (n.yi - c.yi) * (n.yi - c.yi) <= {radius * radius} GROUP BY c.xi, c.yi, c.elev)"""


def tpi_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(grid.tpi_disk(_field(spark, sf_dir), "elev", 6))


register("tpi_disk_6", tpi_disk, with_fixtures("fx_grid", f""", {_disk_sql(6, "t")}
SELECT xi, yi, round(elev, 6) AS elev, round(tpi, 6) + 0 AS tpi FROM t"""))

_SLOPE = """s0 AS (SELECT xi, yi, elev, coalesce(elev, avg(elev) OVER ()) AS v FROM fx_grid),
s1 AS (SELECT *, lag(v) OVER rx AS xb, lead(v) OVER rx AS xa, lag(v) OVER ry AS yb, lead(v) OVER ry AS ya FROM s0
  WINDOW rx AS (PARTITION BY yi ORDER BY xi), ry AS (PARTITION BY xi ORDER BY yi)),
s2 AS (SELECT *, coalesce(CASE WHEN xb IS NOT NULL AND xa IS NOT NULL THEN (xa - xb) / 2 WHEN xb IS NULL THEN xa - v ELSE v - xb END, 0) / 2000 AS gx,
  coalesce(CASE WHEN yb IS NOT NULL AND ya IS NOT NULL THEN (ya - yb) / 2 WHEN yb IS NULL THEN ya - v ELSE v - yb END, 0) / 2000 AS gy FROM s1),
slope AS (SELECT xi, yi, elev, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM s2)"""


def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(grid.slope(_field(spark, sf_dir), "elev"))


register("slope", slope, with_fixtures("fx_grid", f""", {_SLOPE}
SELECT xi, yi, round(elev, 6) AS elev, round(slope_deg, 6) AS slope_deg FROM slope"""))


def landforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landform classes from two disks and the slope."""
    field = _field(spark, sf_dir)
    small = grid.tpi_disk(field, "elev", 1).select(*grid.CELL, F.col("tpi").alias("small"))
    large = grid.tpi_disk(field, "elev", 4).select(*grid.CELL, F.col("tpi").alias("large"))
    both = grid.standardised(small.join(large, grid.CELL), "small", "large").join(grid.slope(field, "elev", 100.0), grid.CELL)
    # rounded z-scores keep a class from hanging on the order of a sum
    z = {c: F.round(c, 6) for c in ("small_z", "large_z", "slope_deg")}
    both = both.withColumns(z).withColumn("landform", grid.landforms(F.col("small_z"), F.col("large_z"), F.col("slope_deg")))
    return both.select(*grid.CELL, "landform")


_LAND = _SLOPE.replace("/ 2000", "/ 100")
register("landforms", landforms, with_fixtures("fx_grid", f""", {_disk_sql(1, "t1")}, {_disk_sql(4, "t4")}, {_LAND},
z AS (SELECT t1.xi, t1.yi, round((t1.tpi - avg(t1.tpi) OVER ()) / stddev_pop(t1.tpi) OVER (), 6) AS a,
  round((t4.tpi - avg(t4.tpi) OVER ()) / stddev_pop(t4.tpi) OVER (), 6) AS b, round(slope_deg, 6) AS s
  FROM t1 JOIN t4 ON t1.xi = t4.xi AND t1.yi = t4.yi JOIN slope ON t1.xi = slope.xi AND t1.yi = slope.yi)
SELECT xi, yi, CASE WHEN a IS NULL OR b IS NULL OR s IS NULL THEN 0 WHEN a <= -1 THEN CASE WHEN b <= -1 THEN 1 WHEN b < 1 THEN 2 ELSE 3 END
  WHEN a < 1 THEN CASE WHEN b <= -1 THEN 4 WHEN b < 1 THEN CASE WHEN s <= 5 THEN 5 ELSE 6 END ELSE 7 END
  WHEN b <= -1 THEN 8 WHEN b < 1 THEN 9 ELSE 10 END AS landform FROM z"""))

_CELLS = f"cells AS (SELECT CAST(x.range AS INT) AS xi, CAST(y.range AS INT) AS yi FROM range(0, {NX}) x, range(0, {NY}) y)"


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.with_cell(fixture(spark, sf_dir, "fx_roads"), "mx", "my", NX, NY)


def traffic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(grid.traffic(_roads(spark, sf_dir), grid.all_cells(spark, NX, NY)))


register("traffic_grid", traffic_grid, with_fixtures("fx_roads", f""", {_CELLS},
r AS (SELECT CAST(round_even(mx / 2000, 0) AS INT) AS xi, CAST(round_even(my / 2000, 0) AS INT) AS yi,
  (car + 1.5 * ldv + 8 * coalesce(hdv, 0) + 5 * bus) * length_m AS load, coalesce(hdv, 0) * length_m AS heavy FROM fx_roads),
s AS (SELECT xi, yi, sum(load) AS load, sum(heavy) AS heavy FROM r GROUP BY xi, yi)
SELECT cells.xi, cells.yi, round(ln(1 + coalesce(load, 0)), 6) AS traffic_load_log, round(ln(1 + coalesce(heavy, 0)), 6) AS traffic_hdv_log
FROM cells LEFT JOIN s ON cells.xi = s.xi AND cells.yi = s.yi"""))


def major_road_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = grid.major_roads(fixture(spark, sf_dir, "fx_roads"))
    return metrics.rounded(grid.nearest_distance(grid.all_cells(spark, NX, NY), roads, "mx", "my"))


register("major_road_distance", major_road_distance, with_fixtures("fx_roads", f""", {_CELLS},
q AS (SELECT quantile_cont(coalesce(hdv, 0), 0.9) AS q FROM fx_roads), m AS (SELECT mx, my FROM fx_roads, q WHERE coalesce(hdv, 0) > q)
SELECT xi, yi, round(min(sqrt((xi * 2e3 - mx) * (xi * 2e3 - mx) + (yi * 2e3 - my) * (yi * 2e3 - my))) / 1000, 6) AS dist_km FROM cells, m GROUP BY xi, yi"""))


def emission_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions, population and the zonal relief of the same points, on every cell."""
    points = grid.with_cell(fixture(spark, sf_dir, "fx_emis"), "x", "y", NX, NY)
    cells = grid.all_cells(spark, NX, NY)
    out = grid.emission_grid(points, cells).join(grid.population_grid(points, cells, "area_m2"), grid.CELL)
    zones = grid.zonal(points, "area_m2").select(*grid.CELL, F.col("mean").alias("area_mean"), F.col("relief").alias("area_relief"))
    return metrics.rounded(out.join(zones, grid.CELL, "left"))


register("emission_grid", emission_grid, with_fixtures("fx_emis", f""", {_CELLS},
s AS (SELECT CAST(round_even(x / 2000, 0) AS INT) AS xi, CAST(round_even(y / 2000, 0) AS INT) AS yi, sum(bap * area_m2) AS b, sum(pm25 * area_m2) AS p,
  sum(area_m2) AS a, avg(area_m2) AS m, max(area_m2) - min(area_m2) AS r FROM fx_emis GROUP BY 1, 2)
SELECT cells.xi, cells.yi, round(ln(1 + coalesce(b, 0)), 6) AS emis_bap_log, round(ln(1 + coalesce(p, 0)), 6) AS emis_pm25_log,
  round(ln(1 + coalesce(a, 0)), 6) AS pop_log, round(m, 6) AS area_mean, round(r, 6) AS area_relief
FROM cells LEFT JOIN s ON cells.xi = s.xi AND cells.yi = s.yi"""))


def directional_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_wind(spark, sf_dir, daily.daily_features(fixture(spark, sf_dir, "fx_hourly").drop("datum")).select("station_id", "datum", "wdir_sin", "wdir_cos"))


def with_wind(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """Adds wdir_emis_bap_log to daily features."""
    stations = fixture(spark, sf_dir, "fx_station").select(
        "station_id", (F.col("station_id") * 4441 % 100000).cast("double").alias("x"), (F.col("station_id") * 2777 % 80000).cast("double").alias("y")
    )
    return grid.directional_emission(days, stations, fixture(spark, sf_dir, "fx_source"))


_DIR = _DAILY + """, st AS (SELECT station_id, CAST(station_id * 4441 % 100000 AS DOUBLE) AS x, CAST(station_id * 2777 % 80000 AS DOUBLE) AS y FROM fx_station),
pr AS (SELECT station_id, x - sx AS dx, y - sy AS dy, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d, bap FROM st, fx_source WHERE bap > 0),
e AS (SELECT d.station_id, d.datum, sum(p.bap * exp(-p.d / 8e3) * greatest(0, wdir_sin * coalesce(p.dx / nullif(p.d, 0), 0) + wdir_cos * coalesce(p.dy / nullif(p.d, 0), 0))) AS e
  FROM d JOIN pr p ON d.station_id = p.station_id AND p.d < 4e4 GROUP BY 1, 2),
r AS (SELECT d.station_id, d.datum, ln(1 + coalesce(e, 0)) AS wdir_emis_bap_log FROM d LEFT JOIN e ON d.station_id = e.station_id AND d.datum = e.datum)"""


def directional_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = directional_days(spark, sf_dir).select("station_id", F.col("datum").cast("string").alias("datum"), "wdir_emis_bap_log")
    return metrics.rounded(out)


register("directional_emission", directional_emission, with_fixtures("fx_hourly fx_station fx_source", _DIR + """
SELECT station_id, CAST(datum AS VARCHAR) AS datum, round(wdir_emis_bap_log, 6) AS wdir_emis_bap_log FROM r"""))


def directional_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stations with the largest mean, with counts of days above 0."""
    v = F.col("wdir_emis_bap_log")
    by_station = directional_days(spark, sf_dir).groupBy("station_id").agg(
        F.count_if(F.round(v, 6) > 0).alias("n_positive"), F.round(F.max(v), 6).alias("most"), F.round(F.avg(v), 6).alias("mean")
    )
    return by_station.orderBy(F.desc("mean"), "station_id").limit(5)


register("directional_summary", directional_summary, with_fixtures("fx_hourly fx_station fx_source", _DIR + """
SELECT station_id, count(*) FILTER (round(wdir_emis_bap_log, 6) > 0) AS n_positive, round(max(wdir_emis_bap_log), 6) AS most, round(avg(wdir_emis_bap_log), 6) AS mean
FROM r GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 5"""))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve layers of the stand-in grid."""
    cell = lambda name, x="mx", y="my": grid.with_cell(fixture(spark, sf_dir, name), x, y, NX, NY)
    return grid.grid_layers(cell("fx_dem"), cell("fx_roads"), cell("fx_emis", "x", "y"), cell("fx_people"), grid.all_cells(spark, NX, NY))


def station_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_station").select(
        "station_id", (F.col("station_id") % NX).cast("int").alias("xi"), (F.col("station_id") * 7 % NY).cast("int").alias("yi")
    )


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with all its layers."""
    return metrics.rounded(layers(spark, sf_dir))


def station_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers at the stations."""
    return metrics.rounded(grid.sampled(station_cells(spark, sf_dir), layers(spark, sf_dir)))


def _at(x: str, y: str) -> str:
    return f"CAST(round_even({x} / 2000, 0) AS INT) AS xi, CAST(round_even({y} / 2000, 0) AS INT) AS yi"


_INSIDE = f"WHERE xi BETWEEN 0 AND {NX - 1} AND yi BETWEEN 0 AND {NY - 1} GROUP BY xi, yi"


def _box(size: int, name: str) -> str:
    h = size // 2
    return f"""{name} AS (SELECT c.xi, c.yi, c.elev - avg(n.elev) AS {name} FROM e c CROSS JOIN range({-h}, {h + 1}) dx, range({-h}, {h + 1}) dy
  JOIN e n ON n.xi = greatest(0, least({NX - 1}, c.xi + dx.range)) AND n.yi = greatest(0, least({NY - 1}, c.yi + dy.range)) GROUP BY c.xi, c.yi, c.elev)"""


LAYERS_SQL = f""", {_CELLS},
dem AS (SELECT xi, yi, avg(elev) AS elev_mean, max(elev) - min(elev) AS elev_relief FROM (SELECT {_at("mx", "my")}, nullif(elev, -9999) AS elev FROM fx_dem) {_INSIDE}),
rd AS (SELECT xi, yi, sum(load) AS load, sum(heavy) AS heavy, count(*) AS k FROM (SELECT {_at("mx", "my")}, (car + 1.5 * ldv + 8 * coalesce(hdv, 0) + 5 * bus) * length_m AS load,
  coalesce(hdv, 0) * length_m AS heavy FROM fx_roads) {_INSIDE}),
em AS (SELECT xi, yi, sum(bap * area_m2) AS bap, sum(pm25 * area_m2) AS pm25 FROM (SELECT {_at("x", "y")}, bap, pm25, area_m2 FROM fx_emis) {_INSIDE}),
pp AS (SELECT xi, yi, sum(persons) AS persons FROM (SELECT {_at("mx", "my")}, greatest(0, nullif(persons, -9999)) AS persons FROM fx_people WHERE persons <> -9999) {_INSIDE}),
e AS (SELECT cells.xi, cells.yi, elev_mean AS elev, elev_relief FROM cells LEFT JOIN dem ON cells.xi = dem.xi AND cells.yi = dem.yi),
{_box(3, "tpi_local")}, {_box(7, "tpi_meso")}, {_box(15, "tpi_broad")},
{_SLOPE.replace("FROM fx_grid", "FROM e")},
inside AS (SELECT mx, my, coalesce(hdv, 0) AS hdv FROM fx_roads WHERE round_even(mx / 2000, 0) BETWEEN 0 AND {NX - 1} AND round_even(my / 2000, 0) BETWEEN 0 AND {NY - 1}),
major AS (SELECT mx, my FROM inside WHERE hdv > (SELECT quantile_cont(hdv, 0.9) FROM inside)),
dist AS (SELECT xi, yi, min(sqrt((xi * 2e3 - mx) * (xi * 2e3 - mx) + (yi * 2e3 - my) * (yi * 2e3 - my))) / 1000 AS d FROM cells, major GROUP BY xi, yi),
layers AS (SELECT e.xi, e.yi, round(e.elev, 6) AS elev_mean, round(e.elev_relief, 6) AS elev_relief, round(tpi_local, 6) + 0 AS tpi_local, round(tpi_meso, 6) + 0 AS tpi_meso,
  round(tpi_broad, 6) + 0 AS tpi_broad, round(slope_deg, 6) AS slope_deg, round(ln(1 + coalesce(load, 0)), 6) AS traffic_load_log, round(ln(1 + coalesce(heavy, 0)), 6) AS traffic_hdv_log,
  round(d, 6) AS dist_major_road_km, round(ln(1 + coalesce(bap, 0)), 6) AS emis_bap_log, round(ln(1 + coalesce(pm25, 0)), 6) AS emis_pm25_log, round(ln(1 + coalesce(persons, 0)), 6) AS pop_log
  FROM e JOIN tpi_local a ON a.xi = e.xi AND a.yi = e.yi JOIN tpi_meso b ON b.xi = e.xi AND b.yi = e.yi JOIN tpi_broad c ON c.xi = e.xi AND c.yi = e.yi
  JOIN slope s ON s.xi = e.xi AND s.yi = e.yi LEFT JOIN dist ON dist.xi = e.xi AND dist.yi = e.yi LEFT JOIN rd ON rd.xi = e.xi AND rd.yi = e.yi
  LEFT JOIN em ON em.xi = e.xi AND em.yi = e.yi LEFT JOIN pp ON pp.xi = e.xi AND pp.yi = e.yi)"""
register("grid_table", grid_table, with_fixtures("fx_dem fx_roads fx_emis fx_people", LAYERS_SQL + " SELECT * FROM layers"))
register("station_layers", station_layers, with_fixtures("fx_station fx_dem fx_roads fx_emis fx_people", LAYERS_SQL + f"""
SELECT station_id, s.xi, s.yi, l.* EXCLUDE (xi, yi) FROM (SELECT station_id, CAST(station_id % {NX} AS INT) AS xi, CAST(station_id * 7 % {NY} AS INT) AS yi FROM fx_station) s
LEFT JOIN layers l ON s.xi = l.xi AND s.yi = l.yi"""))


def fine_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 10 m as means of blocks of 4 by 4, and their position in disks of 5 coarse pixels."""
    coarse = grid.block_means(fixture(spark, sf_dir, "fx_dem"), "elev", 4)
    return metrics.rounded(grid.tpi_tiles(coarse, "elev", 5, tile=16))


register("fine_terrain", fine_terrain, with_fixtures("fx_dem", """,
g AS (SELECT CAST(floor(px / 4) AS INT) AS xi, CAST(floor(py / 4) AS INT) AS yi, avg(nullif(elev, -9999)) AS elev FROM fx_dem GROUP BY 1, 2)
SELECT c.xi, c.yi, round(c.elev, 6) AS elev, round(c.elev - avg(n.elev), 6) + 0 AS tpi FROM g c
JOIN g n ON (n.xi - c.xi) * (n.xi - c.xi) + (n.yi - c.yi) * (n.yi - c.yi) <= 25 GROUP BY c.xi, c.yi, c.elev"""))


def station_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid layers sampled at the stations' cells."""
    stations = fixture(spark, sf_dir, "fx_station").select(
        "station_id", (F.col("station_id") % NX).cast("int").alias("xi"), (F.col("station_id") * 7 % NY).cast("int").alias("yi")
    )
    layers = grid.all_cells(spark, NX, NY).join(_field(spark, sf_dir), grid.CELL, "left").join(traffic_grid(spark, sf_dir), grid.CELL, "left")
    return metrics.rounded(stations.join(layers, grid.CELL, "left").select("station_id", "xi", "yi", "elev", "traffic_load_log"))


register("station_covariates", station_covariates, with_fixtures("fx_station fx_grid fx_roads", f""",
r AS (SELECT CAST(round_even(mx / 2000, 0) AS INT) AS xi, CAST(round_even(my / 2000, 0) AS INT) AS yi,
  sum((car + 1.5 * ldv + 8 * coalesce(hdv, 0) + 5 * bus) * length_m) AS load FROM fx_roads GROUP BY 1, 2),
s AS (SELECT station_id, CAST(station_id % {NX} AS INT) AS xi, CAST(station_id * 7 % {NY} AS INT) AS yi FROM fx_station)
SELECT station_id, s.xi, s.yi, round(elev, 6) AS elev, round(ln(1 + coalesce(load, 0)), 6) AS traffic_load_log
FROM s LEFT JOIN fx_grid g ON s.xi = g.xi AND s.yi = g.yi LEFT JOIN r ON s.xi = r.xi AND s.yi = r.yi"""))


def met_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather at the stations from a cube in chunks, a file a day, some without the date attribute."""
    long = fixture(spark, sf_dir, "fx_cube").withColumn("file", F.concat(F.lit("meteo_"), F.translate("day", "-", ""), F.lit(".nc")))
    chunks = tables.chunked_cube(metrics.rounded(long), ["file", "base"], ["t2m", "hpbl"])
    return tables.read_chunks(chunks, station_cells(spark, sf_dir), ["t2m", "hpbl"], key="station_id", x="xi", y="yi")


register("met_cube", met_cube, with_fixtures("fx_station fx_cube", f"""
SELECT station_id, CAST(day AS TIMESTAMP) + h * INTERVAL 1 HOUR AS time, round(t2m, 6) AS t2m, round(hpbl, 6) AS hpbl
FROM fx_station JOIN fx_cube ON x = station_id % {NX} AND y = station_id * 7 % {NY}"""))


def staged_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as stage v4, with terrain and traffic as v5, with emissions as v6; v6 read back after v5 was published twice."""
    run = tables.Run(scratch(spark, "stages"))
    sites = station_layers(spark, sf_dir)
    run.publish(fixture(spark, sf_dir, "fx_obs"), "v4")
    for _ in range(2):
        run.extend(spark, "v4", "v5", sites.select("station_id", "elev_mean", "traffic_load_log"), ["station_id"])
    run.extend(spark, "v5", "v6", sites.select("station_id", "emis_bap_log"), ["station_id"])
    return metrics.rounded(run.open(spark, "v6").withColumn("datum", F.col("datum").cast("string")))


register("staged_training", staged_training, with_fixtures("fx_station fx_obs fx_dem fx_roads fx_emis fx_people", LAYERS_SQL + f"""
SELECT o.station_id, CAST(datum AS VARCHAR) AS datum, round(bap, 6) AS bap, elev_mean, traffic_load_log, emis_bap_log FROM fx_obs o
LEFT JOIN fx_station s ON s.station_id = o.station_id LEFT JOIN layers l ON l.xi = s.station_id % {NX} AND l.yi = s.station_id * 7 % {NY}"""))
