"""Grid and spatial operators on long tables (xi, yi, value): zonal sums, terrain, roads, emissions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwise.functions import scalar as X
from fillwise.operators.quantiles import quantiles
from fillwise.scratch import stored

CELL = ["xi", "yi"]
VEHICLE_WEIGHTS = {"car": 1.0, "ldv": 1.5, "hdv": 8.0, "bus": 5.0}
DECAY_M, RADIUS_M = 8000.0, 40000.0


def with_cell(df: DataFrame, x: str, y: str, nx: int, ny: int, x0: float = 0.0, y0: float = 0.0, step: float = 2000.0) -> DataFrame:
    """Adds the nearest cell; points outside the grid go."""
    out = df.withColumns({"xi": X.node(x, x0, step), "yi": X.node(y, y0, step)})
    return out.where(F.col("xi").between(0, nx - 1) & F.col("yi").between(0, ny - 1))


def all_cells(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Every cell of the grid, from one generated range."""
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("xi"), F.floor(F.col("id") / nx).cast("int").alias("yi"))


def scatter_add(points: DataFrame, cells: DataFrame, **sums: Column) -> DataFrame:
    """Sums of measures by cell; cells without points have 0."""
    totals = points.groupBy(*CELL).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return cells.join(totals, CELL, "left").fillna(0.0, list(sums))


def zonal(points: DataFrame, value: str) -> DataFrame:
    """Mean, minimum, maximum, relief and sum of fine pixels in each cell, by the pixel's centre."""
    v = X.nodata_to_null(value)
    out = points.groupBy(*CELL).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"))
    return out.withColumn("relief", F.col("max") - F.col("min"))


def tpi_box(field: DataFrame, value: str, size: int) -> DataFrame:
    """Value minus the mean of the size x size square around it, edges repeated, missing values skipped.

    Two passes: along rows, then along columns. Each cell is sent to its ``size`` neighbours in the row (clamped at
    the edge with multiplicity) and sums are taken, then the same along the column: 2 * size rows a cell, not size^2.
    """
    half = size // 2
    box = field.agg(F.max("xi").alias("__nx"), F.max("yi").alias("__ny"))
    rows = field.select(*CELL, F.coalesce(F.col(value), F.lit(0.0)).alias("s"), F.col(value).isNotNull().cast("double").alias("k"))

    def one_way(df: DataFrame, axis: str, last: str) -> DataFrame:
        at, end = F.col(axis), F.col(last)
        near = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: at + o)
        inner = F.filter(near, lambda t: (t >= 0) & (t <= end))
        # the first and last cell stand for those beyond the edge: target t counts them once for each step it lacks
        low = F.transform(F.sequence(F.lit(0), F.lit(half)), lambda t: F.struct(t.alias("t"), (half - t).cast("double").alias("m")))
        high = F.transform(F.sequence(F.lit(0), F.lit(half)), lambda t: F.struct((end - t).alias("t"), (half - t).cast("double").alias("m")))
        plain = F.transform(inner, lambda t: F.struct(t.cast("int").alias("t"), F.lit(1.0).alias("m")))
        extra = F.when(at == 0, F.transform(low, lambda e: F.struct(e["t"].cast("int").alias("t"), e["m"].alias("m")))).otherwise(F.array().cast("array<struct<t:int,m:double>>"))
        more = F.when(at == end, F.transform(high, lambda e: F.struct(e["t"].cast("int").alias("t"), e["m"].alias("m")))).otherwise(F.array().cast("array<struct<t:int,m:double>>"))
        kept = F.filter(F.concat(plain, extra, more), lambda e: (e["m"] > 0) & (e["t"] >= 0) & (e["t"] <= end))
        other = "yi" if axis == "xi" else "xi"
        sent = df.crossJoin(F.broadcast(box)).select(other, "s", "k", F.inline(kept))
        return sent.groupBy(other, F.col("t").alias(axis)).agg(F.sum(F.col("s") * F.col("m")).alias("s"), F.sum(F.col("k") * F.col("m")).alias("k"))

    around = one_way(one_way(rows, "xi", "__nx"), "yi", "__ny")
    mean = F.try_divide("s", "k")
    return field.join(around, CELL, "left").withColumn("tpi", F.col(value) - mean).drop("s", "k")


def slope(field: DataFrame, value: str, step: float = 2000.0) -> DataFrame:
    """Degrees of the steepest slope: central differences inside, one-sided at edges; missing values take the mean."""
    mean = field.agg(F.avg(value).alias("__mean"))
    f = field.crossJoin(F.broadcast(mean)).withColumn("__v", F.coalesce(value, "__mean"))

    def gradient(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        before, after = F.lag("__v").over(w), F.lead("__v").over(w)
        ends = F.when(before.isNull(), after - F.col("__v")).when(after.isNull(), F.col("__v") - before)
        return F.coalesce(F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2), ends, F.lit(0.0)) / step

    f = f.withColumns({"__gx": gradient("xi", "yi"), "__gy": gradient("yi", "xi")})
    return f.withColumn("slope_deg", X.slope_degrees(F.sqrt(F.col("__gx") ** 2 + F.col("__gy") ** 2))).drop("__v", "__mean", "__gx", "__gy")


def tpi_disk(field: DataFrame, value: str, radius: int) -> DataFrame:
    """Value minus the mean of the disk of ``radius`` cells around it, without padding, missing values skipped.

    A disk is one span for each row offset; with prefix sums along rows a span costs two lookups, so a cell needs
    2 * radius + 1 rows and not the disk's area.
    """
    w = Window.partitionBy("yi").orderBy("xi").rowsBetween(Window.unboundedPreceding, 0)
    box = field.agg(F.max("xi").alias("__nx"))
    prefix = field.select(
        *CELL, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w).alias("s"), F.sum(F.col(value).isNotNull().cast("double")).over(w).alias("k")
    )
    offsets = F.transform(
        F.sequence(F.lit(-radius), F.lit(radius)),
        lambda o: F.struct(o.alias("o"), F.floor(F.sqrt(F.lit(float(radius * radius)) - o * o)).cast("int").alias("h")),
    )
    spans = field.select(*CELL).crossJoin(F.broadcast(box)).select(*CELL, "__nx", F.inline(offsets)).select(
        *CELL, (F.col("yi") + F.col("o")).alias("row"), F.least(F.col("xi") + F.col("h"), F.col("__nx")).alias("right"), (F.col("xi") - F.col("h") - 1).alias("left")
    )
    sides = spans.select(*CELL, "row", F.inline(F.array(F.struct(F.col("right").alias("x"), F.lit(1.0).alias("m")), F.struct(F.col("left").alias("x"), F.lit(-1.0).alias("m")))))
    p = prefix.select(F.col("xi").alias("x"), F.col("yi").alias("row"), "s", "k")
    sums = sides.where("x >= 0").join(p, ["x", "row"]).groupBy(*CELL).agg(F.sum(F.col("s") * F.col("m")).alias("s"), F.sum(F.col("k") * F.col("m")).alias("k"))
    return field.join(sums, CELL, "left").withColumn("tpi", F.col(value) - F.try_divide("s", "k")).drop("s", "k")


def standardised(df: DataFrame, *columns: str) -> DataFrame:
    """z-scores with the population deviation, from one aggregate row."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__d_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__d_{c}")) for c in columns})
    return out.drop(*[f"__{k}_{c}" for c in columns for k in "md"])


def landforms(small: Column, large: Column, slope_deg: Column) -> Column:
    """Weiss classes 1 to 10 from standardised position indices at two scales; 0 where there is no data."""
    low, high = (lambda z: z <= -1), (lambda z: z >= 1)
    mid = lambda z: (z > -1) & (z < 1)
    return (
        F.when(small.isNull() | large.isNull() | slope_deg.isNull(), 0)
        .when(low(small) & low(large), 1).when(low(small) & mid(large), 2).when(low(small) & high(large), 3)
        .when(mid(small) & low(large), 4).when(mid(small) & mid(large) & (slope_deg <= 5), 5).when(mid(small) & mid(large), 6)
        .when(mid(small) & high(large), 7).when(high(small) & low(large), 8).when(high(small) & mid(large), 9).otherwise(10)
    )


def traffic(roads: DataFrame, cells: DataFrame) -> DataFrame:
    """log1p of weighted traffic times length, and of heavy vehicles times length, by cell."""
    length = X.numeric_or_zero("length_m")
    load = sum((X.numeric_or_zero(c) * w for c, w in VEHICLE_WEIGHTS.items()), F.lit(0.0)) * length
    out = scatter_add(roads, cells, load=load, heavy=X.numeric_or_zero("hdv") * length)
    return out.select(*CELL, F.log1p("load").alias("traffic_load_log"), F.log1p("heavy").alias("traffic_hdv_log"))


#: What grid_layers adds up for each cell.
MEASURES = ("elev", "load", "heavy", "bap", "pm25", "persons")


def grid_layers(dem: DataFrame, roads: DataFrame, polygons: DataFrame, people: DataFrame, cells: DataFrame, x: str = "mx", y: str = "my") -> DataFrame:
    """All twelve layers of every cell, from pixels, road segments, polygons and population pixels that have their cell.

    The inputs become one table of (cell, measures), with nulls for what a row is not about, and one aggregation by cell
    makes all sums, means and ranges: points meet the grid in one shuffle. Position indices, slope and the distance to
    major roads follow on the cells. ``roads`` also has the coordinates x and y.
    """
    length, area = X.numeric_or_zero("length_m"), X.numeric_or_zero("area_m2")
    load = sum((X.numeric_or_zero(c) * w for c, w in VEHICLE_WEIGHTS.items()), F.lit(0.0)) * length
    none = F.lit(None).cast("double")

    def measured(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*CELL, *[values.get(m, none).alias(m) for m in MEASURES])

    rows = measured(dem, elev=X.nodata_to_null("elev"))
    rows = rows.unionByName(measured(roads, load=load, heavy=X.numeric_or_zero("hdv") * length))
    rows = rows.unionByName(measured(polygons, bap=X.numeric_or_zero("bap") * area, pm25=X.numeric_or_zero("pm25") * area))
    rows = rows.unionByName(measured(people, persons=F.greatest(X.nodata_to_null("persons"), F.lit(0.0))))
    logged = {"traffic_load_log": "load", "traffic_hdv_log": "heavy", "emis_bap_log": "bap", "emis_pm25_log": "pm25", "pop_log": "persons"}
    by_cell = rows.groupBy(*CELL).agg(
        F.avg("elev").alias("elev_mean"), (F.max("elev") - F.min("elev")).alias("elev_relief"), *[F.sum(m).alias(m) for m in MEASURES[1:]]
    )
    out = cells.join(by_cell, CELL, "left").withColumns({name: F.log1p(F.coalesce(m, F.lit(0.0))) for name, m in logged.items()})
    out = stored(out.drop(*MEASURES[1:]), "layers")
    for name, size in (("tpi_local", 3), ("tpi_meso", 7), ("tpi_broad", 15)):
        out = tpi_box(out, "elev_mean", size).withColumnRenamed("tpi", name)
    out = slope(out, "elev_mean")
    distance = nearest_distance(cells, major_roads(roads), x, y).select(*CELL, F.col("dist_km").alias("dist_major_road_km"))
    return out.join(distance, CELL, "left")


def sampled(places: DataFrame, layers: DataFrame) -> DataFrame:
    """The layers of each place's cell; null outside the grid."""
    return places.join(layers, CELL, "left")


def block_means(pixels: DataFrame, value: str, size: int, px: str = "px", py: str = "py") -> DataFrame:
    """Coarser pixels (xi, yi, value): means of size x size pixels. Blocks at the edge take the pixels that they have; blocks without data are null."""
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    return pixels.groupBy(at(px).alias("xi"), at(py).alias("yi")).agg(F.avg(X.nodata_to_null(value)).alias(value))


def tpi_tiles(field: DataFrame, value: str, radius: int, tile: int = 256) -> DataFrame:
    """(xi, yi, value, tpi) as by tpi_disk, for rasters of any size: the disks of a tile's cells are summed in the tile.

    A cell goes to its own tile and to those in whose halo of ``radius`` cells it lies, so a task holds one square of
    tile + 2 * radius cells. Cells without data are null and count for nothing; cells that are missing need no row.
    """
    side = tile + 2 * radius
    spans = [(o, int((radius * radius - o * o) ** 0.5)) for o in range(-radius, radius + 1)]

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))

    def disks(cells: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = (int(cells[t].iloc[0]) * tile - radius for t in ("tx", "ty"))
        sums = np.zeros((2, side, side + 1))
        x, y = cells["xi"].to_numpy() - x0, cells["yi"].to_numpy() - y0
        v = cells["v"].to_numpy(float)
        sums[0, y, x + 1], sums[1, y, x + 1] = np.nan_to_num(v), ~np.isnan(v)
        sums = np.cumsum(sums, axis=2)
        at = np.arange(radius, radius + tile)
        total, count = sum(
            sums[:, radius + o : radius + o + tile][:, :, at + half + 1] - sums[:, radius + o : radius + o + tile][:, :, at - half] for o, half in spans
        )
        own = (x >= radius) & (x < radius + tile) & (y >= radius) & (y < radius + tile)
        x, y, v = x[own], y[own], v[own]
        total, count = total[y - radius, x - radius], count[y - radius, x - radius]
        with np.errstate(invalid="ignore", divide="ignore"):
            tpi = np.where(count > 0.5, v - total / count, np.nan)
        return pd.DataFrame({"xi": x + x0, "yi": y + y0, "v": v, "tpi": tpi})

    sent = field.select("xi", "yi", F.col(value).cast("double").alias("v"), reach("xi").alias("tx")).select("*", reach("yi").alias("ty"))
    out = sent.groupBy("tx", "ty").applyInPandas(disks, "xi int, yi int, v double, tpi double")
    return out.select(*CELL, F.when(~F.isnan("v"), F.col("v")).alias(value), F.when(~F.isnan("tpi"), F.col("tpi")).alias("tpi"))


def major_roads(roads: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Segments whose heavy traffic is above the quantile (strictly)."""
    v = X.numeric_or_zero("hdv")
    cut = quantiles(roads.select(v.alias("v")), "v", [quantile]).get("", [0.0])[0]
    return roads.where(v > cut)


def nearest_distance(cells: DataFrame, points: DataFrame, x: str, y: str, step: float = 2000.0, tile: int = 8, rings: int = 2) -> DataFrame:
    """Kilometres from each cell's centre to the nearest point, exact; no rows where there are no points.

    A cell looks at the tiles within ``rings``. A distance is final when it is at most rings * tile size, since nothing
    nearer can lie further out. Cells without such a distance look again at tiles of twice the size, so that each look
    is at as many tiles; only the empty parts of the map need more than one.
    """
    d = F.hypot(F.col("cx") - F.col("__x"), F.col("cy") - F.col("__y"))
    around = F.sequence(F.lit(-rings), F.lit(rings))
    far = cells.select(*CELL, (F.col("xi") * step).alias("cx"), (F.col("yi") * step).alias("cy"))
    points = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    found, side, some = None, step * tile, not points.isEmpty()
    while True:
        p = points.select("*", F.floor(F.col("__x") / side).alias("tx"), F.floor(F.col("__y") / side).alias("ty"))
        looks = far.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
        looks = looks.withColumns({"tx": F.floor(F.col("cx") / side) + F.col("ox"), "ty": F.floor(F.col("cy") / side) + F.col("oy")})
        near = stored(looks.join(p, ["tx", "ty"]).groupBy(*CELL).agg(F.min(d).alias("d")).where(F.col("d") <= rings * side), "near")
        found = near if found is None else found.unionByName(near)
        far = far.join(near, CELL, "left_anti")
        if not some or side > 1e12 or far.isEmpty():
            return found.select(*CELL, (F.col("d") / 1000).alias("dist_km"))
        side *= 2


def emission_grid(polygons: DataFrame, cells: DataFrame) -> DataFrame:
    """log1p of emission sums by cell, each polygon at its representative point."""
    area = X.numeric_or_zero("area_m2")
    sums = {c: X.numeric_or_zero(c) * area for c in ("bap", "pm25")}
    out = scatter_add(polygons, cells, **sums)
    return out.select(*CELL, F.log1p("bap").alias("emis_bap_log"), F.log1p("pm25").alias("emis_pm25_log"))


def population_grid(points: DataFrame, cells: DataFrame, persons: str) -> DataFrame:
    out = scatter_add(points, cells, persons=F.greatest(X.nodata_to_null(persons), F.lit(0.0)))
    return out.select(*CELL, F.log1p("persons").alias("pop_log"))


#: Stations of a hundred thousand, and sources of a million, that meet in one group of directional_emission at most about.
STATIONS_EACH, SOURCES_EACH = 100_000, 1_000_000


def directional_emission(days: DataFrame, stations: DataFrame, sources: DataFrame, key: str = "station_id") -> DataFrame:
    """log1p of what the day's wind carries from sources within 40 km, decaying over 8 km; 0 without sources.

    Stations that have days meet the sources in cells of a quarter of the radius; sources of one place are one. Pairs
    are not rows: a station sorts its near sources by direction and adds their pulls up in that order, so that a day's
    half-plane of sources is a difference of two sums. Many stations of a cell, or many sources, are dealt over groups.
    """
    cell = RADIUS_M / 4
    at = lambda c: F.floor(F.col(c) / cell)
    winds = days.select(key, "datum", "wdir_sin", "wdir_cos").where(F.col(key).isNotNull())
    placed = stations.where("x IS NOT NULL AND y IS NOT NULL").select(key, F.col("x").cast("double").alias("__x"), F.col("y").cast("double").alias("__y"))
    shards = max(1, -(-stations.count() // STATIONS_EACH))
    shard = F.pmod(F.xxhash64("__x", "__y"), F.lit(shards)).cast("int").alias("__shard")
    near = winds.join(placed, key).select(key, "datum", "wdir_sin", "wdir_cos", "__x", "__y", at("__x").alias("tx"), at("__y").alias("ty"), shard)
    src = sources.where("bap > 0 AND sx IS NOT NULL AND sy IS NOT NULL").groupBy(F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    src = stored(src.agg(F.sum("bap").cast("double").alias("q")), "sources")
    chunks = max(1, -(-src.count() // SOURCES_EACH))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - RADIUS_M) / cell), F.floor((F.col(c) + RADIUS_M) / cell)))
    src = src.withColumn("chunk", F.pmod(F.xxhash64("sx", "sy"), F.lit(chunks)).cast("int")).withColumn("cx", reach("sx")).withColumn("cy", reach("sy"))
    # cells without stations need no sources
    used = placed.select(at("__x").alias("cx"), at("__y").alias("cy"), shard.alias("shard")).distinct()
    src = src.join(used, ["cx", "cy"])
    near = near.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kinds = {c: days.schema[c].dataType.simpleString() for c in (key, "datum")}

    def carried(left: pa.Table, right: pa.Table) -> pa.Table:
        number = lambda t, c: t[c].to_numpy().astype(float)
        sx, sy, q = (number(right, c) for c in ("sx", "sy", "q"))
        x, y = number(left, "__x"), number(left, "__y")
        wind = np.column_stack([pc.fill_null(left[c], 0.0).to_numpy() for c in ("wdir_sin", "wdir_cos")])
        wind[pc.or_(pc.is_null(left["wdir_sin"]), pc.is_null(left["wdir_cos"])).to_numpy()] = 0.0
        order = np.lexsort((y, x))
        ends = np.flatnonzero(np.r_[np.diff(x[order]) != 0, True] | np.r_[np.diff(y[order]) != 0, True]) + 1 if len(x) else []
        out, lo = np.zeros(len(x)), 0
        for hi in ends:
            mine, lo = order[lo:hi], hi
            out[mine] = _half_planes(x[mine[0]] - sx, y[mine[0]] - sy, q, wind[mine])
        return pa.table({key: left[key], "datum": left["datum"], "__e": out})

    sums = near.groupBy("tx", "ty", "__shard", "__chunk").cogroup(src.groupBy("cx", "cy", "shard", "chunk")).applyInArrow(carried, f"{key} {kinds[key]}, datum {kinds['datum']}, __e double")
    out = days.join(sums.groupBy(key, "datum").agg(F.sum("__e").alias("__e")), [key, "datum"], "left")
    return out.withColumn("wdir_emis_bap_log", F.log1p(F.coalesce("__e", F.lit(0.0)))).drop("__e")


def _half_planes(dx: np.ndarray, dy: np.ndarray, q: np.ndarray, wind: np.ndarray) -> np.ndarray:
    """For each wind the sum of q * exp(-d / DECAY_M) * max(0, wind . (dx, dy) / d) over sources at 0 < d < RADIUS_M."""
    d = dx * dx + dy * dy
    use = np.flatnonzero((d < RADIUS_M * RADIUS_M) & (d > 0))
    if not len(use):
        return np.zeros(len(wind))
    d, dx, dy = np.sqrt(d[use]), dx[use], dy[use]
    w = q[use] * np.exp(-d / DECAY_M) / d
    angle = np.arctan2(dy, dx)
    order = np.argsort(angle)
    angle = angle[order]
    pull = np.zeros((2, len(use) + 1))
    np.cumsum((w * dx)[order], out=pull[0, 1:])
    np.cumsum((w * dy)[order], out=pull[1, 1:])
    to = np.arctan2(wind[:, 1], wind[:, 0])  # wdir_sin is the wind's way along x, wdir_cos along y
    turn = lambda a: (a + np.pi) % (2 * np.pi) - np.pi
    low, high = turn(to - np.pi / 2), turn(to + np.pi / 2)
    sums = pull[:, np.searchsorted(angle, high, "right")] - pull[:, np.searchsorted(angle, low, "left")] + np.where(low > high, 1.0, 0.0) * pull[:, -1:]
    return np.where(np.isnan(to), np.nan, np.maximum(0.0, wind[:, 0] * sums[0] + wind[:, 1] * sums[1]))
