"""Sources and sinks around the terrain tables: geometry, crops, road and place features,
zones, curves, run records, digests, outlines."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KM_PER_DEG_LAT = 110.6
KM_PER_DEG_LON = 111.32
DEFAULT_CELL_DEG = 1 / 3600
#: Settlement classes by rank.
PLACE_RANK = {"city": 0, "town": 1, "village": 2}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one of our own only where the session has none
    and all tasks run in this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/ridgeline/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """A stage's table in the shared folder: lineage ends there, and later stages read it, not recompute it."""
    path = scratch_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grid_geometry(dem: DataFrame, origin_lat: float, origin_lon: float, cell_deg: float | None = None, file_cell_deg: float | None = None) -> DataFrame:
    """One row for each region: sizes in pixels and metres; longitude scale at the centre."""
    cell, source = (cell_deg, "given") if cell_deg else (file_cell_deg, "file") if file_cell_deg else (DEFAULT_CELL_DEG, "assumed")
    size = dem.groupBy("region").agg((F.max("r") + 1).cast("long").alias("rows"), (F.max("c") + 1).cast("long").alias("cols"))
    lat = F.lit(origin_lat) - F.col("rows") / 2 * cell
    return size.select("region", "rows", "cols", F.lit(cell).alias("cell_deg"), F.lit(cell * KM_PER_DEG_LAT * 1000).alias("cell_y_m"),
                       (cell * KM_PER_DEG_LON * 1000 * F.cos(F.radians(lat))).alias("cell_x_m"), lat.alias("center_lat"),
                       (F.lit(origin_lon) + F.col("cols") / 2 * cell).alias("center_lon"), F.lit(source).alias("source"))


def origin_check(runs: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Adds lat, lon and status; a supplied origin is used even where the file disagrees."""
    given, known = F.col("given_lat").isNotNull() & F.col("given_lon").isNotNull(), F.col("file_lat").isNotNull()
    off = F.greatest(F.abs(F.col("file_lat") - F.col("given_lat")), F.abs(F.col("file_lon") - F.col("given_lon")))
    status = F.when(~given & ~known, "missing").when(~given, "auto").when(~known, "supplied").when(off > tolerance, "disagrees").otherwise("agrees")
    return runs.withColumn("lat", F.when(given, F.col("given_lat")).otherwise(F.col("file_lat"))).withColumn(
        "lon", F.when(given, F.col("given_lon")).otherwise(F.col("file_lon"))).withColumn("status", status)


def pixel_latlon(pixels: DataFrame, origin_lat: float, origin_lon: float, cell_deg: float) -> DataFrame:
    return pixels.withColumn("lat", F.lit(origin_lat) - F.col("r") * cell_deg).withColumn("lon", F.lit(origin_lon) + F.col("c") * cell_deg)


def crop(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of [start, stop) on both axes, numbered from 0 again."""
    inside = pixels.where(F.col("r").between(rows[0], rows[1] - 1) & F.col("c").between(cols[0], cols[1] - 1))
    return inside.withColumn("r", F.col("r") - rows[0]).withColumn("c", F.col("c") - cols[0])


def box_window(lat: float, lon: float, cell_deg: float, rows: int, cols: int, box: tuple[float, float, float, float]) -> tuple[tuple[int, int], tuple[int, int]]:
    """Rows and columns [start, stop) of the whole pixels that hold `box` (south, north, west, east), as far
    as the map from its upper left corner (lat, lon) goes; an error if box and map share nothing."""
    south, north, west, east = box
    part = lambda lo, hi, size: (max(math.floor(lo / cell_deg), 0), min(math.ceil(hi / cell_deg), size))
    window = part(lat - north, lat - south, rows), part(west - lon, east - lon, cols)
    if any(stop <= start for start, stop in window):
        raise ValueError(f"the map holds latitudes {lat - rows * cell_deg} to {lat} and longitudes {lon} to {lon + cols * cell_deg}, nothing of the box {box}")
    return window


def crop_box(pixels: DataFrame, lat: float, lon: float, cell_deg: float, rows: int, cols: int, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """The pixels of a box, numbered from 0, and a row for each region: size, own origin, far edges and
    range of elevations."""
    (r0, r1), (c0, c1) = box_window(lat, lon, cell_deg, rows, cols, box)
    cut = crop(pixels, (r0, r1), (c0, c1))
    edges = [F.lit(v).alias(n) for n, v in (("origin_lat", lat - r0 * cell_deg), ("origin_lon", lon + c0 * cell_deg), ("south", lat - r1 * cell_deg), ("east", lon + c1 * cell_deg))]
    size = [F.lit(r1 - r0).cast("long").alias("rows"), F.lit(c1 - c0).cast("long").alias("cols")]
    return cut, cut.groupBy("region").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max")).select("region", *size, *edges, "z_min", "z_max")


def downsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column, not an average."""
    some = pixels.where((F.col("r") % factor == 0) & (F.col("c") % factor == 0))
    return some.withColumn("r", F.expr(f"int(r div {factor})")).withColumn("c", F.expr(f"int(c div {factor})"))


ELEMENT = ("id long, lat double, lon double, tags struct<name: string, ref: string, highway: string, place: string, population: string>, "
           "geometry array<struct<lat: double, lon: double>>")


def elements(lines: DataFrame) -> DataFrame:
    """`lines(id, tile, elem)` of JSON to parsed elements."""
    return lines.select("tile", F.from_json("elem", ELEMENT).alias("e")).select("tile", "e.*")


def _first_by_id(rows: DataFrame) -> DataFrame:
    """Tiles repeat what crosses their seams: the lowest tile's copy stays."""
    return rows.groupBy("id").agg(F.min_by(F.struct("*"), "tile").alias("x")).select("x.*")


def roads(lines: DataFrame) -> DataFrame:
    ways = _first_by_id(elements(lines).where(F.size("geometry") >= 2))
    place = lambda p: F.struct(F.round(p["lon"], 5).alias("lon"), F.round(p["lat"], 5).alias("lat"))
    return ways.select("id", F.col("tags.highway").alias("class"), F.coalesce("tags.name", "tags.ref").alias("name"), F.transform("geometry", place).alias("pts"))


def places(lines: DataFrame) -> DataFrame:
    """Named places by rank (city, town, village, other), then population."""
    named = _first_by_id(elements(lines).where("lat is not null")).where("tags.name is not null and tags.name <> ''")
    rank = F.coalesce(*[F.when(F.col("tags.place") == p, F.lit(k)) for p, k in PLACE_RANK.items()], F.lit(len(PLACE_RANK)))
    return named.select("id", F.col("tags.name").alias("name"), F.col("tags.place").alias("place"),
                        F.expr("try_cast(replace(tags.population, ',', '') as bigint)").alias("population"),
                        F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), rank.alias("rank"))


def bbox_tiles(spark: SparkSession, south: float, north: float, west: float, east: float, step: float) -> DataFrame:
    """The box in pieces of at most `step` degrees."""
    def starts(lo: float, hi: float) -> Column:
        count = max(0, -(-(hi - lo - 1e-9) // step))
        return F.explode(F.sequence(F.lit(0), F.lit(int(count) - 1))) if count else F.explode(F.array().cast("array<int>"))

    cut = spark.range(1).select(starts(south, north).alias("i")).select("i", starts(west, east).alias("j"))
    return cut.select((south + F.col("i") * step).alias("lat_lo"), F.least(F.lit(north), south + (F.col("i") + 1) * step).alias("lat_hi"),
                      (west + F.col("j") * step).alias("lon_lo"), F.least(F.lit(east), west + (F.col("j") + 1) * step).alias("lon_hi"))


ZONE = "array<struct<kind: string, lat: double, lon: double, radius_km: double, name: string>>"


def resolve_zones(settings: DataFrame, presets: DataFrame) -> DataFrame:
    """`settings(run, value)` to zones: the name of a preset, or a JSON list; null or 'none' gives none."""
    by_name = settings.join(presets, F.lower("value") == F.col("preset")).select("run", "kind", "lat", "lon", "radius_km", "name")
    listed = settings.where(F.trim("value").startswith("[")).select("run", F.inline(F.from_json("value", ZONE)))
    return by_name.unionByName(listed)


def settlement_preset(places: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each box the preset with most points inside it, ties by name."""
    inside = places.join(F.broadcast(boxes), F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    counts = inside.groupBy("box", "preset").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("box").agg(F.max("n").alias("n"), F.min_by("preset", F.struct(-F.col("n"), "preset")).alias("preset"))


def places_inside(places: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Places of a box, edges included, by rank and population, unknown populations last."""
    inside = places.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return inside.orderBy("rank", F.desc_nulls_last("population"), "id")


def load_curve(spark: SparkSession, path: str, scale: float = 1e-6) -> DataFrame:
    """energy, value; `#` starts a comment. Published energies in GeV become PeV."""
    raw = spark.read.option("comment", "#").schema("energy double, value double").csv(path)
    return raw.select((F.col("energy") * scale).alias("energy_pev"), "value")


def load_runs(records: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """`records(dir, prefix, body)`: of each directory the record of the first prefix that is there."""
    order = F.array_position(F.array(*map(F.lit, prefixes)), F.col("prefix"))
    return records.where(order > 0).groupBy("dir").agg(F.min_by(F.struct("prefix", "body"), order).alias("x")).select("dir", "x.prefix", "x.body")


def digest(table: DataFrame, cols: list[str]) -> DataFrame:
    """An order-free fingerprint: count and combined row hashes."""
    return table.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("digest"))


def outline(labels: DataFrame, origin_lat: float, origin_lon: float, cell_deg: float) -> DataFrame:
    """Boundary edges of each site (site_id, r, c): pixel sides without a neighbour of the same site."""
    sides = [("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1)]
    around = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc")) for s, dr, dc in sides]))
    open_sides = labels.select("site_id", "r", "c", around.alias("x")).select("site_id", "r", "c", "x.*").join(
        labels.select("site_id", F.col("r").alias("nr"), F.col("c").alias("nc")), ["site_id", "nr", "nc"], "left_anti")
    y0 = F.col("r") + F.when(F.col("side") == "s", 1).otherwise(0)
    y1 = F.col("r") + F.when(F.col("side") == "n", 0).otherwise(1)
    x0 = F.col("c") + F.when(F.col("side") == "e", 1).otherwise(0)
    x1 = F.col("c") + F.when(F.col("side") == "w", 0).otherwise(1)
    lat, lon = (lambda y: F.lit(origin_lat) - y * cell_deg), (lambda x: F.lit(origin_lon) + x * cell_deg)
    return open_sides.select("site_id", "r", "c", "side", lat(y0).alias("lat0"), lon(x0).alias("lon0"), lat(y1).alias("lat1"), lon(x1).alias("lon1"))
