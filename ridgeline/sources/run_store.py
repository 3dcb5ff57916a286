"""Where searches leave their results and overlays find them: masks, georeferencing, results and provenance.

A store is a folder. `save` writes masks as runs along rows, one folder for each run, then the records (the six
affine terms as lines of text, results and provenance as JSON), and at last a manifest of each run with the number of its pixels and a
fingerprint of its mask. A run without a manifest was not written to its end; one whose mask does not give its fingerprint has lost or
gained a file. Neither is read. Saving a run again replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.masks import pixels, runs

MASK = "r int, lo int, hi int, run string"
RECORD = "prefix string, world string, results string, provenance string, run string"
MANIFEST = "pixels long, fingerprint long, run string"
#: Names of the six terms of a georeferencing record, in their order.
TERMS = ("x_scale", "y_skew", "x_skew", "y_scale", "x_origin", "y_origin")
OK = "ok"


def world_text(cell_deg: float, origin_lat: float, origin_lon: float) -> str:
    """Six lines: pixel width, two skews, negative pixel height, longitude and latitude of the upper left pixel."""
    return "\n".join(repr(float(t)) for t in (cell_deg, 0, 0, -cell_deg, origin_lon, origin_lat))


def world_terms(text: Column) -> Column:
    """The numbers of a georeferencing text, null unless there are exactly six."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    numbers = F.transform(lines, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) == len(TERMS)) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def _write(df: DataFrame, path: str, kind: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(kind).save(path)


def _prints(masks: DataFrame) -> DataFrame:
    n = F.sum(F.col("hi") - F.col("lo") + 1).cast("long")
    return masks.groupBy("run").agg(n.alias("pixels"), F.bit_xor(F.xxhash64("r", "lo", "hi")).alias("fingerprint"))


def save(store: str, masks: DataFrame, records: DataFrame) -> None:
    """`masks(run, r, c)` and `records(run, prefix, world, results, provenance)`: a run may have no true pixel, but must have a record."""
    spark = masks.sparkSession
    stretches = runs(masks.withColumnRenamed("run", "region")).withColumnRenamed("region", "run")
    _write(stretches.select("run", "r", "lo", "hi"), f"{store}/masks", "parquet")
    _write(records.select("run", "prefix", "world", "results", "provenance"), f"{store}/records", "json")
    found = _prints(spark.read.schema(MASK).parquet(f"{store}/masks"))
    made = records.select("run").join(found, "run", "left").select("run", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.coalesce("fingerprint", F.lit(0)).alias("fingerprint"))
    _write(made, f"{store}/manifests", "json")


def catalogue(spark: SparkSession, store: str, prefixes: tuple[str, ...], dems: DataFrame | None = None) -> DataFrame:
    """(run, prefix, pixels, terms, capacity, dem, status): a row for each run of the store. Status is `ok` or says what is
    wrong. `prefixes`: names of results that are read, the first that a run has wins. `dem` is where the elevation file that the
    provenance names lies, by its last path part, of `dems(name, location)`."""
    read = lambda kind, schema, what: spark.read.schema(schema).format(kind).load(f"{store}/{what}")
    order = F.array_position(F.array(*map(F.lit, prefixes)), F.col("prefix"))
    every = read("json", RECORD, "records")
    best = every.where(order > 0).groupBy("run").agg(F.min_by(F.struct("prefix", "world", "results", "provenance"), order).alias("x")).select("run", "x.*")
    records = every.select("run").distinct().join(best, "run", "left")
    now = _prints(read("parquet", MASK, "masks"))
    rows = records.join(read("json", MANIFEST, "manifests"), "run", "left").join(now.withColumnsRenamed({"pixels": "now_pixels", "fingerprint": "now_print"}), "run", "left")
    terms = world_terms(F.col("world"))
    whole = (F.coalesce("now_pixels", F.lit(0)) == F.col("pixels")) & (F.coalesce("now_print", F.lit(0)) == F.col("fingerprint"))
    status = F.when(F.col("pixels").isNull(), "no manifest").when(~whole, "mask damaged").when(F.col("prefix").isNull(), "no results").when(terms.isNull(), "not six terms").otherwise(OK)
    capacity = F.get_json_object("results", "$.total_capacity").try_cast("long")
    name = F.element_at(F.split(F.get_json_object("provenance", "$.dem"), "/"), -1)
    out = rows.select("run", "prefix", "pixels", terms.alias("terms"), capacity.alias("capacity"), name.alias("dem_name"), status.alias("status"))
    if dems is None:
        return out.select("run", "prefix", "pixels", "terms", "capacity", F.lit(None).cast("string").alias("dem"), "status")
    places = dems.groupBy(F.col("name").alias("dem_name")).agg(F.min("location").alias("dem"))
    return out.join(places, "dem_name", "left").select("run", "prefix", "pixels", "terms", "capacity", "dem", "status")


def open_masks(spark: SparkSession, store: str, wanted: list[str], prefixes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Masks (run, r, c) of the wanted runs and their grids (run, t0 .. t5). Refuses if one is missing or not whole."""
    found = catalogue(spark, store, prefixes).where(F.col("run").isin(wanted))
    state = {r["run"]: r["status"] for r in found.select("run", "status").collect()}  # as many as are wanted
    bad = {run: state.get(run, "not in the store") for run in wanted if state.get(run) != OK}
    if bad:
        raise ValueError("runs cannot be read: " + ", ".join(f"{k} ({v})" for k, v in sorted(bad.items())))
    masks = spark.read.schema(MASK).parquet(f"{store}/masks").where(F.col("run").isin(wanted))
    grids = found.select("run", *[F.col("terms")[k].alias(f"t{k}") for k in range(len(TERMS))])
    return pixels(masks.withColumnRenamed("run", "region")).withColumnRenamed("region", "run"), grids
