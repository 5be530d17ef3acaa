"""Sources and sinks: nested JSON stores, CSV dialects, event logs, upserts and partial refreshes.

Reading is strict on shape and mild on values: fields that do not parse are null, unknown fields are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeledger.sources.scratch import scratch_dir

#: Known fields of a quantification with their defaults (fixed values).
QUANTIFICATION = {
    "site": ("string", "unknown"), "scene_id": ("string", ""), "flow_rate_kgh": ("double", None), "uncertainty_pct": ("double", None),
    "wind_source": ("string", None), "excluded": ("boolean", False), "exclude_reason": ("string", ""), "ingest_seq": ("long", 0),
}
#: Column names of asset lists by dialect (fixed values).
ASSETS = {
    "wri": {"asset_id": "gppd_idnr", "name": "name", "lat": "latitude", "lon": "longitude", "country": "country_long", "fuel": "primary_fuel", "capacity_mw": "capacity_mw", "owner": "owner"},
    "jrc": {"asset_id": "id", "name": "name", "lat": "lat", "lon": "lon", "country": "country", "fuel": "fuel", "capacity_mw": "capacity_mw", "owner": "company"},
}


def scan_timeseries(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One row a record of documents {records: [...]} or bare lists. lines: a document a line, which Spark can split; else one a file.

    A document without records is one record; an empty list gives none.
    """
    fields = T.StructType.fromDDL(schema)
    both = T.StructType([T.StructField("records", T.ArrayType(fields)), *fields.fields])
    df = spark.read.schema(both).option("multiLine", not lines).json(path)
    own = F.struct(*[F.col(f"`{f.name}`") for f in fields.fields])
    return df.select(F.inline(F.coalesce("records", F.array(own))))


def scan_multidate(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """(site, acq_date, fields...) of maps from site to a map from day (yyyyMMdd or yyyy-MM-dd) to a record."""
    text = spark.read.text(path, wholetext=not lines)
    sites = text.select(F.explode(F.from_json("value", f"map<string, map<string, struct<{_nested(schema)}>>>")).alias("site", "days"))
    days = sites.select("site", F.explode("days").alias("day", "r"))
    return days.select("site", F.to_date(F.replace("day", F.lit("-"), F.lit("")), "yyyyMMdd").alias("acq_date"), "r.*")


def _nested(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def scan_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs of both sensors: site -> {dates: {day -> record}}; bad scenes and records without ratio are left out.

    has_tropomi: the record's tropomi part names no error (an absent part counts as present, with enhancement 0).
    """
    record = "is_bad_scene: boolean, sc_ratio: double, s2_detect: boolean, trop_detect: boolean, tropomi: struct<error: string, enhancement: double>"
    text = spark.read.text(path, wholetext=not lines)
    x = text.select(F.explode(F.from_json("value", f"map<string, struct<dates: map<string, struct<{record}>>>>")).alias("site", "s")).select("site", F.explode("s.dates").alias("date", "r"))
    has = F.col("r.tropomi.error").isNull()
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = x.where(~off("r.is_bad_scene") & F.col("r.sc_ratio").isNotNull())
    return x.select("site", "date", "r.sc_ratio", off("r.s2_detect").alias("s2_detect"), has.alias("has_tropomi"), off("r.trop_detect").alias("trop_detect"), F.when(has, F.coalesce("r.tropomi.enhancement", F.lit(0.0))).alias("enhancement"))


def load_quantifications(spark: SparkSession, path: str, exclude_flagged: bool = True, lines: bool = True) -> DataFrame:
    """Quantifications by (site, scene_id), the last of each by ingest_seq; defaults filled in, flagged ones left out on demand."""
    df = spark.read.schema(", ".join(f"{k} {t}" for k, (t, _) in QUANTIFICATION.items())).option("multiLine", not lines).json(path)
    df = df.select(*[(F.col(k) if v is None else F.coalesce(F.col(k), F.lit(v))).alias(k) for k, (_, v) in QUANTIFICATION.items()])
    return latest(df.where(~F.col("excluded")) if exclude_flagged else df, ["site", "scene_id"], "ingest_seq")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by order, then by all other columns; an aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    g = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns])


def load_assets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Assets of a CSV dialect of ASSETS; rows whose place or given capacity is no number are left out. A blank capacity is null."""
    names = ASSETS[kind]
    df = spark.read.option("header", True).csv(path)
    pick = lambda k: F.nullif(F.trim(F.col(f"`{names[k]}`")), F.lit("")) if names[k] in df.columns else F.lit(None).cast("string")
    number = lambda c: c.try_cast("double")
    given = pick("capacity_mw")
    df = df.where(number(pick("lat")).isNotNull() & number(pick("lon")).isNotNull() & (given.isNull() | number(given).isNotNull()))
    return df.select(pick("asset_id").alias("asset_id"), F.coalesce(pick("name"), F.lit("Unknown")).alias("name"), *[number(pick(k)).alias(k) for k in ("lat", "lon", "capacity_mw")], *[pick(k).alias(k) for k in ("country", "fuel", "owner")], F.lit(kind).alias("source"))


def load_inventory(spark: SparkSession, path: str, gas: str = "ch4") -> DataFrame:
    """(year, month, quantity) of a gas, from gas, start_time and emissions_quantity; rows without a readable time are left out."""
    df = spark.read.option("header", True).csv(path).where(F.lower(F.trim("gas")) == gas)
    t = F.col("start_time").try_cast("timestamp")
    return df.where(t.isNotNull()).select(F.year(t).alias("year"), F.month(t).alias("month"), F.col("emissions_quantity").try_cast("double").alias("quantity"))


def load_plume_obs(spark: SparkSession, path: str, numbers: list[str], time: str = "datetime") -> DataFrame:
    """A CSV of plumes: times with a bare +00 are UTC, blank numbers are null."""
    df = spark.read.option("header", True).csv(path)
    number = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).try_cast("double") for c in numbers}
    return df.withColumns(number | {time: F.regexp_replace(time, r"\+00$", "+00:00").try_cast("timestamp")})


def load_releases(spark: SparkSession, path: str, aliases: dict[str, list[str]], satellite: str) -> DataFrame:
    """Controlled releases of a satellite, under our names: of each name's aliases the first that the header has, in any case.

    Flows that are null or not above 0 go; of a day the first stays, by time and then by flow.
    """
    df = spark.read.option("header", True).csv(path)
    have = {c.strip().lower(): c for c in df.columns}
    named = {k: next((have[a.lower()] for a in options if a.lower() in have), None) for k, options in aliases.items()}
    if missing := [k for k, c in named.items() if c is None]:
        raise ValueError(f"no column for {missing}")
    x = df.select(*[F.trim(F.col(f"`{c}`")).alias(k) for k, c in named.items()])
    x = x.withColumns({"flow": F.col("flow").try_cast("double"), "time": F.col("time").try_cast("timestamp")})
    x = x.where((F.lower("satellite") == satellite.lower()) & (F.col("flow") > 0) & F.col("time").isNotNull()).withColumn("day", F.to_date("time"))
    first = x.groupBy("day").agg(F.min(F.struct("time", "flow")).alias("_f"))
    return first.select("day", "_f.time", "_f.flow")


def load_labels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Label files *_label.json anywhere below a folder, with the parent folder's name, the tile and the day (of the file, else of its name)."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_label.json").json(folder)
    p = F.col("_metadata.file_path")
    tile, day = F.nullif(F.regexp_extract(p, r"_T(\d{2}[A-Z]{3})", 1), F.lit("")), F.to_date(F.nullif(F.regexp_extract(p, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")
    out = df.withColumns({"source_dir": F.regexp_extract(p, r"([^/]+)/[^/]+$", 1), "tile": tile, "_hidden": F.regexp_extract(p, r"([^/]+)$", 1).startswith(".")})
    return out.withColumn("day", F.coalesce(F.col("date").try_cast("date"), day) if "date" in df.columns else day).where(~F.col("_hidden")).drop("_hidden")


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Geo sidecars *_geo.json: coordinate system, transform, size and tile of each scene."""
    schema = "scene_id string, crs string, transform array<double>, width int, height int, tile_id string, acquisition_date string, satellite string"
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_geo.json").json(folder)


def append_event_log(df: DataFrame, path: str, logged_at: Column | None = None) -> None:
    """Append rows to a JSON-lines log, with the time of logging and the constant area of a pixel."""
    df.select((F.current_timestamp() if logged_at is None else logged_at).alias("logged_at"), "*", F.lit(400).alias("pixel_area_m2")).write.mode("append").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows by key: the new ones, their last by order where a key comes twice, else the existing ones.

    Rows of null keys are keys like others.
    """
    new = latest(new, keys, order)
    same = [existing[k].eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    kept = existing.join(gone.hint("merge"), same, "left_anti")
    return kept.unionByName(new)


def write_snapshot(df: DataFrame, name: str) -> DataFrame:
    """Write a table as a new snapshot and read it: a reader of an older one is not disturbed."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refresh_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """Replace only those partitions of the table at path that have rows in new; the others stay as they are."""
    new.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def to_do(work: DataFrame, done: DataFrame, keys: list[str], retry: Column | None = None) -> DataFrame:
    """Work whose key is not done; rows of done that retry marks do not count."""
    d = (done if retry is None else done.where(~F.coalesce(retry, F.lit(False)))).select(*keys).distinct()
    return work.join(d.hint("merge"), keys, "left_anti")


def load_sat_events(spark: SparkSession, path: str, site: str, lines: bool = False) -> DataFrame:
    """(year, month, date, enhancement_ppb, n_near_pixels, validated, product_name): a site's events of the second sensor, of a JSON list or JSON lines.

    Dates are year-month-day; events without a readable one go. validated is false and product_name empty where absent.
    """
    schema = "site string, date string, enhancement_ppb double, n_near_pixels long, validated boolean, product_name string"
    e = spark.read.schema(schema).option("multiLine", not lines).json(path).where(F.col("site") == site)
    day = F.when(F.col("date").rlike(r"^\d+-\d+-\d+$"), F.col("date").try_cast("date"))
    e = e.withColumn("day", day).where("day is not null")
    return e.select(F.year("day").alias("year"), F.month("day").alias("month"), "date", "enhancement_ppb", "n_near_pixels", F.coalesce("validated", F.lit(False)).alias("validated"), F.coalesce("product_name", F.lit("")).alias("product_name"))


#: Parts of column names by which the columns of a wind file are known.
WIND_COLUMNS = {"time": ["time", "datetime", "timestamp"], "speed": ["speed", "ws", "wind_s"], "direction": ["dir", "wd", "direction"]}


def load_winds(spark: SparkSession, folder: str, year: int) -> DataFrame:
    """(date, time, speed, direction) of a folder of MM_DD.csv files, a file a day; each file may name and order its columns in its own way.

    A column is the first whose name, in lower case, contains one of the parts in WIND_COLUMNS. Times are HH:MM, HH:MM:SS or whole timestamps; what is unreadable or
    absent is null. Files without a speed column, of other names or of no such day give no rows, nor do blank lines. A file is read as a whole: a day of one mast.
    """
    name = F.regexp_extract("_metadata.file_name", r"^(\d\d)_(\d\d)\.csv$", 0)
    t = spark.read.text(folder, wholetext=True).select("value", F.try_to_date(F.concat(F.lit(f"{year:04d}_"), F.substring(name, 1, 5)), "yyyy_MM_dd").alias("date")).where("date is not null")
    rows = F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")
    cells = lambda line: F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.regexp_replace(c, r'^\s*"|"\s*$', "")))
    t = t.withColumns({"rows": rows, "head": F.transform(cells(F.element_at(rows, 1)), lambda c: F.lower(c))})
    holds = lambda parts: F.transform("head", lambda c: c.rlike("|".join(parts)))
    place = {k: F.array_position(holds(parts), F.lit(True)) for k, parts in WIND_COLUMNS.items()}
    t = t.withColumns({f"at_{k}": v.cast("int") for k, v in place.items()}).where("at_speed > 0")
    line = t.select("date", *[f"at_{k}" for k in place], F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("line")).where("trim(line) <> ''")
    line = line.withColumn("cells", cells(F.col("line")))
    cell = {k: F.when(F.col(f"at_{k}") > 0, F.nullif(F.get("cells", F.col(f"at_{k}") - 1), F.lit(""))) for k in place}
    clock = F.concat(F.col("date").cast("string"), F.lit(" "), F.regexp_extract(cell["time"], r"^\d{1,2}:\d{2}(:\d{2})?", 0))
    time = F.when(cell["time"].rlike(r"^\d{1,2}:\d{2}"), clock.try_cast("timestamp")).otherwise(cell["time"].try_cast("timestamp"))
    return line.select("date", time.alias("time"), cell["speed"].try_cast("double").alias("speed"), cell["direction"].try_cast("double").alias("direction"))
