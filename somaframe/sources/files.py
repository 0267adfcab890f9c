"""Readers and writers of recordings and tables."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.config import DEVICE_SUFFIXES
from somaframe.functions.names import detect_signal, infer_subject
from somaframe.functions.names import found as matched

Loader = Callable[..., DataFrame]
LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    """Registers a loader under a name that configurations can use."""

    def add(f: Loader) -> Loader:
        LOADERS[name] = f
        return f

    return add


def load(name: str, spark: SparkSession, **options: object) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown loader {name}; known: {sorted(LOADERS)}")
    return LOADERS[name](spark, **options)


def separator(first_line: str) -> str:
    """Comma, semicolon, tab or blank, whichever parts the first line."""
    for sep in (",", ";", "\t"):
        if len(next(csv.reader([first_line], delimiter=sep), [])) > 1:
            return sep
    return " "


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """All columns as strings (numbers are coerced later); the separator is read off the first line if not given."""
    if sep is None:
        first = spark.read.text(path).first()
        sep = separator(first[0] if first else "")
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_table(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame | None:
    """Parquet or CSV by the path's ending; None where nothing is there."""
    try:
        df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return df.withColumnsRenamed(rename or {})


def read_first(spark: SparkSession, paths: Sequence[str], required: Sequence[str], time: str | None = None) -> DataFrame | None:
    """The first of some tables that is there, has all required columns and, if `time` names one, a time that is a number."""
    for path in paths:
        df = read_table(spark, path)
        if df is None or not set(required) | {time} - {None} <= set(df.columns):
            continue
        if time is None or not df.where(F.col(time).try_cast("double").isNotNull()).isEmpty():
            return df
    return None


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A new path for each stage: what is read is never overwritten."""
    df.write.partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


@loader("local")
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The recordings below a folder: path, name, subject_id, signal, status (found or skip), bytes. Only names and
    sizes are read. Heart rate and acceleration of known devices get the device's letter."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes")))


def described(files: DataFrame) -> DataFrame:
    """The manifest of files (path, bytes)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    signal = detect_signal(F.col("name"))
    device = F.coalesce(*(F.when(F.lower("name").contains(k), F.lit(v)) for k, v in DEVICE_SUFFIXES.items()), F.lit(""))
    named = files.withColumn("name", name).withColumn("_kind", signal)
    return named.select(
        "path", "name", infer_subject(F.col("name")).alias("subject_id"),
        F.when(F.col("_kind").isin("hr", "acc"), F.concat("_kind", device)).otherwise(F.col("_kind")).alias("signal"),
        F.when(F.col("_kind").isNull() | infer_subject(F.col("name")).isNull(), "skip").otherwise("found").alias("status"), "bytes",
    )


@loader("records")
def records(spark: SparkSession, folder: str, rate: float, signals: Sequence[str] = ("ecg", "resp")) -> DataFrame:
    """Parquet recordings with one column per channel and a sample number `i`, melted to
    (name, signal, time_s, value, fs_hz); channels are matched by the signal's name in theirs."""
    df = spark.read.parquet(folder)
    parts = []
    for signal in signals:
        channel = next((c for c in df.columns if signal in c.lower()), None)
        if channel:
            parts.append(df.select("name", F.lit(signal).alias("signal"), (F.col("i") / rate).alias("time_s"), F.col(channel).cast("double").alias("value"), F.lit(float(rate)).alias("fs_hz")))
    if not parts:
        raise ValueError("no channel matches any signal")
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def subjects(files: DataFrame) -> DataFrame:
    """Distinct ids before the first underscore of file names."""
    return files.select(matched("name", r"^([^_]+)").alias("subject_id")).distinct()


# --- levels of windows: a folder with one subfolder for each level, told by its partition column ---


def levels(spark: SparkSession, base: str) -> list[int]:
    """Levels below a folder, from its subfolders' names alone; none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()] if store.exists(place) else []
    return sorted(int(n.removeprefix("level=")) for n in names if n.removeprefix("level=").isdigit() and n.startswith("level="))


def write_level(df: DataFrame, base: str, level: int | None = None) -> int:
    """Writes df (but its column level) as a level of its own, by default the one after the highest; a level that is there is an error."""
    there = levels(df.sparkSession, base)
    own = max(there, default=0) + 1 if level is None else level
    if own in there:
        raise ValueError(f"level {own} is there already")
    df.drop("level").write.parquet(f"{base.rstrip('/')}/level={own}")
    return own


def read_levels(spark: SparkSession, base: str, only: Sequence[int] | None = None) -> DataFrame:
    """All levels with their number as column level. A condition on it, as `only` sets one, leaves other folders unread."""
    df = spark.read.option("basePath", base).option("mergeSchema", "true").parquet(base).withColumn("level", F.col("level").cast("int"))
    return df if only is None else df.where(F.col("level").isin([int(x) for x in only]))
