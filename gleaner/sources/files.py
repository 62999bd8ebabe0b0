"""Image files: listings, contents, and a boundary for decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import paths as P


def _files(spark: SparkSession, root: str, c: Config) -> DataFrame:
    """binaryFile reads contents only where they are selected."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{c.events_root}")
    # Paths come as encoded URIs.
    plain = F.regexp_replace(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*(?=/)", "")
    return rows.withColumn("path", plain).withColumn("event_name", P.event_of(F.col("path"), c))


def gallery(spark: SparkSession, root: str, c: Config = DEFAULT) -> DataFrame:
    """Images in the galleries of all events, in no order: event_name, path, image_id, length, content."""
    rows = _files(spark, root, c).where(P.in_folder(F.col("path"), "Gallery", c) & P.is_image(F.col("path")))
    return rows.withColumn("image_id", P.canonical(F.col("path"), root, c)).select("event_name", "path", "image_id", "length", "content")


def reference_images(spark: SparkSession, root: str, c: Config = DEFAULT) -> DataFrame:
    """Reference images, numbered by path in each event."""
    rows = _files(spark, root, c).where(P.in_folder(F.col("path"), "reference", c) & P.is_image(F.col("path"), reference=True))
    return rows.withColumn("reference_ord", F.row_number().over(Window.partitionBy("event_name").orderBy("path"))).select("event_name", F.col("path").alias("image_path"), "reference_ord", "length", "content")


def image_index(spark: SparkSession, root: str, c: Config = DEFAULT) -> DataFrame:
    """Gallery images to look observations up by: event_name, image_id, path (absolute).  AVIF files aren't listed."""
    return gallery(spark, root, c).where(P.extension(F.col("path")) != ".avif").select("event_name", "image_id", "path")


def check_root(root: str, needed: tuple[str, ...]) -> None:
    """RuntimeError where files that a root must have aren't there."""
    if missing := [n for n in needed if not Path(root, n).is_file()]:
        raise RuntimeError(f"not a project root: {root}; missing: {', '.join(missing)}")


def events(spark: SparkSession, root: str, c: Config = DEFAULT) -> list[str]:
    """Names of the event directories, by case-folded name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{c.events_root}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"no events root: {path}")
    return sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), key=str.casefold)


def decoded(images: DataFrame, decode: Callable[[bytes], object], run: Callable[[object, str], list[dict]], schema: str) -> DataFrame:
    """Rows of run(image, image_id) for each image; one that fails gives a row with error set and nothing else.

    The decoder and whatever run() holds live in the Python worker; contents never leave the scan's task.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for event, image_id, content in zip(b["event_name"], b["image_id"], b["content"], strict=True):
                try:
                    image = decode(content)
                    if image is None:
                        raise ValueError("Could not read image")
                    rows = run(image, image_id)
                except Exception as e:  # a bad image must not end the job
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                out += [{"event_name": event, "image_id": image_id, "error": None, **r} for r in rows]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in ("event_name", "image_id", "error", *names)})

    return images.select("event_name", "image_id", "content").mapInPandas(go, f"event_name string, image_id string, error string, {schema}")
