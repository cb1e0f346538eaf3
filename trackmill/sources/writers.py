"""Writers: ordered JSON lines, portable documents, and publication in one step."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import leaks_path
from .readers import FIELDS


def index_lines(df: DataFrame, path: str, order: list[str], parts: int) -> None:
    """Rows as JSON lines, in order over `parts` files (their names sort as their rows do)."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)


def portable(df: DataFrame, fields: list[str], private: list[str]) -> DataFrame:
    """The fields in a fixed order as one JSON text; private columns go, texts that name local places fail."""
    kept = [f for f in fields if f not in private]
    texts = [f for f, t in df.dtypes if f in kept and t == "string"]
    clean: Column = F.lit(True)
    for t in texts:
        clean = clean & ~F.coalesce(leaks_path(F.col(t)), F.lit(False))
    checked = df.withColumn("__ok", F.when(clean, True).otherwise(F.raise_error(F.lit("a text names a local place")).cast("boolean")))
    return checked.filter("__ok").select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("document"))


def publish(df: DataFrame, path: str) -> None:
    """A table that appears whole or not at all. Spark's committer moves finished files into place and writes _SUCCESS last;
    readers that wait for it never see a part."""
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


def published(spark, path: str) -> bool:
    """Whether the mark is there (it is hidden from Spark's readers, so the file system is asked)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def point_frames(points: DataFrame, path: str) -> DataFrame:
    """key, bytes: a file of records under `path` for each key of points (key, offset, and the six numbers of a record), in order of the offset.

    A frame is one task's; files are written under another name and then moved, so that a task that is run again leaves whole files.
    """

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        data = rows.sort_values("offset", kind="stable")[FIELDS].to_numpy("<f4").tobytes()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/.{key[0]}.{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            out.write(data)
        store.move(name, f"{folder}/{key[0]}")
        return pd.DataFrame({"key": [key[0]], "bytes": [len(data)]})

    return points.select("key", "offset", *FIELDS).groupBy("key").applyInPandas(write, "key string, bytes long")
