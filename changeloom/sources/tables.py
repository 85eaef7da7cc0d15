"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of one's own under /tmp where it is unset in local mode, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:12]}")
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several branches read and read it back: plans stay small, nothing is computed twice, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote and that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def per_file(df: DataFrame, order: list[str], handle: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What a function makes of the rows of each file, in an order: one shuffle by file, then a pass over sorted rows that holds one file at a time.

    ``df`` begins with ``change_id, file_path``; the function gets the other columns and its rows are put behind these two.
    """
    file = ["change_id", "file_path"]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[tuple] = []
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                if row[:2] != key:
                    out += [(*key, *r) for r in handle(held)] if held else []
                    key, held = row[:2], []
                held.append(row[2:])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*key, *r) for r in handle(held)] if held else [], columns=names)

    return df.repartition(*file).sortWithinPartitions(*file, *order).mapInPandas(run, schema)
