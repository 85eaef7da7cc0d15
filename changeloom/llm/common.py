"""What the operators share: reading tables, cutting lineage, and hashing words in bulk.

Texts stay in Arrow buffers: a batch is one byte array with a start per text, and
words, shingles and windows are hashed from prefix sums, so no Python object is
made for a word.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task hashes at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19
#: White space between words: U+0020 and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one under /tmp where it is unset in local mode, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:12]}")
        found = context.getCheckpointDir()
    return found


def one_per_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` with each id once: rows without an id go, and of rows that repeat an id the text that sorts last stays.

    Only the ids are read to see whether any repeats; texts are grouped only if one does.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def row_keys(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """The rows with one more column, a long that no two rows share and that rises with the id; rows without an id come last.

    It is the id itself where ids are whole numbers, unique and not null; else rows are sorted by id and, where ids repeat, by a hash of all columns over partitions, numbered, and written, as numbers
    must not change when a task runs again. Only equal rows can change places.
    """
    df = df.select(*[c for c in df.columns if c != key])
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return df.withColumn(key, F.col(id_col).cast("long"))
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])]
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The shuffle files of the writing job go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/changeloom/{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def without_cycles() -> Iterator[None]:
    """Pause Python's search for reference cycles while a worker fills large caches that hold none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and where each text starts, with one more start at the end."""
    whole = pc.fill_null(column, "").cast(pa.large_binary())
    starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def batches(starts: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class Sums:
    """Prefix sums over a sequence of 64-bit values; any run of it is hashed at once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run [begin, end), the same wherever the run stands."""
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U) * _U(0xA24BAED4963EE407))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


class Words:
    """Words of a batch of texts: where each begins and ends, its text, its hash, and the first word of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = False, ink: np.ndarray = ~_SPACE):
        """``ink`` says of each byte whether it belongs to a word."""
        texts = len(starts) - 1
        ink = ink[data]
        begin, end = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        edge = starts[1:-1]
        at = edge[edge < len(data)]
        begin[at] = ink[at]
        at = edge[edge > 0] - 1
        end[at] = ink[at]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, starts)
        self.text = np.repeat(np.arange(texts), np.diff(self.first))
        self.hash = Sums(byte_values(_LOWER[data] if lower else data)).hashes(self.begin, self.end)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's long."""
    return x.view(np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema from Spark's short form of one."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(","))])


def rows(ddl: str, *columns) -> pa.RecordBatch:
    """Columns as an Arrow batch of that schema."""
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
