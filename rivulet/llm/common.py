"""Session helpers that the operators share: shared folders, cut lineage, train and held-out rows, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs on one machine (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='rivulet-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of bounded size, so that a Python worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputing."""
    path = f"{shared_dir(df.sparkSession)}/rivulet/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more: what came of them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until no column of df has that name (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as an empty text (so it isn't held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def extended(df: DataFrame, made: dict[str, str]) -> T.StructType:
    """df's schema and further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in made.items())])


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id", text: str = "text", per_class: int = 10_000) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) for fitting, and rows of labels in each class. Held-out ids, null labels and null ids are left out.

    At most per_class rows of each class are fitted, those whose ids hash lowest.
    So the list of ids that is broadcast has a fixed bound, and no text is
    shuffled. An id with several labels counts as the largest.
    """
    known = labels.filter(~is_held_out(F.col(id_column)) & F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    totals = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    parts = [known.filter(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(parts[0].union(parts[1]))
    own = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("text"))
    return own.join(ids, "__id").select("text", F.col("__label").alias("label")), {c: totals.get(c, 0) for c in (0, 1)}


def summed(df: DataFrame, size: int, parts: int = 32) -> np.ndarray:
    """The sum of vectors: df has (part long, body binary): float64 numbers of the vector's parts 0 to parts - 1. The result is on the driver; its size doesn't depend on the data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(body.as_buffer(), np.float64)
                total[part] = total[part] + value if part in total else value.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "body"])

    out = np.zeros(size)
    bounds = part_bounds(size, parts)
    for row in df.repartition(parts, "part").mapInArrow(work, "part long, body binary").collect():
        out[bounds[row.part] : bounds[row.part + 1]] += np.frombuffer(row.body, np.float64)
    return out


def part_bounds(size: int, parts: int = 32) -> np.ndarray:
    return np.linspace(0, size, parts + 1).astype(np.int64)


def vector_parts(value: np.ndarray, parts: int = 32) -> pa.RecordBatch:
    """A vector as rows for summed()."""
    flat, bounds = np.ascontiguousarray(value, np.float64).ravel(), part_bounds(value.size, parts)
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([flat[bounds[k] : bounds[k + 1]].tobytes() for k in range(parts)], pa.binary())], names=["part", "body"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients, the last one the constant, of a penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * max(weight.sum(), 1e-9))
    ridge[-1] *= 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w
