"""Good and rejected records of one scan, in batches and on streams.

``lines`` reads files as (path, offset, line) in byte ranges, so every line has its
place. ``judged`` and ``judged_csv`` parse a line and say why it can't be used; no
line is lost: each row has either a record or a reason. ``split`` and ``routed``
send the two kinds to their places from one pass over the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.lineage import cut
from .ndjson import KINDS
from .ranges import Range, Reader, ranges

LINES = "path string, offset long, line string, intact boolean"


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length, self.parts = options["path"], int(options.get("range_bytes", 1 << 27)), int(options.get("parts", 0))

    def partitions(self) -> list[InputPartition]:
        return ranges(self.path, self.length, self.parts)

    def read(self, partition: Range) -> Iterator[tuple]:
        reader = Reader(partition.path, partition.size)
        try:
            at = partition.begin
            if at:  # a line belongs to the range in which it begins
                end = reader.find(b"\n", at - 1)
                at = partition.size if end < 0 else end + 1
            while at < partition.end:
                end = reader.find(b"\n", at)
                end = partition.size if end < 0 else end
                body = reader.get(at, end - at).removesuffix(b"\r")
                text = body.decode("utf-8", "replace")
                yield partition.path, at, text, "�" not in text or text.encode() == body
                at = end + 1
        finally:
            reader.close()


class LineSource(DataSource):
    """Options: path, range_bytes (128 MB) or parts."""

    @classmethod
    def name(cls) -> str:
        return "rivulet_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, offset, line, intact) of the files at path, a file or a folder. intact: whether the bytes were UTF-8."""
    spark.dataSource.register(LineSource)
    return spark.read.format("rivulet_lines").options(**options).load(path)


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The same columns of files as they come into a folder; Spark's text stream doesn't tell offsets, so they are null."""
    text = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("long").alias("offset"), F.make_valid_utf8("value").alias("line"), F.is_valid_utf8("value").alias("intact"))


def first_lines(rows: DataFrame, most: int) -> DataFrame:
    """The first lines of each file. Spark keeps the first of each file and task before the shuffle."""
    place = Window.partitionBy("path").orderBy("offset")
    return rows.withColumn("__place", F.row_number().over(place)).filter(F.col("__place") <= most).drop("__place")


def judged(rows: DataFrame, kind: str) -> DataFrame:
    """rows (path, offset, line, intact) with record, the fields of a loader's line of a kind, and reason. Lines of other known kinds are left out: they are somebody else's records."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    text = F.trim(F.col("line"))
    fields = T._parse_datatype_string(KINDS[kind]).fields
    record, told = F.from_json(text, KINDS[kind]), F.get_json_object(text, "$.t")
    there = lambda f: F.get_json_object(text, f"$.{f.name}").isNotNull()
    reason = F.when(F.col("line").isNull(), "no line").when(~F.coalesce("intact", F.lit(True)), "not UTF-8").when(text == "", "empty")
    reason = reason.when(~text.startswith("{") | F.get_json_object(text, "$").isNull(), "no JSON object").when(told.isNull(), "no kind").when(~told.isin(*KINDS), "unknown kind")
    for f in fields:
        reason = reason.when(there(f) & F.col("record")[f.name].isNull(), f"bad {f.name}")
    out = rows.withColumn("record", record).withColumn("reason", reason).withColumn("told", told)
    own = F.col("reason").isNotNull() & (F.col("told").isNull() | ~F.col("told").isin(*[k for k in KINDS if k != kind])) | (F.col("told") == kind)
    return out.filter(F.coalesce(own, F.lit(True))).withColumn("record", F.when(F.col("reason").isNull(), F.col("record"))).drop("told")


def judged_csv(rows: DataFrame, schema: str, header: str | None = None, check: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with record, a line's fields by schema, and reason. A line equal to header is left out; check(record) may give another reason."""
    bad = "__bad"
    record = F.from_csv(F.col("line"), f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    reason = F.when(F.col("line").isNull(), "no line").when(~F.coalesce("intact", F.lit(True)), "not UTF-8").when(F.trim("line") == "", "empty").when(F.col("record")[bad].isNotNull(), "fields don't fit")
    if check is not None:
        reason = reason.otherwise(check(F.col("record")))
    kept = rows if header is None else rows.filter(F.col("line").isNull() | (F.col("line") != header))
    out = kept.withColumn("record", record).withColumn("reason", reason)
    return out.withColumn("record", F.when(F.col("reason").isNull(), F.col("record").dropFields(bad)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected: path, offset, line, reason) of judged rows; the input is read once."""
    held = cut(rows)
    return held.filter(F.col("reason").isNull()).select("record.*"), held.filter(F.col("reason").isNotNull()).select("path", "offset", "line", "reason")


def tallied(rows: DataFrame) -> DataFrame:
    """(reason, rows): how many records are good (reason null) and rejected; they add up to the lines read."""
    return rows.groupBy("reason").agg(F.count("*").alias("rows"))


def routed(rows: DataFrame, good: str, rejected: str, checkpoint: str):
    """The running query that writes a stream's judged rows to two folders, a batch each: one that is run again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        records, bad = split(batch)
        records.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
