"""Writers: text forms, outputs split by filter, time, key or size, keyed tables, and an index of seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FLOW_SCHEMA


def write_text(df: DataFrame, path: str, form: str = "csv", separator: str = ",", mode: str = "overwrite") -> None:
    """'csv', 'json', 'xml' or 'parquet' files; nested columns are written as JSON text where the form is flat."""
    if form == "csv":
        nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))} | {c: F.base64(c) for c, t in df.dtypes if t == "binary"}
        df.withColumns(nested).write.mode(mode).csv(path, header=True, sep=separator)
    elif form == "xml":
        df.write.mode(mode).format("xml").option("rowTag", "record").save(path)
    else:
        df.write.mode(mode).format(form).save(path)


def write_filtered(df: DataFrame, outputs: dict[str, str], reject: str | None = None, mode: str = "append") -> None:
    """Each path gets the records that pass its filter, ``reject`` those that pass none."""
    from ..plans.filterlang import compile_filter

    passed = F.lit(False)
    for path, text in outputs.items():
        cond = F.coalesce(compile_filter(text, set(df.columns)), F.lit(False))
        df.where(cond).write.mode(mode).parquet(path)
        passed |= cond
    if reject:
        df.where(~passed).write.mode(mode).parquet(reject)


def write_split(df: DataFrame, path: str, by: str = "day", keys: tuple[str, ...] = (), max_records: int | None = None, mode: str = "overwrite") -> None:
    """Directories by time ('day', 'hour' or 'none') and key values, files of at most ``max_records``.

    Rows are gathered by their directory, and a directory with more than a partition's worth of bytes is divided among as
    many tasks as it takes (adaptive execution), so a hot day has many writers and a quiet one does not leave crumbs.
    """
    parts = {}
    if by in ("day", "hour"):
        parts["date"] = F.date_format(F.timestamp_micros("stime_us"), "yyyy-MM-dd")
    if by == "hour":
        parts["hour"] = F.date_format(F.timestamp_micros("stime_us"), "HH")
    rows = df.withColumns(parts) if parts else df
    names = [*parts, *keys]
    if names:
        rows = rows.hint("rebalance", *names)
    writer = rows.write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*names) if names else writer).parquet(path)


def upsert(existing: DataFrame | None, new: DataFrame, keys: list[str], combine: dict[str, Callable[[str], Column]]) -> DataFrame:
    """The keyed table after inserting ``new``: rows of a key unite, each other column by its aggregate."""
    rows = new if existing is None else existing.unionByName(new)
    return rows.groupBy(*keys).agg(*(f(c).alias(c) for c, f in combine.items()))


def write_upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], combine: dict[str, Callable[[str], Column]]) -> None:
    """:func:`upsert` of the table at ``path``: the result goes to the next version's directory, then becomes current.

    Versions stand beside each other as v=n, so readers never meet a half-written table and a lost executor costs a retry.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
    old = spark.read.parquet(f"{path}/v={max(done)}") if done else None
    upsert(old, new, keys, combine).write.mode("overwrite").parquet(f"{path}/v={max(done, default=0) + 1}")


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a keyed table."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the keys in ``gone``."""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def time_index(df: DataFrame) -> DataFrame:
    """Index second -> (probe, file): first and last record of each file in that second."""
    rows = df.where("stime_us is not null").select(F.expr("stime_us div 1000000").alias("second"), "sid", F.input_file_name().alias("file"), "autoid")
    return rows.groupBy("second", "sid", "file").agg(F.min("autoid").alias("first"), F.max("autoid").alias("last"), F.count(F.lit(1)).alias("n"))


def files_between(index: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """Files an indexed scan of [start_s, end_s] has to read, one row each."""
    return index.where(F.col("second").between(start_s, end_s)).select("file").distinct()


def read_indexed(index: DataFrame, start_s: int, end_s: int, most: int = 100_000) -> DataFrame:
    """Records of [start_s, end_s] from the files that the index names. More than ``most`` files are an error: paths have
    to be handed to the reader by the driver, and for so many a scan of the folder is the better way."""
    spark = index.sparkSession
    paths = [r[0] for r in files_between(index, start_s, end_s).limit(most + 1).collect()]
    if len(paths) > most:
        raise ValueError(f"the index names more than {most} files")
    if not paths:
        return spark.createDataFrame([], FLOW_SCHEMA)
    return spark.read.parquet(*sorted(paths)).where(F.col("stime_us").between(start_s * 1_000_000, end_s * 1_000_000 + 999_999))


def write_keyed(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """A table of key columns, the whole record as JSON, and autoid: a number that is unique in the table and no gap-free
    count. Numbers are drawn by the writing tasks, so nothing is gathered to give them."""
    record = F.to_json(F.struct(*(F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes)))
    df.select(F.monotonically_increasing_id().alias("_autoid"), *keys, record.alias("record")).withColumnRenamed("_autoid", "autoid" if "autoid" not in keys else "row_id").write.mode(mode).parquet(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of an archive with size and age, for retention rules: nothing is deleted here."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))
