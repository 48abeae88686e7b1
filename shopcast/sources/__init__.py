"""Table scans, sinks and staged intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.StringType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

#: Of Spark: files of shuffles are deleted when the statement that made them is done.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By thread. A plain dict: tasks of other modules may carry this one with them.
_MADE: dict[int, Temporaries] = {}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a stated schema (no inference pass over the data)."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet or CSV by suffix; any other suffix is an error.

    CSV has no arrays or structs, so nested columns are written as JSON text.
    """
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        nested = (T.ArrayType, T.MapType, T.StructType)
        flat = [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
        df.select(flat).write.mode(mode).csv(path, header=True, quote='"', escape='"')
    else:
        raise ValueError("output path must end with .parquet or .csv")


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a local session without one gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        folder = os.path.join(tempfile.gettempdir(), "shopcast-staging")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{staging_folder(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when its results are written elsewhere."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def temporary_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder for files that tasks write and read themselves, deleted with the tables staged now.

    None where nothing deletes it, or in stores of Spark's readers only.
    """
    made = _MADE.get(threading.get_ident())
    if made is None:
        return None
    path = staged_path(spark, name, "files")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    made.paths.append(path)
    return task_folder(spark, path)


def staged_path(spark: SparkSession, name: str, suffix: str = "parquet") -> str:
    """A path of its own in this application's part of the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}.{suffix}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor does not repeat the work before
    it, and gives the planner the true size of the table, so a join with it is
    broadcast only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if (made := _MADE.get(threading.get_ident())) is not None:
        made.paths.append(path)
    return out


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files: they would stay until the driver collects its garbage."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


class Temporaries:
    """Paths that :func:`temporaries` deletes."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def kept(self, df: DataFrame) -> DataFrame:
        """A staged table that stays."""
        self.paths = [path for path in self.paths if path != df.__dict__.get("staged_path")]
        return df


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Temporaries]:
    """Tables staged inside are deleted at the end, those that are ``kept`` excepted."""
    made, thread = Temporaries(), threading.get_ident()
    outer = _MADE.get(thread)
    _MADE[thread] = made
    try:
        yield made
    finally:
        if outer is None:
            del _MADE[thread]
        else:
            _MADE[thread] = outer
        for path in made.paths:
            _delete(spark, path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that :func:`task_folder` names and the path inside it, as tasks see them."""
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), folder[len("file:"):]
    return pa.fs.FileSystem.from_uri(folder)


def task_folder(spark: SparkSession, path: str) -> str | None:
    """A folder's name under which tasks can write files of their own; None in stores of Spark's readers only."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    if whole.getScheme() not in ("file", "hdfs"):
        return None
    # A local path is given as it is, with blanks and the like.
    name = f"file:{whole.getPath()}" if whole.getScheme() == "file" else whole.toString()
    try:
        store, base = open_folder(name)
        return name if store.get_file_info(base).type == pa.fs.FileType.Directory else None
    except (OSError, ImportError, ValueError, pa.ArrowException):
        return None


def pending_rows(df: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of ``df`` without a stored result: everything when nothing is stored."""
    if done is None:
        return df
    return df.join(done.select(keys).distinct(), keys, "left_anti")


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# Fine-tuning exports -------------------------------------------------------


def classification_export(
    df: DataFrame, instruction: str, text_col: str, label_col: str
) -> DataFrame:
    from shopcast.functions.replies import label_sentence

    return df.select(
        F.lit(instruction).alias("instruction"),
        F.col(text_col).alias("input"),
        label_sentence(F.col(label_col)).alias("output"),
    )


def preference_export(
    df: DataFrame, system: str, text_col: str, response_col: str, click_col: str
) -> DataFrame:
    from shopcast.functions.replies import click_flag

    return df.select(
        F.lit(system).alias("system"),
        F.col(text_col).alias("query"),
        F.col(response_col).alias("response"),
        click_flag(F.col(click_col)).alias("label"),
    )
