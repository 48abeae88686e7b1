"""Calls of a user-supplied model function over prompt rows."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shopcast.config import ModelSettings
from shopcast.sources import (
    append_results,
    open_folder,
    pending_rows,
    read_table,
    stage,
    staged_path,
    table_exists,
    task_folder,
)

ModelFactory = Callable[[], Callable[[str], str]]

#: Prompts that a worker answers before its replies are stored.
COMMIT_PROMPTS = 20
#: Prompts that a worker holds: each can be as long as a distribution text, and 10,000 of them as large as an executor.
HELD_PROMPTS = 200
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _call_partition(factory: ModelFactory, settings: ModelSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            replies, errors, tries = [], [], []
            for prompt in batch["prompt"]:
                started = time.monotonic()
                reply, error, used = None, None, 0
                while reply is None and used <= settings.retries:
                    if used and settings.retry_wait_seconds:
                        time.sleep(settings.retry_wait_seconds)
                    used += 1
                    try:
                        if model is None:
                            model = factory()
                        reply = model(prompt)
                    except Exception as exc:  # a failing call must not lose its rows
                        error = f"{type(exc).__name__}: {exc}"
                replies.append(reply)
                errors.append(None if reply is not None else error)
                tries.append(used)
                rest = settings.seconds_per_batch - (time.monotonic() - started)
                if rest > 0:
                    time.sleep(rest)
            yield batch.drop(columns="prompt").assign(reply=replies, error=errors, tries=tries)

    return run


@contextmanager
def _few_held(spark: SparkSession, commit_prompts: int) -> Iterator[None]:
    """Workers of what is executed inside get few prompts at a time, whole commits of them."""
    before = spark.conf.get(_BATCH_ROWS)
    most = max(1, HELD_PROMPTS // commit_prompts) * commit_prompts
    spark.conf.set(_BATCH_ROWS, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def _reply_schema(prompts: DataFrame) -> T.StructType:
    kept = [f for f in prompts.schema.fields if f.name != "prompt"]
    return T.StructType(
        kept
        + [
            T.StructField("reply", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("tries", T.IntegerType()),
        ]
    )


def call_model(
    prompts: DataFrame, factory: ModelFactory, settings: ModelSettings, workers: int | None = None
) -> DataFrame:
    """Prompt rows to reply rows: every row comes back, a failed call with a null reply.

    ``factory`` builds the model function once per partition.  The result is
    lazy and would repeat its calls on every use: store it first, as
    :func:`staged_replies` and :func:`resumed_replies` do.
    """
    schema = _reply_schema(prompts)
    spread = prompts.repartition(workers or settings.max_workers)
    return spread.mapInPandas(_call_partition(factory, settings), schema)


def _store_partition(answer, schema: pa.Schema, folder: str, key: str, commit_prompts: int):
    """Calls of ``answer``, a file in ``folder`` for every ``commit_prompts`` of them; a later attempt goes on after them."""
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, (store, base) = TaskContext.get(), open_folder(folder)
        own, stored = f"{run_id}-{context.partitionId()}-", set()
        # Files of this task are those of earlier attempts.
        for info in store.get_file_info(pa.fs.FileSelector(base)):
            if info.base_name.startswith(own):
                held = pa.parquet.read_table(info.path, columns=[key, "reply"], filesystem=store)
                stored.update(held.filter(held["reply"].is_valid())[key].to_pylist())

        def commits():
            for batch in batches:
                if stored:
                    batch = batch[~batch[key].isin(stored)]
                for at in range(0, len(batch), commit_prompts):
                    yield batch.iloc[at : at + commit_prompts]

        for place, replies in enumerate(answer(commits())):
            name = f"{own}{context.taskAttemptId()}-{place}.parquet"
            table = pa.Table.from_pandas(replies, schema, preserve_index=False)
            # Readers pass over a name with a dot in front: a file is there as a whole or not at all.
            pa.parquet.write_table(table.replace_schema_metadata(), f"{base}/.{name}", filesystem=store)
            store.move(f"{base}/.{name}", f"{base}/{name}")
            yield pd.DataFrame({"stored": [len(replies)]})

    return run


def staged_replies(
    prompts: DataFrame, factory: ModelFactory, settings: ModelSettings, workers: int | None = None
) -> DataFrame:
    """Replies written once to the shared folder, so that no later step repeats a call."""
    return stage(call_model(prompts, factory, settings, workers), "replies")


def resumed_replies(
    prompts: DataFrame,
    factory: ModelFactory,
    settings: ModelSettings,
    path: str,
    key: str,
    workers: int | None = None,
    rounds: int | None = None,
    commit_prompts: int = COMMIT_PROMPTS,
) -> DataFrame:
    """Replies kept in a table at ``path``; only prompts without a stored reply are sent.

    Every worker stores the replies to ``commit_prompts`` before it sends more,
    all in one job: a job that dies or a task that is tried again loses no more
    calls than those.  Where ``rounds`` are stated, or tasks cannot write files
    of their own at ``path``, prompts are sent in rounds, a job each, of
    ``commit_prompts`` per worker by default; such a job loses the calls of one
    round.  ``workers`` (``max_workers`` of the settings by default) is free of
    the chunk size.  The prompts still to be sent are found and written once,
    with rounds a folder for each.
    """
    spark = prompts.sparkSession
    stored = table_exists(spark, path)
    done = read_table(spark, path).where(F.col("reply").isNotNull()) if stored else None
    todo = stage(pending_rows(prompts, done, [key]), "pending-prompts")
    workers = workers or settings.max_workers
    if not stored:
        # An empty table: a run without prompts, or one that dies at once, can be read.
        append_results(call_model(todo.limit(0), factory, settings, 1), path)
    own = None if rounds else task_folder(spark, path)
    if own:
        kind = to_arrow_schema(_reply_schema(todo))
        send = _store_partition(_call_partition(factory, settings), kind, own, key, commit_prompts)
        sent = todo.repartition(workers).mapInPandas(send, "stored long")
        with _few_held(spark, commit_prompts):
            sent.write.format("noop").mode("overwrite").save()
    else:
        with _few_held(spark, commit_prompts):
            _send_rounds(todo, factory, settings, path, workers, rounds, commit_prompts)
    # A prompt that failed before and was answered now has both rows: keep the answer.
    return (
        read_table(spark, path)
        .groupBy(key)
        .agg(F.max("reply").alias("reply"), F.max("error").alias("error"))
        .select(key, "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
    )


def _send_rounds(todo, factory, settings, path, workers, rounds, commit_prompts) -> None:
    spark = todo.sparkSession
    rounds = rounds or max(1, math.ceil(todo.count() / (workers * commit_prompts)))
    folder = staged_path(spark, "prompt-rounds")
    dealt = todo.repartition(rounds).withColumn("round", F.spark_partition_id())
    dealt.write.partitionBy("round").parquet(folder)
    for part in range(rounds):
        if table_exists(spark, f"{folder}/round={part}"):
            batch = spark.read.schema(todo.schema).parquet(f"{folder}/round={part}")
            append_results(call_model(batch, factory, settings, workers), path)
