"""Answers of a model, logged as they come, so that nothing is asked twice.

The log holds one row per prompt and model, keyed by a digest of both. What is to be asked is first made distinct and
compared with the log. Each task then asks its prompts batch by batch and writes every batch as a file of its own as
soon as the model has answered. A file is written under a name no other attempt uses and moved to its place when
whole; its place is named by the prompts it answers, so a second attempt of a lost task finds the batches of the
first and goes on behind them. A run that dies leaves its answers to the next one.

Speculative execution would let two attempts ask at the same time; leave it off while a model is asked.
"""

from __future__ import annotations

import hashlib
import sys
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.session import scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per request batch, and seconds to wait after a full one.
BATCH_ROWS = 90
PAUSE_SECONDS = 65.0

ANSWERS = "key binary, response string"
_FILE = pa.schema([("key", pa.binary()), ("response", pa.string())])
Completer = Callable[[Sequence[str]], Sequence[str | None]]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class AnswerLog:
    """The answers of one model in a shared folder, ``base`` (compacted) and ``batches`` (as they came)."""

    def __init__(self, spark: SparkSession, folder: str, model: str = ""):
        self.spark, self.folder, self.model = spark, folder.rstrip("/"), model
        files, root = _opened(self.folder)
        for part in ("batches", "unfinished"):
            files.create_dir(f"{root}/{part}", recursive=True)

    def key(self, prompt: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}"), prompt).cast("binary"), 256))

    def _bases(self) -> list[str]:
        """Finished compacted parts, oldest first."""
        files, root = _opened(self.folder)
        found = files.get_file_info(fs.FileSelector(root))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("base-"))
        return [n for n in names if files.get_file_info(f"{root}/{n}/_SUCCESS").type == fs.FileType.File]

    def answers(self) -> DataFrame:
        """``key`` and ``response`` of every prompt asked so far, of all models; a refused prompt has a null response."""
        paths = [f"{self.folder}/{n}" for n in self._bases()[-1:]] + [f"{self.folder}/batches"]
        return self.spark.read.schema(ANSWERS).parquet(*paths).groupBy("key").agg(F.max("response").alias("response"))

    def pending(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        """The distinct prompts without an answer, with their keys; null prompts are not asked."""
        keyed = prompts.where(F.col(prompt).isNotNull()).select(self.key(F.col(prompt)).alias("key"), F.col(prompt).alias("prompt"))
        return keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).join(self.answers().select("key"), "key", "left_anti")

    def ask(
        self,
        prompts: DataFrame,
        complete: Completer,
        prompt: str = "prompt",
        batch_rows: int = BATCH_ROWS,
        lanes: int | None = None,
        pause: float | None = None,
    ) -> int:
        """Ask what is not in the log yet, ``batch_rows`` prompts at a time; how many were asked comes back.

        With a quota, set ``lanes`` to the number of tasks that may call at once and give each its part of
        the quota: every lane waits ``pause`` x lanes seconds after a full batch. A pause without lanes is
        refused, as then every running task would call at the full quota.
        """
        if pause and not lanes:
            raise ValueError("a pause keeps a quota only together with lanes")
        if lanes and pause is None:
            pause = PAUSE_SECONDS
        wait, folder = (pause or 0.0) * (lanes or 1), self.folder
        # Stored, so that the batches of a partition are the same whenever a task runs.
        todo = stored(self.pending(prompts, prompt), "pending")
        tasks = lanes or max(1, self.spark.sparkContext.defaultParallelism)
        placed = todo.repartition(tasks, "key").sortWithinPartitions("key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = _opened(folder)
            for keys, texts in _cut(batches, batch_rows):
                name = hashlib.sha256(b"".join(keys)).hexdigest()
                place = f"{root}/batches/{name}.parquet"
                if files.get_file_info(place).type == fs.FileType.File:
                    continue
                replies = list(complete(texts))
                if len(replies) != len(texts):
                    raise ValueError("the model must answer every prompt once")
                draft = f"{root}/unfinished/{name}-{uuid.uuid4().hex}"
                rows = pa.table([pa.array(keys, pa.binary()), pa.array(replies, pa.string())], schema=_FILE)
                with files.open_output_stream(draft, compression=None) as out:
                    pq.write_table(rows, out)
                files.move(draft, place)
                yield pa.record_batch([pa.array([len(texts)], pa.int64())], names=["asked"])
                if wait and len(texts) >= batch_rows:
                    time.sleep(wait)

        return placed.mapInArrow(run, "asked bigint").agg(F.sum("asked")).first()[0] or 0

    def answered(self, rows: DataFrame, complete: Completer, prompt: Column, name: str = "response", **call) -> DataFrame:
        """``rows`` plus the answer to ``prompt``, asking what the log does not hold."""
        keyed = rows.withColumn("key__", self.key(prompt))
        self.ask(rows.select(prompt.alias("prompt")), complete, **call)
        found = self.answers().select(F.col("key").alias("key__"), F.col("response").alias(name))
        return keyed.join(found, "key__", "left").drop("key__")

    def compact(self) -> None:
        """Put all answers into one part, then drop the files it was made of.

        Not to be run while prompts are asked or answers read; if it dies, both old and new files stay and say the same.
        """
        files, root = _opened(self.folder)
        old = self._bases()
        batches = [i.path for i in files.get_file_info(fs.FileSelector(f"{root}/batches")) if i.type == fs.FileType.File]
        self.answers().write.parquet(f"{self.folder}/base-{len(old):09d}-{time.time_ns()}")
        for path in batches:
            files.delete_file(path)
        for base in old:
            files.delete_dir(f"{root}/{base}")


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Rows (key, prompt) in batches of ``size``, whatever Arrow's batches are."""
    keys: list[bytes] = []
    texts: list[str] = []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            if len(keys) == size:
                yield keys, texts
                keys, texts = [], []
    if keys:
        yield keys, texts


def own_log(spark: SparkSession, model: str = "") -> AnswerLog:
    """A log of this run alone."""
    return AnswerLog(spark, scratch_path(spark, "answers"), model)
