"""Requests that keep arriving: a Structured Streaming job.

The original tool answers one request per call. Here request bodies land
as JSON-lines files in a folder; each micro-batch of requests is answered
with one batch plan against the (static) inventory -- a stream-static
join -- and the results are written per batch.

Exactly-once output: a micro-batch that is replayed after a failure writes
to the same ``batch_id=<n>`` folders with overwrite, so a replay replaces
rather than duplicates. Progress lives in the checkpoint location under the
shared scratch folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from ..operators.batch import migration_batch, parse_requests, validate_requests
from ..operators.migratable import migratable_batch
from ..operators.scaling import recommend_batch
from ..session import scratch_path


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1
                   ) -> DataFrame:
    """Streaming DataFrame of requests from JSON-lines files in ``source_dir``,
    read and typed as the batch does it; an unreadable line is a request with faults."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir))
    return parse_requests(lines.filter(F.trim("value") != ""), "value")


KINDS = ("migration", "scale_down", "migratable")


def _given(c: str):
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def answer_requests(spark: SparkSession, inventory: Callable[[], DataFrame], source_dir: str,
                    sink_dir: str, checkpoint_dir: str | None = None,
                    available_now: bool = True, kinds: tuple[str, ...] = KINDS
                    ) -> StreamingQuery:
    """Start the stream. Each request is answered by every analysis whose
    fields it carries (``pool1``/``pool2``: migration; ``pool``: scale-down
    and migratable), as the original tool's three request types.

    Outputs under ``sink_dir``: ``requests`` (migration validation),
    ``detail`` and ``summary`` (migration), ``requests_scale_down`` and
    ``recommend``, ``requests_migratable`` and ``migratable``.
    ``inventory`` returns the typed inventory and is called per micro-batch,
    so a refreshed inventory table is picked up.
    """
    ckpt = checkpoint_dir or scratch_path(spark, "request-stream-checkpoint")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        outputs: dict[str, DataFrame] = {}
        inv = inventory()
        if "migration" in kinds:
            # unreadable requests name no pool; they are listed with their faults
            unread = F.size("faults") > 0
            checked = validate_requests(batch.filter(unread | _given("pool1") | _given("pool2")))
            # the matched rows are written once, for detail and summary
            answer = migration_batch(inv, checked.filter("valid").drop("errors", "valid"), materialize=True)
            outputs.update(requests=checked, detail=answer.detail, summary=answer.summary)
        pool_requests = batch.filter(_given("pool"))
        if "scale_down" in kinds:
            checked = validate_requests(pool_requests, "scale_down")
            outputs.update(requests_scale_down=checked,
                           recommend=recommend_batch(inv, checked.filter("valid")))
        if "migratable" in kinds:
            checked = validate_requests(pool_requests, "scale_down")
            outputs.update(requests_migratable=checked,
                           migratable=migratable_batch(inv, checked.filter("valid")))
        for name, df in outputs.items():
            (df.write.mode("overwrite")
             .parquet(os.path.join(sink_dir, name, f"batch_id={batch_id}")))
        batch.unpersist()

    w = (request_stream(spark, source_dir).writeStream
         .foreachBatch(handle)
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_answers(spark: SparkSession, sink_dir: str, name: str) -> DataFrame:
    """Everything the stream has written for one output, with ``batch_id``."""
    return spark.read.parquet(os.path.join(sink_dir, name))

