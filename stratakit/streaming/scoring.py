"""E13 on a stream: the fitted pipeline and decision rule, unchanged.

Every stage of a fitted scoring pipeline (time features, indexers, one-hot,
assembler, tree models, probability normalisation) is a stateless per-row
transform, so the same ``PipelineModel`` scores a streaming frame.  The
threshold registry is a small static table joined by artifact (stream-static
broadcast join).  Progress is checkpointed under the shared checkpoint
folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import score_scenarios
from ..session import ensure_checkpoint_dir


def scored_stream(stream: DataFrame, model: PipelineModel, registry: DataFrame, artifact: str,
                  keep: list[str] = (), forbidden: list[str] = (), required: list[str] = ()
                  ) -> DataFrame:
    """Streaming frame of (keep..., p0, p1, p2, threshold, decision), after
    the same leakage guard as batch scoring."""
    return score_scenarios(model, stream, registry, artifact, list(forbidden), list(required), keep)


def start_scoring(spark: SparkSession, source: str, schema: T.StructType, model: PipelineModel,
                  registry: DataFrame, artifact: str, sink: str, keep: list[str] = (),
                  fmt: str = "parquet", available_now: bool = True,
                  checkpoint: str | None = None, forbidden: list[str] = (),
                  required: list[str] = (), files_per_batch: int | None = None) -> StreamingQuery:
    """Score files arriving under ``source`` into ``sink`` (append), at most ``files_per_batch`` a batch.

    Started again with the same ``checkpoint`` and ``sink``, it goes on behind the last batch
    that was committed; the file sink's log leaves out what a stopped batch had written, so
    every row is in the sink once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source)
    out = scored_stream(stream, model, registry, artifact, keep, forbidden, required)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode("append").option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if fmt == "memory":
        return writer.format("memory").queryName(sink).start()
    return writer.format(fmt).start(sink)


def run_until(query: StreamingQuery, batches: int, seconds: float = 600.0) -> int:
    """Stops ``query`` once it has gone through ``batches`` batches (or has ended, or after
    ``seconds``) and returns how many there were; an error of the stream is raised here."""
    end = time.monotonic() + seconds
    while query.isActive and time.monotonic() < end:
        progress = query.lastProgress
        if progress is not None and progress["batchId"] + 1 >= batches:
            break
        time.sleep(0.05)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return 0 if query.lastProgress is None else query.lastProgress["batchId"] + 1
