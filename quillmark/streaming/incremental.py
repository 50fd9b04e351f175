"""Candidate records from a growing folder of pool files.

A stream of lines is turned into samples and candidate records as they arrive; a sample that the output already has
is passed over, so a restarted or repeated batch adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.candidates import GenerationPlan, build_candidates
from ..operators.resume import remaining
from ..sources.jsonl import done_ids, pool_samples


def numbered(lines: DataFrame) -> DataFrame:
    """A stream has no line numbers; a digest of the line stands in, so that a line without id keeps its id, and two
    different lines never share one."""
    return lines.withColumn("line_no", F.substring(F.sha2("value", 256), 1, 32))


def stream_candidates(spark: SparkSession, source: str, output: str, checkpoint: str, plan: GenerationPlan = GenerationPlan(), files_per_batch: int = 100) -> StreamingQuery:
    """Starts the stream; it handles what is there and ends."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)

    def append(batch: DataFrame, number: int) -> None:
        samples = pool_samples(numbered(batch)).dropDuplicates(["id"])
        todo = remaining(samples, done_ids(batch.sparkSession, output))
        build_candidates(todo, plan).drop("line_no", "source_file", "token_seq").write.mode("append").json(output)

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
