"""Jobs from a stream of files, answered batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.commands import Jobs


def serve(jobs: Jobs, folder: str, answers: str, checkpoint: str) -> StreamingQuery:
    """Answer the jobs (one a line) in text files that appear in ``folder``; results are appended as Parquet."""
    stream = jobs.spark.readStream.text(folder)

    def answer(batch: DataFrame, epoch: int) -> None:
        asked = [r["value"] for r in batch.where("length(value) > 0").distinct().toLocalIterator()]
        if asked:
            jobs.run_all(asked).write.mode("append").parquet(answers)

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
