"""Batch operators over arriving files.

The operators are batch operators.  What streaming needs of them is only that a
stored partial and a new one merge, which :func:`millrace.combine_final` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregates import Aggregate
from millrace.operators.combine import combine_partial


def partials_stream(stream: DataFrame, group_by: Sequence[str], aggregates: Sequence[Aggregate], path: str, checkpoint: str) -> StreamingQuery:
    """Store each micro-batch's partial rows; ``combine_final`` over ``path`` gives totals at any time.

    A batch that is retried overwrites its own folder, so partials count once.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        combine_partial(batch, group_by, aggregates).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
