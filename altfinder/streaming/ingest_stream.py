"""I5-I7 as a stream: new source files are embedded, written and recorded by
a file-source stream with ``trigger(availableNow=True)``.

Each micro-batch is one run of the batch job (I6), which appends its outcomes
as the epoch of that number and replaces only that when it is repeated, so a
replay after a failure leaves the same tables behind and the cost of a
micro-batch does not grow with the table. The checkpoint records which files
are done; a restart continues with the next -- the resumable run of the
reference without its high-water-mark gap. Vectors, progress and reports are
read with ``operators.ingest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from altfinder.operators import ingest as ing


def start(rows: DataFrame, base: str, checkpoint: str, dim: int, ts, fields: list[str],
          embedder=None) -> StreamingQuery:
    """Start the stream over ``rows``, a streaming DataFrame of id and text
    fields; it processes every file present and stops."""
    def batch(df: DataFrame, epoch: int) -> None:
        ing.process(df, base, dim, ts, run=epoch, embedder=embedder, fields=fields)

    return (rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
