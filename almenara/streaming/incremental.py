"""Feeding the incremental index load from a stream of new fragments.

The row-wise operators (cleaning, chunking, encoding) run unchanged on a streaming DataFrame; only
the load needs a table per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from almenara.operators.index import load_index


def loader(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a batch that is replayed after a failure adds nothing twice.

    Rows are compared with the stored ones rather than by the number of the batch, which starts again when a stream
    gets a new checkpoint folder.
    """
    def load(batch: DataFrame, _epoch: int) -> None:
        load_index(batch, path, key)

    return load


def load_stream(fragments: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Load everything that has arrived and stop."""
    return (
        fragments.writeStream.foreachBatch(loader(path, key)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
