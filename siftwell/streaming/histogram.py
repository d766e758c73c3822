"""The histogram behind the profile is a sum, so it runs unchanged over a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.profile import histogram
from siftwell.schema import Columns, Detection


def stream_histogram(cells: DataFrame, cols: Columns, p: Detection, name: str, trigger: dict | None = None) -> StreamingQuery:
    """A running histogram (sample, r, n) as an in-memory table; state is at most samples x (grid + 1) rows."""
    out = histogram(cells, cols, p).writeStream.outputMode("complete").format("memory").queryName(name)
    return (out.trigger(**trigger) if trigger else out).start()
