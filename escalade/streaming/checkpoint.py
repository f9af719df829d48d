"""Resumable probing as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import VersionedTable, todo


def probe_stream(source: DataFrame, table: VersionedTable, probe: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "query_id", replace_all: bool = False) -> StreamingQuery:
    """Probes a streaming source in micro-batches: rows whose key is stored are skipped, each finished batch is upserted.

    A batch that fails leaves all batches before it stored, and the checkpoint resumes after them. replace_all probes
    stored keys again.
    """

    def flush(batch: DataFrame, _: int) -> None:
        rows = batch if replace_all else todo(batch, table.read(), key)
        done = probe(rows.dropDuplicates([key]))
        if not done.isEmpty():
            table.upsert(done, key)

    return source.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
