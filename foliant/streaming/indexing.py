"""Newly stored pages brought into the chunk index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.chunking import chunk_pages, content_keys
from foliant.operators.index import ChunkIndex, diff


def index_stream(pages: DataFrame, index: ChunkIndex, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of whole documents is chunked; documents whose content key is already stored are skipped."""

    def upsert(batch: DataFrame, number: int) -> None:
        keys = content_keys(batch)
        todo = diff(keys, index.keys()).filter("state in ('new', 'changed')").select("doc_id", "key")
        if not todo.isEmpty():
            index.upsert(chunk_pages(batch).join(todo, "doc_id"))
            index.commit()

    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
