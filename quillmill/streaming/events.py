"""Answers as server-sent events, and ingestion from a folder that is watched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import col
from ..plans.ingest import ingest
from ..sources.store import ChunkStore

MARKER = "---\n📚 **Sources:**"


def split_stream(pieces: Iterable[str], marker: str = MARKER) -> Iterator[str]:
    """Pieces of an answer up to the list of sources; what precedes the marker in its piece comes trimmed at the end."""
    text, sent = "", 0
    for piece in pieces:
        text += piece
        at = text.find(marker)
        if at >= 0:
            if rest := text[sent:at].rstrip():
                yield rest
            return
        yield piece
        sent = len(text)


def event(kind: str, data: Column) -> Column:
    """A typed event of a struct."""
    return F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(data), F.lit("\n\n"))


def plain_frames(pieces: str | Column) -> Column:
    """Array of plain frames: line feeds escaped, carriage returns dropped, closed by [DONE]."""
    frames = F.transform(col(pieces), lambda p: F.concat(F.lit("data: "), F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("")), F.lit("\n\n")))
    return F.concat(frames, F.array(F.lit("data: [DONE]\n\n")))


def answer_events(answers: DataFrame) -> DataFrame:
    """question_id and the array ``events`` of the result of ``ask``: chunk, sources if there are any, done; or error and done."""
    good = F.concat(
        F.array(event("chunk", F.struct(F.col("answer").alias("text")))),
        F.when(F.size("sources") > 0, F.array(event("sources", F.struct("sources")))).otherwise(F.array().cast("array<string>")),
        F.array(event("done", F.struct(F.lit(False).alias("fromCache")))),
    )
    bad = F.array(event("error", F.struct("error")), event("done", F.struct(F.lit(False).alias("success"))))
    return answers.select("question_id", F.when(F.col("status") == 200, good).otherwise(bad).alias("events"))


def watch(store: ChunkStore, folder: str, tenant_id: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingest files as they appear in ``folder``. A batch that is run again replaces what it wrote, so files count once."""
    spark = store.spark
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def put(batch: DataFrame, _: int) -> None:
        ingest(store, batch, tenant_id, **options)

    return named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
