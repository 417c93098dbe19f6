"""Ingest and rebuild of chunk collections: chunk, embed, store, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.catalog import SUPPORTED_TYPES, ingest_status
from quarry.operators.chunking import chunk_documents, chunk_text
from quarry.operators.embedding import Embedder, embed
from quarry.operators.retrieval import chunk_rows, upsert_chunks
from quarry.session import spread


@dataclass(frozen=True)
class Ingested:
    """Stored chunks with their vectors, and one outcome per file."""

    chunks: DataFrame
    status: DataFrame


def usable_file() -> Column:
    """A supported type and some text."""
    kind = F.lower(F.btrim("file_type", F.lit(".")))
    return kind.isin(*SUPPORTED_TYPES) & (F.length(strip(F.coalesce("text", F.lit("")))) > 0)


def ingest_files(
    files: DataFrame, embedder: Embedder, store: Callable[[DataFrame], DataFrame], chunker: Callable[[str | None], list[str]] = chunk_text
) -> Ingested:
    """Chunk and embed `files`, store the chunks with `store`, and judge every file.

    `files` holds file_id, project_id, file_name, file_type, file_bytes and `text`. `store`
    writes a frame and returns what was written, so that models run once. A file whose
    chunks did not all get a vector is reported as failed and its chunks are not kept.
    """
    keep = ["file_id", "project_id", "file_name"]
    usable = files.filter(F.coalesce(usable_file(), F.lit(False))).select(*keep, "text")
    vectors = embed(chunk_documents(spread(usable), keep, chunker=chunker), embedder, strict=False)
    written = store(chunk_rows(vectors))
    counts = written.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"))
    status = ingest_status(files, counts)
    whole = counts.filter("chunks = vectors").select("file_id")
    return Ingested(written.join(whole, "file_id", "left_semi"), status)


def replace_chunks(stored: DataFrame, ingested: Ingested) -> DataFrame:
    """The next snapshot of a collection: files that are ready replace all their old chunks."""
    return upsert_chunks(stored, ingested.chunks)


def rebuild_index(
    files: DataFrame,
    embedder: Embedder,
    store: Callable[[DataFrame], DataFrame],
    project: int | None = None,
    limit: int | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Chunk and embed all ready files again; ok, failed and chunks per project.

    `project` and `limit` (the first files by id) restrict the work; a dry run only chunks.
    """
    ready = files.filter("process_status = 'ready'")
    if project is not None:
        ready = ready.filter(F.col("project_id") == project)
    if limit is not None:
        ready = ready.orderBy("file_id").limit(limit)
    keep = ["file_id", "project_id", "file_name"]
    chunks = chunk_documents(spread(ready.select(*keep, "text")) if limit is None else ready.select(*keep, "text"), keep)
    if not dry_run:
        written = store(chunk_rows(embed(chunks, embedder, strict=False)))
        chunks = written.filter(F.col("embedding").isNotNull())
    counts = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    done = ready.select("file_id", "project_id").join(counts, "file_id", "left")
    some = F.coalesce("chunks", F.lit(0)) > 0
    return done.groupBy("project_id").agg(
        F.count_if(some).alias("ok"), F.count_if(~some).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")
    )
