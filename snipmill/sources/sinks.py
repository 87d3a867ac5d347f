"""Writers. Tables are one Spark job each, whose committer gives all or nothing; Markdown files appear whole, one by one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.session import cut_lineage
from snipmill.sources.stores import locate


def sink_transcripts(parts: DataFrame, destinations: DataFrame, path: str) -> None:
    """Append transcript parts with their file name, by year and month.

    ``destinations(doc_key, destination)`` come from a run that settled names
    against everything already written, so nothing is overwritten.
    """
    place = F.split("destination", "/")
    rows = parts.join(destinations.select("doc_key", "destination"), "doc_key").withColumns({
        "year": place[1], "month": place[2], "file": place[3],
    })
    rows.select("file", "part_no", "text", "year", "month").write.mode("append").partitionBy(
        "year", "month").parquet(path)


def sink_transcript_files(pieces: DataFrame, destinations: DataFrame, root: str) -> DataFrame:
    """Writes each transcript as its Markdown file below ``root``; gives (destination, n_parts, n_bytes, sha256).

    ``pieces(doc_key, part_no, text)`` have the line ends between them. A task writes its files one after the other from
    sorted parts, so none is held whole. A file gets its name when it is complete: a task that is lost
    leaves a ``.part`` file, and the one that runs instead writes the same text. Null texts are empty.
    """
    rows = pieces.join(destinations.select("doc_key", "destination"), "doc_key").select(
        "destination", "part_no", F.coalesce("text", F.lit("")).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = locate(root)
        current, out, path, held, count, size = None, None, "", None, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if current is not None:
                out.close()
                fs.move(path, f"{top}/{current}")
                yield pa.RecordBatch.from_pylist([
                    {"destination": current, "n_parts": count, "n_bytes": size, "sha256": held.hexdigest()}], schema=_WRITTEN)

        for batch in batches:
            for destination, text in zip(batch.column("destination").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if destination != current:
                    yield from close()
                    current, held, count, size = destination, hashlib.sha256(), 0, 0
                    fs.create_dir(f"{top}/{destination}".rsplit("/", 1)[0], recursive=True)
                    path = f"{top}/{destination}.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(path)
                data = text.encode("utf-8", "surrogatepass")
                out.write(data)
                held.update(data)
                count, size = count + 1, size + len(data)
        yield from close()

    written = rows.repartition("destination").sortWithinPartitions("destination", "part_no").mapInArrow(
        of, "destination string, n_parts long, n_bytes long, sha256 string")
    return cut_lineage(written)


_WRITTEN = pa.schema([("destination", pa.string()), ("n_parts", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


def sink_drafts(drafts: DataFrame, path: str, accounting: DataFrame) -> None:
    """Append rendered drafts by kind; names were settled before this job runs.

    Nothing is written unless ``accounting`` (of the compile that made the drafts) accounts for every fence.
    """
    accounting.write.format("noop").mode("overwrite").save()
    rows = drafts.select("filename", "emitter", "content", "renamed", "namespace", "kind")
    rows.write.mode("append").partitionBy("kind").parquet(path)


def event_lines(events: DataFrame) -> DataFrame:
    """One compact JSON line per event; NULL fields and non-ASCII are kept."""
    return events.select(
        F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))


def sink_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)
