"""Exports written as files, archives and folders, and read back in byte ranges."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.plans.corpus import derived
from snipmill.session import new_folder
from snipmill.sources import json_arrays as J
from snipmill.sources.stores import locate

# Every 8 conversations are an export with one element for each turn and its whole text. Of 8 exports two are
# archives, one is a folder with a neighbour, and four have a fault.
ELEMENTS = """
SELECT conv_id // 8 AS export, conv_id * 1000 + turn AS place, role, coalesce(text, '') AS text FROM conversations
"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ELEMENTS.replace("conv_id // 8", "CAST(floor(conv_id / 8) AS BIGINT)"), "conversations")


def _files(folder: str, export: int) -> tuple[str, bytes, bytes, bytes]:
    """Path, and what stands in front of, between and behind the elements."""
    kind = export % 8
    path = f"{folder}/e{export}" + {1: "/" + fixed.EXPORT_FILE, 2: ".zip", 6: ".zip"}.get(kind, ".json")
    if kind == 3:
        return path, b'{"conversations": [', b", ", b"]}"
    return path, b"[\n ", b",\n " if kind < 4 else b",", {4: b"", 5: b"]}", 6: b",]"}.get(kind, b"]\n")


def write_exports(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (export, place, role, text) as one array for each export; a task writes one file after the other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = locate(folder)
        current, out, member, archive, last, more = None, None, None, None, b"", b""
        count = 0

        def close() -> None:
            if current is not None:
                member.write(last)
                member.close()
                if archive is not None:
                    archive.close()
                out.close()

        for batch in batches:
            for row in batch.to_pylist():
                if row["export"] != current:
                    close()
                    path, first, more, last = _files(root, row["export"])
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, archive, current = fs.open_output_stream(path), None, row["export"]
                    member = out
                    if path.endswith(".zip"):
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                        member = archive.open("data/" + fixed.EXPORT_FILE, "w")
                    elif path.endswith(fixed.EXPORT_FILE):
                        with fs.open_output_stream(path.rsplit("/", 1)[0] + "/user.json") as neighbour:
                            neighbour.write(b'{"not": "an export"}')
                    member.write(first)
                    count += 1
                else:
                    member.write(more)
                member.write(json.dumps({"place": row["place"], "role": row["role"], "parts": [{"text": row["text"]}]},
                                        ensure_ascii=False, indent=row["place"] % 3 or None).encode())
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    return rows.repartition("export").sortWithinPartitions("export", "place").mapInArrow(of, "files long")


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = new_folder(spark, "exports")
    write_exports(_elements(spark, sf_dir), folder).collect()  # one count for each task
    return J.scan_export_files(spark, folder)


def _export(path: str) -> F.Column:
    return F.regexp_extract(path, r"/e([0-9]+)(?:/[^/]*|\.[a-z]+)$", 1).cast("long")


def scan_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all good exports, with the digest of the whole text, and the faults of the others."""
    entries, errors = _scan(spark, sf_dir)
    value = lambda at, kind: F.variant_get("entry", at, kind)
    good = entries.select(_export("export_key").alias("export"), "position", value("$.place", "long").alias("place"),
                          value("$.role", "string").alias("role"), F.md5(value("$.parts[0].text", "string")).alias("what"))
    bad = errors.select(_export("path").alias("export"), F.col("error").alias("what"))
    return good.unionByName(bad, allowMissingColumns=True)


QUERIES = {"scan_export_files": scan_export_files}
ORACLES = {"scan_export_files": f"""
WITH elements AS ({ELEMENTS})
SELECT export, CAST(row_number() OVER (PARTITION BY export ORDER BY place) - 1 AS INT) AS position, place, role, md5(text) AS what
FROM elements WHERE export % 8 NOT IN (3, 4, 5, 6)
UNION ALL
SELECT DISTINCT export, NULL, NULL, NULL, CASE export % 8 WHEN 3 THEN '{J.NO_ARRAY}' ELSE '{J.NO_JSON}' END
FROM elements WHERE export % 8 IN (3, 4, 5, 6)
"""}
