"""Archives: zip files of parts with a manifest that tells each part's bytes and SHA-256, built and read as rows."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name of the manifest, date of all entries (so that equal parts make equal archives).
MANIFEST, DATE = "manifest.json", (1980, 1, 1, 0, 0, 0)


def pack(parts: dict[str, bytes]) -> bytes:
    """A zip file of the parts, by name, and their manifest."""
    entries = [{"name": n, "bytes": len(c), "sha256": hashlib.sha256(c).hexdigest()} for n, c in sorted(parts.items())]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in [*sorted(parts.items()), (MANIFEST, json.dumps({"files": entries}).encode())]:
            book.writestr(zipfile.ZipInfo(name, DATE), content)
    return out.getvalue()


def _packed(table: pa.Table) -> pa.Table:
    parts = dict(zip(table["name"].to_pylist(), (c or b"" for c in table["content"].to_pylist()), strict=True))
    return pa.table({"archive": table["archive"].slice(0, 1), "content": pa.array([pack(parts)], pa.binary())})


def build(parts: DataFrame) -> DataFrame:
    """archive, content (the zip file) of parts (archive, name, content). An archive is one row, so it has to fit in one; of repeated names one stays."""
    kind = parts.schema["archive"].dataType.simpleString()
    rows = parts.select("archive", "name", "content").where("archive is not null and name is not null")
    return rows.groupBy("archive").applyInArrow(_packed, f"archive {kind}, content binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, content in enumerate(batch.column("content").to_pylist()):
            rows, error = [], None
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
                    told = {e["name"]: (e["bytes"], e["sha256"]) for e in json.loads(book.read(MANIFEST))["files"]}
                    for name in sorted({*book.namelist(), *told} - {MANIFEST}):
                        data = book.read(name) if name in book.namelist() else None
                        digest = None if data is None else hashlib.sha256(data).hexdigest()
                        rows.append((name, None if data is None else len(data), digest, data, data is not None and told.get(name) == (len(data), digest)))
            except (KeyError, TypeError, ValueError, zipfile.BadZipFile) as broken:
                rows, error = [(None, None, None, None, False)], f"{type(broken).__name__}: {broken}"
            column = lambda i, kind: pa.array([r[i] for r in rows], kind)  # noqa: E731, B023
            archive = pa.concat_arrays([batch.column("archive").slice(k, 1)] * len(rows)) if rows else batch.column("archive").slice(0, 0)
            yield pa.RecordBatch.from_arrays([archive, column(0, pa.string()), column(1, pa.int64()), column(2, pa.string()), column(3, pa.binary()), column(4, pa.bool_()), pa.array([error] * len(rows), pa.string())], ["archive", "name", "bytes", "sha256", "content", "sound", "error"])


def read(archives: DataFrame) -> DataFrame:
    """archive, name, bytes, sha256, content, sound, error of the parts of archives (archive, content).

    `sound`: the part is there and as its manifest says. A missing part has null content; a file
    that is no archive with a manifest gives one row with an error.
    """
    kind = archives.schema["archive"].dataType.simpleString()
    return archives.select("archive", "content").mapInArrow(_unpacked, f"archive {kind}, name string, bytes long, sha256 string, content binary, sound boolean, error string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """archive (its path) and content of every file under `path`, for `read`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), "content")


def pages_error(pages: Column, owned: Column, total: Column | None = None) -> Column:
    """Why a payload's pages (array of numbers) can't be taken, null if they can.

    They have to be 1 to n in order, as many as `total` says, and every page in `owned` one of them.
    """
    n = F.size(pages)
    wrong = (n <= 0) | F.exists(F.transform(pages, lambda p, i: ~p.eqNullSafe((i + 1).cast("long"))), lambda x: x)
    return F.when(pages.isNull() | wrong, "pages").when(F.lit(False) if total is None else total != n, "total").when(F.exists(owned, lambda p: (p < 1) | (p > n)), "owned")
