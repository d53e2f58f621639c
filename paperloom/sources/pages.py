"""PDF files through an injected reader.

The library for layout is the caller's: ``reader(path, content)`` yields, for one
file, dicts with a ``kind`` (page, span, grid, image or word) and the columns of that
kind's schema. A file that cannot be read becomes a status row, not an exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions import text as T

Reader = Callable[[str, bytes], Iterable[dict]]
#: How a trailer, which may stand anywhere, names the dictionary of an encrypted file.
_ENCRYPTED = re.compile(rb"/Encrypt\s+\d+\s+\d+\s+R")
KINDS = {"span": "SPANS", "grid": "GRIDS", "image": "IMAGES", "word": "WORDS"}


def schema_of(kind: str) -> StructType:
    return getattr(S, KINDS[kind])


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, document_id, content, modified)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", T.document_id(F.col("path")).alias("document_id"), "content", F.col("modificationTime").alias("modified"))


def _status(content: bytes | None) -> str | None:
    if not content:
        return "empty"
    if not content.startswith(b"%PDF"):
        return "not_pdf"
    return "encrypted" if _ENCRYPTED.search(content) else None


def scan(source: DataFrame, reader: Reader, kind: str) -> DataFrame:
    """What the reader yields of one kind, for all files that can be read."""
    fields = schema_of(kind)
    names = [f.name for f in fields if f.name != "document_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, doc, content in zip(batch["path"], batch["document_id"], batch["content"], strict=True):
                if _status(content):
                    continue
                try:
                    rows = [r for r in reader(path, content) if r.get("kind") == kind]
                except Exception:  # reported by ``status``
                    continue
                if rows:
                    yield pd.DataFrame([{"document_id": doc} | {n: r.get(n) for n in names} for r in rows])

    return source.select("path", "document_id", "content").mapInPandas(run, fields)


def status(source: DataFrame, reader: Reader) -> DataFrame:
    """One row for each page, or one for a file that failed, with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, doc, content in zip(batch["path"], batch["document_id"], batch["content"], strict=True):
                bad, error, pages = _status(content), None, []
                if not bad:
                    try:
                        pages = sorted({int(r["page_number"]) for r in reader(path, content)})
                        bad = None if pages else "no_pages"
                    except Exception as e:  # the reason goes into the row
                        bad, error = "unreadable", str(e)
                yield pd.DataFrame([{"path": path, "document_id": doc, "page_number": p, "total_pages": len(pages), "status": bad or "ok", "error": error} for p in (pages or [None])])

    return source.select("path", "document_id", "content").mapInPandas(run, S.PAGES)
