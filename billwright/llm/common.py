"""Readers and small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: Ids up to this many are broadcast (8 bytes each, 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}
#: In a worker process: how to free what its last operator keeps.
_KEPT: list[Callable[[], None]] = []

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE_SPACE = re.compile(r"(?:^|\s) | (?:\s|$)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def folded(text: str | Column) -> Column:
    """Text with A-Z in lower case and every other character as it is; null as ''."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row: its id and a hash of its text, so rows that share an id stay apart."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def semi_by_id(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in ``ids``; broadcast only if counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, "left_semi")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it Arrow batches have at most ``rows`` rows: for rows that are large themselves, written at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def slices(batch: pa.RecordBatch, column: int, limit: int, release: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of the text column each.

    ``release``, a function of a module, frees what the caller keeps from batch
    to batch. A worker process serves one operator after the other: it is
    called as soon as a batch of another one comes.
    """
    if _KEPT and _KEPT[0] is not release:
        _KEPT.pop()()
        gc.collect()  # kept states refer to each other
        give_back()
    if release is not None and not _KEPT:
        _KEPT.append(release)
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return to the system what is free: it would stay with the worker process, beside the next operator's rows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def safe_parts(text: str) -> list[str]:
    """``text`` cut at single spaces between two characters that are not white space.

    The spaces are left out: every part but the first has one before it. The
    token patterns of the byte-level vocabularies never match across such a
    space's left side, so the parts can be encoded one by one.
    """
    return _SAFE_SPACE.split(text) if _UNSAFE_SPACE.search(text) else text.split(" ")


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a batch, null as ''."""
    return [t or "" for t in batch.column(column).to_pylist()]


def anti_by_id(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` not in ``ids`` by ``columns``; broadcast only if counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, columns, "left_anti")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()  # the driver serves the file as long as it runs
    archive = f"{folder.name}/{package.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED[context.applicationId] = folder
