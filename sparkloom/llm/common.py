"""Shared plumbing of the corpus operators: table access, shared-folder tables and bounded Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.shared import cut

#: Bytes of text that one vectorised step handles at a time; a single longer text is a step of its own.
SLICE_BYTES = 1 << 19
#: Bytes of a batch on its way to Python and back; the session setting is lowered to that where it is higher.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialise = cut


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task ``make()`` and steps whose text stays near ``SLICE_BYTES``.

    The first string or binary column decides how a batch is cut. Batches are bounded in bytes where the plan is run, so the
    session's limit on them is lowered to ``BATCH_BYTES`` if it is higher, and stays so: the plan may be run at any later time.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if parse_bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                out = step(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def parse_bytes(size: str) -> int:
    """A size as Spark writes it, as 64MB or 4096."""
    digits = size.rstrip("bBkKmMgG")
    return int(digits) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[size[len(digits) :].lower()]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)]
    if not wide or not batch.num_rows:
        yield batch
        return
    ends = offsets(wide[0])[1:]
    start, base = 0, int(offsets(wide[0])[0])
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array, ``len + 1`` of them, into its data buffer."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column as one array and the offsets into it; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    at = offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_bytes(text) -> F.Column:
    """UTF-8 length of a text column, a null being empty."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(member: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member`` of at least ``least``, none across one of ``ends``."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(member) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(member & (edge[:-1] | ~np.concatenate(([False], member[:-1]))))
    stops = np.flatnonzero(member & (edge[1:] | ~np.concatenate((member[1:], [False])))) + 1
    long = stops - starts >= least
    return starts[long], stops[long]
