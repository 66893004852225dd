"""Arrow batches in, Arrow batches out: the one way in which these operators leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from ctypes import CDLL
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.llm.marks import free

#: Rows handled at once inside a task, so that a batch of long texts is not held twice as Python objects.
SLICE = 256
#: Bytes of a batch of texts or sets where two of them make a row.
BATCH = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """What is materialised inside goes to Python in batches of about ``size`` bytes at most; the JVM and Python each hold them whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Memory that a task's worker has freed goes back to the system, not to the worker's next task alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What ``kept`` has made for the tasks of one operator.
_KEPT: list = []


def kept(make: Callable) -> Callable:
    """``make`` with its last result kept by the worker process for later tasks, until it turns to other texts (``forget``).

    Workers outlive stages; so what one operator needs does not stay beside what the next one needs.
    """
    cached = lru_cache(maxsize=1)(make)
    _KEPT.append(cached)
    return cached


def forget() -> None:
    """Drops what ``kept`` has made in this process."""
    if any(f.cache_info().currsize for f in _KEPT):
        for f in _KEPT:
            f.cache_clear()
        give_back()


def each_text(
    df: DataFrame, text: str, make: Callable[[], Callable[[str | None], tuple]], out: str | StructType, keep: Iterable[str] = ()
) -> DataFrame:
    """For every row the kept columns and what ``make()`` computes from the text, in one pass without a shuffle.

    ``make`` runs once per task and returns the function of a text, so models and caches live as long as the task.
    """
    keep = list(keep)
    rows = df.select(*[f"`{k}`" for k in keep], df[text].cast("string").alias(free(df, "text_of_row")))
    added = StructType.fromDDL(out) if isinstance(out, str) else out
    whole = StructType(list(rows.schema.fields[: len(keep)]) + list(added.fields))
    kinds = list(to_arrow_schema(added).types)
    names = [f.name for f in whole.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = list(zip(*(f(t.as_py()) for t in part.column(len(keep))), strict=True))
                new = [pa.array(column, kind) for column, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=names)
        give_back()

    return rows.mapInArrow(run, whole)
