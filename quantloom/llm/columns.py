"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of plain words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def narrowed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names do no harm."""
    return docs.select(*[docs[n] for n in names])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores at its end as it takes for no column to have it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(docs: DataFrame, name: str = "row") -> Column:
    """Each row as one struct: while a plan works on it, no name of its columns can clash; ``unpacked`` gives it back."""
    return F.struct(*[docs[quoted(c)] for c in docs.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    """The columns of rows that ``row_of`` packed, alone."""
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [b if b is not None else b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def free_memory() -> None:
    """Give back what Arrow and the C library hold beyond what is in use: a worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """For mapInArrow: ``run``, and memory given back at the end of each task."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return whole


def arrow_map(rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """For mapInArrow: one output batch for each input batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield rows(batch)

    return tidy(run)


def empty_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
