"""Tokenisation and Arrow helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Texts of one Arrow batch are worked on in slices of at most so many bytes, so that memory follows neither
#: the batch size nor the length of the texts that happen to meet in a batch.
SLICE_BYTES = 4 << 20
#: Rows of texts that go to Python at a time where memory is short; Spark's own bound is 64 MB a batch.
BATCH_ROWS = 512


def words(data: bytes) -> list[bytes]:
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased (bytes.split and bytes.lower know
    ASCII only, so UTF-8 sequences stay whole)."""
    return data.lower().split()


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes together; one row may exceed it."""
    sizes = batch.column(column).cast(pa.binary())
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, names: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The named columns of the batch, then the given ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(columns.values()), names=[*names, *columns])


def map_slices(docs, change, text_col: str = "text"):
    """Apply ``change(RecordBatch) -> RecordBatch`` of the same columns to slices of the documents; no shuffle."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, text_col):
                yield change(part)

    return docs.mapInArrow(run, docs.schema)
