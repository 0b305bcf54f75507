"""Arrow batches in small pieces, so that a worker's memory follows a piece and not the table."""

from __future__ import annotations

PIECE_BYTES = 1 << 21


def tidy() -> None:
    """Give a worker's freed memory back; workers outlive their tasks and share the executor's room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(batches, most: int = PIECE_BYTES, rows: int = 1 << 30):
    """Every batch as slices of about ``most`` bytes and at most ``rows`` rows, all rows in their order."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
        tidy()
