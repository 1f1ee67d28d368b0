"""Slices of Arrow batches; intermediate tables are those of the library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

from orrery.sources.scratch import dropped, shared_dir, written

__all__ = ["dropped", "fresh", "shared_dir", "slices", "written"]

ROWS_PER_SLICE, BYTES_PER_SLICE = 1000, 8 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_PER_SLICE, size: int = BYTES_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Views of the batches of at most ``rows`` rows and, on average, ``size`` bytes (one row at least).

    Spark itself bounds the bytes of the batches it sends (64 MB by default); what Python makes of their texts is
    bounded by these slices. Nothing is copied and no setting of the session is changed.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as keep it apart from the ``taken`` ones, whatever their case."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out
