"""Square tiles of pixel tables as the units of work of Arrow tasks.

A pixel table is dealt out by image and tile, which is the only shuffle of it; a tile may bring a halo
of the pixels around it. A task goes through its tiles a million rows at a time, so what it holds does
not depend on the size of an image, and many small images are worked on together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256
HELD = 1 << 20  # rows gone through together
CELLS = 1 << 22  # of dense planes
_PLACE = ("__tr", "__tc")


def _starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """First rows of the stretches of equal values."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        if not pa.types.is_integer(column.type) or column.null_count:
            column = pc.dictionary_encode(column, null_encoding="encode").indices
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def map_tiles(
    pixels: DataFrame,
    keys: Sequence[str],
    change: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table], list],
    fields: Sequence[T.StructField],
    *,
    tile: int = TILE,
    halo: int = 0,
) -> DataFrame:
    """Add the columns that ``change(starts, row, col, table)`` makes of complete tiles.

    ``starts`` are the first rows of the tiles in ``table``; row and col count from 0 at the halo's
    corner. The new values of halo pixels are thrown away. Columns of the same names are replaced.
    """
    if halo > tile:
        raise ValueError("the halo has to fit into a tile")
    keys = list(keys)
    place = {}
    for name, axis in zip(_PLACE, ("row", "col"), strict=True):
        at = F.col(axis).cast("long") - 1
        place[name] = (
            F.explode(F.sequence(F.greatest(F.floor((at - halo) / tile), F.lit(0)), F.floor((at + halo) / tile)))
            if halo
            else F.floor(at / tile)
        )
    dealt = pixels
    for name, column in place.items():
        dealt = dealt.withColumn(name, column)
    dealt = dealt.repartition(*keys, *_PLACE).sortWithinPartitions(*keys, *_PLACE)
    added = {f.name for f in fields}
    names = [c for c in pixels.columns if c not in added]
    schema = T.StructType([pixels.schema[c] for c in names] + list(fields))

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        local = [
            table.column(axis).to_numpy().astype(np.int64) - 1 - table.column(at).to_numpy() * tile + halo
            for axis, at in zip(("row", "col"), _PLACE, strict=True)
        ]
        made = change(starts, *local, table)
        out = pa.table([*(table.column(c) for c in names), *(pa.array(m) for m in made)], names=schema.names)
        if halo:
            own = np.logical_and.reduce([(x >= halo) & (x < halo + tile) for x in local])
            out = out.filter(pa.array(own))
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                table = pa.Table.from_batches(held)
                starts = _starts(table, [*keys, *_PLACE])
                if len(starts) > 1:  # the last tile may go on in the next batch
                    yield from work(table.slice(0, int(starts[-1])), starts[:-1])
                    held = table.slice(int(starts[-1])).to_batches()
                    rows = sum(b.num_rows for b in held)
        if rows:
            table = pa.Table.from_batches(held)
            yield from work(table, _starts(table, [*keys, *_PLACE]))

    return dealt.mapInArrow(run, schema)


def dense(
    starts: np.ndarray,
    row: np.ndarray,
    col: np.ndarray,
    values: np.ndarray,
    change: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> np.ndarray:
    """``change(planes, present)`` of all tiles as dense planes (n, h, w), read back at the rows.

    Tiles of about the same size share planes of at most CELLS cells (one tile may have more).
    """
    sizes = np.diff(np.append(starts, len(row)))
    number = np.repeat(np.arange(len(starts)), sizes)
    row, col = (x - np.minimum.reduceat(x, starts)[number] for x in (row, col))
    h, w = (np.maximum.reduceat(x, starts) + 1 for x in (row, col))
    kind = np.ceil(np.log2(h)).astype(int) * 64 + np.ceil(np.log2(w)).astype(int)
    out = None
    for k in np.unique(kind):
        tiles = np.flatnonzero(kind == k)
        height, width = int(h[tiles].max()), int(w[tiles].max())
        step = max(1, CELLS // (height * width))
        for first in range(0, len(tiles), step):
            some = tiles[first : first + step]
            n = sizes[some]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(starts[some] - begin, n)
            cell = (np.repeat(np.arange(len(some)), n), row[at], col[at])
            planes = np.zeros((len(some), height, width), values.dtype)
            present = np.zeros(planes.shape, bool)
            planes[cell], present[cell] = values[at], True
            made = change(planes, present)
            if out is None:
                out = np.zeros(len(row), made.dtype)
            out[at] = made[cell]
    return out
