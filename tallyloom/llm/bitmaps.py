"""A bit map of fixed size over 64-bit hashes: tells for sure what is absent, however many are marked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One MB, to ship to every executor.
MAP_BITS = 23
_CELL = 32_768  # bits to a value of bitmap_construct_agg


class BitMap:
    """Marks by the top ``bits`` bits of a hash."""

    def __init__(self, cells: list[tuple[int, bytes]], bits: int = MAP_BITS):
        self.bits, self.marked = bits, None
        if cells:
            self.marked = np.zeros(1 << (bits - 3), np.uint8)
            for cell, held in cells:
                self.marked[cell * _CELL // 8 : (cell + 1) * _CELL // 8] = np.frombuffer(bytes(held), np.uint8)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of those that may be marked."""
        if self.marked is None:
            return np.zeros(0, np.int64)
        place = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        octet = self.marked[(place >> np.uint64(3)).astype(np.int64)]
        return np.flatnonzero(octet >> (place & np.uint64(7)).astype(np.uint8) & 1)


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> BitMap:
    """Of a frame with one column of hashes.  Collects bits, ``2 ** bits`` at most, not hashes."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    placed = hashes.select(place.alias("place")).select((F.col("place") / _CELL).cast("long").alias("cell"), F.pmod("place", F.lit(_CELL)).alias("at"))
    cells = placed.groupBy("cell").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    return BitMap([(r["cell"], r["bits"]) for r in cells.collect()], bits)
