"""A Bloom filter of a fixed size: an overfull one lets more pass, at more cost, and loses nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, which is sent to the executors whole. It stays selective for about a tenth as many keys.
FILTER_BITS, PROBES = 1 << 27, 4


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of a hash: steps of its upper half from its lower."""
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(33)) | np.uint64(1)
    return [((low + np.uint64(k) * step) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in range(PROBES)]


def bloom(keys: DataFrame, name: str = "key") -> np.ndarray:
    """The filter of a column's 64-bit hashes, FILTER_BITS / 8 bytes however many there are."""
    low, step = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(name, 33).bitwiseOR(F.lit(1).cast("long"))
    at = F.explode(F.array(*[(low + step * k).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) for k in range(PROBES)]))
    words_set = keys.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    # neighbouring words travel as one array, so that few rows reach the driver
    rows = words_set.groupBy(F.shiftright("w", 12).alias("k")).agg(F.collect_list(F.struct("w", "bits")).alias("x")).select("x.w", "x.bits")
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows.toLocalIterator():
        table[r["w"]] = r["bits"]
    return table.view(np.uint8)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for at in _probes(h):
        hit &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)
    return hit
