"""The numbers of a 32-bit xorshift generator (shifts 13, 17, 5), at any positions: a step is linear over bits, so powers of it jump ahead."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions that are stepped through from one jump.
BLOCK = 1 << 12
#: The state's greatest value: numbers are states over this, so 1 is one of them.
TOP = 0xFFFFFFFF


def stepped(x: np.ndarray) -> np.ndarray:
    """The states after ``x`` (uint32)."""
    x = x ^ (x << np.uint32(13))
    x = x ^ (x >> np.uint32(17))
    return x ^ (x << np.uint32(5))


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A bit matrix, given as where it sends every single bit, times states."""
    out = np.zeros_like(x)
    for bit, to in enumerate(columns):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), to, np.uint32(0))
    return out


@cache
def _powers() -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... steps."""
    found = [stepped(np.uint32(1) << np.arange(32, dtype=np.uint32))]
    while len(found) < 63:
        found.append(_applied(found[-1], found[-1]))
    return found


def jumped(state: int, steps: int) -> np.uint32:
    x = np.array([state], np.uint32)
    for k, power in enumerate(_powers()):
        if steps >> k & 1:
            x = _applied(power, x)
    return x[0]


def run(state: int, first: int) -> np.ndarray:
    """BLOCK states from the one at position ``first`` on; position 0 is the first after ``state``. Lengths are doubled, not stepped."""
    x = np.array([jumped(state, first + 1)], np.uint32)
    for power in _powers()[: BLOCK.bit_length() - 1]:
        x = np.concatenate((x, _applied(power, x)))
    return x


def unit(position: Column, seed: int) -> Column:
    """Numbers in [0, 1] at positions (0, 1, ...) after seeding; seed 0 is 1, as the state 0 would stay."""
    state = (seed & TOP) or 1

    @F.pandas_udf("double")
    def at(places: pd.Series) -> pd.Series:
        p = places.to_numpy(np.int64)
        out = np.empty(len(p))
        blocks, which = np.unique(p // BLOCK, return_inverse=True)
        for k, block in enumerate(blocks.tolist()):
            mine = which == k
            out[mine] = run(state, block * BLOCK)[p[mine] % BLOCK] / TOP
        return pd.Series(out)

    return at(position)
