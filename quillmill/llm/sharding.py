"""Placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: it
starts at an offset and advances by a step, both from hashes of its name, and
so visits every slot. Shards take turns; the one whose turn it is claims the
first slot of its order that is still free. A key is placed by one look at slot
``hash(key) mod size``. Shards get nearly equal numbers of slots, and when one
leaves, few slots besides its own change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537  # prime; the broadcast table has so many rows whatever the data
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt.encode()).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the number of the shard that claimed it. The result depends on the set of names, not their order."""
    names = sorted(shards)
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, and at least one")
    if not is_prime(size) or size < len(names):
        raise ValueError("the table's size must be a prime number no less than the number of shards")
    number = {n: i for i, n in enumerate(shards)}
    at = [_hash(n, "offset") % size for n in names]
    step = [_hash(n, "step") % (size - 1) + 1 if size > 2 else 1 for n in names]
    table = np.full(size, -1, np.int32)
    free = size
    while True:
        for k, n in enumerate(names):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % size
            table[slot] = number[n]
            at[k] = (slot + step[k]) % size
            free -= 1
            if not free:
                return table


def slot(key: str | Column, size: int = TABLE_SIZE) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``key``, slot and shard for every row of ``df``.

    A null key is placed like the empty string, a key of any length by its
    hash. Repeated keys go to the same shard. A key column that is itself
    named ``slot`` or ``shard`` keeps its name; the result then has two columns
    of that name, the key first. The table is broadcast: its rows are fixed by
    ``size``. No shuffle.
    """
    table = lookup_table(shards, size)
    rows = pa.table({"_slot": pa.array(np.arange(size), pa.int32()), "_shard": pa.array([shards[i] for i in table], pa.string())})
    slots = df.sparkSession.createDataFrame(rows)
    own = df.select(F.col(f"`{key}`").alias("_key"))
    found = own.withColumn("_slot", slot("_key", size)).join(F.broadcast(slots), "_slot")
    return found.select(F.col("_key").alias(key), F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
