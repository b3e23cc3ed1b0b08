"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table (offset
and skip from its name).  Shards take turns; at its turn a shard claims its first
preference still free, until every slot is taken.  A row's slot is its key's hash modulo
the table size; one broadcast of the fixed-size table places all rows.  Slots, and so
rows, are even to one slot per shard, and removing a shard moves few of the others' rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default table size, a prime; the broadcast table never has more rows than this setting.
TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the place of the shard that claimed it in ``shards``."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(size) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one, no more than the slots; the table size must be prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    offset, skip = {}, {}
    for i in order:
        digest = hashlib.md5(shards[i].encode()).hexdigest()
        offset[i], skip[i] = int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1
    owner, at, free = [-1] * size, dict(offset), size
    while free:
        for i in order:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a string key: the leading 60 bits of its md5, modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard_id, shard: the filled table as a DataFrame made from one literal."""
    claimed = ",".join(map(str, fill_table(shards, size)))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    table = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(claimed), ",").cast("array<int>")).alias("slot", "shard_id"))
    return table.select("slot", "shard_id", F.element_at(names, F.col("shard_id") + 1).alias("shard"))


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], *, size: int = TABLE_SIZE, prefix: str = "") -> DataFrame:
    """df with <prefix>slot, <prefix>shard_id and <prefix>shard.

    The key is the listed columns as text, joined by a separator, a null part as the empty text; equal
    keys always meet in one shard.  If every part is null, the row is placed by the text of its other
    columns, so such rows spread.  Columns of df that bear the new names need another ``prefix``
    (ValueError).  An empty df gives an empty result.
    """
    new = [prefix + x for x in ("slot", "shard_id", "shard")]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    parts = [F.coalesce(df[k].cast("string"), F.lit("")) for k in keys]
    whole = F.concat_ws("\x1f", *parts) if len(parts) > 1 else parts[0]
    key = F.when(F.coalesce(*[df[k].cast("string") for k in keys]).isNull(), F.to_json(F.struct(*[df[c] for c in df.columns]))).otherwise(whole)
    table = lookup_table(df.sparkSession, shards, size).toDF(*new)
    return df.withColumn(new[0], slot_of(key, size)).join(F.broadcast(table), new[0], "left").select(*df.columns, *new)
