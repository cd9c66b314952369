"""Sharding by a permutation-filled lookup table, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

N_SHARDS = 64
#: A prime well above 100 slots a shard, so that shard shares differ by less than one part in a thousand.
TABLE_SIZE = 65_537


def _hash(value: str) -> int:
    import hashlib

    return int(hashlib.md5(value.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``shards``) of every slot.

    Each shard prefers the slots in the order of a permutation of its own, offset + j * skip modulo the prime
    ``size``; shards take turns, each claiming the first slot on its list that is still free. Removing a shard
    moves its own keys and few others.
    """
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shard names must be distinct, at least one, and no more than slots")
    step = [(_hash(f"{s}/offset") % size, _hash(f"{s}/skip") % (size - 1) + 1) for s in shards]
    at, table, left = [o for o, _ in step], [-1] * size, size
    while left:
        for i, (_, skip) in enumerate(step):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % size


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, spread: list[str] | None = None, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key, in one scan: the table (``size`` rows, fixed) is broadcast.

    The same key always goes to the same shard, whatever the rows around it. A null key has no identity to keep
    together, so such rows are spread by the columns ``spread`` (all, if None). ``out`` replaces a column of that
    name. An empty table gives an empty table.
    """
    text = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("_slot", "_i")).select(F.col("_slot").cast("long").alias("_slot"), F.get(names, F.col("_i").cast("int")).alias("_shard"))
    carry = [c for c in df.columns if c != out]
    rest = F.abs(F.xxhash64(*(df[c].cast("string") for c in (spread or df.columns))) % size)
    rows = df.select(F.struct(*carry).alias("_row"), F.coalesce(slot_of(df[key], size), rest).alias("_slot"))
    return rows.join(F.broadcast(table), "_slot").select("_row.*", F.col("_shard").alias(out))


SHARDS = [f"shard-{i:03d}" for i in range(N_SHARDS)]


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents by doc_id."""
    return assign_shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def oracle() -> str:
    table = ",".join(map(str, fill_table(SHARDS)))
    return f"""
WITH slots AS (SELECT string_split('{table}', ',') AS s)
SELECT doc_id, 'shard-' || lpad(s[(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {TABLE_SIZE}) + 1], 3, '0') AS shard
FROM documents, slots"""
