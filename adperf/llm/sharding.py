"""Sharding by jump consistent hashing, with built-in functions only.

The shard is a function of the row's id and the shard count: a generator seeded with the id
draws where the key would next move as shards are appended, and the last move below the shard
count is the shard. Appending a shard moves only about 1/(n+1) of the rows, all into the new
one, and needs no ring table. A key moves at most once per appended shard, so ``n`` steps
always end the walk.

Slots number the rows of a shard from 0 without gaps. A shard is not sorted in one task: its
rows are dealt into cells by the id's hash, numbered inside the cell, and shifted by the number
of rows in the cells before (a window over cells, not rows).

Edge cases: a null id counts as 0; a null text has no bytes (size 8, CRC 0); repeated rows get
one slot each (equal ones in any order, which no column shows); texts of any length are read
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the published algorithm
MULTIPLIER = 2862933555777941757
WORD = 18446744073709551616  # 2**64
DRAW = 8589934592  # 2**33: the top 31 bits are the draw
SCALE = 2147483648.0  # 2**31

CELL_ROWS = 50_000


def next_key(key: Column) -> Column:
    """One step of the 64-bit generator; decimals hold the full product."""
    product = key * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)
    return (product.cast("decimal(38,0)") % F.lit(str(WORD)).cast("decimal(20,0)")).cast(
        "decimal(20,0)")


def _seed(row_id: Column) -> Column:
    """The id as an unsigned 64-bit number."""
    key = F.coalesce(row_id.cast("long"), F.lit(0)).cast("decimal(20,0)")
    wrapped = (key + F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(key < 0, wrapped).otherwise(key)


def jump_shard(row_id: Column, shards: int) -> Column:
    """Shard of each id among ``shards``, and among one more, as a struct (shard, grown)."""
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"),
                     _seed(row_id).alias("key"), F.lit(0).cast("long").alias("shard"),
                     F.lit(0).cast("long").alias("grown"))

    def step(acc: Column, _: Column) -> Column:
        key = next_key(acc["key"])
        # integer division of the unsigned key: its top 31 bits
        top = F.floor(key / F.lit(DRAW).cast("decimal(10,0)")).cast("double")
        to = F.floor((acc["to"] + F.lit(1)) * (F.lit(SCALE) / (top + F.lit(1.0)))).cast("long")
        moving = acc["to"] <= F.lit(shards)
        return F.struct(
            F.when(moving, acc["to"]).otherwise(acc["at"]).alias("at"),
            F.when(moving, to).otherwise(acc["to"]).alias("to"),
            F.when(moving, key).otherwise(acc["key"]).alias("key"),
            F.when(acc["to"] < F.lit(shards), acc["to"]).otherwise(acc["shard"]).alias("shard"),
            F.when(moving, acc["to"]).otherwise(acc["grown"]).alias("grown"))

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(walk["shard"].cast("int").alias("shard"),
                    walk["grown"].cast("int").alias("grown"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
           cells: int | None = None) -> DataFrame:
    """Shard, slot and shard after growth for every row.

    ``cells`` (default: one per ``CELL_ROWS`` rows) splits each shard's numbering.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    if cells is None:
        cells = max(1, -(-docs.count() // CELL_ROWS))
    rows = (rows.withColumn("jump", jump_shard(F.col("doc_id"), shards))
            .withColumn("shard", F.col("jump.shard"))
            .withColumn("grown_shard", F.col("jump.grown"))
            .withColumn("cell", (next_key(_seed(F.col("doc_id"))) % F.lit(cells)).cast("long"))
            .drop("jump"))
    sizes = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    sizes = sizes.select("shard", "cell", before.alias("before"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("inside", F.row_number().over(inside))
            .join(sizes, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"),
                    "grown_shard"))


def write_shards(rows: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``rows`` as one folder per shard; AQE splits a large shard over several files."""
    ids = shards.select(F.col("doc_id").alias(id_col), "shard").distinct()
    rows.join(ids, id_col).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
