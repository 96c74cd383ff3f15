"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly into buckets that fit in memory, by seeded hashes. Pass two
collects each bucket, permutes it with Spark's ``shuffle`` (a Fisher-Yates shuffle) and numbers its
rows after those of the shard's earlier buckets. The shard of a record is its rendezvous choice:
the shard whose seeded hash with the record's id is largest, so that one more shard takes records
from the others and moves none between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.llm.cluster import cut, drop_existing, missing, small_side

#: Bytes of records in a bucket, about: several such buckets fit in an executor's memory.
BUCKET_BYTES = 16 << 20
#: What a row takes in a collected bucket besides its text, about: rows without text fill buckets too.
ROW_BYTES = 256
#: Bits of the fine cells from which buckets are put together once sizes are known.
CELL_BITS = 18


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard (0 to shards - 1) whose hash with the key is largest; all null keys share one."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(j), key).alias("h"), F.lit(j).alias("j")) for j in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["j"]


def sharded(docs: DataFrame, size: Column, shards: int = 8, seed: int = 20, id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with shard, slot and grown_shard (ints; slot long).

    ``size`` is the bytes of a row as buckets count them. ``slot`` numbers a shard's rows from 0
    without gaps in shuffled order. ``grown_shard`` is the shard with one shard more. Rows with
    equal or null ids go to one shard but are spread over its buckets by where they stand, so ``docs``
    must be a table or a checkpoint: it is read twice. Columns of these names are replaced. Empty
    input gives no rows.
    """
    docs = drop_existing(docs, "shard", "slot", "grown_shard")
    # the record travels as one column, so that its names clash with none of ours
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col(id_col).alias("key"), (size + ROW_BYTES).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    row = row.select("*", rendezvous(F.col("key"), shards, seed).alias("shard"), rendezvous(F.col("key"), shards + 1, seed).alias("grown"), F.xxhash64(F.lit(seed + 1), "key", "row").alias("hash"))
    row = row.drop("key").withColumn("cell", F.shiftrightunsigned("hash", 64 - CELL_BITS).cast("int"))
    cells = cut(row.groupBy("shard", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    # each shard has as many buckets as its own bytes need
    needs = {r["shard"]: max(1, -(-r["bytes"] // bucket_bytes)) for r in cells.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    buckets = F.element_at(F.array(*[F.lit(needs.get(k, 1)) for k in range(shards)]), F.col("shard") + 1)
    bucket = F.shiftright(F.col("cell").cast("long") * buckets, CELL_BITS).cast("int")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("shard", bucket.alias("bucket")).agg(F.sum("n").alias("n")).select("shard", "bucket", missing(F.sum("n").over(before), 0).alias("start"))
    starts = small_side(cut(starts))
    dealt = row.select(F.struct("hash", "row", "r", "grown").alias("one"), "shard", bucket.alias("bucket")).repartition(sum(needs.values()) or 1, "shard", "bucket")
    filled = dealt.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("one")).alias("rows")).sortWithinPartitions("shard", "bucket")
    mixed = filled.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "one"))
    out = mixed.join(starts, ["shard", "bucket"])
    return out.select(*[F.col("one.r")[c].alias(c) for c in docs.columns], F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("one.grown").cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``sharded`` with whole records: a row's size is its text's UTF-8 bytes plus 1 (null: none)."""
    return sharded(docs, missing(F.octet_length(text_col), 0) + 1, shards, seed, id_col, bucket_bytes)


def shard_digest(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard; texts are read once."""
    text = missing(F.col(text_col), "")
    narrow = cut(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    out = sharded(narrow, F.col("size"), shards, seed, id_col)
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as Parquet, one folder per shard, in slot order within files."""
    shard_documents(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
