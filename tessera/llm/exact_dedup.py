"""Exact deduplication with an extendible-hash index on shared files.

Every row becomes an index entry (64-bit key, SHA-256, length). The directory begins with one
bucket and doubles as long as a bucket is overfull; each doubling splits the overfull ones by one
more leading bit of the key. A bucket is a range of keys; owner tasks take ranges of buckets
and keep the entries of one key as a chain. Rows find their entry by bucket and chain, and
are compared byte by byte with its head; what differs is grouped anew by its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, broadcast_if, discard, materialize, row_key, small, table, text_or_empty

KEY = ["key", "sha", "n_bytes"]
#: Distinct texts that a bucket holds before it is split.
CAPACITY = 1 << 14
#: Keys of several rows, and the directory, are broadcast up to so many rows (some 25 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def directory(groups: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """slot (leading max_depth bits of a key), bucket (first slot of its range), local_depth. At most 2**max_depth rows.

    Doubled until no bucket has more than ``capacity`` entries or max_depth is reached. The rounds
    work on the counts of the slots, not on the entries.
    """
    slots = groups.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    leaves = materialize(slots.select("slot", "n", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("local_depth")), "dedup-slots")
    for depth in range(1, max_depth + 1):
        overfull = materialize(leaves.groupBy("bucket").agg(F.sum("n").alias("filled")).filter(F.col("filled") > capacity).select("bucket", F.lit(True).alias("overfull")), "dedup-overfull")
        if overfull.isEmpty():
            break
        half = F.expr(f"shiftleft(shiftright(slot, {max_depth - depth}), {max_depth - depth})")
        split = leaves.join(broadcast_if(overfull, BROADCAST_ROWS), "bucket", "left")
        before = leaves
        leaves = materialize(split.select("slot", "n", F.when(F.col("overfull"), half).otherwise(F.col("bucket")).alias("bucket"), F.when(F.col("overfull"), depth).otherwise(F.col("local_depth")).alias("local_depth")), "dedup-directory")
        discard(before, overfull)
    return leaves.drop("n")


def routed(rows: DataFrame, leaves: DataFrame, max_depth: int) -> DataFrame:
    """rows with the bucket of their key."""
    slots = broadcast_if(leaves.select("slot", "bucket"), BROADCAST_ROWS)
    return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - max_depth)).join(slots, "slot").drop("slot")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with keys and buckets, lazily; entries on shared files; index on shared files).

    The index has a row per distinct key, digest and length: bucket, chain (place in its key's
    chain), keep_id, size. Copies are counted before the shuffle, so a group of any size arrives as
    one entry per map task; then a file holds a range of buckets, written by its owner task.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), ascii_lower(text_or_empty(text_col)).alias("norm")).select(
        "doc_id", "row", "norm", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes")
    )
    entries = materialize(keyed.drop("norm"), "dedup-entries")
    groups = materialize(entries.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")), "dedup-groups")
    max_depth = min(26, (groups.count() // capacity).bit_length() + 3)  # deeper than an even spread needs
    leaves = directory(groups, capacity, max_depth)
    chain = Window.partitionBy("bucket", "key").orderBy("sha", "n_bytes")
    index = routed(groups, leaves, max_depth).repartitionByRange("bucket").withColumn("chain", F.row_number().over(chain))
    index = materialize(index.sortWithinPartitions("bucket", "key", "chain"), "dedup-index")
    return routed(keyed, leaves, max_depth), routed(entries, leaves, max_depth), index


def collisions(keyed: DataFrame, index: DataFrame, salt_rows: int = 4096) -> DataFrame:
    """Rows whose bytes differ from the head of their chain entry: doc_id, the key columns and norm.

    Only entries of two rows or more are looked at, and only their texts are shuffled. A large entry is dealt over as many
    salts as it has thousands of rows, so no task compares more than a few of them.
    """
    multi = index.filter("size > 1").select("bucket", *KEY, "keep_id", F.ceil(F.col("size") / salt_rows).cast("int").alias("salts"))
    multi = materialize(multi, "dedup-multi")
    wanted = F.broadcast(multi.select("bucket", "key").distinct()) if small(multi, BROADCAST_ROWS) else multi.select("bucket", "key").distinct()
    members = materialize(keyed.join(wanted, ["bucket", "key"], "left_semi").join(multi, ["bucket", *KEY]).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), "salts").cast("int")), "dedup-members")
    heads = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(KEY)
    heads = heads.select("bucket", *KEY, F.col("norm").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return members.join(heads, ["bucket", *KEY, "salt"]).filter("norm <> head").select("doc_id", *KEY, "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row (common.row_key()).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the largest doc_id stays. Null ids never win against others; rows that repeat the
    winning id are all marked kept. An empty table gives an empty result. Other columns are
    not looked at.
    """
    keyed, entries, index = build_index(docs, id_col, text_col, capacity)
    odd = materialize(collisions(keyed, index), "dedup-collisions")
    multi = materialize(index.filter("size > 1").select("bucket", *KEY, "keep_id", "size"), "dedup-owners")
    rows = entries.join(broadcast_if(multi, BROADCAST_ROWS // 4), ["bucket", *KEY], "left")
    size, keep = F.coalesce("size", F.lit(1)), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    if not odd.isEmpty():
        split = odd.groupBy(*KEY, "norm").agg(F.max("doc_id").alias("odd_keep"), F.count(F.lit(1)).alias("odd_size"))
        again = odd.join(split, [*KEY, "norm"]).dropDuplicates(["doc_id", *KEY]).select("doc_id", *KEY, "odd_keep", "odd_size")
        rows = rows.join(odd.groupBy(*KEY).agg(F.count(F.lit(1)).alias("gone")), KEY, "left").join(again, ["doc_id", *KEY], "left")
        size = F.coalesce("odd_size", F.col("size") - F.coalesce("gone", F.lit(0)), F.lit(1))
        keep = F.when(F.col("odd_size").isNotNull(), F.col("odd_keep")).otherwise(keep)
    return rows.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), "row")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": SQL}
