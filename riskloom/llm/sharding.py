"""Sharding by extendible hashing, with DataFrame functions only.

A shard is a prefix of the bits of a row's 64-bit hash. The directory starts at one bucket;
a bucket above the byte limit splits on the next bit, and no other bucket does, until each
fits or holds a single row. Bytes are summed once over cells of `step` bits (a bounded table);
only cells that are still too large are summed again with more bits.

Defined results: a null text counts no bytes; rows with the same hash (the same id) can't be
told apart by bits and, beyond the limit, go to overflow pages of the same bucket, each of which fits
the limit; they are numbered within blocks of BLOCK rows, so that no task orders all rows of one id. A
single row above the limit has a shard of its own; an empty table gives no rows. Only the id and
the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stash


def hash_bits(key: Column) -> Column:
    """The first 64 bits of the key's MD5 as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _depths(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell (the first `high` bits), depth of its leaf between low and high, open (still too large)."""
    cells = rows.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    nodes = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    nodes = nodes.withColumn("node", F.expr(f"shiftrightunsigned(cell, {high} - depth)"))
    large = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("b"), F.sum("n").alias("m"))
    large = large.filter((F.col("b") > limit) & (F.col("m") > 1)).select("depth", "node", F.lit(True).alias("is_large"))
    leaf = nodes.join(large, ["depth", "node"], "left").groupBy("cell")
    leaf = leaf.agg(F.max(F.when(F.col("is_large"), F.col("depth"))).alias("deepest"))
    return leaf.select("cell", (F.coalesce("deepest", F.lit(low - 1)) + 1).alias("depth"), (F.coalesce("deepest", F.lit(-1)) == high).alias("open"))


#: Rows of one hash that are put on pages together.
BLOCK = 1 << 16


def _pages(limit: int) -> Column:
    """A page for each row of an overflowing hash: rows above half the limit have one each, of others each half limit of bytes begins one."""
    block, small = F.floor(F.col("row") / BLOCK), F.col("bytes") * 2 <= limit
    before = F.sum("bytes").over(Window.partitionBy("h", block, small).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(before, F.lit(0)) * 2 / limit)
    return F.when(small, F.concat_ws("-", block, number)).otherwise(F.concat(F.lit("r"), F.col("row")))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int | None = None) -> DataFrame:
    """One row per input row: id_col, shard_id (its bits, with .page for overflow pages), local_depth, n_bytes.

    step: bits that one pass over the rows resolves; by default as many as the corpus needs
    if it were even, and four more.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"))
    rows = stash(rows.withColumns({"h": hash_bits(F.col("id")), "row": F.monotonically_increasing_id()}), "sizes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    step = step or min(24, 4 + max(1, math.ceil(math.log2(1 + total / limit))))
    low, high, rest, found = 0, min(64, step), rows, []
    while True:
        depths = stash(_depths(rest, low, high, limit), "directory")
        placed = rest.withColumn("cell", _prefix(F.col("h"), high)).join(depths, "cell")
        found.append(placed.filter(~F.col("open")).select("id", "bytes", "h", "depth", F.lit(None).cast("string").alias("page")))
        rest = placed.filter("open").select("id", "bytes", "h", "row")
        if depths.filter("open").isEmpty():
            break
        if high == 64:
            found.append(rest.select("id", "bytes", "h", F.lit(64).alias("depth"), _pages(limit).alias("page")))
            break
        low, high = high + 1, min(64, high + step)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    bits = F.expr("substring(lpad(bin(h), 64, '0'), 1, depth)")
    return out.select(
        F.col("id").alias(id_col),
        F.concat(F.lit("s"), bits, F.coalesce(F.concat(F.lit("."), F.col("page")), F.lit(""))).alias("shard_id"),
        F.col("depth").cast("int").alias("local_depth"),
        F.col("bytes").alias("n_bytes"),
    )
