"""Exact deduplication with a heavy-hitter split.

Digests that a Misra-Gries summary finds frequent are verified by exact counts; their winners
(at most 1/support rows) are broadcast, so their copies are decided where they are read. All
other digests, none of which can hold more than a `support` share of the rows, are shuffled:
their winners are aggregated with partial sums and joined back, which AQE may split.
DataFrame functions only.

Defined results: a null text is the empty text; all empty texts are equal; of rows that tie in
code points the smallest id stays, null ids last; of rows repeated with the same id exactly one
stays; texts of any length are read whole; an empty table gives no rows. `decide` reads only the
id and the text; `deduplicated` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, free, stash, unused

#: Misra-Gries counters are 1/SUPPORT: every digest on more than this share of the rows is found.
SUPPORT = 1 / 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("n"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        row.alias("row"),
    )


def _rank() -> Column:
    """Largest wins: most code points, an id at all, smallest id, first row."""
    return F.struct(F.col("n"), F.col("id").isNotNull(), (-F.col("id")).alias("neg_id"), (-F.col("row")).alias("neg_row"), F.col("id").alias("id"), F.col("row").alias("row"))


def frequent(rows: DataFrame, support: float) -> DataFrame:
    """digest: those that the summary finds on more than a `support` share of the rows, and perhaps some more."""
    found = rows.select(F.hex("digest").alias("h")).stat.freqItems(["h"], support).first()[0] or []
    return rows.sparkSession.createDataFrame([(h,) for h in found], "h string").select(F.unhex("h").alias("digest"))


def heavy_winners(rows: DataFrame, support: float, total: int) -> DataFrame:
    """digest, group_size, best for each digest on more than support * total rows."""
    exact = rows.join(F.broadcast(frequent(rows, support)), "digest", "left_semi").groupBy("digest")
    exact = exact.agg(F.count("*").alias("group_size"), F.max(_rank()).alias("best"))
    return exact.filter(F.col("group_size") > F.lit(max(1.0, support * total)))


def decisions(digested: DataFrame, support: float) -> DataFrame:
    """One row per digested row: row, id, keep_id, group_size, kept, digest."""
    rows = stash(digested, "digests")
    heavy = stash(heavy_winners(rows, support, rows.count()), "winners")  # at most 1/support rows
    known = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    light = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(_rank()).alias("best"))
    every = known.unionByName(rest.join(light, "digest"))
    kept = (F.col("row") == F.col("best.row")).alias("kept")
    return every.select("row", "id", F.col("best.id").alias("keep_id"), "group_size", kept, "digest")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = decisions(digests(docs, id_col, text_col, F.monotonically_increasing_id()), support)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _tally(rows: DataFrame) -> DataFrame:
    """digest, size, best (n, id) and how many rows are like the best one: ties."""
    alike = rows.groupBy("digest", "n", "id").agg(F.count("*").alias("c"))
    best = F.max(F.struct(F.col("n"), F.col("id").isNotNull(), (-F.col("id")).alias("neg_id"), F.col("id").alias("id"), F.col("c").alias("c"))).alias("best")
    out = alike.groupBy("digest").agg(F.sum("c").alias("size"), best)
    return out.select("digest", "size", F.col("best.n").alias("n"), F.col("best.id").alias("id"), F.col("best.c").alias("ties"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each digest, whatever ids repeat or are null.

    Winners are known by digest, length and id, so no row is written or numbered; where several rows
    are the same in all three, one of them stays.
    """
    rows = stash(digests(docs, id_col, text_col, F.lit(0)).drop("row"), "digests")
    total = rows.count()
    counted = _tally(rows.join(F.broadcast(frequent(rows, support)), "digest", "left_semi"))
    heavy = stash(counted.filter(F.col("size") > F.lit(max(1.0, support * total))), "winners")  # at most 1/support rows
    light = stash(_tally(rows.join(F.broadcast(heavy), "digest", "left_anti")).filter("size > 1"), "groups")
    own = unused(docs, "digest")
    out = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)))
    length, tied = F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)), F.lit(1)
    n_light, repeats = light.count(), not heavy.unionByName(light).filter("ties > 1").isEmpty()
    for winners, small in ((heavy, True), (light, n_light * 64 <= BROADCAST_BYTES)):
        k = unused(out, "winner")
        w = winners.select(F.col("digest").alias(own), F.struct("n", "id", "ties").alias(k))
        out = out.join(F.broadcast(w) if small else w, own, "left")
        out = out.filter(F.col(k).isNull() | ((F.col(f"{k}.n") == length) & F.col(f"{k}.id").eqNullSafe(F.col(f"`{id_col}`"))))
        tied = F.greatest(tied, F.coalesce(F.col(f"{k}.ties"), F.lit(1)))
    if repeats:
        several = unused(out, "tied")
        out = out.withColumn(several, tied > 1)
        out = out.filter(~F.col(several)).unionByName(out.filter(F.col(several)).dropDuplicates([own]))
    free(rows)
    return out.select([F.col(f"`{c}`") for c in docs.columns])
