"""Investigation memory: the last turns of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import compact


def last_turns(turns: DataFrame, by: str, order: str, role: str, text: str, n: int = 5) -> DataFrame:
    """by, turns, prior_questions, prior_answers, summary from the last n turns, cut to 300 and 500 characters."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(text)))
    rows = turns.withColumn("__r", rank).filter(F.col("__r") <= n)
    texts = lambda who, most: F.transform(F.array_sort(F.collect_list(F.when(F.col(role) == who, F.struct((-F.col("__r")).alias("k"), compact(F.col(text), most).alias("t"))))), lambda x: x["t"])
    out = rows.groupBy(by).agg(F.count("*").alias("turns"), texts("user", 300).alias("prior_questions"), texts("assistant", 500).alias("prior_answers"))
    recent = F.slice("prior_questions", F.greatest(F.lit(1), F.size("prior_questions") - 2), 3)
    summary = F.when(F.size("prior_questions") > 0, F.concat(F.lit("Prior questions: "), F.concat_ws("; ", recent))).otherwise(F.lit("No prior investigation history supplied."))
    return out.select(by, "turns", F.size("prior_questions").alias("n_questions"), F.size("prior_answers").alias("n_answers"), summary.alias("summary"))
