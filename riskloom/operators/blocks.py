"""Typed blocks from rows and texts: schema inference, paragraphs, chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.dates import PATTERNS
from riskloom.functions.text import stable_id

DATE_HINTS = "date|time|year|month|period"
EMPTY = ["nan", "nat", "none", "null"]


def clean_cell(c: Column) -> Column:
    """Null for cells that say so."""
    return F.when(~F.lower(F.trim(c.cast("string"))).isin(EMPTY), c)


def is_numeric_like(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), ",", "").try_cast("double").isNotNull()


def date_like(c: Column) -> Column:
    """A date from text that looks like one; a bare year counts as its first day."""
    text = F.trim(c.cast("string"))
    looks = text.rlike(r"\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in PATTERNS))
    return F.when(looks, parsed).when(text.rlike(r"^\d{4}$"), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))


def long_cells(df: DataFrame, order: str) -> DataFrame:
    """ord, column, position, value (text): one row per non-empty cell."""
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.col(f"`{n}`").cast("string").alias("value")) for i, n in enumerate(df.columns) if n != order))
    return df.select(F.col(order).alias("ord"), F.explode(cells).alias("c")).select("ord", "c.*").filter("value IS NOT NULL AND value <> ''")


def infer_schema(df: DataFrame, order: str, sample: int = 20, share: float = 0.8) -> DataFrame:
    """column, position, semantic_type, unit, non_null_count; from each column's first non-empty values.

    The first values are a top-k per column, taken before anything is grouped.
    """
    columns = [n for n in df.columns if n != order]
    counts = df.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & (F.col(f"`{n}`").cast("string") != "")).alias(n) for n in columns))
    counts = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("non_null_count")) for n in columns))).alias("c")).select("c.*")
    first = None
    for i, n in enumerate(columns):
        c = F.col(f"`{n}`").cast("string")
        top = df.filter(c.isNotNull() & (c != "")).orderBy(order).limit(sample).select(F.lit(n).alias("column"), F.lit(i).alias("position"), c.alias("value"))
        first = top if first is None else first.unionByName(top)
    hits = first.groupBy("column", "position").agg(F.count("*").alias("n"), F.count_if(is_numeric_like(F.col("value"))).alias("numbers"), F.count(date_like(F.col("value"))).alias("dates"))
    need = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))
    kind = F.when((F.col("dates") >= need) & F.lower("column").rlike(DATE_HINTS), F.lit("date")).when(F.col("numbers") >= need, F.lit("numeric")).otherwise(F.lit("categorical_or_text"))
    unit = F.coalesce(F.nullif(F.regexp_extract("column", r"\(([^)]+)\)", 1), F.lit("")), F.nullif(F.regexp_extract("column", r"_([a-zA-Z%$]+)$", 1), F.lit("")))
    return hits.join(counts, "column").select("column", "position", kind.alias("semantic_type"), unit.alias("unit"), "non_null_count")


def infer_frequency(dates: DataFrame, date: str) -> DataFrame:
    """One row: frequency, by the upper median of the gaps of the first 20 distinct dates."""
    days = dates.select(F.col(date).cast("date").alias("d")).filter("d IS NOT NULL").distinct().orderBy("d").limit(20)
    gaps = days.agg(F.array_sort(F.collect_list("d")).alias("d"))
    gaps = gaps.select(F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size("d") - 1, F.lit(1))), lambda i: F.datediff(F.get("d", i), F.get("d", i - 1)))).alias("g"), F.size("d").alias("n"))
    m = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    name = F.when(F.col("n") < 3, F.lit(None)).when(m <= 1, F.lit("daily")).when(m.between(6, 8), F.lit("weekly")).when(m.between(27, 32), F.lit("monthly")).when(m.between(80, 100), F.lit("quarterly")).when(m.between(350, 380), F.lit("annual"))
    return gaps.select(name.alias("frequency"), F.col("n").alias("dates_used"))


def paragraph_spans(docs: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """id, paragraph_id, start_char, end_char, text: non-empty lines of at least `least` characters once trimmed.

    Offsets are running sums over a text's lines; on Arrow batches they take one pass, however many
    lines there are, and no shuffle. A null text has no paragraphs.
    """
    import pyarrow.compute as pc

    names = [id_col, "paragraph_id", "start_char", "end_char", "text"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = pc.split_pattern(part.column(1).cast(pa.large_string()), "\n")
                flat, parent = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
                n = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.cumsum(n + 1) - (n + 1)
                first = np.searchsorted(parent, parent)  # where the text of each line begins
                start = begin - begin[first] if len(n) else begin
                trimmed = pc.utf8_trim(flat, " \t\n\x0b\f\r")
                keep = np.flatnonzero(pc.utf8_length(trimmed).to_numpy(zero_copy_only=False) >= least)
                number = np.arange(len(keep)) - np.searchsorted(parent[keep], parent[keep])
                ids = part.column(0).take(pa.array(parent[keep]))
                columns = [ids, pa.array(number, pa.int32()), pa.array(start[keep], pa.int32()), pa.array((start + n)[keep], pa.int32()), trimmed.take(pa.array(keep)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, paragraph_id int, start_char int, end_char int, text string")


def chunk_ranges(paragraphs: DataFrame, id_col: str, size: int = 4) -> DataFrame:
    """id, chunk, start_paragraph, end_paragraph, start_char, end_char: groups of `size` paragraphs."""
    chunk = F.floor(F.col("paragraph_id") / size).cast("int")
    return paragraphs.groupBy(id_col, chunk.alias("chunk")).agg(F.min("paragraph_id").alias("start_paragraph"), F.max("paragraph_id").alias("end_paragraph"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))


def chunk_spans(text: str, most: int = 2500, least: int = 500) -> list[tuple[int, int]]:
    """Windows of at most `most` characters that end at a blank line if one lies far enough in."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (gap := text.rfind("\n\n", at, end)) > at + least:
            end = gap
        out.append((at, end))
        at = end
    return out


def chunk_text(docs: DataFrame, id_col: str, text_col: str, most: int = 2500) -> DataFrame:
    """id, chunk, start_char, end_char, text. Each cut depends on the one before, so this runs on Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").strip()
                kept = [(a, b, text[a:b].strip()) for a, b in chunk_spans(text, most)]
                rows += [(i, k, a, b, t) for k, (a, b, t) in enumerate(x for x in kept if x[2])]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], [id_col, "chunk", "start_char", "end_char", "text"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, chunk int, start_char int, end_char int, text string")


def within_budget(blocks: DataFrame, by: str, order: str, text: str, per_block: int, total: int) -> DataFrame:
    """The first blocks of a document whose cut texts fit a total of characters; the first one always."""
    cut = blocks.withColumn(text, F.substring(F.col(text), 1, per_block)).withColumn("truncated", F.char_length(F.col(text)) >= per_block)
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = cut.withColumns({"__used": F.sum(F.char_length(text)).over(run), "__k": F.row_number().over(Window.partitionBy(by).orderBy(order))})
    return used.filter((F.col("__used") <= total) | (F.col("__k") == 1)).drop("__used", "__k")


# ---------------------------------------------------------------- blocks of tables and series

#: Rows of a table and of a series that stand in its text.
TABLE_ROWS, SERIES_ROWS = 20, 10


def detect_time_series(df: DataFrame, order: str) -> DataFrame:
    """No row, or one: date_column, value_columns, start_date, end_date, frequency of a table that is a series.

    The first column that looks like a date and all that look numeric make it; two dates are needed.
    """
    schema = infer_schema(df, order)
    picked = schema.agg(F.min(F.when(F.col("semantic_type") == "date", F.struct("position", "column"))).alias("d"), F.array_sort(F.collect_list(F.when(F.col("semantic_type") == "numeric", F.struct("position", "column")))).alias("v"))
    cells = F.array(*(F.struct(F.lit(n).alias("c"), date_like(F.col(f"`{n}`")).alias("day")) for n in df.columns if n != order))
    days = df.select(F.explode(cells).alias("x")).select("x.c", "x.day").filter("day IS NOT NULL")
    days = days.join(F.broadcast(picked.select(F.col("d.column").alias("c"))), "c", "left_semi")
    span = days.agg(F.count("*").alias("n"), F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    one = picked.join(F.broadcast(span)).filter(F.col("d").isNotNull() & (F.size("v") > 0) & (F.col("n") >= 2))
    return one.join(F.broadcast(infer_frequency(days, "day"))).select(F.col("d.column").alias("date_column"), F.transform("v", lambda x: x["column"]).alias("value_columns"), "start_date", "end_date", "frequency")


def row_text(columns: list[str]) -> Column:
    """A row's cells as `name: value; ...`."""
    return F.concat_ws("; ", *(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("None"))) for n in columns))


def first_rows(df: DataFrame, order: str, columns: list[str], most: int, label: str) -> DataFrame:
    """One row: `lines`, the first rows as text, and `total`, how many there are."""
    top = df.orderBy(order).limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row_text(columns).alias("t")))).alias("rows"))
    lines = F.transform("rows", lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), x["t"]))
    return top.select(lines.alias("lines")).join(F.broadcast(df.agg(F.count("*").alias("total"))))


def table_block(df: DataFrame, order: str, document: str, caption: str = "") -> DataFrame:
    """A table as one block: block_id, block_type, document_id, caption, row_count, column_schema, text. Nothing for an empty table."""
    columns = [n for n in df.columns if n != order]
    schema = infer_schema(df, order).select(F.struct("position", "column", "semantic_type").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("schema"))
    rows = first_rows(df, order, columns, TABLE_ROWS, "Row").filter("total > 0").join(F.broadcast(schema))
    typed = F.concat(F.lit("Column schema: "), F.array_join(F.transform("schema", lambda s: F.concat(s["column"], F.lit("="), s["semantic_type"])), "; "))
    more = F.when(F.col("total") > TABLE_ROWS, F.array(F.concat(F.lit("... "), (F.col("total") - TABLE_ROWS).cast("string"), F.lit(" additional rows omitted")))).otherwise(F.array().cast("array<string>"))
    head = ([F.lit(f"Table caption: {caption}")] if caption else []) + [F.lit("Columns: " + ", ".join(columns)), F.concat(F.lit("Row count: "), F.col("total").cast("string")), typed]
    text = F.array_join(F.concat(F.array(*head), F.col("lines"), more), "\n")
    return rows.select(
        stable_id("blk_", F.lit(document), F.lit("table"), F.lit(caption), F.lit(",".join(columns)), F.col("total")).alias("block_id"), F.lit("table").alias("block_type"), F.lit(document).alias("document_id"), F.lit(caption).alias("caption"),
        F.col("total").alias("row_count"), F.array_join(F.transform("schema", lambda s: F.concat(s["column"], F.lit("="), s["semantic_type"])), ";").alias("column_schema"), text.alias("text"),
    )


def series_block(df: DataFrame, order: str, document: str, instrument: str = "tabular_time_series") -> DataFrame:
    """The series that a table holds as one block, or nothing: block_id, block_type, document_id, instrument, dates, frequency, text."""
    columns = [n for n in df.columns if n != order]
    found = detect_time_series(df, order)
    rows = found.join(F.broadcast(first_rows(df, order, columns, SERIES_ROWS, "Observation")))
    fields = F.concat(F.array("date_column"), F.col("value_columns"))
    head = F.array(
        F.lit(f"Time series instrument: {instrument}"), F.concat(F.lit("Fields: "), F.array_join(fields, ", ")), F.concat(F.lit("Date field: "), F.col("date_column")),
        F.concat(F.lit("Value fields: "), F.array_join("value_columns", ", ")), F.concat(F.lit("Frequency: "), F.col("frequency")), F.concat(F.lit("Date range: "), F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string")),
    )
    more = F.when(F.col("total") > SERIES_ROWS, F.array(F.concat(F.lit("... "), (F.col("total") - SERIES_ROWS).cast("string"), F.lit(" additional observations omitted")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), F.col("lines"), more), "\n")
    return rows.select(
        stable_id("blk_", F.lit(document), F.lit("time_series"), F.col("date_column"), F.array_join("value_columns", ","), F.col("total")).alias("block_id"), F.lit("time_series").alias("block_type"), F.lit(document).alias("document_id"),
        F.lit(instrument).alias("instrument"), "date_column", "value_columns", "start_date", "end_date", "frequency", F.col("total").alias("observation_count"), text.alias("text"),
    )


def table_blocks(df: DataFrame, order: str, document: str, caption: str = "") -> DataFrame:
    """block_id, block_type, document_id, text: the table's block, and its series' if it is one."""
    keep = ["block_id", "block_type", "document_id", "text"]
    return table_block(df, order, document, caption).select(keep).unionByName(series_block(df, order, document, caption or "tabular_time_series").select(keep))


def chart_text(title: Column, description: Column, data: Column, image: Column) -> Column:
    """A chart's parts as lines; those that are empty are left out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Chart title", title), line("Description", description), line("Extracted data", data), line("Image reference", image))


def payload(blocks: DataFrame, most: int) -> DataFrame:
    """evidence_id, block_type, document_id, text (cut), truncated: what a prompt gets of each block."""
    return blocks.select(F.col("block_id").alias("evidence_id"), "block_type", "document_id", F.substring("text", 1, most).alias("text"), (F.char_length("text") > most).alias("truncated"))


def manifest(blocks: DataFrame) -> DataFrame:
    """evidence_id, document_id, block_type: one row per block, without its text."""
    return blocks.select(F.col("block_id").alias("evidence_id"), "document_id", "block_type").dropDuplicates(["evidence_id"])


def with_text(evidence: DataFrame, url: str) -> DataFrame:
    """Evidence whose text is more than blanks, trimmed, with the given URL where it has none."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return evidence.withColumns({"text": text, "source_url": F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.lit(url))}).filter("text <> ''")


def tiles(ranges: DataFrame, totals: DataFrame, id_col: str) -> DataFrame:
    """id, problem: null where ranges (id, start_paragraph, end_paragraph) cover a document's paragraphs once and in order."""
    before = F.lag("end_paragraph").over(Window.partitionBy(id_col).orderBy("start_paragraph", "end_paragraph"))
    rows = ranges.withColumn("gap", F.col("start_paragraph") != F.coalesce(before + 1, F.lit(0))).join(totals.select(id_col, "paragraphs"), id_col)
    out = (F.col("start_paragraph") < 0) | (F.col("start_paragraph") > F.col("end_paragraph")) | (F.col("end_paragraph") >= F.col("paragraphs"))
    rows = rows.groupBy(id_col).agg(F.max(out).alias("out"), F.max("gap").alias("gap"), (F.max("end_paragraph") + 1 != F.max("paragraphs")).alias("short"))
    problem = F.when(F.col("out"), F.lit("out of bounds")).when(F.col("gap"), F.lit("not contiguous")).when(F.col("short"), F.lit("not covered"))
    every = totals.select(id_col, "paragraphs").join(rows, id_col, "left")
    return every.select(id_col, F.when(F.col("out").isNull() & (F.col("paragraphs") > 0), F.lit("not covered")).otherwise(problem).alias("problem"))
