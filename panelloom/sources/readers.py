"""Landed files to long tables ``(entity, period_idx, value)``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelloom.functions import calendar as cal
from panelloom.functions.names import clean_headers, repair_mojibake, squish
from panelloom.functions.numbers import to_number


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered UTF-8 CSV with a declared schema; a header that differs from it is an error."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", escape='"')


def read_sheet(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """One table of a partitioned store; only its folder is scanned."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


def read_all_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All tables of a partitioned store, the table's name as a column."""
    return spark.read.parquet(path)


def normalise_report(sheet: DataFrame, is_data: Column, is_header: Column) -> DataFrame:
    """Drop the preamble of a report sheet and promote its header row to column names.

    Header and data rows are told by predicates, since row order means nothing in a distributed scan. One row, the
    header, is read to name the columns; a sheet without one, or with several, is an error.
    """
    headers = sheet.where(is_header).distinct().take(2)
    if len(headers) != 1:
        raise ValueError(f"the sheet has {'no' if not headers else 'more than one'} header row")
    named = sheet.where(is_data).toDF(*[f"c{i}" if h is None else str(h) for i, h in enumerate(headers[0])])
    return clean_headers(named)


def series_from_json(documents: DataFrame, text: str = "value") -> DataFrame:
    """``{"data": {code: {"YYYY-MM": number}}}`` documents to rows ``(code, period_idx, value)``."""
    parsed = F.from_json(text, "data map<string, map<string, double>>")
    by_code = documents.select(F.explode(parsed["data"]).alias("code", "series"))
    by_month = by_code.select("code", F.explode("series").alias("month", "value"))
    return by_month.select("code", cal.parse_month(F.col("month")).alias("period_idx"), "value")


def codes_from_json(documents: DataFrame, country: str, group: str, text: str = "value") -> DataFrame:
    """``{"country": {country: {group: {code: name}}}}`` documents to rows ``(code, name)``."""
    parsed = F.from_json(text, "country map<string, map<string, map<string, string>>>")
    names = parsed["country"].getItem(country).getItem(group)
    rows = documents.select(F.explode(names).alias("code", "name"))
    return rows.select("code", squish(repair_mojibake(F.col("name"))).alias("name"))


def json_cells(df: DataFrame, keys: list[str], cell: str, value_type: str = "double") -> DataFrame:
    """One row per entry of a flat JSON object cell."""
    entries = F.from_json(cell, f"map<string, {value_type}>")
    return df.select(*keys, F.explode(entries).alias("key", "value"))


# Marks that stand for a missing number.
MISSING = ("-", "--", "n/d", "N/D", "s/d", "S/D", "ND", "NA", "N/A", "*")


def _month_lines(lines: DataFrame, line: str, file: str, year: str) -> DataFrame:
    """Each line that is not empty with its file's header (``months``, ``full``: its cells with the total) and its cells.

    A line ends in cells, no more of them than its file's header names, so what stands before those is its name,
    whatever it holds. More than half of the cells are numbers or marks of missing ones, and there are at least two.
    """
    cells = lines.select(
        F.col(file).alias("file"), F.regexp_extract(file, year, 1).try_cast("int").alias("year"), squish(F.col(line)).alias("line")
    ).where("line <> ''")
    words = cells.withColumn("words", F.split("line", " "))
    is_month = lambda word: cal.month_number(word).isNotNull()
    labels = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    named = words.withColumn("months", F.filter(labels, is_month)).withColumn("full", F.size(labels))
    heads = is_month(F.get("words", F.lit(1))) & (F.col("full") - F.size("months")).isin(0, 1)
    marked = named.withColumn("is_header", F.coalesce(heads, F.lit(False)))
    # One header per file: the one of most months, so the join adds no rows.
    headers = marked.where("is_header").groupBy(F.col("file").alias("_file")).agg(
        F.max(F.struct(F.size("months"), "full", "months")).alias("_head")
    )
    body = marked.where("NOT is_header").drop("months", "full").join(headers, F.expr("file = _file"), "left")
    body = body.selectExpr("file", "year", "line", "words", "_head.months AS months", "_head.full AS full")
    # Cells begin with the first number or mark behind the first word, at most as many as the header has.
    is_cell = lambda word: word.rlike(r"^[-+]?[0-9][0-9.,]*$") | word.isin(*MISSING)
    first = F.array_position(F.transform(F.slice("words", 2, F.size("words")), is_cell), True).cast("int")
    taken = body.withColumn("taken", F.when(first > 0, F.least(F.size("words") - first, F.col("full"))))
    found = F.size(F.filter(F.slice("words", F.size("words") - F.col("taken") + 1, F.col("taken")), is_cell))
    return taken.withColumn("readable", (2 * found > F.col("taken")) & (F.col("taken") >= F.least(F.lit(2), F.col("full"))) & F.col("year").isNotNull())


FILE_YEAR = r"(\d{4})[^/]*$"


def month_table_from_text(lines: DataFrame, line: str = "value", file: str = "file", year: str = FILE_YEAR) -> DataFrame:
    """Yearly text tables to rows ``(entity, period_idx, value)``, one for each month of the file's header.

    A file holds one year, which the pattern ``year`` finds in its path. Its header line is a name and month
    abbreviations, at most followed by a yearly total; a data line is a name and cells. Cells that are no number and
    those that a short line lacks are NULL. Lines that cannot be read so are in ``unread_lines``.
    """
    rows = _month_lines(lines, line, file, year).where("readable")
    rows = rows.selectExpr(
        "year", "concat_ws(' ', slice(words, 1, size(words) - taken)) AS entity",
        "slice(words, size(words) - taken + 1, taken) AS cells", "posexplode(months) AS (pos, month)",
    )
    number = to_number(F.get("cells", F.col("pos")))
    return rows.select("entity", (F.col("year") * 12 + cal.month_number(F.col("month")) - 1).cast("int").alias("period_idx"), number.alias("value"))


def unread_lines(lines: DataFrame, line: str = "value", file: str = "file", year: str = FILE_YEAR) -> DataFrame:
    """``file, line`` of the lines that ``month_table_from_text`` cannot read: titles, notes, lines without a header."""
    return _month_lines(lines, line, file, year).where("NOT coalesce(readable, false)").select("file", "line")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all text files below ``path`` with the path of their file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_month_text(spark: SparkSession, path: str, year: str = FILE_YEAR) -> DataFrame:
    """All yearly text files below ``path`` in one scan; long rows, so the years need no join."""
    return month_table_from_text(text_lines(spark, path), year=year)


def wide_months_to_long(wide: DataFrame, entity: str = "entity") -> DataFrame:
    """A table with one ``YYYY-MM`` column per month to long rows; the names become indices once, not per row."""
    months = {c: int(c[:4]) * 12 + int(c[5:]) - 1 for c in wide.columns if re.fullmatch(r"\d{4}-\d{1,2}", c)}
    cells = F.array(
        *[F.struct(F.lit(i).alias("period_idx"), F.col(f"`{c}`").cast("double").alias("value")) for c, i in months.items()]
    )
    return wide.select(F.col(entity).alias("entity"), F.inline(cells))


def months_between(panel: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Rows of a closed month range; plain comparisons, so they reach the Parquet scan."""
    if first is not None:
        panel = panel.where(F.col("period_idx") >= first)
    if last is not None:
        panel = panel.where(F.col("period_idx") <= last)
    return panel
