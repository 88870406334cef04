"""Readers and writers, on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import END, START
from panelloom.functions import calendar as cal
from panelloom.functions.numbers import fixed_decimals
from panelloom.plans import climate
from panelloom.plans import tables as tb
from panelloom.schema import LONG_PANEL
from panelloom.session import scratch_path
from panelloom.sources import readers, writers


@query("S1 S9", f"SELECT CAST(entity AS VARCHAR) AS entity, period_idx, {rnd('value', 4)} AS value FROM monthly")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    panel = tb.monthly_values(spark, sf).select(F.col("entity").cast("string"), "period_idx", "value")
    writers.write_csv(panel, path)
    return rounded(readers.read_csv(spark, path, LONG_PANEL), 4, "value")


@query(
    "S2 S10 S11 D8",
    f"""SELECT norm_years, entity, period_idx, {rnd('temp', 6)} AS temp, {rnd('mean_temp', 6)} AS mean_temp
    FROM temp_anomalies WHERE norm_years = 2""",
)
def sheet_by_norm(spark, sf):
    path = scratch_path(spark, "norms")
    index = tb.shipments(spark, sf).select("entity", "period_idx", "temp")
    norms = climate.all_norms(index, ["entity"], ["temp"], tb.NORMS, START, END)
    writers.write_by_key(norms.select("norm_years", "entity", "period_idx", "temp", "mean_temp"), path)
    sheet = readers.read_sheet(spark, path, "norm_years", 2)
    return rounded(sheet.select("norm_years", "entity", "period_idx", "temp", "mean_temp"), 6, "temp", "mean_temp")


@query(
    "S3 S10",
    f"""SELECT norm_years, entity, period_idx, {rnd('deviation_temp', 6)} AS deviation_temp FROM temp_anomalies""",
)
def all_sheets(spark, sf):
    path = scratch_path(spark, "norms")
    index = tb.shipments(spark, sf).select("entity", "period_idx", "temp")
    norms = climate.all_norms(index, ["entity"], ["temp"], tb.NORMS, START, END)
    writers.write_results(norms.select("norm_years", "entity", "period_idx", "deviation_temp"), path)
    sheets = readers.read_all_sheets(spark, path)
    return rounded(sheets.select("norm_years", "entity", "period_idx", "deviation_temp"), 6, "deviation_temp")


def _census_report(spark, sf):
    """Customers by nation and segment as a report sheet: preamble, header row, subtotals, a grand total."""
    counts = tb.read(spark, sf, "customer").join(
        tb.regions(spark, sf), F.col("c_nationkey") == F.col("entity")
    )
    text = lambda c: c.cast("string")
    name = F.format_string("%02d %s", "entity", "n_name")
    by_segment = counts.groupBy(name.alias("c0"), F.col("c_mktsegment").alias("c1"), F.lit("Total").alias("c2"))
    totals = counts.groupBy(name.alias("c0"), F.lit("Total").alias("c1"), F.lit("Total").alias("c2"))
    grand = counts.groupBy(F.lit("All Nations").alias("c0"), F.lit("Total").alias("c1"), F.lit("Total").alias("c2"))
    n = text(F.count(F.lit(1))).alias("c3")
    preamble = [("Census", None, None, None), (None, None, None, None), ("Área Geográfica", "Grupo", "Sexo", "Población")]
    sheet = spark.createDataFrame(preamble, "c0 string, c1 string, c2 string, c3 string")
    for part in (by_segment, totals, grand):
        sheet = sheet.unionByName(part.agg(n))
    return sheet


@query(
    "S4 D2 P5 A6 F1 F19",
    f"""SELECT n_name AS entity, {rnd('population / 1e6', 6)} AS population, {rnd('weight', 6)} AS weight FROM weighted""",
)
def report_sheet(spark, sf):
    from panelloom.functions.names import strip_code_prefix

    sheet = _census_report(spark, sf)
    report = readers.normalise_report(
        sheet, F.col("c0").rlike(r"^[0-9]{2}\s"), F.col("c0") == "Área Geográfica"
    )
    report = report.withColumn("area_geografica", strip_code_prefix(F.col("area_geografica")))
    is_entity = (F.col("grupo") == "Total") & (F.col("sexo") == "Total")
    weights = climate.population_weights(report, is_entity, "area_geografica", "poblacion")
    return rounded(weights, 6, "population", "weight")


@query("S5", f"SELECT CAST(entity AS VARCHAR) AS code, period_idx, {rnd('value', 4)} AS value FROM monthly")
def json_series_explode(spark, sf):
    month = F.date_format(cal.period_start(F.col("period_idx"), 12), "yyyy-MM")
    # One document per nation, at most one entry per month of the calendar.
    series = tb.monthly_values(spark, sf).groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct(month, "value"))).alias("series")
    )
    document = F.to_json(F.struct(F.create_map(F.col("entity").cast("string"), "series").alias("data")))
    rows = readers.series_from_json(series.select(document.alias("value")))
    return rounded(rows, 4, "value")


@query("S6 F2", "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def json_code_names(spark, sf):
    names = tb.regions(spark, sf).groupBy("r_regionkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("entity").cast("string"), "n_name"))).alias("names")
    )
    nested = F.create_map(F.lit("ALL"), F.create_map(F.lit("S"), "names"))
    documents = names.select(F.to_json(F.struct(nested.alias("country"))).alias("value"))
    return readers.codes_from_json(documents, "ALL", "S")


@query(
    "S5 F24",
    """SELECT event_id, 'k' AS key, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS value FROM events""",
)
def json_map_explode(spark, sf):
    return readers.json_cells(tb.read(spark, sf, "events"), ["event_id"], "props", "int")


# Lines of a text table that are hard to read: a name that ends in a number, a first month that is no number in two
# ways, and a line without its last month and total.
_ODD_NAME, _NO_DATA, _DASH, _SHORT = range(4)
_YEAR_PATH = r"year=(\d{4})/"


def _month_text(spark, sf) -> str:
    """Yearly text tables, one file a year and one line per nation, written to the shared folder."""
    panel = tb.monthly_panel(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))
    odd, january = F.col("entity") % 5, F.col("period_idx") % 12 == 0
    letters = F.translate(F.col("entity").cast("string"), "0123456789", "abcdefghij")
    name = F.when(odd == _ODD_NAME, F.concat(F.lit("Zona "), "entity")).otherwise(F.concat(F.lit("Nation   "), letters))
    cell = F.when(january & (odd == _NO_DATA), "n/d").when(january & (odd == _DASH), "-").otherwise(fixed_decimals(F.col("value"), 1))
    month = F.struct(F.col("period_idx"), cell.alias("text"))
    # Twelve months at most per line.
    years = panel.groupBy(name.alias("name"), odd.alias("odd"), cal.year_of(F.col("period_idx"), 12).alias("year")).agg(
        F.array_sort(F.collect_list(month)).alias("months"), F.sum("value").alias("total")
    )
    cells = F.concat(F.transform("months", lambda m: m["text"]), F.array(fixed_decimals(F.col("total"), 1)))
    shown = F.when(F.col("odd") == _SHORT, F.slice(cells, 1, F.size(cells) - 2)).otherwise(cells)
    lines = years.select("year", F.concat_ws("     ", F.concat(F.lit("  "), "name"), F.concat_ws("   ", shown)).alias("value"))
    each = years.groupBy("year").agg(F.max(F.size("months")).alias("n"))
    labels = F.concat_ws("  ", F.slice(F.array(*[F.lit(m) for m in cal.MONTH_ABBREVIATIONS]), 1, F.col("n")))
    header = each.select("year", F.concat_ws("  ", F.lit("Entidad"), labels, F.lit("Anual")).alias("value"))
    notes = each.select("year", F.lit("Temperatura media por entidad").alias("value"))
    path = scratch_path(spark, "text")
    # A year's lines come from one task, so they are one file.
    lines.unionByName(header).unionByName(notes).repartition("year").write.partitionBy("year").text(path)
    return path


@query(
    "S7 S8 F19",
    f"""SELECT CASE WHEN entity % 5 = {_ODD_NAME} THEN 'Zona ' || entity ELSE 'Nation ' || translate(CAST(entity AS VARCHAR), '0123456789', 'abcdefghij') END AS entity, period_idx,
    CASE WHEN period_idx % 12 = 0 AND entity % 5 IN ({_NO_DATA}, {_DASH}) THEN NULL
      WHEN entity % 5 = {_SHORT} AND (period_idx % 12 = 11 OR period_idx = {END}) THEN NULL
      ELSE {rnd('coalesce(value, 0.0)', 1)} END AS value FROM spine""",
)
def fixed_text_rows(spark, sf):
    return rounded(readers.read_month_text(spark, _month_text(spark, sf) + "/*", _YEAR_PATH), 1, "value")


@query(
    "S7",
    "SELECT 'Temperatura media por entidad' AS line, CAST(count(DISTINCT period_idx // 12) AS BIGINT) AS n FROM calendar",
)
def unread_text_lines(spark, sf):
    lines = readers.text_lines(spark, _month_text(spark, sf) + "/*")
    return readers.unread_lines(lines, year=_YEAR_PATH).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S8 S13 R1",
    f"SELECT CAST(entity AS VARCHAR) AS entity, period_idx, {rnd('value', 4)} AS value FROM spine WHERE period_idx BETWEEN {START + 12} AND {START + 35}",
)
def wide_months_by_range(spark, sf):
    """A wide file with one column per month, unpivoted and cut to two years."""
    months = [f"{i // 12}-{i % 12 + 1:02d}" for i in range(START, END + 1)]
    label = F.date_format(cal.period_start(F.col("period_idx"), 12), "yyyy-MM")
    wide = (
        tb.monthly_panel(spark, sf)
        .withColumn("month", label)
        .groupBy(F.col("entity").cast("string").alias("entity"))
        .pivot("month", months)
        .agg(F.first("value"))
    )
    long = readers.wide_months_to_long(wide)
    return rounded(readers.months_between(long, START + 12, START + 35), 4, "value")
