"""Scalar expressions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd
from panelloom.catalogue.sql import SEASON
from panelloom.config import LONG_RUN_CUTOFFS, PROJECTION_CUTOFFS
from panelloom.functions import calendar as cal
from panelloom.functions import names, numbers
from panelloom.plans import tables as tb

# DuckDB's own list of accents; letters that it leaves alone are spelled out.
_FOLD = "strip_accents(text)"
for _letter, _plain in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i")):
    _FOLD = f"replace({_FOLD}, '{_letter}', '{_plain}')"


@query(
    "F1 F2 F4",
    f"""SELECT doc_id, length(folded) AS n_folded, md5(folded) AS folded_md5 FROM (
      SELECT doc_id, trim(regexp_replace({_FOLD}, '[\\s\\x0B\\x{{00A0}}]+', ' ', 'g'), ' ') AS folded FROM documents)""",
)
def fold_text(spark, sf):
    """Accents folded and blanks squeezed in the whole text of every document."""
    folded = tb.read(spark, sf, "documents").select(
        "doc_id", names.squish(names.fold_accents(F.col("text"))).alias("folded")
    )
    return folded.select(
        "doc_id", F.length("folded").cast("bigint").alias("n_folded"), F.md5(F.col("folded").cast("binary")).alias("folded_md5")
    )


@query(
    "F3 F5 F8 F9",
    """SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS sentence, upper(p_type) AS upper_type,
      lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '.', 'g')) AS brand_slug, 'part-' || p_brand || '-' || p_partkey AS label,
      substr(p_type, 1, 5) AS short_type FROM part""",
)
def name_case(spark, sf):
    part = tb.read(spark, sf, "part")
    # The brand ends in a digit, so its slug loses no trailing dot.
    return part.select(
        "p_partkey",
        names.sentence_case(F.col("p_name")).alias("sentence"),
        F.upper("p_type").alias("upper_type"),
        names.slug(F.col("p_brand")).alias("brand_slug"),
        F.concat_ws("-", F.lit("part"), "p_brand", "p_partkey").alias("label"),
        F.substring("p_type", 1, 5).alias("short_type"),
    )


@query(
    "F2 F5 F6 H7",
    """SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'first nation' WHEN 'NATION_13' THEN 'thirteenth nation'
      ELSE lower(replace(n_name, '_', '.')) END AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def conform_names(spark, sf):
    """Spelling variants of nation names to one entity each, by exact alias."""
    customers = tb.read(spark, sf, "customer").join(
        tb.regions(spark, sf), F.col("c_nationkey") == F.col("entity")
    ).drop("entity")
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit("."))).otherwise(
        F.replace("n_name", F.lit("A"), F.lit("Ã\u0081"))
    )
    variants = customers.select("c_custkey", written.alias("written"))
    aliases = spark.createDataFrame(
        [("nation.1", "first nation"), ("nation.13", "thirteenth nation")], "alias_slug string, entity string"
    )
    return names.conform(variants, "written", aliases).drop("written")


@query(
    "F7",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECONOMY|STANDARD|PROMO') THEN 'type.' || lower(regexp_extract(p_type, '(ECONOMY|STANDARD|PROMO)', 1)) ELSE 'type' END AS kind FROM part""",
)
def extract_label(spark, sf):
    from panelloom.plans.macro import sector_of

    return tb.read(spark, sf, "part").select(
        "p_partkey", sector_of(F.col("p_type"), ["ECONOMY", "STANDARD", "PROMO"], "type").alias("kind")
    )


@query(
    "F10 F11 F12 F13 F14 F15",
    f"""SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS d,
      CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE) AS quarter_end_month,
      CAST(date_trunc('month', d) + INTERVAL 7 MONTH AS DATE) AS later, year(d) || ' Q' || quarter(d) AS label,
      CAST(year(d) * 4 + quarter(d) - 1 AS INTEGER) AS parsed,
      {SEASON} AS season_q, CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring' WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season_m
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS period_idx FROM orders)""",
)
def calendar_fields(spark, sf):
    day = F.col("o_orderdate").cast("date")
    month, quarter = cal.month_index(day), cal.quarter_index(day)
    label = cal.quarter_label(quarter)
    return tb.read(spark, sf, "orders").select(
        "o_orderkey",
        cal.year_of(month, 12).alias("y"),
        cal.quarter_of_month(cal.sub_period_of(month, 12)).alias("q"),
        cal.sub_period_of(month, 12).alias("m"),
        F.dayofmonth(day).alias("d"),
        cal.period_start(month, 12).alias("month_start"),
        cal.quarter_end_month(quarter).alias("quarter_end_month"),
        F.add_months(cal.period_start(month, 12), 7).alias("later"),
        label.alias("label"),
        cal.parse_quarter(label).alias("parsed"),
        cal.season(cal.sub_period_of(quarter, 4), 4).alias("season_q"),
        cal.season(cal.sub_period_of(month, 12), 12).alias("season_m"),
    )


@query(
    "F16 F17 F18 F19 F20 N5 N7",
    f"""SELECT c_custkey, greatest(c_acctbal, 0.0) + 0.0 AS pos, greatest(-c_acctbal, 0.0) + 0.0 AS neg, abs(c_acctbal) AS size,
      CASE WHEN c_acctbal > 0 THEN {rnd('ln(c_acctbal)', 6)} END AS log_balance, {rnd('c_acctbal / 1000', 2)} AS thousands,
      CASE WHEN c_acctbal >= 0 THEN 'credit' ELSE 'debit' END AS side, CAST(substr(c_name, 10) AS DOUBLE) AS number,
      CASE WHEN c_acctbal >= 0 THEN {rnd('sqrt(abs(c_acctbal))', 6)} END AS root FROM customer""",
)
def number_functions(spark, sf):
    balance = F.col("c_acctbal")
    return tb.read(spark, sf, "customer").select(
        "c_custkey",
        (numbers.positive_part(balance) + 0.0).alias("pos"),
        (numbers.negative_part(balance) + 0.0).alias("neg"),
        F.abs(balance).alias("size"),
        numbers.round_places(numbers.log_or_null(balance), 6).alias("log_balance"),
        numbers.round_places(balance / 1000, 2).alias("thousands"),
        F.when(balance >= 0, "credit").otherwise("debit").alias("side"),
        numbers.to_number(F.substring("c_name", 10, 100)).alias("number"),
        numbers.round_places(numbers.nan_to_null(F.sqrt(balance)), 6).alias("root"),
    )


@query(
    "F22 F23 H15",
    """SELECT p_partkey, CASE WHEN t > 2.576 THEN '***' WHEN t > 1.96 THEN '**' WHEN t > 1.645 THEN '*' END AS response_stars,
      CASE WHEN t > 2.326 THEN '***' WHEN t > 1.96 THEN '**' WHEN t > 1.645 THEN '*' ELSE '' END AS long_run_stars
    FROM (SELECT p_partkey, p_retailprice / 500.0 AS t FROM part)""",
)
def significance_stars(spark, sf):
    t = F.col("p_retailprice") / 500.0
    return tb.read(spark, sf, "part").select(
        "p_partkey",
        numbers.stars(t, PROJECTION_CUTOFFS).alias("response_stars"),
        numbers.stars(t, LONG_RUN_CUTOFFS, "").alias("long_run_stars"),
    )
