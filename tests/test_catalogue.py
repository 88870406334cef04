"""Every registered query against its SQL on the smallest given tables, and the shape of the plans."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as driver
from panelloom.catalogue import COVERS, ORACLES, QUERIES
from tools.check_queries import GIVEN, compare

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# On the smallest tables these have more regressors than rows, and plain SQL does not alias.
NEED_ROWS = {"ardl_fit", "long_run", "ardl_compare_view", "fe_ols_batch"}

pytestmark = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    connections = {}
    for folder in (SMALL, MEDIUM):
        connections[folder] = duckdb.connect()
        for table in GIVEN:
            connections[folder].execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connections


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    folder = MEDIUM if name in NEED_ROWS else SMALL
    result = compare(spark, duck[folder], folder, name)
    assert result.startswith(("ok", "rows only")), result


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
    assert set(COVERS) == set(QUERIES)


def test_inventory_is_covered():
    """Each item of the operator inventory is exercised by a query, or by the named tests."""
    covered = set(re.findall(r"\b[SPRJAWUFDEV]\d+\b", " ".join(COVERS.values())))
    wanted = {f"{kind}{i}" for kind, n in dict(S=13, P=15, R=8, J=10, A=13, W=15, U=2, F=24, D=21, E=10, V=6).items() for i in range(1, n + 1)}
    elsewhere = {"S12"}  # path builder: tests/test_functions.py
    assert wanted - covered - elsewhere == set()


def plan(spark, name, folder=MEDIUM):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


# The national series is one row per quarter, so its windows may hold it whole.
ONE_SERIES = {"national_per_capita"}
PLANNED = [q for q in ORACLES if q not in ("csv_round_trip", "sheet_by_norm", "all_sheets", "fixed_text_rows", "group_id", "summary_stats_rows", *ONE_SERIES)]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_products_or_global_windows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    for window in re.findall(r"windowspecdefinition\(([^()]*)", text):
        assert not re.match(r"[\w#]+ (ASC|DESC)", window), f"window without a partition: {window}"


def test_scans_read_only_what_they_use(spark):
    text = plan(spark, "weighted_region_index")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    orders = next(s for s in schemas if "o_custkey" in s)
    assert "o_orderstatus" not in orders and "o_orderkey" not in orders
    customer = next(s for s in schemas if "c_custkey" in s)
    assert "c_acctbal" not in customer and "c_name" not in customer


def test_filters_reach_the_scan(spark):
    text = plan(spark, "pattern_filter")
    assert "PushedFilters" in text and "In(p_type, [ECONOMY,STANDARD])" in text


def shuffles(spark, name):
    return len(re.findall(r"\bExchange (?:hash|range|single|round)", plan(spark, name)))


def test_shuffle_counts(spark):
    """One shuffle for the monthly totals and one by entity, which windows, roll-ups and norms all share."""
    assert shuffles(spark, "trailing_norm") == 2
    assert shuffles(spark, "all_norms_long") == 2
    assert shuffles(spark, "cumulative_log_change") == 2
    # Spine, lags and packing by entity run on one shuffle; two more join the sums.
    assert shuffles(spark, "lp_irf") <= 8


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "last_rows_per_group")


def test_ranked_rows_never_sort_in_one_task(spark):
    text = plan(spark, "group_id")
    assert "c_name" not in "".join(re.findall(r"Window \[([^\]]*)\]", text))


def test_full_regression_grid(spark):
    monthly = QUERIES["lp_monthly"](spark, MEDIUM)
    assert monthly.count() == 3 * 6 * 10 * 9 and monthly.agg({"horizon": "max"}).first()[0] == 8
    fits = QUERIES["ardl_fit"](spark, MEDIUM).select("norm_years", "spec_id").distinct()
    assert fits.count() == 3 * 4 * 9
