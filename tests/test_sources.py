import pytest
from pyspark.sql import functions as F

from panelloom.plans import climate
from panelloom.schema import CITIES, LONG_PANEL
from panelloom.sources import readers, writers

HEADER = "ciudad,region_7,d_region_7,region_4,d_region_4,ent,entidad\n"


def test_csv_with_byte_order_mark_and_accents(spark, tmp_path):
    path = tmp_path / "cities.csv"
    path.write_text("﻿" + HEADER + '"Juárez, Cd.",1,Frontera Norte,1,Norte, Chih,Chihuahua\n', encoding="utf-8")
    row = readers.read_csv(spark, str(path), CITIES).first()
    assert row["ciudad"] == "Juárez, Cd." and row["region_7"] == 1 and row["entidad"] == "Chihuahua"


def test_csv_with_another_header_is_an_error(spark, tmp_path):
    path = tmp_path / "cities.csv"
    path.write_text(HEADER.replace("entidad", "estado") + "a,1,b,1,c,d,e\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(path), CITIES).collect()


def test_region_dimension_removes_the_wrong_pairs(spark, tmp_path):
    cities = [
        ("Matamoros", 1, "Frontera Norte", 1, "Norte", "Tamaulipas"),
        ("Tampico", 3, "Noreste", 1, "Norte", "Tamaulipas"),
        ("Monterrey", 3, "Noreste", 1, "Norte", "Nuevo Leon"),
        ("Veracruz", 5, "Centro Sur", 4, "Sur", "Veracruz"),
        ("Coatzacoalcos", 6, "Sur", 4, "Sur", "Veracruz"),
        ("Córdoba", 5, "Centro Sur", 4, "Sur", "Veracruz"),
    ]
    df = spark.createDataFrame(cities, "ciudad string, region_7 int, d_region_7 string, region_4 int, d_region_4 string, entidad string")
    wrong = spark.createDataFrame(climate.WRONG_REGION_PAIRS, "d_region_7 string, entidad string")
    levels = ["region_7", "d_region_7", "region_4", "d_region_4"]
    got = climate.region_dimension(df, "entidad", levels, wrong, ["d_region_7", "entidad"], national=True)
    assert {(r["entidad"], r["d_region_7"]) for r in got.where("NOT is_total").collect()} == {
        ("Tamaulipas", "Frontera Norte"), ("Nuevo Leon", "Noreste"), ("Veracruz", "Centro Sur")
    }
    total = got.where("is_total").collect()
    assert len(total) == 1 and total[0]["region_7"] == 0 and total[0]["entidad"] == "national"


def test_csv_round_trip_keeps_values(spark, tmp_path, rows):
    df = spark.createDataFrame([("a,\"b\"", 1, 0.1), ("c", 2, None)], LONG_PANEL)
    writers.write_csv(df, str(tmp_path / "out"))
    assert rows(readers.read_csv(spark, str(tmp_path / "out"), LONG_PANEL)) == rows(df)


def test_one_sheet_scans_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(20, "a", 1.0), (30, "a", 2.0)], "norm_years int, e string, x double")
    writers.write_by_key(df, str(tmp_path / "norms"))
    sheet = readers.read_sheet(spark, str(tmp_path / "norms"), "norm_years", 30)
    assert [r["x"] for r in sheet.collect()] == [2.0]
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(norm_years" in plan
    assert readers.read_all_sheets(spark, str(tmp_path / "norms")).count() == 2


def test_writing_one_norm_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "norms")
    writers.write_results(spark.createDataFrame([(20, "a", 1.0), (30, "a", 2.0)], "norm_years int, e string, x double"), path)
    writers.write_results(spark.createDataFrame([(30, "b", 3.0)], "norm_years int, e string, x double"), path)
    assert sorted((r["norm_years"], r["e"], r["x"]) for r in readers.read_all_sheets(spark, path).collect()) == [(20, "a", 1.0), (30, "b", 3.0)]


def test_nested_json(spark, rows):
    text = '{"data": {"MEX.1": {"1901-01": 10.5, "1901-02": null}, "MEX.2": {"1901-01": 7}}}'
    got = readers.series_from_json(spark.createDataFrame([(text,)], "value string"))
    assert rows(got) == [("MEX.1", 22812, 10.5), ("MEX.1", 22813, None), ("MEX.2", 22812, 7.0)]


def test_json_codes_are_repaired(spark, rows):
    text = '{"country": {"MEX": {"S": {"1": "MichoacÃ¡n", "2": "Sonora "}}, "CAN": {"S": {"9": "Yukon"}}}}'
    got = readers.codes_from_json(spark.createDataFrame([(text,)], "value string"), "MEX", "S")
    assert rows(got) == [("1", "Michoacán"), ("2", "Sonora")]


TEXT = """Servicio Nacional
Temperatura media
(grados)
Entidad   Ene  Feb  Mar  Anual
  Aguascalientes   13.2  -1.5  16.0   14.9
 Baja California Sur  17.1 18.0  N/E 18.2
 San Luis Potosí  10 11 12 11
Nota: cifras preliminares 2023
"""


def test_fixed_text_table(spark, tmp_path, rows):
    (tmp_path / "2023.txt").write_text(TEXT, encoding="utf-8")
    (tmp_path / "2024.txt").write_text("Entidad Ene\nAguascalientes 15.5\n", encoding="utf-8")
    got = readers.read_month_text(spark, str(tmp_path))
    base = 2023 * 12
    assert rows(got.where("entity LIKE 'Agua%'")) == [
        ("Aguascalientes", base, 13.2), ("Aguascalientes", base + 1, -1.5), ("Aguascalientes", base + 2, 16.0),
        ("Aguascalientes", base + 12, 15.5),
    ]
    assert rows(got.where("entity LIKE 'San%'"), "value") == [(10.0,), (11.0,), (12.0,)]


def test_fixed_text_cell_that_is_no_number(spark, tmp_path, rows):
    (tmp_path / "2023.txt").write_text(TEXT, encoding="utf-8")
    got = readers.read_month_text(spark, str(tmp_path)).where("entity LIKE 'Baja%'")
    assert rows(got, "period_idx", "value") == [
        (2023 * 12, 17.1), (2023 * 12 + 1, 18.0), (2023 * 12 + 2, None)
    ]


def test_wide_months(spark, rows):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], ["entity", "1901-01", "1901-02"])
    assert rows(readers.wide_months_to_long(wide)) == [
        ("a", 22812, 1.0), ("a", 22813, None), ("b", 22812, 3.0), ("b", 22813, 4.0)
    ]


def test_report_sheet(spark, rows):
    sheet = spark.createDataFrame(
        [("Censo", None), (None, None), ("Entidad federativa", "Población"), ("09 Ciudad de México", "9209944"), ("01 Aguascalientes", "1425607")],
        "a string, b string",
    )
    got = readers.normalise_report(sheet, F.col("a").rlike(r"^[0-9]{2}\s"), F.col("b") == "Población")
    assert got.columns == ["entidad_federativa", "poblacion"] and got.count() == 2
    weights = climate.population_weights(got, F.lit(True), "entidad_federativa", "poblacion")
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_hard_lines_of_a_text_table(spark, tmp_path, rows):
    """A short line, marks of missing numbers, a name with a digit: every line comes out, the rest is reported."""
    lines = ["Resumen", "Entidad Ene Feb Mar Anual", "Corta 1.0 2.0", "Sin n/d 2.0 3.0 2.5", "Raya - 2.0 3.0 2.5", "Zona 2 1.0 2.0 3.0 2.0", "Baja Sur 1 2 3 2", "Nota 7"]
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "2003.txt").write_text("\n".join(lines), encoding="utf-8")
    got = readers.read_month_text(spark, str(tmp_path) + "/a")
    first = 2003 * 12
    assert rows(got) == sorted(
        [
            *[("Corta", first + i, v) for i, v in enumerate([1.0, 2.0, None])], *[("Sin", first + i, v) for i, v in enumerate([None, 2.0, 3.0])],
            *[("Raya", first + i, v) for i, v in enumerate([None, 2.0, 3.0])], *[("Zona 2", first + i, v) for i, v in enumerate([1.0, 2.0, 3.0])],
            *[("Baja Sur", first + i, v) for i, v in enumerate([1.0, 2.0, 3.0])],
        ],
        key=lambda r: tuple((v is not None, v) for v in r),
    )
    assert rows(readers.unread_lines(readers.text_lines(spark, str(tmp_path) + "/a")), "line") == [("Nota 7",), ("Resumen",)]
    # Two folders with a file of one name are two files.
    assert readers.read_month_text(spark, str(tmp_path) + "/*").count() == 2 * got.count()


def test_scratch_needs_a_shared_folder():
    from panelloom.session import ensure_checkpoint_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Cluster)
