import pytest

from unitloom.functions.formula import FormulaError, Name, columns_of, compile_column, parse, to_whole, unit_of
from unitloom.functions.units import Unit, UnitError
from unitloom.operators import tables
from unitloom.operators.tables import Table
from unitloom.plans.spec import ColumnSpec, TableSpec, quoted, split_header


def test_units():
    assert abs(Unit.parse("km/h").factor_to(Unit.parse("m/s")) - 1 / 3.6) < 1e-12
    assert Unit.parse("kg*m/s^2*K").dims == (("K", -1), ("kg", 1), ("m", 1), ("s", -2))
    assert Unit.parse(" - ").dims == () and Unit.parse("m/m").dimensions() == "dimensionless"
    assert Unit.parse("km").describe() == "km [m]" and Unit.parse("1/s").dimensions() == "1/s"
    assert Unit.parse("km").factor_to(Unit.parse("s")) is None and Unit.parse("USD").scale == 1.0
    for bad in ("m^x", "m*^2", "m m", "m^"):
        with pytest.raises(UnitError):
            Unit.parse(bad)


def _value(spark, text):
    return spark.range(1).select(compile_column(parse(text), {}, quoted).alias("x")).first()["x"]


def test_grammar(spark):
    assert [_value(spark, t) for t in ("-2^2", "2e-3 * 1000", "(1 + 2) * 3", "2^-1", "7 - 2 - 1", "8 / 4 / 2")] == [-4.0, 2.0, 9.0, 0.5, 4.0, 1.0]
    assert columns_of(parse("b + a * b")) == ["b", "a"] and parse("größe_1") == Name("größe_1")
    for bad in ("2^3^2", "1 +", "(1", "a b", "a % b", "2^a", ""):
        with pytest.raises(FormulaError):
            parse(bad)


def test_unit_check_refuses_before_any_job():
    units = {"distance": Unit.parse("m"), "elapsed": Unit.parse("s")}
    with pytest.raises(UnitError, match="cannot add m and s"):
        unit_of(parse("distance + elapsed"), units)
    with pytest.raises(UnitError):
        unit_of(parse("distance + 5"), units)
    spec = TableSpec.of([ColumnSpec("distance", "int", "km"), ColumnSpec("elapsed", "int", "min"), ColumnSpec("speed", "float", "km", "distance + elapsed")])
    with pytest.raises(FormulaError, match="speed"):
        spec.check()


def test_division_and_whole_numbers(spark):
    rows = [(1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (-1.0, 0.0), (6.0, 4.0), (None, 2.0), (2.5, 1.0), (-2.5, 1.0), (1e30, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(compile_column(parse("a / b"), {}, quoted).alias("q"))
    assert [str(r["q"]) for r in df.collect()] == ["inf", "-inf", "nan", "-inf", "1.5", "None", "2.5", "-2.5", "1e+30"]
    whole = [r["n"] for r in df.select(to_whole(df.q).alias("n")).collect()]
    assert whole == [2**63 - 1, -(2**63), 0, -(2**63), 2, None, 3, -3, 2**63 - 1]


def test_recompute(spark):
    spec = TableSpec.of([ColumnSpec("leg"), ColumnSpec("distance", "float", "km"), ColumnSpec("elapsed", "float", "h"), ColumnSpec("speed", "float", "km/h", "distance / elapsed")])
    rows = spark.createDataFrame([("a", 120.0, 2.0, None), ("b", 90.0, 1.5, 7.0), ("c", None, 1.0, 5.0)], "leg string, distance double, elapsed double, speed double")
    made = tables.recompute(Table(rows, spec))
    assert [r["speed"] for r in made.rows.collect()] == [60.0, 60.0, None]
    assert tables.filled(made).first()["filled"] == 2
    mixed = TableSpec.of([ColumnSpec("long", "float", "km"), ColumnSpec("short", "float", "m"), ColumnSpec("total", "float", "m", "long + short")])
    out = tables.recompute(Table(spark.createDataFrame([(1.0, 500.0)], "long double, short double"), mixed))
    assert out.rows.first()["total"] == 1500.0


def test_later_formula_is_a_warning():
    spec = TableSpec.of([ColumnSpec("a", "float", None, "b * 2"), ColumnSpec("b", "float", None, "1 + 1")])
    assert [p[0] for p in spec.problems()] == ["warning"]


def test_headers():
    assert split_header("speed (m/s) = distance / elapsed") == ColumnSpec("speed", unit="m/s", expr="distance / elapsed")
    assert split_header(" mass [kg] ") == ColumnSpec("mass", unit="kg") and split_header("plain") == ColumnSpec("plain")
    assert split_header("speed (m/s) = a / b").header == "speed (m/s) = a / b"
