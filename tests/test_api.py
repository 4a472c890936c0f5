import pytest

from unitloom import api
from unitloom.operators.rules import FieldRule
from unitloom.plans.capabilities import Capabilities
from unitloom.plans.migrations import Op, Rule, RuleSet


def test_tables_settings_and_texts(spark, tmp_path):
    (tmp_path / "journey.csv").write_text("leg,distance (km),elapsed (h),speed (km/h) = distance / elapsed\na,120.0,2.0,\nb,90.0,1.5,\n")
    table = api.recompute(api.read(spark, str(tmp_path / "journey.csv")))
    assert [r["speed"] for r in api.view(table).collect()] == [60.0, 60.0]
    assert api.summary(table).first()["rows"] == 2 and "rows" in api.preview("j", table)
    api.write(table, str(tmp_path / "out.csv"), "table")
    with pytest.raises(Exception, match="exist"):
        api.write(table, str(tmp_path / "out.csv"), "table")
    issues = api.validate(table, [FieldRule("distance", "float", max=100)], Capabilities(network=True), Capabilities()).collect()
    assert sorted(i["path"] for i in issues) == ["distance", "network"]

    (tmp_path / "s.json").write_text('{"a": {"b": 1}, "c": [true]}')
    leaves = api.read(spark, str(tmp_path / "s.json"))
    assert api.get_path(leaves, "a.b").first()["text"] == "1"
    changed = api.unset_path(api.set_path(leaves, "a.b", "2"), "c")
    assert sorted((r["path"], r["kind"]) for r in api.diff(leaves, changed).collect()) == [("a.b", "modified"), ("c.0", "removed")]
    moved, steps = api.migrate(leaves, RuleSet((Rule(1, 2, (Op("rename_key", {"from": "a", "to": "z"}),)),)), 1)
    assert len(steps) == 1 and api.get_path(moved, "z.b").count() == 1
    assert [i["message"] for i in api.validate(leaves, [FieldRule("a.b", "string"), FieldRule("q", required=True)]).orderBy("path").collect()] == ["declared string, found int", "required value is missing"]
    api.convert(spark, str(tmp_path / "s.json"), str(tmp_path / "s.toml"), "config")
    assert "[a]" in "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "s.toml")).collect())

    (tmp_path / "n.md").write_text("# T\n\none\n\ntwo\n")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "n.md").write_text("# T\n\none\n\nthree\n")
    notes = api.read(spark, str(tmp_path / "n.md"), "text")
    assert api.summary(notes).first()["headings"] == 1 and api.validate(notes).count() == 0
    other = api.read(spark, str(tmp_path / "m" / "n.md"), "text")
    same = lambda df: df.withColumn("file", api.F.lit("f"))
    assert [(r["kind"], r["path"]) for r in api.diff(same(notes), same(other)).collect()] == [("modified", "section[2]")]
    with pytest.raises(ValueError):
        api.diff(table, leaves)
    assert api.pin(api.read(spark, str(tmp_path / "n.md"), "document")).count() == 3
    assert {f[0] for f in api.formats()} == {"text", "document", "image", "config", "table"}
    assert api.empty_table(spark, ["a (m)"]).rows.count() == 0 and api.starter("text", "x") == "# x\n"
