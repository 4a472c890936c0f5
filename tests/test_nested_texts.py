import json

import pytest

from unitloom.operators import alignment, documents, nested, texts
from unitloom.sources import configs, pdf

SERVICE = '{"name":"ridge-logger","listen":{"host":"0.0.0.0","port":8080},"features":["telemetry","retry"],"plugins":[],"debug":false,"ratio":1.0,"none":null,"zebra":1,"apple":{}}'


def leaves(spark, *bodies):
    return nested.flatten(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), ["id"], "body")


def test_flatten_and_rebuild(spark):
    flat = leaves(spark, SERVICE, "5", "[]", '[[1,[2]],{"a":[{"b":"x"}]}]')
    assert [r["path"] for r in flat.where("id = 0").orderBy("pos").collect()] == ["name", "listen.host", "listen.port", "features.0", "features.1", "plugins", "debug", "ratio", "none", "zebra", "apple"]
    back = {r["id"]: r["text"] for r in nested.unflatten(flat, ["id"]).collect()}
    for i, body in enumerate((SERVICE, "5", "[]", '[[1,[2]],{"a":[{"b":"x"}]}]')):
        assert json.dumps(json.loads(back[i])) == json.dumps(json.loads(body))
    with pytest.raises(ValueError):
        nested.rebuild([([{"is_index": False, "key": "a", "idx": None}], "int", "1"), ([{"is_index": True, "key": None, "idx": 0}], "int", "1")])


def test_set_unset_and_prefixes(spark):
    flat = nested.set_path(nested.set_path(leaves(spark, SERVICE), ["id"], "features.2", "new"), ["id"], "debug", True)
    flat = nested.unset_path(nested.rename_key(flat, "listen", "server.bind"), "name")
    value = json.loads(nested.unflatten(flat, ["id"]).first()["text"])
    assert value["features"] == ["telemetry", "retry", "new"] and value["debug"] is True and "name" not in value and value["server"]["bind"]["port"] == 8080


def test_config_diff_and_summary(spark):
    a, b = leaves(spark, SERVICE), leaves(spark, SERVICE.replace("8080", "8081").replace('"debug":false', '"verbose":true').replace("1.0", "1"))
    found = sorted((r["path"], r["kind"], r["note"]) for r in nested.diff(a, b, ["id"]).collect())
    assert found == [("debug", "removed", None), ("listen.port", "modified", None), ("ratio", "modified", "type float -> int"), ("verbose", "added", None)]
    s = nested.summarise(a, ["id"]).first()
    assert (s["leaves"], s["depth"], s["names"][:3]) == (11, 2, ["name", "listen", "features"])


def test_yaml_and_toml():
    assert configs.read_yaml("a: 2020-01-01\n1: x\ntrue: !t y\n") == {"a": "2020-01-01", "1": "x", "true": "y"}
    with pytest.raises(configs.ConfigError):
        configs.read_yaml("? [a]\n: b\n")
    value, dated = configs.read_toml('x = 1979-05-27T07:32:00Z\n[a]\nb = [1, 2]\n[[a.c]]\nd = 1.5\n')
    assert dated == ["x"] and configs.read_toml(configs.write_toml(value, dated)) == (value, dated)
    for bad in ({"a": None}, [1]):
        with pytest.raises(configs.ConfigError):
            configs.write_toml(bad)


NOTES = "# Title\n\nA paragraph\nof two lines.\n\n## Next\n- one\n  more\n- two\n  1. deep\n\n> said\n> so\n\n```python\ncode\n\n# no heading\n```\n---\nend"


@pytest.mark.parametrize("source", [NOTES, "", "\n\n a\r\n\r\nb \t\n", "no end", "```\nopen\n\n", "#no\n####### seven\n", "> \n>\n", " \n"])
def test_sections_concatenate_to_the_source(source):
    for markdown in (True, False):
        assert "".join(s["text"] + s["sep"] for s in texts.sections(source, markdown)) == source


def test_section_kinds():
    found = [(s["kind"], s["level"], s["lang"]) for s in texts.sections(NOTES)]
    assert found == [("heading", 1, ""), ("paragraph", 0, ""), ("heading", 2, ""), ("list", 0, ""), ("list", 0, ""), ("list", 1, ""), ("quote", 0, ""), ("code", 0, "python"), ("rule", 0, ""), ("paragraph", 0, "")]


def test_documents():
    found = documents.blocks(NOTES)
    assert [b["kind"] for b in found] == ["heading", "paragraph", "heading", "list", "list", "list", "quote", "code", "rule", "paragraph"]
    assert found[1]["text"] == "A paragraph of two lines." and found[3]["text"] == "one more" and found[6]["text"] == "said so"
    once = "\n\n".join(map(documents.markdown, found))
    assert [(b["kind"], b["text"]) for b in documents.blocks(once)] == [(b["kind"], b["text"]) for b in found]
    pins = documents.laid_out(documents.blocks("# T\n\n" + "word " * 4000))
    assert max(p["page"] for p in pins) >= 2 and all(p["x"] == round(p["x"], 1) for p in pins)


def test_pdf_round_trip():
    pins = documents.laid_out(documents.blocks("# Head (one)\n\nPlain \\ words é here."))
    text, caveats = pdf.extract(pdf.render(pins))
    assert text == "Head (one)\nPlain \\ words é here." and caveats == []
    assert pdf.extract(b"%PDF-1.4\n")[1] == ["no text was found; the pages may be images"]


def test_alignment():
    kinds = lambda a, b: [c[0] for c in alignment.changes(a, b)]
    assert kinds(list("abc"), list("abc")) == [] and kinds(list("abc"), list("xabc")) == ["added"] and kinds(list("abc"), list("ac")) == ["removed"]
    assert alignment.changes(["one", "two", "three"], ["one", "2", "three"], "SECT") == [("modified", "SECT[1]", 1, 1)]
    moved = kinds(["one", "two", "three"], ["three", "one", "two"])
    assert "moved" in moved and "modified" not in moved
    long = [str(i) for i in range(2500)]
    assert alignment.changes(long, [*long[:5], "x", *long[6:]]) == [("modified", "[5]", 5, 5)]


def test_rebuilding_calls_python_per_batch_not_per_key(spark):
    flat = leaves(spark, *(f'{{"k": {i}, "l": [null, {{"m": "x{i}"}}]}}' for i in range(5000)))
    back = nested.unflatten(flat.repartition(7), ["id"])
    assert "FlatMapGroups" not in back._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["text"]) for r in back.collect()} == {(i, f'{{"k": {i}, "l": [null, {{"m": "x{i}"}}]}}') for i in range(5000)}
    keyed = spark.createDataFrame([(None, 1.5, '{"a": 1}'), (2, float("nan"), None), (3, float("nan"), '{"a": "\\u00e9", "b": {}}')], "id long, x double, body string")
    back = nested.unflatten(nested.flatten(keyed, ["id", "x"], "body"), ["id", "x"]).collect()
    assert sorted((r["id"] or 0, str(r["x"]), r["text"]) for r in back) == [(0, "1.5", '{"a": 1}'), (3, "nan", '{"a": "é", "b": {}}')]
