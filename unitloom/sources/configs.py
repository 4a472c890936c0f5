"""JSON, YAML and TOML: texts to values and back. Values become leaves with ``operators.nested.flatten``."""

from __future__ import annotations

import datetime
import json
import math
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from unitloom.functions.scalars import float_text
from unitloom.operators.nested import _spell, flatten, limit_ints, unflatten


class ConfigError(ValueError):
    """A text that cannot be read, or a value that a format cannot hold."""


def read_json(text: str) -> Any:
    return limit_ints(json.loads(text))


def write_json(value: Any) -> str:
    return json.dumps(_spell(value), ensure_ascii=False, indent=2)


def read_yaml(text: str) -> Any:
    """Scalar keys become texts, other keys are refused; tags are dropped; dates stay texts."""
    import yaml

    def spelled(key: Any) -> str:
        if isinstance(key, (list, dict, tuple)):
            raise ConfigError("a key that is a list or map cannot be kept")
        return key if isinstance(key, str) else "null" if key is None else str(key).lower() if isinstance(key, bool) else float_text(key) if isinstance(key, float) else str(key)

    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            self.flatten_mapping(node)
            return {spelled(self.construct_object(k, deep=True)): self.construct_object(v, deep=True) for k, v in node.value}

    Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def untagged(loader, _, node):
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, deep=True)

    Loader.add_multi_constructor("!", untagged)
    try:
        return limit_ints(yaml.load(text, Loader))
    except yaml.constructor.ConstructorError as e:
        raise ConfigError(str(e)) from e


def write_yaml(value: Any) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def read_toml(text: str) -> tuple[Any, list[str]]:
    """The value, with dates and times as texts, and the paths where those stand."""
    dated: list[str] = []

    def plain(value: Any, path: str) -> Any:
        if isinstance(value, dict):
            return {k: plain(v, f"{path}.{k}".lstrip(".")) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v, f"{path}.{i}".lstrip(".")) for i, v in enumerate(value)]
        if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
            dated.append(path)
            return value.isoformat().replace("+00:00", "Z")
        return value

    return limit_ints(plain(tomllib.loads(text), "")), dated


def _toml_key(key: str) -> str:
    return key if key and all(c.isascii() and (c.isalnum() or c in "-_") for c in key) else json.dumps(key, ensure_ascii=False)


def write_toml(value: Any, dated: tuple[str, ...] | list[str] = ()) -> str:
    """The root must be a map and nothing may be null. Texts at ``dated`` paths are written as dates."""
    if not isinstance(value, dict):
        raise ConfigError("TOML needs a map at the root")

    def inline(v: Any, path: str) -> str:
        if v is None:
            raise ConfigError(f"TOML cannot hold the null at '{path}'")
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return ("nan" if math.isnan(v) else "inf" if v > 0 else "-inf") if not math.isfinite(v) else float_text(v) or ""
        if isinstance(v, str):
            return v if path in dated else json.dumps(v, ensure_ascii=False)
        if isinstance(v, bytes):
            return json.dumps(v.hex())
        if isinstance(v, list):
            return "[" + ", ".join(inline(x, f"{path}.{i}") for i, x in enumerate(v)) + "]"
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{_toml_key(k)} = {inline(x, f'{path}.{k}')}" for k, x in v.items()) + " }"
        return str(v)

    lines: list[str] = []

    def table(v: dict, path: list[str]) -> None:
        for k, x in v.items():
            if not isinstance(x, dict):
                lines.append(f"{_toml_key(k)} = {inline(x, '.'.join([*path, k]))}")
        for k, x in v.items():
            if isinstance(x, dict):
                here = [*path, k]
                lines.extend(["", "[" + ".".join(map(_toml_key, here)) + "]"])
                table(x, here)

    table(value, [])
    return "\n".join(lines).lstrip("\n") + "\n"


READERS = {"json": read_json, "yaml": read_yaml, "yml": read_yaml, "toml": lambda t: read_toml(t)[0]}
WRITERS = {"json": write_json, "yaml": write_yaml, "yml": write_yaml, "toml": write_toml}


def read_config(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Leaves of every file that ``path`` names, with the file as ``file``."""
    from pyspark.sql import functions as F

    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return flatten(files, ["file"], "text", READERS[kind])


def config_text(leaves: DataFrame, key: list[str], kind: str) -> DataFrame:
    return unflatten(leaves, key, WRITERS[kind])
