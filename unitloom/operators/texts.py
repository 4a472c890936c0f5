"""Text as sections that concatenate to the source byte for byte, and their summaries, checks and differences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.functions.scalars import first_line, words

SECTION = "sec int, kind string, level int, lang string, text string, sep string"
WORDS_A_MINUTE = 238.0
_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_END = re.compile(r"[\r\n]*\Z")
_MARKER = re.compile(r"(?:[-*+]|[0-9]+[.)]) ")
_HEADING = re.compile(r"(#{1,6}) ")
_RULE = re.compile(r"(?:-{3,}|={3,}|\*{3,})\Z")
#: Whether a line, without its indent, goes on with an open section of a kind.
_GOES_ON: dict[str, Callable[[str], bool]] = {
    "quote": lambda t: t.startswith(">"),
    "list": lambda t: not _MARKER.match(t),
    "paragraph": lambda t: not t.startswith(("#", "```", ">")) and not _MARKER.match(t),
    "plain": lambda t: True,
    "heading": lambda t: False,
    "rule": lambda t: False,
}


def _opened(line: str, markdown: bool) -> tuple[str, int, str]:
    """Kind, level and language of the section that a line opens."""
    t = line.lstrip()
    if not markdown:
        return "plain", 0, ""
    if t.startswith("```"):
        return "code", 0, t[3:].strip()
    if found := _HEADING.match(t):
        return "heading", len(found[1]), ""
    if _RULE.match(t.rstrip()):
        return "rule", 0, ""
    if t.startswith("> ") or t == ">":
        return "quote", 0, ""
    if _MARKER.match(t):
        return "list", min(12, len(line) - len(t)) // 2, ""
    return "paragraph", 0, ""


def sections(source: str, markdown: bool = True) -> list[dict]:
    """Sections of a text. Blank lines belong to the separator of the section before; those at the start open an empty
    paragraph. A fence runs to the closing fence or the end."""
    out: list[dict] = []
    lines: list[str] = []
    kind = ""
    fenced = False

    def close() -> None:
        if lines:
            whole = "".join(lines)
            cut = _END.search(whole).start()
            out[-1] |= {"text": whole[:cut], "sep": whole[cut:]}
            lines.clear()

    for line in _LINES.findall(source):
        t = line.lstrip()
        if kind == "code" and fenced:
            lines.append(line)
            fenced = not t.startswith("```")
            if not fenced:
                close()
                kind = ""
        elif not t:
            close()
            kind = ""
            if not out:
                out.append({"kind": "paragraph", "level": 0, "lang": "", "text": "", "sep": ""})
            out[-1]["sep"] += line
        elif kind and _GOES_ON[kind](t):
            lines.append(line)
        else:
            close()
            kind, level, lang = _opened(line, markdown)
            fenced = kind == "code"
            out.append({"kind": "paragraph" if kind == "plain" else kind, "level": level, "lang": lang})
            lines.append(line)
    close()
    return [{"sec": i, **s} for i, s in enumerate(out)]


def segment(texts: DataFrame, key: list[str], text: str = "text", markdown: bool = True) -> DataFrame:
    """The key and the sections of each row's text. A null text has none."""
    types = dict(texts.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + f", {SECTION}"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row[:-1], s["sec"], s["kind"], s["level"], s["lang"], s["text"], s["sep"]) for row in batch.itertuples(index=False, name=None) if row[-1] is not None for s in sections(row[-1], markdown)]
            yield pd.DataFrame(rows, columns=[*key, "sec", "kind", "level", "lang", "text", "sep"])

    return texts.select(*key, text).mapInPandas(of, shape)


def to_text(sections: DataFrame, key: list[str]) -> DataFrame:
    """Each key's text again. What is gathered per key is one text."""
    parts = F.array_sort(F.collect_list(F.struct("sec", F.concat("text", "sep").alias("t"))))
    return sections.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p.t), "").alias("text"))


def summarise(sections: DataFrame, key: list[str]) -> DataFrame:
    """``sections``, ``words``, ``chars``, ``reading_minutes``, counts by kind and the ``opening`` paragraph, by key."""
    n_words, n = F.sum(words(F.col("text"))), F.count("*")
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("heading", "paragraph", "list", "quote", "code", "rule")]
    opening = F.min_by(first_line(F.col("text"), 240), F.when((F.col("kind") == "paragraph") & (F.col("text") != ""), F.col("sec")))
    return sections.groupBy(*key).agg(n.alias("sections"), n_words.alias("words"), F.sum(F.length("text") + F.length("sep")).alias("chars"), F.round(n_words / WORDS_A_MINUTE, 1).alias("reading_minutes"), *kinds, opening.alias("opening"))


def outline(sections: DataFrame, key: list[str]) -> DataFrame:
    """Headings in order, without their marks."""
    return sections.where("kind = 'heading'").select(*key, "sec", "level", F.regexp_replace("text", r"^\s*#+ *", "").alias("title"))


def validate(sections: DataFrame, key: list[str], every: DataFrame | None = None) -> DataFrame:
    """Issues: headings of several lines, white space in a fence's language and, given all keys, files without text."""
    found = sections.select(*key, "sec", F.explode(F.array_compact(F.array(
        F.when((F.col("kind") == "heading") & F.col("text").contains("\n"), F.struct(F.lit("error").alias("severity"), F.lit("a heading spans several lines").alias("message"))),
        F.when(F.col("lang").rlike(r"\s"), F.struct(F.lit("warning").alias("severity"), F.lit("the language of a fence holds white space").alias("message"))),
    ))).alias("i")).select(*key, "sec", "i.severity", "i.message")
    if every is None:
        return found
    hollow = every.select(*key).distinct().join(sections.where(F.col("text") != "").select(*key).distinct(), key, "left_anti")
    return found.unionByName(hollow.select(*key, F.lit(None).cast("int").alias("sec"), F.lit("warning").alias("severity"), F.lit("the text is empty").alias("message")))
