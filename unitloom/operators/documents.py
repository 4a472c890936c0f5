"""Documents as blocks: normalising Markdown in and out, plain text, page layout with pins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.functions.scalars import first_line, words
from unitloom.operators.texts import WORDS_A_MINUTE

BLOCK = "block int, kind string, level int, lang string, text string"
_ITEM = re.compile(r"(?:[-*+] |[0-9]+[.)] )\s*(.*)", re.S)
_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_BREAKS = ("\\pagebreak", "<!-- pagebreak -->")


def _starts_block(t: str) -> bool:
    return not t or t.startswith(("#", "```", ">")) or bool(_ITEM.match(t))


def blocks(source: str) -> list[dict]:
    """Blocks of a Markdown text; lines that continue a block are joined by one space."""
    lines = [x.removesuffix("\r") for x in source.split("\n")]
    out: list[dict] = []
    at = 0

    def add(kind: str, text: str = "", level: int = 0, lang: str = "") -> None:
        out.append({"block": len(out), "kind": kind, "level": level, "lang": lang, "text": text})

    def run(first: str, goes_on, clean) -> str:
        nonlocal at
        parts = [first]
        while at < len(lines) and goes_on(lines[at]):
            parts.append(clean(lines[at].lstrip()))
            at += 1
        return " ".join(parts)

    while at < len(lines):
        line, t = lines[at], lines[at].lstrip()
        at += 1
        bare = t.rstrip()
        if not t:
            continue
        if t.startswith("```"):
            begin = at
            while at < len(lines) and not lines[at].lstrip().startswith("```"):
                at += 1
            body = lines[begin:at]
            if at == len(lines) and body and body[-1] == "":
                body = body[:-1]  # the end of the source is no line
            add("code", "\n".join(body), lang=t[3:].strip())
            at += 1
        elif found := _HEADING.match(t):
            add("heading", found[2].strip(), len(found[1]))
        elif len(bare) >= 3 and set(bare) in ({"-"}, {"*"}):
            add("rule")
        elif t in _BREAKS:
            add("page_break")
        elif item := _ITEM.match(t):
            level = min(4, (len(line) - len(t)) // 2)
            add("list", run(item[1], lambda x: x.lstrip() != "" and not _ITEM.match(x.lstrip()) and x[:1].isspace(), lambda x: x), level)
        elif t.startswith(">"):
            add("quote", run(t[1:].strip(), lambda x: x.lstrip().startswith(">"), lambda x: x.lstrip(">").strip()))
        else:
            add("paragraph", run(bare, lambda x: not _starts_block(x.lstrip()), str.rstrip))
    return out


def markdown(block: dict) -> str:
    text, level = block["text"], block["level"]
    match block["kind"]:
        case "heading":
            return f"{'#' * max(1, level)} {text}"
        case "list":
            return f"{'  ' * level}- {text}"
        case "quote":
            return f"> {text}"
        case "code":
            return f"```{block['lang']}\n{text}\n```"
        case "rule":
            return "---"
        case "page_break":
            return _BREAKS[0]
    return text


def from_markdown(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    types = dict(texts.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + f", {BLOCK}"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r[:-1], b["block"], b["kind"], b["level"], b["lang"], b["text"]) for r in batch.itertuples(index=False, name=None) if r[-1] is not None for b in blocks(r[-1])]
            yield pd.DataFrame(rows, columns=[*key, "block", "kind", "level", "lang", "text"])

    return texts.select(*key, text).mapInPandas(of, shape)


def from_plain(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Paragraphs parted by empty lines, white space inside made one space; native."""
    clean = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    return texts.select(*key, F.posexplode(clean).alias("block", "text")).select(*key, "block", F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("lang"), "text")


def _joined(found: DataFrame, key: list[str], each, between: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("block", each.alias("t"))))
    return found.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p.t), between).alias("text"))


def to_markdown(found: DataFrame, key: list[str]) -> DataFrame:
    """Regenerated Markdown, one blank line between blocks."""
    kind, text = F.col("kind"), F.col("text")
    each = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.col("level"))), F.lit(" "), text))
        .when(kind == "list", F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), text))
        .when(kind == "quote", F.concat(F.lit("> "), text))
        .when(kind == "code", F.concat(F.lit("```"), "lang", F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "rule", "---")
        .when(kind == "page_break", _BREAKS[0])
        .otherwise(text)
    )
    return _joined(found, key, each, "\n\n")


def to_plain(found: DataFrame, key: list[str]) -> DataFrame:
    return _joined(found.where("kind not in ('rule', 'page_break')"), key, F.col("text"), "\n\n")


def summarise(found: DataFrame, key: list[str]) -> DataFrame:
    n_words = F.sum(words(F.col("text")))
    title = F.min_by("text", F.when(F.col("kind") == "heading", F.col("block")))
    opening = F.min_by(first_line(F.col("text"), 240), F.when(F.col("kind") == "paragraph", F.col("block")))
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("heading", "paragraph", "list", "quote", "code")]
    return found.groupBy(*key).agg(F.count("*").alias("blocks"), n_words.alias("words"), F.round(n_words / WORDS_A_MINUTE, 1).alias("reading_minutes"), *kinds, title.alias("title"), opening.alias("opening"))


def validate(found: DataFrame, key: list[str], pins: DataFrame | None = None) -> DataFrame:
    """Issues: heading levels outside 1 to 6, headings of several lines; given pins, blocks without one and pins without a block."""
    issue = lambda c, m: F.when(c, F.lit(m))
    own = found.select(*key, "block", F.explode(F.array_compact(F.array(
        issue((F.col("kind") == "heading") & ~F.col("level").between(1, 6), "a heading's level lies outside 1 to 6"),
        issue((F.col("kind") == "heading") & F.col("text").contains("\n"), "a heading spans several lines"),
    ))).alias("message")).withColumn("severity", F.lit("error"))
    if pins is None:
        return own
    at = [*key, "block"]
    bare = found.where("kind not in ('rule', 'page_break') and text <> ''").select(*at).join(pins.select(*at).distinct(), at, "left_anti")
    stale = pins.select(*at).distinct().join(found.select(*at), at, "left_anti")
    for rows, message in ((bare, "the block has no pin"), (stale, "a pin has no block")):
        own = own.unionByName(rows.select(*at, F.lit(message).alias("message"), F.lit("warning").alias("severity")))
    return own


#: Widths in thousandths of the font size, Courier; the page in points.
CELL = 0.6
PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 595.0, 842.0, 56.0
SIZES = {"heading": {1: 22.0, 2: 17.0, 3: 14.0}, "code": 9.5}


def wrapped(text: str, width: int) -> list[str]:
    """Greedy lines of at most ``width`` characters; a longer word stands alone."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def laid_out(found: list[dict]) -> list[dict]:
    """Pins: page, place (to a tenth of a point), font, size and text of each line of a document."""
    pins: list[dict] = []
    page, y = 0, MARGIN
    for b in found:
        if b["kind"] == "page_break":
            page, y = page + 1, MARGIN
            continue
        size = SIZES["heading"].get(b["level"], 12.0) if b["kind"] == "heading" else SIZES["code"] if b["kind"] == "code" else 11.0
        indent = 18.0 * (b["level"] + 1) if b["kind"] == "list" else 18.0 if b["kind"] == "quote" else 0.0
        width = max(1, int((PAGE_WIDTH - 2 * MARGIN - indent) / (size * CELL)))
        for line in b["text"].split("\n") if b["kind"] == "code" else wrapped(b["text"], width):
            if y + size * 1.35 > PAGE_HEIGHT - MARGIN:
                page, y = page + 1, MARGIN
            pins.append({"block": b["block"], "page": page, "x": round(MARGIN + indent, 1), "y": round(y, 1), "font": "Courier-Bold" if b["kind"] == "heading" else "Courier", "size": size, "text": line})
            y += size * 1.35
        y += size * 0.6
    return pins


def pin(found: DataFrame, key: list[str]) -> DataFrame:
    """The layout of every document: its blocks come together, one document at a time."""
    types = dict(found.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + ", block int, page int, x double, y double, font string, size double, text string"

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        pins = pd.DataFrame(laid_out(rows.to_dict("records")), columns=["block", "page", "x", "y", "font", "size", "text"])
        for i, k in enumerate(key):
            pins.insert(i, k, rows[k].iloc[0])
        return pins

    return found.groupBy(*key).applyInPandas(of, shape)


def pin_changes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Blocks whose pins were added, removed or changed."""
    at = [*key, "block"]
    held = lambda df, n: df.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("page", "y", "x", "font", "size", "text"))).alias(n))
    joined = held(a, "old").join(held(b, "new"), at, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(*at, kind.alias("kind"))
