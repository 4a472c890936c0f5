"""Which handler reads and writes which kind of file."""

from __future__ import annotations

import html as _html
from dataclasses import dataclass


class UnsupportedSource(ValueError):
    """No handler reads or writes files of a kind."""


@dataclass(frozen=True)
class Format:
    name: str
    about: str
    imports: tuple[str, ...]
    exports: tuple[str, ...]


FORMATS = (
    Format("text", "plain and Markdown text, byte for byte", ("txt", "md"), ("txt", "md")),
    Format("document", "documents that reflow", ("md", "txt", "pdf"), ("md", "txt", "pdf")),
    Format("image", "RGBA images in tiles", ("png",), ("png",)),
    Format("config", "nested settings", ("json", "yaml", "yml", "toml"), ("json", "yaml", "yml", "toml")),
    Format("table", "columns with units and formulas", ("csv", "tsv", "json"), ("csv", "tsv", "json")),
)
#: Content that tells a kind whatever the name says.
_SIGNS = ((b"\x89PNG\r\n\x1a\n", "png"), (b"%PDF-", "pdf"), (b"\xff\xd8\xff", "jpg"))


def extension(name: str, head: bytes = b"") -> str:
    for sign, kind in _SIGNS:
        if head.startswith(sign):
            return kind
    return name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def preferred(kind: str, wanted: str | None = None, direction: str = "imports") -> tuple[Format, list[str]]:
    """The handler for an extension and the names of the others that could."""
    able = [f for f in FORMATS if kind in getattr(f, direction)]
    if wanted:
        able = [f for f in able if f.name == wanted]
    if not able:
        raise UnsupportedSource(f"no {f'{wanted} ' if wanted else ''}handler {'reads' if direction == 'imports' else 'writes'} .{kind} files")
    return able[0], [f.name for f in able[1:]]


def extensions(direction: str = "imports") -> list[str]:
    return sorted({e for f in FORMATS for e in getattr(f, direction)})


def preview_html(title: str, facts: dict[str, object], image_png: bytes | None = None) -> str:
    """A page from a summary alone; everything is escaped."""
    import base64

    rows = "".join(f"<tr><th>{_html.escape(k)}</th><td>{_html.escape(str(v))}</td></tr>" for k, v in facts.items())
    picture = f'<img alt="" src="data:image/png;base64,{base64.b64encode(image_png).decode()}">' if image_png else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{_html.escape(title)}</title></head><body><h1>{_html.escape(title)}</h1>{picture}<table>{rows}</table></body></html>"


def preview_text(title: str, facts: dict[str, object]) -> str:
    width = max(map(len, facts), default=0)
    return "\n".join([title, *(f"  {k.ljust(width)}  {v}" for k, v in facts.items())])
