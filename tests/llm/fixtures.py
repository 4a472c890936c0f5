"""Small inputs with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
import re

#: Columns whose names operators could use themselves.
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, print long, h long, win string, pos int, score double, phase int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(3)
    passage, other = sentence(rng, 60), sentence(rng, 140)
    near = other.split()
    near[70] = "changed"
    texts = [
        passage, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}", f"{passage} {sentence(rng, 5)}", other, other, " ".join(near), None, "", "  \n\t ", "Übung macht den Meister – naïve café",
        "MIT License. Released under the MIT License.", "a", "one two", sentence(rng, 20_000), f"{sentence(rng, 9)}\nLicensed under the Apache License, Version 2.0.\n{sentence(rng, 9)}", "x " * 300,
    ]
    rows = [(i, t, "en", "big" if i % 3 else None if i % 2 else "small", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[3], None, None, None), (None, None, None, None, None), (5, "another text under a used id", "en", "big", 28)]
    return [(*r, 7, "k", "r", 1, 2, "w", 3, 0.5, 4) for r in rows]


def plain(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def blank_parted(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()
