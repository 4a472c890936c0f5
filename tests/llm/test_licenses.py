import math
import re

from tests.llm.fixtures import SHAPE, documents, plain
from unitloom.llm import licenses


def brute(text):
    words = plain(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
    blocks = (text or "").split("\n") + (re.split(r"\n[ \t\r]*\n+", text) if text and re.search(r"\n[ \t\r]*\n+", text) else [])
    found, best = set(), 0.0
    for label, own in licenses.template_words().items():
        share = max(len(set(own) & set(plain(b))) / len(own) for b in blocks)
        if len(own) * share >= math.ceil(round(licenses.THRESHOLD * len(own), 9)) - 1e-9:
            found.add(label)
            best = max(best, share)
    return len(words), places, sorted(found), best


def test_scan_equals_brute_force(spark):
    rows = documents()
    permission = licenses.TEMPLATES["mit-permission"].split()
    extra = [(90, "a\n\nPermission is hereby granted,\nfree of charge, " + " ".join(permission[7:]) + "\n\nb"), (91, " ".join(permission[:5])), (92, "GENERAL public-license, general public license\n")]
    rows += [(i, t, *rows[0][2:]) for i, t in extra]
    found = licenses.scan(spark.createDataFrame(rows, SHAPE)).collect()
    got = sorted(((r["id"], r["n_words"], sorted((p["at"], p["label"]) for p in r["places"]), r["found"], r["share"]) for r in found), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SHAPE)).collect() == []
