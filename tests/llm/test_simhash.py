import itertools
import random

import numpy as np
import xxhash

from tests.llm.fixtures import SHAPE, blank_parted, documents
from unitloom.llm import simhash
from unitloom.llm.components import connected_components


def slow_print(text, size=3):
    words = blank_parted(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    """Of pairs (id, print): the least id reachable over links of two bits or fewer."""
    left, out = list(range(len(prints))), {}
    while left:
        group, ring = set(), [left[0]]
        while ring:
            i = ring.pop()
            group.add(i)
            ring += [j for j in left if j not in group and (prints[i][1] ^ prints[j][1]).bit_count() <= 2]
        ids = [prints[i][0] for i in group if prints[i][0] is not None]
        out |= {i: min(ids) if ids else None for i in group}
        left = [i for i in left if i not in group]
    return out


def test_every_pair_of_words_two_bits_apart_shares_a_codeword():
    rng = random.Random(1)
    for base in [0, *(rng.getrandbits(23) for _ in range(4))]:
        near = [base, *(base ^ 1 << i for i in range(23)), *(base ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(23), 2))]
        keys = simhash.codeword_indices(np.array(near, dtype=np.int64))
        first = set(keys[0].tolist())
        assert all(first & set(k) for k in keys.tolist())


def test_prints_equal_the_plain_version():
    for row in documents():
        assert simhash.simhash(row[1]) == slow_print(row[1])


def test_classes_equal_brute_force(spark):
    rows = documents()
    found = simhash.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(found) == len(rows)
    prints = [(r[0], slow_print(r[1])) for r in rows]
    roots = slow_roots(prints)
    want = sorted(((p[0], p[1], roots[i]) for i, p in enumerate(prints)), key=str)
    assert sorted(((r["id"], r["print"] % 2**64, r["root"]) for r in found), key=str) == want


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        p = rng.choice(sorted(prints))
        prints.add(p ^ 1 << rng.randrange(20) ^ 1 << rng.randrange(20))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = connected_components(simhash.print_links(spark.createDataFrame(signed, "print long"))).collect()
    of = {r["node"] % 2**64: r["root"] % 2**64 for r in links}
    numbered = [(i, p) for i, p in enumerate(sorted(prints))]
    roots = slow_roots(numbered)
    for (i, p), (j, q) in itertools.combinations(numbered[:200], 2):
        assert (of.get(p, p) == of.get(q, q)) == (roots[i] == roots[j])


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SHAPE)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(50))
