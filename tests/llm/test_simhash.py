from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from labspark.llm.components import components
from labspark.llm.simhash import class_pairs, drop_near_duplicates, fingerprint, near_duplicates, tile_links


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["A b C d", "É é A\x0bB\x85C d e", "a b c d e " * 50, "\x1c a b"]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def near_texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
            out.append(" ".join(copy))
    return out


def test_groups_match_all_pairs(docs_of, odd_rows):
    texts = near_texts(60) + [r[1] for r in odd_rows[:-1]]
    prints = [plain_fingerprint(t or "") for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(range(len(texts)), linked)
    # Small tiles: classes are cut in several, and every pair of tiles must meet.
    for tile_rows in (4096, 2):
        rows = near_duplicates(docs_of(texts), tile_rows=tile_rows).collect()
        assert {r.id: r.component_id for r in rows} == want
        assert {r.id: r.fingerprint % (1 << 64) for r in rows} == dict(enumerate(prints))


def test_one_row_stays_of_each_group(docs_of, odd, odd_rows):
    texts = near_texts(30, 2)
    rows = near_duplicates(docs_of(texts)).collect()
    kept = drop_near_duplicates(docs_of(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    groups = near_duplicates(odd).select("root").distinct().count()
    assert kept.count() == groups


def test_tile_links_span_groups():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) for c in centre])
    a, b = tile_links(values, values, 4)
    assert len(a) <= 2 * len(values)
    pairs = [(int(x), int(y)) for i, x in enumerate(values) for y in values[:i] if (int(x) ^ int(y)).bit_count() <= 4]
    names = {int(v) for v in values}
    assert roots(names, zip(a.tolist(), b.tolist())) == roots(names, pairs)


def test_class_pairs_cover_the_radius():
    sizes = {(h, w): 10 for h in range(33) for w in range(33)}
    pairs = {(p[2:4], p[4:6]) for p in class_pairs(sizes, 4, 4)}
    for a in sizes:
        for b in sizes:
            near = abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 4
            assert (((a, b) in pairs) or ((b, a) in pairs)) == near


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    edges += [(7, 7), (3, 2), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert found == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert near_duplicates(empty).count() == 0
    assert drop_near_duplicates(empty).count() == 0
