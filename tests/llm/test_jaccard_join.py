import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from municipia.llm import jaccard_join, signature_tree
from municipia.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(rows):
    import re

    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = sets_of(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_against_all_pairs(awkward, block):
    got = result(jaccard_join.near_duplicates(awkward, block=block))
    assert got == brute([(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()])


def test_a_star_of_copies_that_are_not_alike_among_themselves(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(220)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(0, 220, 5), 4):
            t[at] = f"x{i}_{at}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.near_duplicates(docs)) == brute(rows)


def test_no_documents(no_docs):
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_tree_pairs_hold_all_similar_pairs():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [rng.choice(universe, rng.integers(130, 190), replace=False) for _ in range(40)]
    for s in list(sets):
        for _ in range(3):
            t = s.copy()
            k = rng.integers(0, 20)
            t[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(t))
    sets.sort(key=len)
    maps = [signature_tree.bitmap(s) for s in sets]
    bits = np.stack([signature_tree.fold(m, min(map(len, maps))) for m in maps])
    tree = signature_tree.Tree(bits, np.array([len(s) for s in sets]), np.arange(len(sets)))
    left = set(zip(*(x.tolist() for x in signature_tree.traverse(tree, tree, 4, 5)), strict=True))
    alike = {(j, i) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert alike <= left and len(left) < len(sets) * (len(sets) - 1) / 4
    best = signature_tree.traverse(tree, tree, 4, 5, best_only=True)
    assert len(best[0]) <= len(sets) and set(zip(*(x.tolist() for x in best), strict=True)) <= left


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 102), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


def test_one_of_each_group_stays(awkward):
    kept = jaccard_join.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for (_, _, c) in brute([(r["doc_id"], r["text"]) for r in awkward.collect()])}
    assert len(ids) == len(set(ids)) and set(ids) == want
