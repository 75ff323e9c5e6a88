import random
from itertools import permutations

import duckdb

from municipia.llm import filter_audit


def brute(docs, labels):
    """part, order, step -> counts, by applying each order's filters left to right."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for i, (doc_id, text, part) in enumerate(docs):
        t = text or ""
        for c in "\t\n\v\f\r":
            t = t.replace(c, " ")
        w, t = [x for x in t.split(" ") if x], text or ""
        copy = doc_id is not None and any(x is not None and x < doc_id and (y or "") == t for x, y, _ in docs)
        failed = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), copy)
        rows.append((part or "", {f for f, x in zip("ABCDE", failed) if x}, doc_id))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in mine if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_every_step_of_every_order(spark, awkward, no_docs):
    rng = random.Random(5)
    extra = [(200 + i, rng.choice(["Ab# cd", "w " * 210, " ".join(f"w{j}" for j in range(230)), "x" * 300 + rng.choice("ab"), "", None]), None, rng.choice(["p", "", None]), None, "mine", "theirs") for i in range(60)]
    docs = awkward.unionByName(spark.createDataFrame(extra, awkward.schema))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, labels)
    for size in (filter_audit.TRIE_BYTES, 2_000):  # one trie, and many parted by prefix and hash
        got = filter_audit.audit(docs, table, trie_bytes=size).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(no_docs, table).collect() == []
    assert filter_audit.audit(docs, table.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0

    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    told = duck.execute(filter_audit.ORACLE).fetchall()
    assert {(p, o, k): tuple(v) for p, o, k, *v in told} == want


def test_trie_holds_the_least_id_of_whole_texts():
    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "abd", "b" * 5000, "b" * 4999 + "c"] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    trie, least = filter_audit.RadixTrie(), {}
    ends = []
    for i in rng.sample(range(len(texts)), len(texts)):
        least[texts[i]] = min(i, least.get(texts[i], i))
        ends.append((texts[i], trie.insert(texts[i], i)))
    assert all(end[2] == least[t] for t, end in ends)
    assert len({id(end) for _, end in ends}) == len(least)


def test_boundaries_part_alike_beginnings():
    texts = ["the same beginning of all " + str(i) for i in range(1000)]
    cuts, parts = filter_audit.boundaries(texts, 10, 32)
    assert len(cuts) == 9 and cuts == sorted(set(cuts)) and max(map(len, cuts)) < 30
    cuts, parts = filter_audit.boundaries(["x" * 256] * 1000, 10, 32)
    assert cuts == [] and parts == [16]
