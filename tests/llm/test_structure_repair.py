import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pytest

from municipia.llm import structure_repair as repair

sys.setrecursionlimit(20_000)
GOOD = re.compile(r"(s?(ua)+)?")


def best_edits(rows):
    """The least (cost, initials, lines) over all edits of rows (role, text, fault), from the end back."""
    ahead = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def rest(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for r in "ua":
                if r in ahead[state]:
                    c, a, lines = rest(i, r, inserted + 1)
                    found.append((c + 5, "I" + a, (names[r] + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, lines = rest(i + 1, state, 0)
            found.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in ahead[state]:
                    c, a, lines = rest(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                for r in "ua":
                    if r in ahead[state]:
                        c, a, lines = rest(i + 1, r, 0)
                        found.append((c + more + 1, "R" + a, (f"{names[r]}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def brute(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in [t for t in turns if t[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        known = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = best_edits(told)
        assert GOOD.fullmatch("".join(x[0] for x in lines))
        count = lambda f: sum(t[2] == f for t in told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Übersetzer"]
    texts = ["Fine.", "Why?", "cut off", "", " \n", None, "No!\t", "ends in a line separator. ", "x.", "😀"]
    rows = [(c, t, rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 12))]
    rows += [(200, t * 3, ["user", "assistant"][t % 2], f"Turn {t % 70}.") for t in range(300)]  # many chunks, texts seen earlier
    rows += [(201, None, "user", "Null turn."), (201, None, "user", "Null turn."), (201, -5, "assistant", "Before."), (201, 10**12, "user", "Far.")]
    rows += [(None, 0, "user", "Whose?"), (None, 1, "assistant", "Nobody's.")]
    rows += [(300, 7, "user", "Again."), *[(300, 7, "user", "Again.")] * 40, (300, 8, "assistant", "Yes.")]
    rows += [(c, 0, None, None) for c in range(400, 460)]  # some of them lose all rows
    return rows


def test_every_conversation_gets_the_cheapest_repair(spark, turns):
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, audit string, c int").repartition(6)
    want = brute(turns)
    got = repair.repair_report(table).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert repair.repair_report(table.limit(0)).collect() == []

    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    told = duck.execute(repair.ORACLE).fetchall()
    assert {r[0]: r[1:] for r in told} == want


def test_repaired_lines_of_undamaged_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "tool", "Answer."), (2, 0, "assistant", "Alone.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "system:Be kind."), (1, 1, "user:Hello."), (1, 2, "assistant:Answer.")]


@pytest.mark.parametrize("seed", range(3))
def test_grammar_does_not_change_a_string(spark, seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choice("abbcil") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rules = repair.re_pair(spark.createDataFrame([(s, 1) for s in strings], "seq string, n long"))
    assert 5 < len(rules) <= repair.RULES
    known, plain = repair.evaluated(rules), repair.symbols()
    for s in strings:
        short = s
        for name, left, right in rules:
            short = short.replace(left + right, name)
        along, along_plain = known[short[0]], plain[s[0]]
        for x in short[1:]:
            along += known[x]
        for x in s[1:]:
            along_plain += plain[x]
        assert repair._row(along) == repair._row(along_plain) and len(short) < len(s) or len(s) < 4
