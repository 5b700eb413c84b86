import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from wardspark.llm import q11_structure, structure

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", None, "", "admin", "User"]
TEXTS = ["Yes.", "no", "", None, " \t\n", "What? ", "and then\n", "é!", "Yes.", "so", "...", " "]
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def cheapest(rows):
    """(cost, audit, roles) of the cheapest edits, from the end backwards over all edits, by the pattern's automaton:
    rows are (initial, fault); states are what has been said so far."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for r in "ua":
                if (state, r) in after:
                    c, a, e = best(i, after[state, r], inserts + 1)
                    found.append((c + 2, "I" + a, (("I", r), *e)))
        if i < len(rows):
            initial, fault = rows[i]
            c, a, e = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, (("D", ""), *e)))
            if fault not in ("blank", "duplicate"):
                for edit, r, price in [("K", initial, 0), ("R", "u", 2), ("R", "a", 2)]:
                    if (state, r) in after:
                        c, a, e = best(i + 1, after[state, r], 0)
                        found.append((c + price + (fault == "truncated"), edit + a, ((edit, r), *e)))
        return min(found, default=(1 << 30, "", ()))

    return best(0, "", 0)


def want(turns):
    """The contract, row by row."""
    out = {}
    for c in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in (t for t in turns if t[0] == c):
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn is not None, turn or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        rows.sort()
        seen, kinds = set(), []
        for _, _, role, text in rows:
            bare = text.rstrip("".join(structure.BLANKS))
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for there, t, *_ in rows if there]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, edits = cheapest(tuple((r[2][:1], k) for r, k in zip(rows, kinds)))
        left, at = [], iter(rows)
        for e, r in edits:
            row = next(at) if e != "I" else None
            if e != "D":
                left.append((row[2] if e == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + (row[3] if row else ""))
        out[c] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def turns(n=250, seed=2, most=9):
    r = random.Random(seed)
    out = [(c, r.choice([None, k, k, k, k + r.randint(0, 4)]), r.choice(ROLES[:3] * 3 + ROLES), r.choice(TEXTS[:3] * 2 + TEXTS)) for c in range(n) for k in range(r.randint(1, most))]
    return out + [(None, k, "user", f"q{k}?") for k in range(5)] + [out[3]] * 3


def got(d):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in q11_structure.repairs(d).collect()}


def test_program_against_all_edits():
    """All conversations of up to three turns, and many longer ones: price, audit and roles."""
    kinds = list(product("suat", ("", "truncated", "blank")))
    r = random.Random(1)
    some = [t for n in range(4) for t in product(kinds, repeat=n)] + [tuple(r.choice(kinds) for _ in range(r.randint(4, 30))) for _ in range(1500)]
    for rows in some:
        c = structure.Conversation()
        for initial, fault in rows:
            c.add(structure.INITIALS.get(initial, structure.NONE), fault or None)
        cost, edits = c.edits()
        best = cheapest(rows)
        assert (cost, "".join(e[0] for e in edits)) == best[:2] and sum(e[3] for e in edits) == cost, rows
        roles = "".join(e[2][0] if e[2] else rows[e[1]][0] for e in edits if e[0] != "D")
        assert re.fullmatch("(s?(ua)+)?", roles) and roles == "".join(x for e, x in best[2] if e != "D")


def test_steps_are_few():
    structure._step.cache_clear()
    test_program_against_all_edits()
    assert structure._step.cache_info().currsize < 3000


@pytest.mark.parametrize("more", [(), ("pos", "fault", "edit", "step", "cost", "again", "initial", "illegal", "fresh", "copy", "_conv", "_role", "audit")])
def test_repairs(spark, more):
    t = turns()
    d = spark.createDataFrame(t, SCHEMA).repartition(5).select("*", *[F.lit("own").alias(c) for c in more])
    assert got(d) == want(t)


def test_long_conversation_and_text(spark):
    r = random.Random(8)
    t = [(1, k, r.choice(ROLES[:3]), f"{k}{r.choice(['.', '', '?'])}") for k in range(3000)] + [(2, 0, "user", "x" * 1_000_000), (2, 1, "assistant", "é " * 300_000 + "!")]
    g = got(spark.createDataFrame(t, SCHEMA))
    c = structure.Conversation()
    for row in sorted(structure.faults(q11_structure.damaged(spark.createDataFrame(t, SCHEMA).where("conv_id = 1"))).collect(), key=lambda x: x.pos):
        c.add(structure.INITIALS[row.role[0]], row.fault)
    assert g[1][5:7] == (c.edits()[0], "".join(e[0] for e in c.edits()[1])) and g[2] == want(t[-2:])[2]


def test_repaired_turns(spark):
    t = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", ""), (1, 3, "tool", "Then."), (2, 0, "system", "Be."), (3, 0, "user", " ")]
    rows = sorted(tuple(r) for r in structure.repaired(spark.createDataFrame(t, SCHEMA)).collect())
    assert rows == [(1, 0, "K", "user", "Hi."), (1, 3, "R", "assistant", "Then.")]
    assert structure.edits(structure.faults(spark.createDataFrame(t, SCHEMA))).where("conv_id > 1").selectExpr("min(edit)", "max(edit)").first() == ("D", "D")


def test_nothing(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert q11_structure.repairs(d).count() == 0 and structure.repaired(d).count() == 0
