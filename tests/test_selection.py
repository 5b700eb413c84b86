"""Selection in turns against the plain procedure over all items."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest

from wardspark.operators import datasets


def plain(items, target, cap, share=0.35):
    target = min(target, len(items))
    items = [dict(zip(("id", "source", "rule", "weight", "hard"), x)) for x in items]
    quota = round(target * share)
    hard = {x["id"] for x in sorted(items, key=lambda x: (-x["hard"], x["id"]))[:quota] if x["hard"] > 0}
    counts, out = defaultdict(int), []

    def robin(pool, limit, tier):
        by = defaultdict(list)
        for x in sorted(pool, key=lambda x: (-(x["weight"] + x["hard"]), sha256(f"select:{x['id']}".encode()).hexdigest(), x["id"])):
            by[x["source"] or "unknown"].append(x)
        taken = 0
        while taken < limit and any(by.values()):
            for s in sorted(by):
                while by[s] and taken < limit:
                    x = by[s].pop(0)
                    if cap and counts[x["rule"] or ""] >= cap:
                        continue
                    counts[x["rule"] or ""] += 1
                    out.append((x["id"], s, x["rule"] or "", len(out) + 1, tier))
                    taken += 1
                    break

    robin([x for x in items if x["id"] in hard], quota, "hard")
    robin([x for x in items if x["id"] not in hard], target - len(out), "easy")
    robin([x for x in items if x["id"] not in {o[0] for o in out}], target - len(out), "fallback")
    return out


@pytest.mark.parametrize(("n", "target", "cap"), [(300, 40, 3), (300, 40, 0), (50, 80, 2), (200, 100, 1), (5, 3, 4)])
def test_turns(spark, n, target, cap):
    r = random.Random(n + cap)
    items = [(f"i{k:03}", r.choice(["bandit", "semgrep", "x", None, ""]), r.choice(["A", "B", "C", "D", "E", None]), r.randint(1, 3), r.choice([0, 0, 1, 2, 4])) for k in range(n)]
    d = spark.createDataFrame(items, "item_id string, source string, rule_id string, weight int, hardness int").repartition(3)
    got = sorted((tuple(x) for x in datasets.select_round_robin(d, target, cap).collect()), key=lambda x: x[3])
    assert got == plain(items, target, cap)


def test_nothing(spark):
    assert datasets.select_round_robin(spark.createDataFrame([], "item_id string, source string, rule_id string, weight int, hardness int"), 5, 1).count() == 0
