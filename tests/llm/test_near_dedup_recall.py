"""The near-dedup of the pipeline against all pairs of the driver's documents: none is false, few are missed."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from wardspark.llm import similar
from wardspark.llm.stage import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def pairs(sets):
    """Pairs of different sets of a Jaccard similarity of 0.8 or more, by counting what they share."""
    of, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            of[x].append(k)
    for ks in of.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def copies(rows):
    """Texts of the documents again, with words changed at so many places that about 0.8 to 0.97 of the shingles stay."""
    r = random.Random(11)
    for i, t in rows:
        words = re.split(r"([\x20\x09-\x0D]+)", t)
        n = (len(words) + 1) // 2
        if n >= 60 and i % 3 == 0:
            for k in r.sample(range(n), max(1, int(n * r.uniform(0.005, 0.022)))):
                words[2 * k] = f"edit{r.randint(0, 10**9)}"
            yield 100_000 + i, "".join(words)


def test_recall_on_the_documents(spark):
    """Links between the driver's documents, and to edited copies of a third of them."""
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    more = list(copies(rows))
    rows += more
    ids = defaultdict(list)
    for i, t in rows:
        ids[shingles(t)].append(i)
    sets = list(ids)
    true = pairs(sets)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(len({got[i] for i in same}) == 1 for same in ids.values())  # equal sets are always together
    found = {p for p in true if got[ids[sets[p[0]]][0]] == got[ids[sets[p[1]]][0]]}
    near = [p for p, j in true.items() if j < 0.85]
    assert len(true) > 150 and len(near) > 20 and len(found) >= 0.95 * len(true) and len(found & set(near)) >= 0.9 * len(near)
    # what is together is joined by true links
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in true:
        root[top(a)] = top(b)
    by = defaultdict(set)
    for k, s in enumerate(sets):
        by[got[ids[s][0]]].add(top(k))
    assert all(len(tops) == 1 for tops in by.values())
