import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, key int"


def brute(rows, every=97):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        new = [i + 1]
        for j, d in enumerate(y):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def corpus(seed=1):
    rng = random.Random(seed)
    letters = "abcdeé×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ababab", "z" * 70]
    words = []
    for s in stems:
        w = s
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words += [w] * rng.randrange(2, 30)
        words += [s] * rng.randrange(1, 60)
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "1", "Ā"]).join(x.upper() if i % 3 == 0 else x for x in words[i * 20 : i * 20 + 20]), "x", 1) for i in range(len(words) // 20 + 1)]
    return rows + [(500, None, "x", 1), (500, "", "x", 1), (None, rows[0][1], "x", 1), (501, rows[1][1], "x", 1), (501, rows[1][1], "x", 1), (502, "house mouse " * 30_000 + "houses " * 5, "x", 1)]


def found(df, every=97):
    return sorted(tuple(r) for r in S.variants(df, every=every).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    assert sum(r[1] is not None for r in want) > 15 and any(r[1] and r[2] != r[1] for r in want)


def test_damage_of_every_third_run(spark):
    rows = corpus(5)
    assert found(spark.createDataFrame(rows, SCHEMA), every=3) == brute(rows, every=3)


def test_hot_keys_are_halved_between_tasks_and_in_them(spark, monkeypatch):
    """Words of one rare start, whose key holds them all."""
    monkeypatch.setattr(S, "HOT_ROWS", 40)
    monkeypatch.setattr(S, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(S, "BUCKET_ROWS", 100)
    rng = random.Random(3)
    own = {"xq" + "".join(rng.choice("aab") for _ in range(rng.randrange(4, 8))) for _ in range(150)}
    rows = [(i, " ".join([w] * rng.randrange(3, 9)), "x", 1) for i, w in enumerate(sorted(own))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_pivots_are_disjoint_prefix_grams_of_least_cost():
    rng = np.random.default_rng(0)
    w = rng.integers(97, 101, (300, 7)).astype(np.uint8)
    counts = rng.integers(1, 1000, 1 << 16)
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), counts))] = np.arange(1 << 16)
    prefix, pivot = S.chosen(w, counts, rank)
    for i in range(len(w)):
        g = S.grams_of(w[i : i + 1])[0]
        own = [p for p in range(6) if rank[g[p]] <= sorted(rank[g])[2]]
        best = min(counts[g[p]] + counts[g[q]] for p in own for q in own if q - p > 1)
        x, y = np.flatnonzero(pivot[i])
        assert own == np.flatnonzero(prefix[i]).tolist() and y - x > 1 and counts[g[x]] + counts[g[y]] == best


def test_empty_table(spark):
    assert S.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.variants(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).count() == 0
