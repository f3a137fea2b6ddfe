import random
import re
from collections import Counter

import pytest

from ridgeline.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, word string, code int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top=2000):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, text, own, *_ in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = {p: a for p, a in cand.items() if not any(len(q) > len(p) and b >= a and inside(p, q) for q, b in cand.items())}
        found = []
        for p, a in kept.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "a", "né", "x|y", "b", "c"]) if rng.random() < 0.6 else f"w{rng.randrange(40)}"
    hot = "to be or not to be that is"
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) + rng.choice([".", ",", " \t", "\n", "\r\n", " "]) for _ in range(rng.randrange(9))]
        rows.append((i, "".join(parts) + (hot if i % 3 == 0 else ""), rng.choice(["en", "de", None, "und"]), "x", 1))
    return rows + [(900, None, "en", "x", 1), (900, "", None, "x", 1), (None, "the the the the the the", "en", "x", 1), (901, rows[0][1], "en", "x", 1), (902, "to be " * 20_000 + "end", "fr", "x", 1)]


def found(df, least, top=2000):
    return sorted(tuple(r) for r in C.collocations(df, least, top).collect())


@pytest.mark.parametrize("budget", [(1 << 16, 1 << 20), (20, 20)])
def test_equals_brute_force(spark, monkeypatch, budget):
    """Small budgets extend prefixes to all four words and make many groups."""
    monkeypatch.setattr(C, "GROUP_SUFFIXES", budget)
    monkeypatch.setattr(C, "RUN_WORDS", 300)
    rows = corpus()
    want = brute(rows, 5)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), 5) == want
    assert len(want) > 100 and any(len(r[2].split()) == 5 for r in want) and any(r[0] == "und" for r in want)


def test_words_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    rows = corpus(7, 60)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), 4) == brute(rows, 4)


def test_top_cut_in_buckets_and_ties(spark):
    rows = [(i, " ".join(f"p{k} q{k} ." for k in range(50)), "en", "x", 1) for i in range(3)]
    want = brute(rows, 3, 7)
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 7) == want and [r[2] for r in want] == sorted(r[2] for r in want)


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000_000
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    own = [("en", ["a"], 2_000_000_000_000), ("en", ["b"], 1_999_999_999_999), ("en", ["a", "b"], 1_999_999_999_998)]
    r = C.scored(spark.createDataFrame(own, "lang string, words array<string>, f long"), totals).first()
    assert r.score == 1000 * 1_999_999_999_998 * n // (2_000_000_000_000 * 1_999_999_999_999)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA)).count() == 0
