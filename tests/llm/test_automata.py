import random

from ridgeline.llm import automata

SCHEMA = "doc_id long, text string, n_words string"


def held(reference_words, run):
    return any(run == w[i : i + len(run)] for w in reference_words for i in range(len(w) - len(run) + 1))


def brute(text, references, span):
    w, gone = (text or "").split(), set()
    refs = [r.split() for r in references if r]
    for i in range(len(w) - span + 1):
        if held(refs, w[i : i + span]):
            gone.update(range(i, i + span))
    return " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)


def test_spans_are_those_of_all_substrings():
    rng = random.Random(1)
    for _ in range(300):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(3)]
        text = [rng.randrange(3) for _ in range(20)]
        a = automata.Automaton()
        for r in refs:
            a.feed(r)
        a = automata.Automaton.unpacked(a.packed())
        for least in (1, 2, 4):
            got = {i for s, e in a.spans(text, least) for i in range(s, e)}
            want = {j for i in range(len(text) - least + 1) if held(refs, text[i : i + least]) for j in range(i, i + least)}
            assert got == want


def test_both_ways_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "É"]) + str(rng.randrange(50))
    refs = [" ".join(word() for _ in range(rng.choice([5, 6, 7, 30, 80]))) for _ in range(12)] + [None, "", "a1 b2"]
    docs = [(None, None, "x"), (1, "", "x"), (2, " \n", "x")]
    for i in range(60):
        w = [word() for _ in range(rng.randrange(40))]
        own = rng.choice(refs[:12]).split()
        w[rng.randrange(len(w) + 1) : 0] = own[rng.randrange(4) :]
        docs.append((i % 50, rng.choice([" ", "\n", " \t"]).join(w), "x"))
    df, references = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(r,) for r in refs], "text string")
    want = sorted(str((d, *brute(t, refs, 6))) for d, t, _ in docs)
    told = lambda out: sorted(str((r.doc_id, r.text, r.n_words, r.n_removed)) for r in out.collect())
    assert told(automata.strip_references(df, references, 6)) == want
    monkeypatch.setattr(automata, "SHARD_WORDS", 60)
    assert told(automata.strip_references(df, references, 6)) == want
    monkeypatch.setattr(automata, "MOST_WORDS", 10)
    assert told(automata.strip_references(df, references, 6)) == want


def test_no_references_and_empty_table(spark):
    df, none = spark.createDataFrame([(1, "a  b", "x")], SCHEMA), spark.createDataFrame([], "text string")
    assert [r.text for r in automata.strip_references(df, none).collect()] == ["a b"]
    assert automata.strip_references(df.limit(0), none).count() == 0
