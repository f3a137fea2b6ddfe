import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "this very line is found in more than a few of the documents"


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["river", "house", "stone", "water", "morning"]) + rng.choice("abcdefgh") + rng.choice("ijklm")
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(5, 120))]
        if i % 10 == 3:
            w += items[i % 5][1].split()
        text = " ".join(w)
        if i % 4 == 1:
            text += "\n" + LONG + " \n" + text[:30]
        docs.append((i, text, "en", "s", len(text)))
    for i in range(10):
        t = docs[i * 3][1].split(" ")
        t[len(t) // 2] = word()
        docs.append((100 + i, " ".join(t), None, "s", 0))
    return docs + [(200, None, None, "s", 0), (201, "12 34", None, "s", 0), (202, docs[7][1], "en", "s", 0), (203, LONG, "en", "s", 0)], items


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  the fixture is ASCII
    holders = {}
    for d, text, *_ in docs:
        for x in text.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    return [(d, "\n".join(x for x in text.split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d), *rest) for d, text, *rest in docs]


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]  # one language: each text with a letter has score 1
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "lines":
            want = brute_lines(want)
        elif name == "near_duplicates":
            kept = test_near_dup.brute([(d[0], d[1], "") for d in want])
            want = [d for d in want if kept[d[0]][2]]
        elif name == "decontamination":
            bad = test_decontaminate.brute([(d[0], d[1], "") for d in want], items)
            want = [d for d in want if not bad[d[0]][3]]
        assert {r.doc_id: r.text for r in df.collect()} == {d[0]: d[1] for d in want}
        seen.append(len(want))
    assert seen[0] == len(docs) - 2 and seen[1] == seen[0] and seen[1] > seen[2] > seen[3]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lengths = out.groupby("doc_id").length.sum().to_dict()
    assert lengths == {d[0]: len(tokenizer.encode(d[1], add_special_tokens=False).ids) + 1 for d in want}


def test_rows_of_null_and_repeated_ids_are_judged_alone(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, near, unlike, alone, none = text(20), text(60), text(50), text(40), text(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        out = stage(spark, spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    # a contaminated row takes no clean one of its id along, and a long clean one doesn't let it through
    long = text(1000)
    clean = [(None, alone), (None, long), (3, unlike), (3, long)]
    assert left(corpus_pipeline.decontamination, [(None, item), (3, item), *clean]) == sorted(clean, key=str)

    # near copies go by themselves; null-id copies and identical rows are reduced to one
    rows = [(1, near), (2, near + " end"), (2, unlike), (5, alone), (5, alone), (None, none), (None, none + " end"), (None, none + " end"), (7, ""), (7, ""), (None, near)]
    out = left(corpus_pipeline.near_duplicates, rows)
    kept = [r for r in out if r[0] is None]
    assert [r for r in out if r[0] is not None] == sorted([(1, near), (2, unlike), (5, alone), (7, ""), (7, "")], key=str)
    assert len(kept) == 1 and kept[0][1].startswith(none)


def test_empty_tables_clashing_columns_and_a_long_text(spark, tmp_path):
    docs, items = corpus()
    long = " ".join(f"{w} stream" for w in docs[0][1].split() * 4000)
    rows = [(*d, 1, "k", 2.0, 3) for d in [*docs[:30], (300, long, "en", "s", 0)]]
    schema = SCHEMA + ", _gone int, key string, score double, n_lines int"
    for name, own in (("full", rows), ("empty", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items if own else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, f"{tmp_path}/full")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "_gone", "key", "score", "n_lines"]
    left = df.collect()
    assert {tuple(r[5:]) for r in left} == {(1, "k", 2.0, 3)} and {r.doc_id: r.text for r in left}[300] == long
    out = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert out.count() == 0 and "sequence_id" in out.columns
