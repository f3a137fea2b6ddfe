import math
import random
import zlib

from pyspark.sql import functions as F

from ridgeline.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the of and to in that is was for with this from they have house water river morning people small".split()
DE = "der die und das nicht mit sich auch auf für wasser haus leute morgen fluß klein über schön werden".split()
FR = "le la les des et dans pour que avec une maison eau rivière matin gens petite être déjà où cette".split()


def corpus(n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang, words = rng.choice([("en", EN), ("de", DE), ("fr", FR)])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))).title(), lang if i % 9 else None, "x"))
    return rows


def model(spark):
    return langid.fit(langid.training(spark.createDataFrame(corpus(), SCHEMA)))


def test_held_out_accuracy_and_scores(spark):
    df = spark.createDataFrame(corpus(300, 2), SCHEMA)
    out = langid.predicted(df, model(spark)).where(F.col("lang").isNotNull()).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_unseen_words_back_off_to_character_grams(spark):
    m = model(spark)
    df = spark.createDataFrame([(1, "Hausflußmorgen", None, ""), (2, "rivièrette maisonnée", None, ""), (3, "waterhouse smallest", None, "")], SCHEMA)
    assert "hausflußmorgen" not in m.words
    assert {r.doc_id: r.lang_pred for r in langid.predicted(df, m).collect()} == {1: "de", 2: "fr", 3: "en"}


def test_counts_equal_a_plain_count(spark):
    from collections import Counter

    rows = corpus(60)
    got = {(r.lang, r.word): r.n for r in langid.word_counts(spark.createDataFrame(rows, SCHEMA).where("lang IS NOT NULL").repartition(3)).collect()}
    assert got == Counter((lang, w) for _, t, lang, _ in rows if lang for w in t.lower().split())
    grams = {(r.lang, r.word): r.n for r in langid.gram_counts(spark.createDataFrame([("x", "ab", 2), ("x", "abc", 1)], "lang string, word string, n long")).collect()}
    assert grams[("x", " ab")] == 3 and grams[("x", "b ")] == 2 and grams[("x", " abc ")] == 1 and grams[("x", " ")] == 6


def test_the_sample_is_dealt_to_all_languages_and_keeps_their_words(spark):
    """Rare languages keep all rows, large ones about their share; no word of a sampled row is dropped."""
    rows = [(i, f"aa{i}", "big") for i in range(3000)] + [(i, f"bb{i} bb{i + 1}", "small") for i in range(5000, 5040)] + [(i, f"w{i} common", f"l{i}") for i in range(6000, 6300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.sampled(df, 1000).groupBy("lang").count().collect()
    n = {r.lang: r["count"] for r in got}
    assert n["small"] == 40 and len(n) == 302 and 550 < n["big"] < 770
    m = langid.fit(df, 1000)
    assert len(m.languages) == 302
    out = {r.doc_id: r.lang_pred for r in langid.predicted(df.where("lang <> 'big'").withColumn("text", F.regexp_replace("text", "[0-9]", "")), m).collect()}
    assert out[5000] == "small" and len(out) == 340


def plainly_predicted(rows, labelled):
    """Word-first backoff as its description has it, word by word."""
    from collections import Counter, defaultdict

    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, lang, _ in labelled:
        for w in langid.words_of(text or ""):
            words[lang][w] += 1
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    grams[lang][k][f" {w} "[i : i + k]] += 1
    langs = sorted(words)
    out = {}
    for doc, text, _, _ in rows:
        own = langid.words_of(text or "")
        if not own:
            out[doc] = ("und", 0.0)
            continue
        total = dict.fromkeys(langs, 0.0)
        for w in own:
            parts = []
            if any(w in words[x] for x in langs):
                parts.append((w, 0))
            else:
                at, m = 0, f" {w} "
                while at < len(m):
                    k = next((k for k in range(min(5, len(m) - at), 0, -1) if any(m[at : at + k] in grams[x][k] for x in langs)), 0)
                    if k:
                        parts.append((m[at : at + k], k))
                    at += k or 1
            for x in langs:
                for p, k in parts:
                    table = grams[x][k] if k else words[x]
                    total[x] += math.log((table[p] + 0.1) / (sum(table.values()) + 1))
        best = max(langs, key=lambda x: total[x])
        out[doc] = (best, 1 / sum(math.exp((total[x] - total[best]) / math.sqrt(len(own))) for x in langs))
    return out


def test_predictions_equal_a_plain_version(spark):
    rng = random.Random(3)
    twisted = [(1000 + i, " ".join("".join(rng.sample(w, len(w))) for w in t.split()[:9]), None, "x") for i, t, _, _ in corpus(60, 5)]
    rows = corpus(150, 4) + twisted + [(2000, "½ ²", None, "x"), (2001, "Ⅷ ۱۲ ́", None, "x"), (2002, "漢字 हिन्दी 𐐷𐐨", None, "x"), (2003, "Ħ", None, "x")]
    labelled = [r for r in corpus() if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = plainly_predicted(rows, labelled)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(spark.createDataFrame(rows, SCHEMA), model(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_words_are_letters_and_their_marks():
    assert langid.words_of("½ ² Ⅷ ۱ _ ́ 3") == []
    assert langid.words_of("हिन्दी Été2x naïve 𐐀𐐨b") == ["हिन्दी", "été", "x", "naïve", "𐐨𐐨b"]


def test_undetermined_texts_null_columns_and_empty_tables(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 !? _", None, None), (None, "the water", "en", "x"), (4, "the water", None, "x"), (4, "the water", None, "x"), (5, "the " * 200000, "en", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.predicted(df, model(spark)).collect()
    assert len(out) == 7 and all((r.lang_pred, r.score) == ("und", 0) for r in out if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "en" for r in out if r.doc_id not in (1, 2, 3))
    nothing = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predicted(df, nothing).collect()} == {"und"}
    assert langid.predicted(df.limit(0), nothing).count() == 0


def test_query_learns_from_the_right_rows_only(spark, tmp_path):
    rows = corpus()
    poison = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "x") for i, t, lang, _ in rows]
    spark.createDataFrame(poison, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op1_language_id(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and "zz" not in {r.lang_pred for r in out.values()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
