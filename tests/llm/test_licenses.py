import random
import re

import pytest

from ridgeline.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, places int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w = plain_words(text)
    out = []
    for phrase, label in L.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), sorted({x for _, x in out})


def corpus():
    rng = random.Random(4)
    common = "the of and to a in is it this that license public software by cc general gnu mit apache é 4 0".split()
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 80)), "x", 1) for i in range(60)]
    rows += [(100 + k, f"{text(20)}\n{t.text}.\n{text(10)}", "x", 1) for k, t in enumerate(L.TEMPLATES)]
    return rows + [(200, None, "x", 1), (201, "", "x", 1), (202, "Mit-LICENSE, mit license MIT  License", "x", 1), (202, "cc by", "x", 1), (None, "Apache License", "x", 1), (203, "cc " * 5000 + "by " + "x " * 60_000 + L.TEMPLATES[0].text, "x", 1)]


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, L.license_places(df).collect()


def test_base_places_equal_brute_force(found):
    rows, out = found
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((d or -1, *brute_base(t)) for d, t, *_ in rows), key=str)
    assert sum(r.n_base for r in out) > 20 and {x for r in out for x in r.base_labels} == {"gpl", "apache", "cc-by", "mit"}


def test_whole_and_damaged_texts_are_found_and_others_are_not(spark, found):
    rows, out = found
    by = {r.doc_id: r for r in out}
    for k, t in enumerate(L.TEMPLATES):
        assert t.label in by[100 + k].labels and by[100 + k].score > 0.99
        place = next(p for p in by[100 + k].places if p.label == t.label and p.score > 0.99)
        assert abs(place.start - 20) <= L.DRIFT
    assert "mit-text" in by[203].labels
    assert not by[200].labels and not by[201].labels and by[200].score == 0 and by[200].first_word is None

    mit = L.TEMPLATES[0].text.split()
    cut, inserted, shuffled, no_phrase = mit[:], mit[:], mit[:], " ".join(mit).replace("free of charge", "for a fee")
    del cut[30:33]
    inserted[25:25] = ["big", "grey", "elephants"]
    random.Random(1).shuffle(shuffled)
    more = [(1, " ".join(cut), "", 0), (2, " ".join(inserted), "", 0), (3, " ".join(shuffled), "", 0), (4, no_phrase, "", 0), (5, "we sell copies of the software free of charge", "", 0)]
    some = {r.doc_id: r.labels for r in L.license_places(spark.createDataFrame([(10 + d, t, "", 0) for d, t, *_ in rows if d and d < 60] + more, SCHEMA)).where("doc_id < 6").collect()}
    assert some == {1: ["mit-text"], 2: ["mit-text"], 3: [], 4: [], 5: []}


def brute_labels(index, text):
    """All templates at all offsets, without an index: the same rule on dense scans."""
    out = set()
    for k, own in enumerate(index.texts):
        rare = {w for w, p in index.postings.items() if any(x == k for x, _ in p)}
        for low in range(-len(own), len(text)):
            span = range(low, low + L.DRIFT + 1)
            hit = lambda i: any(0 <= i + d < len(text) and text[i + d] == own[i] for d in span)
            if sum(index.weight[w] for i, w in enumerate(own) if w in rare and hit(i)) < index.needed[k] - 1e-9:
                continue
            near = all(any(text[at + d : at + d + len(index.phrases[p])] == index.phrases[p] for d in range(max(-at, low - L.DRIFT), low + 2 * L.DRIFT + 1)) for p, at in index.mandatory[k])
            if near and sum(index.weight[w] for i, w in enumerate(own) if hit(i)) >= L.LEAST_SCORE * index.total[k]:
                out.add(index.labels[k])
    return out


def test_labels_agree_with_scans_of_every_offset(spark):
    rng = random.Random(9)
    rows = [r for r in corpus() if r[1] and len(r[1]) < 4000]
    weight = L.weights(spark.createDataFrame(rows, SCHEMA), L.vocabulary(L.TEMPLATES, L.BASE))
    index = L.Index(weight)
    for k in range(40):
        t = rng.choice(L.TEMPLATES).text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(3)] = rng.choice([[], ["zebra"], ["this", "license"]])
        text = L.words((" ".join(["some", "words"] * rng.randrange(6)) + " " + " ".join(t)).encode())
        got = {x[0] for x in index.scan(text)[1]}
        assert got <= brute_labels(index, text)
        if not rng.randrange(3) or k == 0:
            assert {x[0] for x in index.scan(L.words(rng.choice(L.TEMPLATES).text.encode()))[1]}


def test_empty_table_and_too_many_templates(spark, monkeypatch):
    df = spark.createDataFrame(corpus()[:3], SCHEMA)
    assert L.license_places(df.limit(0)).count() == 0
    monkeypatch.setattr(L, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="more than 10 words"):
        L.license_places(df)
