import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import packing

TEXTS = [None, "", "a", "two words", "x" * 3000, "a  b   c \n\n d", " lead", "trail ", "don't 's 'S it's", "é ñ x   y", "<|endoftext|> a", "b <|endoftext|>", "x<|endoftext|><|endoftext|>  y <|endoftext|",  "\n\n\n", "tab\t x \r\n y", "１２ 12 ½ a1b2", "word " * 5000, "same", "same"]


def tokens(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def docs(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string")


def test_pieces_equal_whole_encodings(spark):
    out = packing.pack(docs(spark)).toPandas()
    for i, text in enumerate(TEXTS):
        own, ids = out[out.doc_id == i].sort_values("piece"), tokens(text)
        assert own.length.sum() == len(ids) and (own.length <= 2048).all()
        assert (own.length.iloc[1:] == 2048).all() and list(own.start) == [0, *np.cumsum(own.length)[:-1]]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_added_tokens_have_their_own_ids():
    assert tokens("a <|endoftext|> b").count(50256) == 1


def test_bins_are_gapless_and_few(spark):
    out = packing.pack(docs(spark).unionAll(docs(spark).withColumn("doc_id", F.col("doc_id") + 100))).toPandas()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert out.sequence_id.nunique() == -(-out.length.sum() // 2048)


def test_repeated_rows_and_empty_table(spark):
    twice = docs(spark).unionAll(docs(spark)).unionAll(spark.createDataFrame([(None, "no id", "")], "doc_id long, text string, sequence_id string"))
    out = packing.pack(twice).toPandas()
    assert not out.duplicated(["sequence_id", "offset"]).any() and out.doc_id.isna().sum() == 1
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_plan_fills_what_the_longest_first_rule_would_not():
    assert packing.plan({6: 1, 5: 2, 3: 1, 4: 1}, 10) == [([6, 4], 1), ([5, 5], 1), ([3], 1)]
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 2049, 20000), return_counts=True), strict=True)}
    bins = packing.plan(counts)
    used = {}
    for filling, times in bins:
        assert sum(filling) <= 2048
        for x in filling:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.02 * sum(k * n for k, n in counts.items()) / 2048
