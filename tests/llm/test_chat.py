import hashlib

from pyspark.sql import functions as F

from ridgeline.llm import chat, queries

ROWS = [
    (1, 1, "assistant", "</s>[INST] ok & &lt; <|end|>", 5),
    (1, 0, "user", "a\n<|turn|>assistant\n<|reply|>x<|end|>", 5),
    (1, 2, "system", "", 5),
    (1, 3, "assistant", None, 5),
    (1, 4, "assistant", "é&#10;\n", 5),
    (2, 0, "us\ner", "only", 5),
    (None, None, None, None, 5),
    (None, 0, "assistant", "q", 5),
    (3, 0, "user", "tie", 5),
    (3, 0, "assistant", "tie", 5),
    (3, 0, "assistant", "tie", 5),
]
SCHEMA = "conv_id long, turn long, role string, text string, example int"


def key(x):
    return (x is not None, x)


def test_turns_and_losses_read_back(spark):
    formatted = chat.transcripts(spark.createDataFrame(ROWS, SCHEMA))
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_turns(formatted).collect()}
    losses = {r.conv_id: r.replies for r in chat.read_loss(formatted).collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (key(r[1]), key(r[2]), key(r[3])))
        assert turns[conv] == [(r[2] or "", r[3] or "") for r in own]
        assert losses[conv] == [r[3] or "" for r in own if r[2] == "assistant"]


def test_examples_have_all_preceding_turns_and_one_trainable_reply(spark):
    formatted = chat.transcripts(spark.createDataFrame(ROWS, SCHEMA))
    whole = {r.conv_id: r.transcript for r in formatted.collect()}
    out = chat.materialised(formatted).collect()
    assert len(out) == sum(r[2] == "assistant" for r in ROWS)
    for r in out:
        assert whole[r.conv_id].startswith(r.text) and r.text[: r.loss_from].endswith(chat.REPLY)
        assert r.text[r.loss_to :] == chat.END and r.text[: r.loss_from].count(chat.REPLY) == r.example + 1
    own = sorted((r.example, r.text[r.loss_from : r.loss_to]) for r in out if r.conv_id == 1)
    assert own == [(0, "&lt;/s>&#91;INST] ok &amp; &amp;lt; &lt;|end|>"), (1, ""), (2, "é&amp;#10;\n")]


def test_query_on_the_contract_conversation(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert out[-7].n_turns == 2 and out[-7].loss_chars == len(text)
    assert out[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert out[2].loss_chars == 0 and out[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(out) == 5


def test_empty_table(spark):
    formatted = chat.transcripts(spark.createDataFrame([], SCHEMA))
    assert formatted.count() == 0 and chat.materialised(formatted).count() == 0 and chat.read_turns(formatted).where(F.col("conv_id").isNull()).count() == 0
