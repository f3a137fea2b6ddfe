"""The operators of this subpackage applied to whole tables, and oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import chat, collocations, decontaminate, gif, langid, licenses, line_dedup, near_dup, packing, secrets, spelling, substrings, url_filter
from ridgeline.sources.stage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predicted(docs.select("doc_id", "text"), langid.fit(langid.training(docs)))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_within(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.payload_features(gif.media(table(spark, sf_dir, "documents")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = stored(chat.transcripts(every), "transcripts")
    examples = stored(chat.examples(formatted), "examples")
    replies = examples.groupBy(F.col("conv_id").alias("_conv")).agg(F.sort_array(F.collect_list(F.struct("example", chat.restored(F.col("target")).alias("reply")))).alias("replies"))
    both = chat.read_turns(formatted).join(replies, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.coalesce(F.array_join("replies.reply", ""), F.lit(""))
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("transcript").cast("long").alias("formatted_chars"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.fit(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    base = F.sha2(told(F.filter("spans", lambda s: s["kind"] != "model")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), told("spans").alias("spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_places(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", told("base_labels"), told("labels"), "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{decontaminate.WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{decontaminate.WORD}') AS w FROM benchmark),
items AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS key
          FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 13) AS k FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT k FROM items),
probes AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM probes JOIN items USING (k, key)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

PLAIN_WORD = r"[^\x20\x09-\x0D]+"

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{PLAIN_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

OP7_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

# '&' and '[' gain four characters each when escaped, '<' three, a line end in a role four.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN_WORD}') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(role) + length(text) + 4 * length(regexp_replace(role || text, '[^&[]', '', 'g')) + 3 * length(regexp_replace(role || text, '[^<]', '', 'g'))
             + 4 * length(regexp_replace(role, '[^' || chr(10) || ']', '', 'g'))
             + length('<|turn|>') + 1 + length('<|end|>') + CASE WHEN role = 'assistant' THEN length('<|reply|>') ELSE 0 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
v AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
own AS (SELECT a.* FROM v a WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM v WHERE k > 2) b WHERE b.lang = a.lang AND b.phrase = a.phrase AND b.f >= a.f)),
cuts AS (SELECT lang, phrase, f, c, array_to_string(w[1:c], ' ') AS h, array_to_string(w[c + 1:k], ' ') AS t FROM (SELECT *, unnest(range(1, k)) AS c FROM own)),
z AS (SELECT x.lang, x.phrase, x.f AS a, h.f AS l, t.f AS r, n.n, c, (1000::HUGEINT * x.f * n.n // (h.f::HUGEINT * t.f))::BIGINT AS score
      FROM cuts x JOIN v h ON h.lang = x.lang AND h.phrase = x.h JOIN v t ON t.lang = x.lang AND t.phrase = x.t JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_gif_media": op5_gif_media,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_secret_scan": op10_secret_scan,
    "op11_license_scan": op11_license_scan,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
