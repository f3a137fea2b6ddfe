"""Language ID by word-first backoff.

A word that the model knows scores its log frequency in each language. A word that it doesn't know is cut, from its
start on, into the longest character n-grams that it knows (of at most five characters, word edges marked), each
scoring its log frequency in each language. The language of the largest sum wins; the score is its share in the softmax of
the sums, tempered by text length.

A model is fitted on a bounded sample of labelled rows: ``ROWS`` in all, dealt evenly to the languages, those of a language
chosen by a hash of doc_id and text; a language with fewer rows has all of them. Every word and n-gram of the sample is
kept, with the languages that it occurs in, so the model's size follows the sample, whatever the number of languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned;
ties go to the language that sorts first; rows without a language, a text or a doc_id teach nothing; repeated rows count
each; words are runs of letters and the marks that follow them, lower-cased, so numerals and marks alone are no words; texts of
any length are read whole; an empty table gives no row; other columns pass through ``predicted``, whatever their names, and
columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.texts import column, forget, pieces, plus, strings
from ridgeline.sources.stage import stored

UNKNOWN = "und"
LONGEST = 5
#: Labelled rows that a model is fitted on at the most, in all languages together.
ROWS = 10_000
#: Words that a task counts before it passes its counts on.
FLUSH = 100_000
#: Words whose scores a worker keeps, and words looked up at once.
KEPT, PART = 125_000, 25_000


def runs(codes: Iterable[int]) -> str:
    """Code points as the ranges of a character class."""
    out = []
    for _, own in groupby(enumerate(codes), lambda e: e[1] - e[0]):
        own = [c for _, c in own]
        out.append(f"{re.escape(chr(own[0]))}-{re.escape(chr(own[-1]))}")
    return "".join(out)


def word_pattern(codes: range) -> re.Pattern:
    """A letter, then letters and marks, among these code points."""
    kinds = [(c, unicodedata.category(chr(c))[0]) for c in codes]
    letters = runs(c for c, k in kinds if k == "L")
    return re.compile(f"[{letters}][{runs(c for c, k in kinds if k in 'LM')}]*")


#: For texts of ASCII, of the basic plane and of any characters: the smaller sets are searched faster.
PATTERNS: dict[int, re.Pattern] = {}


def words_of(text: str) -> list[str]:
    top = 0x80 if text.isascii() else 0x10000 if max(text) < "\U00010000" else 0x110000
    if top not in PATTERNS:
        PATTERNS[top] = word_pattern(range(top))
    return PATTERNS[top].findall(text.lower())


def training(docs: DataFrame) -> DataFrame:
    """The labelled rows that may teach: crc32 of the id as text, modulo 4, isn't 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out(F.col("doc_id")) == F.lit(False)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own: dict[str, Counter] = defaultdict(Counter)

        def told() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in own.items() for w, n in c.items()]
            lang, word, n = zip(*rows, strict=True) if rows else ((),) * 3
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in pieces(batches, most=1 << 20):
            for lang, text in zip(column(batch, "lang").to_pylist(), strings(batch, "text"), strict=True):
                own[lang].update(words_of(text))
            if sum(map(len, own.values())) > FLUSH:
                yield told()
                own.clear()
        yield told()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, size, word (an n-gram of the marked word), n."""
    marked = words.select("lang", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"), "n")
    sizes = marked.select("lang", "w", "n", F.explode(F.expr(f"sequence(1, least({LONGEST}, length(w)))")).alias("size"))
    return sizes.select("lang", "size", "n", F.explode(F.expr("transform(sequence(1, length(w) - size + 1), i -> substr(w, i, size))")).alias("word")).groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of words and n-grams.

    Each has the languages that it occurs in and what it adds there to the log frequency of one never seen: all words share a
    base, and so do all n-grams of a size (``base``). It is sent as two texts of lines and arrays; a worker makes the look-up
    tables from them.
    """

    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table):
        self.languages = languages
        coded = [t["word"].combine_chunks().dictionary_encode() for t in (words, grams)]
        own, parts = (c.dictionary.to_pylist() for c in coded)
        row = np.concatenate([coded[0].indices.to_numpy(zero_copy_only=False), len(own) + coded[1].indices.to_numpy(zero_copy_only=False).astype(np.int64)])
        place = {x: i for i, x in enumerate(languages)}
        lang = np.array([place[x] for t in (words, grams) for x in t["lang"].to_pylist()], np.int64)
        n = np.concatenate([t["n"].to_numpy() for t in (words, grams)])
        length = np.concatenate([np.zeros(len(own), np.int64), pc.utf8_length(pa.array(parts, pa.string())).to_numpy(zero_copy_only=False)])
        size = np.zeros((LONGEST + 1, len(languages)))
        np.add.at(size, (length[row], lang), n)
        self.base = np.log(0.1 / (size + 1))
        order = np.argsort(row, kind="stable")
        self.lang, self.extra = lang[order].astype(np.int32), np.log1p(10 * n[order]).astype(np.float32)
        self.ends = np.cumsum(np.bincount(row, minlength=len(length)))
        self.sent = "\n".join(own), "\n".join(parts)
        self._tables()

    def _tables(self) -> None:
        own, parts = (x.split("\n") if x else [] for x in self.sent)
        self.words = dict(zip(own, range(len(own)), strict=True))
        self.grams = dict(zip(parts, range(len(own), len(own) + len(parts)), strict=True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "grams")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tables()

    def parts(self, word: str) -> list[tuple[int, int]]:
        """(row, base) of the word if it is known, else of the longest n-grams that are."""
        if (known := self.words.get(word)) is not None:
            return [(known, 0)]
        w, at, out = f" {word} ", 0, []
        while at < len(w):
            for k in range(min(LONGEST, len(w) - at), 0, -1):
                if (known := self.grams.get(w[at : at + k])) is not None:
                    out.append((known, k))
                    break
            else:
                k = 1
            at += k
        return out


def sampled(labelled: DataFrame, rows: int = ROWS) -> DataFrame:
    """lang and text of about ``rows`` rows at the most, dealt evenly to the languages."""
    counts = sorted((r.n, r.lang) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    shares, left = [], rows
    for i, (n, lang) in enumerate(counts):
        take = min(n, max(1, left // (len(counts) - i)))
        left -= take
        shares.append((lang, 2.0 if take == n else take / n))
    shares = labelled.sparkSession.createDataFrame(shares, T.StructType([T.StructField("_lang", T.StringType()), T.StructField("_share", T.DoubleType())]))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    return labelled.select("doc_id", "lang", "text").join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(place < F.col("_share")).select("lang", "text")


def fit(labelled: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` rows of ``labelled`` (doc_id, lang, text)."""
    words = stored(word_counts(sampled(labelled, rows)), "word-counts")
    own, grams = words.toArrow(), gram_counts(words).toArrow()
    return Model(sorted(set(own["lang"].to_pylist())), own, grams)


class Rows(dict):
    """Places of words in tables of what they add by language and of the bases that they use, worked out once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.kinds = np.zeros((KEPT, LONGEST + 1), np.int32)
        self.ends = np.zeros(KEPT + 1, np.int64)
        self.lang, self.extra = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.float32)

    def __missing__(self, word: str) -> int:
        m, k = self.model, len(self)
        parts = m.parts(word)
        spans = [slice(m.ends[r - 1] if r else 0, m.ends[r]) for r, _ in parts]
        lang = np.concatenate([np.zeros(0, np.int32), *(m.lang[s] for s in spans)])
        extra = np.concatenate([np.zeros(0, np.float32), *(m.extra[s] for s in spans)])
        if len(parts) > 1:
            total = np.bincount(lang, extra, len(m.languages))
            lang = np.flatnonzero(total)
            extra = total[lang]
        self.kinds[k] = np.bincount([b for _, b in parts], minlength=LONGEST + 1) if parts else 0
        at = self.ends[k]
        to = self.ends[k + 1] = at + len(lang)
        if to > len(self.lang):
            self.lang, self.extra = (np.concatenate([x, np.zeros(max(len(x), len(lang)), x.dtype)]) for x in (self.lang, self.extra))
        self.lang[at:to], self.extra[at:to] = lang, extra
        self[word] = k
        return k

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Texts x languages: the summed log frequencies of each text's words."""
        d, n = len(texts), len(self.model.languages)
        flat, owner = list(chain.from_iterable(texts)), np.repeat(np.arange(d), [len(w) for w in texts])
        out, kinds = np.zeros(d * n), np.zeros((d, LONGEST + 1))
        for at in range(0, len(flat), PART):
            part, own = flat[at : at + PART], owner[at : at + PART]
            if len(self) + len(part) > KEPT:
                self.clear()
            place = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            first = self.ends[place]
            many = self.ends[place + 1] - first
            entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out += np.bincount(np.repeat(own, many) * n + self.lang[entry], self.extra[entry], d * n)
            whole = self.kinds[place, 0]
            kinds[:, 0] += np.bincount(own, whole, d)
            cut = np.flatnonzero(whole == 0)
            for k in range(1, LONGEST + 1) if len(cut) else ():
                kinds[:, k] += np.bincount(own[cut], self.kinds[place[cut], k], d)
        return out.reshape(d, n) + kinds @ self.model.base


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only ``text`` is read for them."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    schema = plus(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = Rows(kept.value)
        names = np.array([*kept.value.languages, UNKNOWN], object)
        last = len(names) - 1
        for batch in pieces(batches, most=2 << 20):
            words = [words_of(t) if t else [] for t in strings(batch, "text")]
            long = np.array([len(w) for w in words])
            best, share = np.full(len(words), last), np.zeros(len(words))
            if last and long.any():
                total = rows.sums(words)
                top = total.max(1, keepdims=True)
                told = long > 0
                best[told] = total.argmax(1)[told]
                share[told] = (1 / np.exp((total - top) / np.sqrt(np.maximum(long, 1))[:, None]).sum(1))[told]
            new = {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(share, pa.float64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else column(batch, f.name) for f in schema.fields], [f.name for f in schema.fields])

    return docs.mapInArrow(predict, schema)
