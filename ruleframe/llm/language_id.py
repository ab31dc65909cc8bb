"""Language identification by prediction by partial matching.

For every language a context tree over bytes of depth ``order`` (4) is counted, and frozen: each context gives the bytes seen after
it count / (total + distinct), and escapes to the next shorter context with distinct / (total + distinct), down to a uniform
choice. Counted are the whole texts of a bounded sample of labelled rows for each language. What a language has seen is held as sorted lists of code lengths and of costs of escape, so a text's code length under
a language is an exact sum of look-ups over all its bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import bound_batches, in_slices, tidy

#: All byte values are symbols of their own.
SYMBOLS = 256
#: Symbol 0 stands before a text; a byte of 0 takes the place of an A, which lower-casing leaves unused.
PLACES = np.where(np.arange(SYMBOLS) == 0, ord("A"), np.arange(SYMBOLS))
#: The longest code of a byte.
LONGEST = -np.log(1e-12)
#: Rows of a language that its model is fitted on, about and at most in the mean; a language of fewer rows gives all.
SAMPLE = 1_000


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each position, its symbol and the ``order`` before it as one integer; the text starts after symbols 0."""
    padded = np.concatenate([np.zeros(order, dtype=np.int64), symbols])
    code = np.zeros(len(symbols), dtype=np.int64)
    for k in range(order + 1):
        code = code * SYMBOLS + padded[k : k + len(symbols)]
    return code


class Listed:
    """Values by (code, language), of the pairs that occur."""

    def __init__(self, codes: np.ndarray, langs: np.ndarray, values: np.ndarray):
        """The pairs are distinct and sorted."""
        self.codes, starts = np.unique(codes, return_index=True)
        self.starts, self.langs, self.values = np.append(starts, len(codes)), langs.astype(np.int32), values.astype(np.float32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ``codes``, language, value) of all their pairs."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        rows = np.flatnonzero(self.codes[at] == codes) if len(self.codes) else np.zeros(0, dtype=np.int64)
        lo = self.starts[at[rows]]
        n = self.starts[at[rows] + 1] - lo if len(rows) else lo
        entries = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(rows, n), self.langs[entries], self.values[entries]


def levels_of(codes: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: int, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of (order + 1)-grams by code and language -> those of the 1-grams, 2-grams, ... up to them, in order of (code, language)."""
    out = []
    for k in range(order + 1):
        pairs, at = np.unique(codes % SYMBOLS ** (k + 1) * languages + langs, return_inverse=True)
        out.append((pairs // languages, pairs % languages, np.bincount(at, weights=counts, minlength=len(pairs))))
    return out


class CodeLengths:
    """The frozen trees of all languages; ``[codes]`` gives nats, (grams, languages)."""

    def __init__(self, codes: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: int, order: int):
        """``counts`` of (order + 1)-grams by code and language."""
        self.languages, self.levels, below = languages, [], None
        for k, (code, lang, n) in enumerate(levels_of(codes, langs, counts, languages, order)):
            contexts, at = np.unique(code // SYMBOLS * languages + lang, return_inverse=True)
            total, distinct = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            escape = np.where(distinct == SYMBOLS, 0, distinct)
            # what the shorter context says, without the bytes that the longer one has seen; what a gram ends in was seen as well
            shorter = np.full(len(code), 1 / SYMBOLS) if below is None else below[1][np.searchsorted(below[0], code % SYMBOLS**k * languages + lang)]
            left = 1 - np.bincount(at, weights=shorter, minlength=len(contexts))
            p = n / (total + escape)[at]
            step = escape / (total + escape) / np.maximum(left, 1e-15)
            self.levels.append((Listed(contexts // languages, contexts % languages, -np.log(np.maximum(step, 1e-300))), Listed(code, lang, -np.log(p))))
            below = code * languages + lang, p

    def __getitem__(self, key) -> np.ndarray:
        if isinstance(key, tuple):
            return self[key[0]][:, key[1]]
        out = np.full((len(key), self.languages), np.log(SYMBOLS), dtype=np.float32)
        for k, (escapes, seen) in enumerate(self.levels):
            code = key % SYMBOLS ** (k + 1)
            row, lang, nats = escapes.find(code // SYMBOLS)
            out[row, lang] += nats
            row, lang, nats = seen.find(code)
            out[row, lang] = nats
        return np.minimum(out, np.float32(LONGEST))


class Remembered:
    """Rows of ``table`` for sorted distinct grams; those of grams met before are remembered, up to ``most`` values."""

    def __init__(self, table: CodeLengths, most: int = 1 << 21):
        self.table, self.most = table, most
        self.forget()

    def forget(self) -> None:
        self.codes, self.rows = np.zeros(0, dtype=np.int64), np.zeros((0, self.table.languages), dtype=np.float32)

    def new(self, known: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.ones(len(known), dtype=bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, known), len(self.codes) - 1)] != known

    def __getitem__(self, known: np.ndarray) -> np.ndarray:
        new = self.new(known)
        if (len(self.codes) + int(new.sum())) * self.table.languages > self.most:
            self.forget()
            new = self.new(known)
        if new.any():
            codes = np.concatenate([self.codes, known[new]])
            order = np.argsort(codes, kind="stable")
            self.codes, self.rows = codes[order], np.concatenate([self.rows, self.table[known[new]]])[order]
        return self.rows[np.searchsorted(self.codes, known)]


def code_lengths(counts: np.ndarray, order: int) -> np.ndarray:
    """``counts`` of all (order + 1)-grams of one language -> nats for each of them under the frozen tree."""
    codes = np.flatnonzero(counts)
    return CodeLengths(codes, np.zeros(len(codes), dtype=np.int64), counts[codes], 1, order)[np.arange(len(counts))].ravel()


def some_of_each(rows: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The languages in order, and about ``sample`` rows of each, chosen by the hash of their text; all rows of smaller languages."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > sample:
            share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
    return sorted(sizes), rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))


def fit(rows: DataFrame, order: int = 4, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, CodeLengths]:
    """``rows(text, lang)`` without nulls -> all languages in order, symbols of the bytes, code lengths by gram and language.

    What reaches the driver is one count per language and gram that occurs in its ``sample`` rows."""
    bound_batches(rows.sparkSession)
    langs, rows = some_of_each(rows, sample)
    symbols, place = PLACES, {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        held = 0

        def drain() -> pa.RecordBatch:
            parts = []
            for k, codes in found.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                parts.append((np.full(len(code), k), code.astype(np.int64), n))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["lang", "code", "n"])

        for batch in in_slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    codes = grams(symbols[np.frombuffer(text.encode().lower(), dtype=np.uint8)], order)
                    found.setdefault(place[lang], []).append(codes)
                    held += len(codes)
                if held > 2_000_000:
                    yield drain()
                    held = 0
        if found:
            yield drain()

    counts = rows.select("text", "lang").mapInArrow(tidy(run), "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    return langs, symbols, CodeLengths(*(found.column(x).to_numpy() for x in ("code", "lang", "n")), max(len(langs), 1), order)


def predict(docs: DataFrame, langs: list[str], symbols: np.ndarray, table: CodeLengths, order: int = 4) -> DataFrame:
    """``docs`` and columns ``lang_pred`` and ``score``, from column ``text`` alone. Columns of ``docs`` with these names give way."""
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score", "__letter")
    model = docs.sparkSession.sparkContext.broadcast((symbols, table))  # 16 bytes for each language and gram, at all lengths, that occurs in the sample
    stretch = max(1 << 12, (1 << 20) // max(len(langs), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, table = model.value
        table = Remembered(table)

        def nats(texts: list[np.ndarray]) -> np.ndarray:
            """(texts, languages): code lengths. Grams of all texts are looked up once for each stretch of bytes; a text may go over several."""
            codes, owner = np.concatenate([grams(t, order) for t in texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            out = np.zeros((len(texts), len(langs)))
            for lo in range(0, len(codes), stretch):
                part, whose = codes[lo : lo + stretch], owner[lo : lo + stretch]
                known, at = np.unique(part, return_inverse=True)
                first = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
                out[whose[first]] += np.add.reduceat(table[known][at], first, axis=0, dtype=np.float64)
            return out

        for batch in in_slices(batches, most_bytes=500_000):
            letters = batch.column("__letter").to_numpy(zero_copy_only=False)
            preds, scores, at = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.flatnonzero(letters) if langs else []
            if len(at):
                texts = [symbols[np.frombuffer(x.encode().lower(), dtype=np.uint8)] for x in batch.column("text").take(pa.array(at)).to_pylist()]
                total = nats(texts)
                best = total.argmin(1)
                scores[at] = 1 / np.exp(np.maximum(total[np.arange(len(at)), best][:, None] - total, -700)).sum(1)
                for k, b in zip(at.tolist(), best.tolist(), strict=True):
                    preds[k] = langs[b]
            kept = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tidy(run), schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, order: int = 4, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from rows with text and lang whose crc32(doc_id) mod ``folds`` is not ``held``, about ``sample`` of each language; a null
    doc_id counts as an empty string there. A prediction depends on the text alone: equal texts, and rows that repeat, get equal
    answers. ``score`` is the share of the chosen language when every language has the weight 2^-(its code length). Null texts, texts
    without a letter, and all texts when nothing could be learned get ``und`` and 0. Ties go to the first language by name. Texts may be
    of any length. No rows give no rows; columns beside doc_id, text and lang are not read.
    """
    out = fold(F.col("doc_id"), folds) == held
    learn = docs.filter(~out & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    langs, symbols, table = fit(learn, order, sample)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), langs, symbols, table, order).select("doc_id", "held_out", "lang_pred", "score")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return identify(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, and those for which no language is likelier than the others together."""
    learn = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    own = F.struct(*docs.columns).alias("own")  # whatever the columns are called
    said = predict(docs.select(own, "text"), *fit(learn)).filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return said.select("own.*")
