"""Packing by non-negative least squares over length combinations.

Documents are cut at whole windows; full windows are sequences of their own. For the tails, every combination of up to
three length bins that fills a window is a column, and non-negative least squares finds how often each is used to
reproduce the histogram of tails. The counts are rounded down, and what is left in the histogram is packed greedily, longest first
into the best fit. All this is on a histogram of bounded size; tails then get their sequence by rank in their bin.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import BROADCAST_ROWS, Scratch, in_slices, pieces, sum_before, tidy, worker_cache

#: A single space between two other characters always begins a token of this vocabulary; texts with other runs of white space go
#: whole. White space is what Unicode and Python call so; line feeds may stand between words.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_SPACE = rf"[{SPACE}][{SPACE}]|[{SPACE.replace('\\n', '').replace(' ', '')}]|^[{SPACE}]|[{SPACE}]$"

#: What a byte is where words are cut, as flags: 1 a space, 2 a line feed, 4 an ASCII letter, 8 a mark or line feed, 16 not ASCII.
KINDS = np.zeros(256, dtype=np.uint8)
for flag, those in ((1, b" "), (2, b"\n"), (4, bytes(range(65, 91)) + bytes(range(97, 123))), (8, b".,;:!?\n"), (16, bytes(range(128, 256)))):
    KINDS[list(those)] |= flag


class Encoder:
    """Token ids of many texts; each distinct word of a slice is encoded once, and remembered, in later tasks as well. When the words
    met since the last change have ``most`` bytes with their ids, they become the older ones, and those older before and not met since go."""

    def __init__(self, vocabulary: str, most: int = 24_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older, self.held, self.most = Tokenizer.from_file(vocabulary), {}, {}, 0, most
        added = self.tokenizer.get_added_tokens_decoder()
        plain = [(x.content, k) for k, x in added.items() if not (x.lstrip or x.rstrip or x.single_word or x.normalized)]
        self.mark = min(plain, default=None)
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids before which a joined word ends: a space (written so by byte-level models), or the mark
        self.begins[[k for x, k in vocab.items() if x[:1] == "\u0120"] + [self.mark[1]] * bool(self.mark)] = True
        self.odd = "(?s)" + "|".join([ODD_SPACE, r"\x00", *(re.escape(x.content) for x in added.values())])  # a text that spells an added token goes whole

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(x.ids, dtype="<u4").tobytes()

    def encode_words(self, words: list[str], at_once: int = 200) -> Iterator[bytes]:
        """Words without a space inside, joined and cut again where an id begins with a space; before a word that begins with none
        stands an added token, which parts words whatever they are."""
        for lo in range(0, len(words) if self.mark else 0, at_once):
            some = words[lo : lo + at_once]
            joined = "".join([x if x[:1] == " " else self.mark[0] + x for x in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some):
                data, froms = ids.tobytes(), starts + (ids[starts] == self.mark[1])
                yield from (data[a:b] for a, b in zip((4 * froms).tolist(), (4 * np.append(starts[1:], len(ids))).tolist(), strict=True))
            else:  # not every space begins a token
                yield from self.encode(some)
        if not self.mark:
            yield from self.encode(words)

    def of_words(self, names: list[str]) -> list[bytes]:
        """Ids of distinct words, most of which are known."""
        if self.held > self.most:
            self.known, self.older, self.held = {}, self.known, 0
        ids = list(map(self.known.get, names))
        at = [k for k, x in enumerate(ids) if x is None]
        new = [names[k] for k in at]
        found = list(map(self.older.get, new))
        first = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(first, self.encode_words([new[k] for k in first]), strict=True):
            found[k] = x
        self.known.update(zip(new, found, strict=True))
        self.held += 150 * len(new) + sum(map(len, new)) + sum(map(len, found))
        for k, x in zip(at, found, strict=True):
            ids[k] = x
        return ids

    def by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, none empty, whose only white space is single characters between words. Cut is before a space, around a line
        feed, and between a letter (ASCII or Latin-1: a cut may be left out anywhere) and a mark: there a token ends in any case."""
        texts = texts.cast(pa.string())
        heads = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw, heads = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[heads[0] : heads[-1]], heads - heads[0]
        kinds = KINDS[raw]
        before, after = kinds[:-1], kinds[1:]
        cut = np.ones(len(raw), dtype=np.uint8)
        cut[1:] = (after & 1) | (before & 2) | (after >> 1 & before & 4)
        accented = np.flatnonzero(after << 1 & before & 16) + 1  # marks after a byte of another character
        cut[accented] |= (raw[accented - 2] == 0xC3) & (raw[accented - 1] != 0x97) & (raw[accented - 1] != 0xB7)
        cut[heads[:-1]] = 1
        places = np.flatnonzero(cut)
        words = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        coded, firsts = words.dictionary_encode(), np.searchsorted(places, heads[:-1])
        ids, codes = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        data, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), lengths[codes]
        ends = np.cumsum(sizes)
        at = np.repeat(((np.cumsum(lengths) - lengths)[codes] - (ends - sizes)).astype(np.int32), sizes)  # ids of a slice are fewer than its bytes, and those fewer than 2^31
        at += np.arange(ends[-1], dtype=np.int32)
        out, cuts = data[at], [*(ends - sizes)[firsts].tolist(), int(ends[-1])]
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for mask, make in ((~odd & ~empty, self.by_words), (odd & ~empty, lambda xs: self.encode(xs.to_pylist()))):
            at = np.flatnonzero(mask)
            if len(at):
                for k, x in zip(at.tolist(), make(texts.take(pa.array(at))), strict=True):
                    out[k] = x
        return out


def cut_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: whole windows from each document's front, then its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_cache(name, lambda: Encoder(vocabulary)), np.uint32(end_id).astype("<u4").tobytes()
        for batch in in_slices(batches, most_bytes=1_000_000):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in enumerate(encoder.ids(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind, name = dict(docs.dtypes)["doc_id"], f"encoder {vocabulary}"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run, keeps=name), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fillings(bins: int) -> np.ndarray:
    """All combinations of one to three bins (1..bins) that add up to ``bins``, as columns of use counts."""
    rows = [(bins,)] + [(a, bins - a) for a in range(1, bins // 2 + 1)]
    rows += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    out = np.zeros((bins + 1, len(rows)))
    for j, row in enumerate(rows):
        for b in row:
            out[b, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Lawson-Hanson non-negative least squares on the normal equations, of which only those of active columns are formed: with
    thousands of columns, all of them would take hundreds of megabytes of the driver."""
    x, active = np.zeros(a.shape[1]), []
    for _ in range(steps):
        slope = a.T @ (b - a[:, active] @ x[active])
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active.append(j)
        while active:
            used = a[:, active]
            s = np.linalg.lstsq(used.T @ used, used.T @ b, rcond=None)[0]
            if s.min() > 0:
                x[active] = s
                break
            old = x[active]
            down = s <= 0
            t = float(np.min(np.where(down, old / np.maximum(old - s, 1e-300), np.inf)))
            x[active] = np.maximum(old + t * (s - old), 0)
            gone = [k for k, v in zip(active, x[active], strict=True) if v <= 1e-12] or [active[int(np.argmin(s))]]
            x[gone] = 0
            active = [k for k in active if k not in gone]
    return x


def recipes(histogram: np.ndarray, bins: int) -> list[tuple[dict[int, int], int]]:
    """``histogram[b]``: tails in bin b. Pairs (bin -> uses, repeats) that use up every tail exactly."""
    left, out = histogram.astype(np.int64).copy(), []

    def use(row: dict[int, int], times: int) -> None:
        if times > 0:
            out.append((row, times))
            for b, m in row.items():
                left[b] -= m * times

    columns = fillings(bins)
    x = nnls(columns, histogram.astype(float))
    for j in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
        row = {int(b): int(columns[b, j]) for b in np.flatnonzero(columns[:, j])}
        use(row, min(int(x[j] + 1e-6), *(int(left[b]) // m for b, m in row.items()), 1 << 62))
    while left.any():
        room, row = bins, Counter()
        while room and (fit := np.flatnonzero(left[1 : room + 1] > [row[b] for b in range(1, room + 1)])).size:
            b = int(fit[-1]) + 1
            row[b] += 1
            room -= b
        use(dict(row), min(int(left[b]) // m for b, m in row.items()))
    return out


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, window: int = 2048, end_id: int = 1, bin_tokens: int = 8) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. Rows that repeat are documents of their own. Texts may be of any length: a
    document of n tokens gives ceil(n / window) pieces. Sequences hold at most ``window`` tokens; sequence ids have no
    order beside identity. No rows give no rows; columns beside doc_id and text are not read.
    """
    bins = -(-window // bin_tokens)
    cut = scratch.keep(cut_documents(docs, vocabulary, window, end_id).withColumn("bin", F.ceil(F.col("length") / bin_tokens).cast("int")), "pieces")
    counts = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``bins`` rows
    histogram = np.array([counts.get(b, 0) for b in range(bins + 1)], dtype=np.int64)
    plan, at, base = [], Counter(), 0
    for row, times in recipes(histogram, bins):
        slot = 0
        for b, m in sorted(row.items(), reverse=True):
            plan.append((b, at[b], at[b] + m * times, m, base, slot))
            at[b] += m * times
            slot += m
        base += times
    spark = cut.sparkSession
    if len(plan) > BROADCAST_ROWS:  # a recipe uses up a bin or is a column of the least squares, so there are a few for each bin
        raise ValueError(f"{len(plan)} recipes for {bins} bins")
    plan = F.broadcast(spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "bin int, lo long, hi long, uses long, base long, slot long"))
    ranked = sum_before(cut, ["bin"], ["doc_id", "start", "ids_crc32", "doc_tokens"], F.lit(1), "rank", pieces(int(histogram.sum())))
    chosen = ranked.join(plan, (ranked["bin"] == plan["bin"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(plan["bin"])
    chosen = chosen.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("uses"))).withColumn("place", F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("uses"))
    # a sequence holds a bounded number of pieces, as each has a token at least
    from pyspark.sql.window import Window as W

    ahead = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return chosen.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, Scratch(spark, "op6"), public_tokenizers.path("byte_bpe_50k.json"))
