"""Brown class n-gram scoring.

Words get classes by exchange clustering, and a text's probability is the product of class-transition and word-emission
probabilities. The most frequent words (``head_words`` at most) move between classes in rounds: every word of one half is taken
out of its class and offered the class with the largest gain in the likelihood of the class bigrams. The proposed moves are made
together, and stand only if the likelihood of all bigrams rises; else the better half of them is tried. Rounds end when the
likelihood has settled. Every other training word, however rare, is then put by the same gain into the class that its
neighbours' classes favour. Counts of words, bigrams and neighbours cover all training documents.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import Scratch, in_slices, tidy
from ruleframe.llm.language_id import fold

#: Ids of words of the exchange fit 16 bits; the last stands for all other words.
OTHER = (1 << 16) - 1
#: Words of this rank and above meet all others so often that their neighbours are summed in parts.
HOT_RANK, HOT_PARTS = 256, 64
#: In a row of classes: a word whose class a join brings.
PENDING = 255
#: Tasks of a round of the exchange, at most.
TASKS = 64


def words_of(text: str | None) -> list[bytes]:
    """lower() and split() of bytes know ASCII only: A-Z, and the white space x20, x09-x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """``(word, n)`` over all rows of ``texts(text)``; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            counts[b""] += batch.num_rows
            if len(counts) > most:
                yield drain()
        if counts:
            yield drain()

    return texts.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, int]:
    """(words, counts, least): the end first, then all words that occur ``least`` times or more, most frequent first; ``least`` is
    the smallest number for which they are ``most`` at most."""
    least, total = 1 << 62, 0
    for r in vocabulary.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect():
        if (total := total + r["words"]) > most:
            break
        least = r["n"]
    found = vocabulary.filter((F.col("n") >= least) | (F.col("word") == F.lit(b""))).toArrow()  # ``most`` rows and one
    pairs = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (x[0] != b"", -x[1], x[0])) or [(b"", 0)]
    return [w for w, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64), least


def buffers(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values`` cut at ``starts`` as binary values."""
    offsets = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary arrays without nulls, and where each row's begin; the end of the last is added."""
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw.view(kind), (starts - starts[0]) // np.dtype(kind).itemsize


def neighbours(texts: DataFrame, ids, scratch: Scratch, tokens: int = 4_000_000) -> DataFrame:
    """``(word, before, n_before, after, n_after)``, one row for each id under ``OTHER``: the ids that stand before and after it
    (16 bits each) and how often (floats). A text stands between two ends. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = ids.value, [], 0

        def side(word: np.ndarray, other: np.ndarray, n: np.ndarray, after: bool) -> Iterator[pa.RecordBatch]:
            """A row for each word, those of hot words in parts."""
            for hot in (False, True):
                mask = (word < HOT_RANK) == hot if hot else (word >= HOT_RANK) & (word != OTHER)
                w, o, k = word[mask], other[mask], n[mask]
                key = (w * HOT_PARTS + o % HOT_PARTS if hot else w).astype(np.uint16)
                order = np.argsort(key, kind="stable")  # by radix
                key, o, k = key[order], o[order].astype("<u2"), k[order].astype("<f4")
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
                first = key[at].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(first // HOT_PARTS if hot else first), pa.array(first % HOT_PARTS if hot else first * 0), pa.array(np.full(len(at), after)), buffers(o, at), buffers(k, at)], names=["word", "part", "after", "other", "n"])

        def drain() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            a, b = code >> np.uint32(16), code & np.uint32(0xFFFF)
            yield from side(b, a, n, False)
            yield from side(a, b, n, True)

        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                seq = np.array([0, *[known.get(w, OTHER) for w in words_of(text)], 0], dtype=np.uint32)  # the end is word 0
                held.append((seq[:-1] << np.uint32(16)) | seq[1:])
                size += len(seq)
            if size > tokens:
                yield from drain()
                size = 0
        if held:
            yield from drain()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the rows of each (word, part), which come one after another."""
        sums, key, out, size = np.zeros((2, OTHER + 1)), None, [], 0

        def close() -> int:
            row = [key[0]]
            for s in sums:
                at = np.flatnonzero(s)
                row += [at.astype("<u2").tobytes(), s[at].astype("<f4").tobytes()]
                s[at] = 0
            out.append(row)
            return sum(map(len, row[1:]))

        def drain() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), *[pa.binary()] * 4))], names=["word", "before", "n_before", "after", "n_after"])
            out.clear()
            return done

        for batch in batches:
            words, parts, after = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("word", "part", "after"))
            (other, starts), (n, _) = flat(batch.column("other"), "<u2"), flat(batch.column("n"), "<f4")
            for word, part, side, a, b in zip(words, parts, after, starts.tolist(), starts.tolist()[1:], strict=False):
                if (word, part) != key:
                    size += close() if key is not None else 0
                    key = word, part
                sums[int(side)][other[a:b]] += n[a:b]
                if size > 4_000_000:
                    yield drain()
                    size = 0
        if key is not None:
            close()
            yield drain()

    keys, merged = ["word", "part"], "word int, before binary, n_before binary, after binary, n_after binary"
    put_together = lambda rows: rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(merge), merged)
    parts = scratch.keep(put_together(texts.select("text").mapInArrow(tidy(run), "word int, part int, after boolean, other binary, n binary")), "neighbours-parts")
    # the parts of a hot word meet once more: each is of bounded size by now
    hot = parts.filter(F.col("word") < HOT_RANK).withColumn("part", F.lit(0))
    sides = [hot.select("word", "part", F.lit(after).alias("after"), F.col(name).alias("other"), F.col(f"n_{name}").alias("n")) for after, name in ((False, "before"), (True, "after"))]
    hot = scratch.keep(put_together(sides[0].unionAll(sides[1])), "neighbours-hot")
    return parts.filter(F.col("word") >= HOT_RANK).unionAll(hot)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray, classes: int) -> float:
    """What the classes add to the log-likelihood of the bigrams; ``n[c, d]`` counts class d after c, the last class is of words that
    have no class yet."""
    return float(xlogx(n).sum() - xlogx(n.sum(1)[:classes]).sum() - xlogx(n.sum(0)[:classes]).sum())


def gains(n: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, self_n: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(words, classes): how much the likelihood rises when a word, taken out of its class ``own`` (-1: it has none), is put into
    each class. ``left[w, c]``, ``right[w, c]``: how often class c stands before and after w, w itself (``self_n``) not counted;
    ``first``, ``last``: how often w begins and ends a bigram. ``n`` has a row and column more than classes."""
    classes, words = n.shape[0] - 1, np.arange(len(own))
    inside = own >= 0
    at = np.where(inside, own, 0)
    out = np.zeros((len(own), classes))
    for near, across, table in ((left, right, n), (right, left, n.T)):  # table[c]: what stands on the word's side of class c
        w, c = np.nonzero(near)
        k = near[w, c][:, None]
        base = table[c][:, :classes].astype(float)
        mine = inside[w] & (c == own[w])  # the word's own class without the word
        base[mine] -= across[w[mine], :classes]
        stay = inside[w]
        base[np.flatnonzero(stay), own[w[stay]]] -= k[stay, 0]
        delta = xlogx(np.maximum(base, 0) + k) - xlogx(np.maximum(base, 0))
        same = np.flatnonzero(c < classes)
        delta[same, c[same]] = 0  # a class after itself is counted below
        order = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, dtype=np.int64)
        if len(order):
            out[w[order]] += np.add.reduceat(delta, order, axis=0)
    loops = np.broadcast_to(np.diag(n)[:classes], out.shape).astype(float)
    begins, ends = (np.broadcast_to(n.sum(axis)[:classes], out.shape).astype(float) for axis in (1, 0))
    loops[words[inside], at[inside]] -= (left[words, at] + right[words, at] + self_n)[inside]
    begins[words[inside], at[inside]] -= first[inside]
    ends[words[inside], at[inside]] -= last[inside]
    out += xlogx(loops + left[:, :classes] + right[:, :classes] + self_n[:, None]) - xlogx(loops)
    return out - (xlogx(begins + first[:, None]) - xlogx(begins)) - (xlogx(ends + last[:, None]) - xlogx(ends))


class Exchange:
    """Exchange of words ``0..len(counts)-1`` between classes, over the stored table of ``neighbours``."""

    def __init__(self, table: DataFrame, counts: np.ndarray, classes: int):
        # a bounded number of words with a bounded number of neighbours: a bounded number of tasks, each with a class matrix
        self.table, self.classes, self.words = table.coalesce(TASKS), classes, len(counts)
        self.of = np.full(OTHER + 1, classes, dtype=np.uint8)
        self.of[: self.words] = np.arange(self.words) % classes
        self.from_other = np.zeros(OTHER + 1, dtype=np.int64)
        found = self.each_word(lambda x: [x.sums("before", lambda other: other == OTHER)], "n long").toArrow()  # one row a word
        self.from_other[found.column("word").to_numpy()] = found.column("n").to_numpy()
        self.history: list[float] = []

    def each_word(self, work, schema: str, chosen: DataFrame | None = None) -> DataFrame:
        """``work`` on slices of the table gives columns with a value for each word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(in_slices(batches, "after"), "before"):
                columns = work(Slice(batch))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("word")), *(pa.array(c) for c in columns)], names=names)

        names = ["word", *(x.split()[0] for x in schema.split(", "))]
        return (self.table if chosen is None else chosen).mapInArrow(tidy(run), f"word int, {schema}")

    def matrix(self, of: np.ndarray) -> np.ndarray:
        """Class bigrams under ``of``; the last class is that of all other words."""
        wide, place = self.classes + 1, self.table.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(wide * wide, dtype=np.int64)
            for batch in in_slices(batches, "after"):
                x = Slice(batch)
                word, other, n = x.pairs("after")
                code = place.value[x.words[word]].astype(np.int64) * wide + place.value[other]
                total += np.bincount(code, weights=n, minlength=wide * wide).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

        found = self.table.select("word", "after", "n_after").mapInArrow(tidy(run), "counts binary").toArrow()  # a matrix for each of 64 tasks at most
        out = sum((np.frombuffer(x, dtype=np.int64) for x in found.column(0).to_pylist()), np.zeros(wide * wide))
        out = out.reshape(wide, wide)
        out[self.classes] = np.bincount(of, weights=self.from_other, minlength=wide)[:wide]
        return out

    def proposals(self, of: np.ndarray, n: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, classes) of the words of one half that gain by a move, largest gain first."""
        classes, place, model = self.classes, self.table.sparkSession.sparkContext.broadcast(of), self.table.sparkSession.sparkContext.broadcast(n)

        def work(x: Slice) -> list[np.ndarray]:
            own = place.value[x.words].astype(np.int64)
            left, right = x.by_class("before", place.value, classes + 1), x.by_class("after", place.value, classes + 1)
            loops = x.sums("after", None)
            first, last = right.sum(1), left.sum(1)
            left[np.arange(len(own)), own] -= loops
            right[np.arange(len(own)), own] -= loops
            value = gains(model.value, left, right, own, loops, first, last)
            best = value.argmax(1)
            return [best.astype(np.int32), value[np.arange(len(own)), best] - value[np.arange(len(own)), own]]

        chosen = self.table.filter((F.col("word") % 2 == half) & (F.col("word") < self.words))
        found = self.each_word(work, "class int, gain double", chosen).filter("gain > 1e-6").toArrow()  # a row a word at most
        words, to, gain = (found.column(k).to_numpy() for k in range(3))
        order = np.lexsort((words, -gain))
        return words[order], to[order]

    def run(self, settled: float = 0.02) -> np.ndarray:
        """The classes once two rounds together, one of each half, raise the likelihood by less than ``settled`` of its rise so far."""
        of, n = self.of, self.matrix(self.of)
        self.history = [likelihood(n, self.classes)]
        for step in itertools.count():
            words, to = self.proposals(of, n, step % 2)
            take = len(words)
            while take:
                trial = of.copy()
                trial[words[:take]] = to[:take]
                new = self.matrix(trial)
                if likelihood(new, self.classes) > self.history[-1]:
                    of, n = trial, new
                    break
                take //= 8  # moves that were good one by one can be bad together
            self.history.append(likelihood(n, self.classes))
            if step % 2 and self.history[-1] - self.history[-3] <= settled * (self.history[-1] - self.history[0]):
                self.of, self.n = of, n
                return of


class Slice:
    """Some rows of the table of neighbours as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.words, self.batch = batch.column("word").to_numpy(), batch

    def pairs(self, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, other word, count) of every neighbour."""
        (other, starts), (n, _) = flat(self.batch.column(side), "<u2"), flat(self.batch.column(f"n_{side}"), "<f4")
        return np.repeat(np.arange(len(self.words)), np.diff(starts)), other, n

    def by_class(self, side: str, of: np.ndarray, classes: int) -> np.ndarray:
        row, other, n = self.pairs(side)
        return np.bincount(row * classes + of[other], weights=n, minlength=len(self.words) * classes).reshape(-1, classes)

    def sums(self, side: str, chosen) -> np.ndarray:
        """Counts of the neighbours that ``chosen`` picks, or of the word itself."""
        row, other, n = self.pairs(side)
        mask = other == self.words[row] if chosen is None else chosen(other)
        return np.bincount(row[mask], weights=n[mask], minlength=len(self.words)).astype(np.int64)


def place_others(texts: DataFrame, ids, of: np.ndarray, n: np.ndarray, classes: int, most: int = 300_000) -> DataFrame:
    """``(word, n, class)`` of every word without an id: the class with the largest gain, by the classes before and after it."""
    spark = texts.sparkSession
    place, model = spark.sparkContext.broadcast(np.where(np.arange(OTHER + 1) == OTHER, classes, of).astype(np.uint8)), spark.sparkContext.broadcast(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, near, of = ids.value, [], [], place.value

        def drain() -> pa.RecordBatch:
            coded = pa.array(words, pa.binary()).dictionary_encode()
            at = coded.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            starts = np.cumsum(np.bincount(at, minlength=len(coded.dictionary))) - np.bincount(at, minlength=len(coded.dictionary))
            both = np.concatenate(near)[order]
            words.clear()
            near.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary, buffers(both, starts)], names=["word", "near"])

        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                own = words_of(text)
                seq = np.array([0, *[known.get(w, OTHER) for w in own], 0], dtype=np.uint16)
                rare = seq[1:-1] == OTHER
                if rare.any():
                    cls = of[seq]
                    words += itertools.compress(own, rare.tolist())
                    near.append((cls[:-2][rare].astype("<u2") << 8) | cls[2:][rare])
            if len(words) > most:
                yield drain()
        if words:
            yield drain()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a word come one after another; only the last word's counts are held."""
        wide, n = classes + 1, model.value
        held: tuple | None = None  # word, left, right

        def close(words: list[bytes], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            first = right.sum(1)
            lefts, rights = left.copy(), right.copy()
            lefts[:, classes] = rights[:, classes] = 0  # words that have no class say nothing
            value = gains(n, lefts, rights, np.full(len(words), -1), np.zeros(len(words)), first, first)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(first.astype(np.int64)), pa.array(value.argmax(1).astype(np.int32))], names=["word", "n", "class"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 4_000):
                part = batch.slice(lo, 4_000)
                word = part.column("word")
                new = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
                row = np.cumsum(new) - 1
                words = word.take(pa.array(np.flatnonzero(new))).to_pylist()
                near, starts = flat(part.column("near"), "<u2")
                near = near.astype(np.int64)
                at = np.repeat(row, np.diff(starts)) * wide
                left, right = (np.bincount(at + c, minlength=len(words) * wide).reshape(-1, wide).astype(float) for c in (near >> 8, near & 255))
                if held is not None:
                    if held[0] == words[0]:
                        left[0] += held[1]
                        right[0] += held[2]
                    else:
                        yield close([held[0]], held[1][None], held[2][None])
                held = words[-1], left[-1].copy(), right[-1].copy()
                if len(words) > 1:
                    yield close(words[:-1], left[:-1], right[:-1])
        if held is not None:
            yield close([held[0]], held[1][None], held[2][None])

    found = texts.select("text").mapInArrow(tidy(run), "word binary, near binary")
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(put), "word binary, n long, class int")


def read_texts(docs: DataFrame, known, model) -> DataFrame:
    """One row per row of ``docs(doc_id, held_out, text)``: its tokens' classes as bytes, ``PENDING`` for words outside ``known``;
    those words, each once, and for each such token the number of its word. Counts, base and logs are of the known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (of, base_log, word_log, base_den) = known.value, model.value
        none = len(of)
        of = np.append(of, PENDING).astype(np.uint8)
        for batch in in_slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                seq = np.array([*[ids.get(w, none) for w in words], 0], dtype=np.int64)
                own = seq[seq < none]
                tail: dict[bytes, int] = {}
                at = [tail.setdefault(w, len(tail)) for w in itertools.compress(words, (seq[:-1] == none).tolist())]
                values = len(seq), int((word_log[own] > -1).sum()), float(base_log[own].sum() - base_den * len(seq)), float(np.maximum(word_log[own], 0).sum()), of[seq].tobytes(), [*tail], np.array(at, dtype="<i4").tobytes()
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "logs", "classes", "words", "at"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, logs double, classes binary, words array<binary>, at binary")


def with_all_classes(rows: DataFrame, unseen: int) -> DataFrame:
    """``rows`` of ``read_texts`` with ``found``, an array of (k, n, class): puts the joined words' classes and counts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(in_slices(batches, "at"), "classes"):
            known, base, logs, filled = [], [], [], []
            for n_known, b, log, classes, at, found in zip(*(batch.column(c).to_pylist() for c in ("n_known", "base", "logs", "classes", "at", "found")), strict=True):
                at = np.frombuffer(at, dtype="<i4")
                if len(at):
                    of, n = np.full(at.max() + 1, unseen, dtype=np.uint8), np.zeros(at.max() + 1)
                    for x in found or ():
                        of[x["k"]], n[x["k"]] = x["class"], x["n"]
                    cls, n = np.frombuffer(classes, dtype=np.uint8).copy(), n[at]
                    cls[cls == PENDING] = of[at]
                    n_known, b, log, classes = n_known + int((n > 0).sum()), b + float(np.log10(n + 0.5).sum()), log + float(np.log10(np.maximum(n, 1)).sum()), cls.tobytes()
                for column, x in zip((known, base, logs, filled), (n_known, b, log, classes), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(logs, pa.float64()), pa.array(filled, pa.binary())], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "logs", "classes"]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(tidy(run), ", ".join(f"{x} {kinds[x]}" for x in names))


def class_bigrams(rows: DataFrame, end: int, wide: int) -> np.ndarray:
    """Counts of class pairs over ``rows(classes)``; a text begins after the class of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, dtype=np.int64)
        for batch in in_slices(batches, "classes"):
            for x in batch.column("classes").to_pylist():
                seq = np.frombuffer(bytes([end]) + x, dtype=np.uint8).astype(np.int64)
                total += np.bincount(seq[:-1] * wide + seq[1:], minlength=wide * wide)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["code", "n"])

    out = np.zeros(wide * wide)
    for r in rows.select("classes").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # wide ** 2 rows at most
        out[r["code"]] = r["n"]
    return out.reshape(wide, wide)


def transitions(n: np.ndarray, once: int, total: int) -> np.ndarray:
    """log10 P(class | class before), classes and the class of unseen words last, from class bigrams ``n``.

    Unseen words have the share of words that occur once; the rest is Witten-Bell: a class's followers back off to the classes' own
    shares."""
    classes = len(n)
    unseen = (once + 0.5) / (total + 1)
    own = (n.sum(0) + 0.5) / (n.sum() + 0.5 * classes)
    kinds = np.maximum((n > 0).sum(1, keepdims=True), 1)
    out = np.full((classes + 1, classes + 1), unseen)
    out[:classes, :classes] = (1 - unseen) * (n + kinds * own) / (n.sum(1, keepdims=True) + kinds)
    out[classes, :classes] = (1 - unseen) * own
    return np.log10(out)


def score_texts(docs: DataFrame, scratch: Scratch, folds: int = 5, held: int = 1, head_words: int = 1 << 15, known_words: int = 1 << 18, classes: int = 64) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose crc32(doc_id as text) mod ``folds`` is not ``held`` (a null doc_id counts as empty text). Tokens
    are a text's words, A-Z in lower case, and one end; null texts count as empty. ``score`` is the log10 probability under
    the class model: the sum of log P(class | class before) + log P(word | class); all words that training has not seen are one
    kind with a class of its own. Up to ``head_words`` frequent words take part in the exchange and ``known_words`` are held in each
    task; the classes and counts of all others come by a join. With no training documents the base and the model are those of empty
    counts. Texts may be of any length. Rows that repeat are scored one by one. No rows give no rows; columns beside doc_id and text
    are not read.
    """
    spark = docs.sparkSession
    held_out = fold(F.col("doc_id"), folds) == held
    train = docs.filter(~held_out).select("text")
    vocabulary = scratch.keep(count_words(train), "vocabulary")
    n_all, v_all, once = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    words, counts, least = frequent_words(vocabulary, known_words)
    head = min(len(words), head_words)
    ids = spark.sparkContext.broadcast({w: k for k, w in enumerate(words[:head])})
    exchange = Exchange(neighbours(train, ids, scratch), counts[:head], classes)
    of = exchange.run()
    placed = scratch.keep(place_others(train, ids, of, exchange.n, classes), "placed")
    scratch.drop("vocabulary", "neighbours-parts", "neighbours-hot")

    middle = placed.filter(F.col("n") >= least).toArrow()  # ``known_words`` rows at most
    classed = dict(zip(middle.column("word").to_pylist(), middle.column("class").to_pylist(), strict=True))
    known_of = np.concatenate([of[:head], np.array([classed[w] for w in words[head:]], dtype=np.uint8)])
    base_den = float(np.log10(n_all + 0.5 * (v_all + 1)))
    word_log = np.where(counts > 0, np.log10(np.maximum(counts, 1)), -1.0)
    known = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    model = spark.sparkContext.broadcast((known_of, np.log10(counts + 0.5), word_log, base_den))
    local = read_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), known, model)
    local = scratch.keep(local.withColumn("row", F.monotonically_increasing_id()), "local")
    tail = local.select("row", F.posexplode("words").alias("k", "word")).join(placed.filter(F.col("n") < least), "word")
    tail = tail.groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("found"))  # one document's words
    full = scratch.keep(with_all_classes(local.drop("words").join(tail, "row", "left"), classes), "full")

    n = class_bigrams(full.filter("not held_out"), int(known_of[0]), classes + 1)[:classes, :classes]
    step = transitions(n, once, int(n_all))
    class_log = np.append(np.log10(np.maximum(n.sum(0), 1)), 0.0)
    final = spark.sparkContext.broadcast((int(known_of[0]), step, class_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step, class_log = final.value
        for batch in in_slices(batches, "classes"):
            scores = []
            for x, logs in zip(batch.column("classes").to_pylist(), batch.column("logs").to_pylist(), strict=True):
                seq = np.frombuffer(bytes([end]) + x, dtype=np.uint8)
                scores.append(float(step[seq[:-1], seq[1:]].sum() - class_log[seq[1:]].sum() + logs))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base"]
    kind = dict(docs.dtypes)["doc_id"]
    out = full.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score_texts(docs, Scratch(spark, "op8"))
