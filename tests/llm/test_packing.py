import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ruleframe.llm import packing, queries
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, out, window):
    """An exact round trip: every document's ids come back from its pieces, and sequences are whole."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    left = defaultdict(list)
    for d, t, *_ in rows:
        left[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for d, texts in left.items():
        for ids in texts:
            n = len(ids) // 4
            wanted[d] += [(s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * min(n, s + window)]), n) for s in range(0, n, window)]
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in wanted.items()}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
    used = sum(n for x in sequences.values() for _, n in x)
    return used / (window * len(sequences)) if sequences else 1.0


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(spark, window):
    rng = random.Random(2)
    rows = awkward(rng) + [(100 + k, sentence(rng, rng.randrange(1, 90))) for k in range(300)]
    rows += [(500, "two  spaces"), (501, "tab\there\nand line"), (502, " lead"), (503, "trail "), (504, "1 2 3 . , ; ''s 're"), (505, "　wide space")]
    rows += [(506, "<|endoftext|> <s> </s> [CLS] text that looks like special tokens")]
    full = check(rows, packing.pack(frame(spark, rows), Scratch(spark, "test"), VOCABULARY, window).collect(), window)
    assert full > 0.9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (1, "a b"), (1, "a b")]])
def test_few_rows(spark, rows):
    check(rows, packing.pack(frame(spark, rows, 1), Scratch(spark, "test"), VOCABULARY).collect(), 2048)


def test_least_squares_against_a_grid():
    a = np.array([[1.0, 0.0, 2.0], [1.0, 2.0, 0.0]])
    b = np.array([3.0, 1.0])
    x = packing.nnls(a, b)
    assert (x >= 0).all()
    best = min(((a @ np.array([i, j, k]) - b) ** 2).sum() for i in np.arange(0, 4, 0.25) for j in np.arange(0, 2, 0.25) for k in np.arange(0, 2, 0.25))
    assert ((a @ x - b) ** 2).sum() <= best + 1e-9
    assert packing.nnls(np.array([[1.0]]), np.array([-1.0]))[0] == 0


def test_recipes_use_every_tail_once():
    rng = np.random.default_rng(4)
    histogram = np.concatenate([[0], rng.integers(0, 50, 16)])
    left = histogram.copy()
    for row, times in packing.recipes(histogram, 16):
        assert sum(b * m for b, m in row.items()) <= 16
        for b, m in row.items():
            left[b] -= m * times
    assert not left.any()


def test_recipes_of_a_real_window_take_little_of_the_driver():
    import tracemalloc

    histogram = np.concatenate([[0], np.random.default_rng(6).integers(0, 3, 256)])
    tracemalloc.start()
    packing.recipes(histogram, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_query_over_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert check(rows, queries.QUERIES["op6_packing"](spark, small).collect(), 2048) > 0.9


def test_words_forgotten_and_kept_give_the_same_ids():
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    small, plain = packing.Encoder(VOCABULARY, most=5_000), packing.Encoder(VOCABULARY)
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(8)]
        expected = [np.array(plain.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert small.ids(pa.array(texts)) == plain.ids(pa.array(texts)) == expected
    assert len(small.known) + len(small.older) < len(plain.known)


def test_cuts_into_words_give_the_ids_of_whole_texts():
    import pyarrow as pa

    rng = random.Random(7)
    parts = ["ab", "Äé", "ß", "×", "÷", "я", "жук", "漢字", "12", "3.5", "'s", "don't", ".", ",", "?!", ";", ":", "###", "Ġ", "\u0120a", "\U0001f600", "é.", "×.", "я.", "漢!", "é\na", "12\nb", "a.\nb", "×\n÷"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(1, 12))) for _ in range(2_000)]
    encoder = packing.Encoder(VOCABULARY)
    expected = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.ids(pa.array(texts)) == expected
    assert encoder.ids(pa.array(["left out", *texts], pa.large_string())[1:]) == expected
    encoder.begins[:] = False  # as with a vocabulary whose spaces begin no token
    encoder.known, encoder.older = {}, {}
    assert encoder.ids(pa.array(texts)) == expected


def test_words_go_to_the_tokenizer_with_little_between_them():
    import pyarrow as pa

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.sent = tokenizer, 0

        def encode_batch_fast(self, texts, **more):
            self.sent += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **more)

    encoder = packing.Encoder(VOCABULARY)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    text = " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600))
    encoder.ids(pa.array([text]))
    assert counted.sent <= 1.1 * len(text)


def test_another_operator_frees_what_a_worker_held():
    from ruleframe.llm import common

    common.worker_cache("encoder of a test", lambda: [1])
    list(common.tidy(lambda batches: batches, keeps="encoder of a test")(iter([])))
    assert "encoder of a test" in common.worker_held()
    list(common.tidy(lambda batches: batches)(iter([])))
    assert not common.worker_held()
