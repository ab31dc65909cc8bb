import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ruleframe.llm import class_lm, queries
from ruleframe.llm.common import Scratch
from tests.llm.rows import awkward, frame


def words(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def corpus(rng, n=200):
    """A language of noun and verb classes that alternate."""
    nouns, verbs = [f"noun{k}" for k in range(12)], [f"verb{k}" for k in range(8)]
    return [(k, " ".join(rng.choice(nouns if j % 2 == 0 else verbs) for j in range(rng.randrange(4, 40))), "en", "s") for k in range(n)]


def check(rows, out):
    """Counts, fold and base score by brute force; returns the sums of base and model over held-out rows."""
    counts = Counter()
    for d, t, *_ in rows:
        if not held(d):
            counts.update([*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for d, t, *_ in rows:
        tokens = [*words(t), b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        wanted.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    close = lambda a, b: a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)
    assert len(got) == len(wanted) and all(close(a, b) for a, b in zip(sorted(got, key=repr), sorted(wanted, key=repr), strict=True))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    test = [r for r in out if r["held_out"]]
    return sum(r["base_score"] for r in test), sum(r["score"] for r in test)


@pytest.mark.parametrize(("head_words", "known_words"), [(8, 8), (8, 20), (60_000, 1 << 18)])
def test_counts_and_base_against_brute_force(spark, head_words, known_words):
    rng = random.Random(1)
    rows = corpus(rng) + [(d + 1000 if d is not None else None, t, None, None) for d, t in awkward(rng)] + [(2000, "Never Seen Words ünd 12 ab,cd. x", None, None)]
    check(rows, class_lm.score_texts(frame(spark, rows), Scratch(spark, "test"), head_words=head_words, known_words=known_words, classes=6).collect())


def test_classes_beat_the_base_on_held_out_text(spark):
    rows = corpus(random.Random(2), 400)
    base, model = check(rows, class_lm.score_texts(frame(spark, rows), Scratch(spark, "test"), classes=4).collect())
    assert model > base * 0.9


def fitted(spark, rows, head_words, classes):
    """(words, Exchange, class of every training word) of the documents that are learned from."""
    texts = frame(spark, [r for r in rows if not held(r[0])]).select("text")
    frequent, counts, _ = class_lm.frequent_words(class_lm.count_words(texts), 1 << 18)
    frequent, counts = frequent[:head_words], counts[:head_words]
    ids = spark.sparkContext.broadcast({w: k for k, w in enumerate(frequent)})
    scratch = Scratch(spark, "test")
    exchange = class_lm.Exchange(class_lm.neighbours(texts, ids, scratch), counts, classes)
    of = exchange.run()
    placed = {bytes(r["word"]): r for r in class_lm.place_others(texts, ids, of, exchange.n, classes).collect()}
    counted = Counter(w for d, t, *_ in rows if not held(d) for w in words(t))
    assert {w: r["n"] for w, r in placed.items()} == {w: n for w, n in counted.items() if w not in frequent}
    return frequent, exchange, {**{w: int(of[k]) for k, w in enumerate(frequent)}, **{w: r["class"] for w, r in placed.items()}}


def test_exchange_finds_the_two_classes_and_its_likelihood_never_falls(spark):
    rows = corpus(random.Random(3), 400)
    frequent, exchange, of = fitted(spark, rows, 1000, 4)
    kinds = {k: {c for w, c in of.items() if w.startswith(k)} for k in (b"noun", b"verb")}
    assert not kinds[b"noun"] & kinds[b"verb"]
    history = exchange.history
    assert len(history) > 2 and all(a <= b for a, b in zip(history, history[1:], strict=False)) and history[-1] > history[0]


def test_rare_words_go_to_the_class_of_their_neighbours(spark):
    rows = corpus(random.Random(4), 400) + [(5000 + k, f"rare{k} verb1 noun{k % 12} verb2", None, None) for k in range(40)]
    _, _, of = fitted(spark, rows, 21, 4)  # the end, the nouns and the verbs
    nouns = {c for w, c in of.items() if w.startswith(b"noun")}
    rare = [c for w, c in of.items() if w.startswith(b"rare")]
    assert len(rare) > 20 and sum(c in nouns for c in rare) > 0.9 * len(rare)


def test_gains_are_differences_of_the_likelihood():
    """Every move of every word, against the likelihood of the bigrams counted anew."""
    rng = np.random.default_rng(5)
    words_n, classes, tokens = 9, 3, rng.integers(0, 10, 400)  # word 9 has no class
    of = np.append(rng.integers(0, classes, words_n), classes)

    def counted(of):
        n = np.zeros((classes + 1, classes + 1))
        np.add.at(n, (of[tokens[:-1]], of[tokens[1:]]), 1)
        return n

    n, pairs = counted(of), np.zeros((10, 10))
    np.add.at(pairs, (tokens[:-1], tokens[1:]), 1)
    left, right, loops = np.zeros((words_n, classes + 1)), np.zeros((words_n, classes + 1)), np.diag(pairs)[:words_n]
    for w in range(words_n):
        for other in range(10):
            if other != w:
                left[w, of[other]] += pairs[other, w]
                right[w, of[other]] += pairs[w, other]
    value = class_lm.gains(n, left, right, of[:words_n], loops, pairs.sum(1)[:words_n], pairs.sum(0)[:words_n])
    for w in range(words_n):
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            wanted = class_lm.likelihood(counted(moved), classes) - class_lm.likelihood(n, classes)
            assert value[w, c] - value[w, of[w]] == pytest.approx(wanted, abs=1e-6)


@pytest.mark.parametrize(("head_words", "known_words"), [(10, 10), (10, 30), (5_000, 5_000)])
def test_scores_against_brute_force(spark, head_words, known_words):
    rng = random.Random(6)
    rows = corpus(rng, 80) + [(700 + k, t, None, None) for k, (_, t) in enumerate(awkward(rng))] + [(900 + k, f"solo{k} noun1 solo{k + 1} x{k} y{k}", None, None) for k in range(30)]
    _, _, of = fitted(spark, rows, head_words, 5)
    learn = [[*words(t), b""] for d, t, *_ in rows if not held(d)]
    counts, n = Counter(w for ws in learn for w in ws), np.zeros((5, 5))
    for ws in learn:
        for a, b in zip([b"", *ws], ws, strict=False):
            n[of[a], of[b]] += 1
    total, once = sum(counts.values()), sum(c == 1 for c in counts.values())
    step, size = class_lm.transitions(n, once, total), n.sum(0)
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(frame(spark, rows), Scratch(spark, "test"), head_words=head_words, known_words=known_words, classes=5).collect()}
    for d, t, *_ in rows:
        cls, out = of[b""], 0.0
        for w in [*words(t), b""]:
            now = of.get(w, 5)
            out += step[cls, now] + (math.log10(counts[w] / size[now]) if w in of else 0)
            cls = now
        assert got[d] == pytest.approx(out, rel=1e-9)


def test_probabilities_add_up():
    """P(class | class before) over all classes and that of unseen words is 1, and so are a class's emissions: shares of its tokens."""
    n = np.random.default_rng(7).integers(0, 30, (6, 6)).astype(float)
    n[2] = 0
    for once in (0, 5, 400):
        assert np.allclose((10 ** class_lm.transitions(n, once, 500)).sum(1), 1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, "b c")]])
def test_few_rows(spark, rows):
    check(rows, class_lm.score_texts(frame(spark, rows, 1), Scratch(spark, "test")).collect())


def test_query_over_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    base, model = check(rows, queries.QUERIES["op8_lm_scoring"](spark, small).collect())
    assert model > base  # held-out text is likelier under the classes than under single words
    assert np.isfinite(model)
