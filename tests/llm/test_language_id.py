import math
import random
import zlib

import numpy as np
import pytest

from ruleframe.llm import language_id, queries
from tests.llm.rows import awkward, frame

LETTERS = {"en": "the and of to in is that ", "de": "der die und das nicht ist ", "fr": "le la les des est dans "}


def documents(rng, n=240):
    out = []
    for k in range(n):
        lang = rng.choice(sorted(LETTERS))
        out.append((k, " ".join(rng.choice(LETTERS[lang].split()) for _ in range(rng.randrange(3, 40))), lang, f"s{k % 3}"))
    return out


def brute_tables(texts, order, symbols):
    """Code length of every context and byte by the definition: count / (total + distinct), escape distinct / (total + distinct)."""
    from collections import Counter, defaultdict

    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        s = [0] * order + [int(x) for x in symbols[np.frombuffer(t.encode().lower(), dtype=np.uint8)]]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1

    def p(context, symbol):
        below = {x: 1 / language_id.SYMBOLS for x in range(language_id.SYMBOLS)}
        for k in range(order + 1):
            c = counts[k].get(tuple(context[len(context) - k :]))
            if not c:
                continue
            total, distinct = sum(c.values()), len(c)
            rest = sum(v for x, v in below.items() if x not in c)
            escape = 0 if distinct == language_id.SYMBOLS else distinct
            below = {x: (c[x] if x in c else escape * v / rest if rest else 0) / (total + escape) for x, v in below.items()}
        return below[symbol]

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_code_lengths_against_the_definition(spark, order):
    rng = random.Random(1)
    rows = documents(rng, 60)
    langs, symbols, table = language_id.fit(frame(spark, rows).select("text", "lang"), order)
    assert langs == ["de", "en", "fr"]
    for lang in langs:
        p = brute_tables([r[1] for r in rows if r[2] == lang], order, symbols)
        for text in ("the und", "les", "zzz q"):
            s = [0] * order + [int(x) for x in symbols[np.frombuffer(text.encode(), dtype=np.uint8)]]
            wanted = sum(-math.log(max(p(s[i - order : i], s[i]), 1e-12)) for i in range(order, len(s)))
            own = table[language_id.grams(np.array(s[order:]), order), langs.index(lang)].sum()
            assert own == pytest.approx(wanted, rel=1e-4)


def test_probabilities_of_a_context_add_up_to_one():
    counts = np.random.default_rng(1).integers(0, 3, language_id.SYMBOLS**3) * (np.random.default_rng(2).random(language_id.SYMBOLS**3) < 0.05)
    p = np.exp(-language_id.code_lengths(counts, 2)).reshape(-1, language_id.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-6)


@pytest.mark.parametrize("most", [1, 40, 1 << 21])
def test_remembered_rows_are_those_of_the_table(most):
    rng = np.random.default_rng(most)
    codes = np.unique(rng.integers(0, 256**2, 300))
    table = language_id.CodeLengths(np.repeat(codes, 2), np.tile([0, 1], len(codes)), rng.integers(1, 9, 2 * len(codes)), 2, 1)
    remembered = language_id.Remembered(table, most)
    for n in (0, 5, 60, 7, 200, 60):
        asked = np.unique(np.concatenate([rng.choice(codes, min(n, len(codes))), rng.integers(0, 256**2, n)]))
        np.testing.assert_array_equal(remembered[asked], table[asked])


def test_predictions_against_the_definition(spark):
    """Every document's language and score, by code lengths computed one byte at a time."""
    rows = documents(random.Random(8), 40) + [(500, "le und the", None, "s"), (501, "Zürich état", None, "s")]
    learn = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    models = {x: brute_tables([r[1] for r in learn if r[2] == x], 4, language_id.PLACES) for x in sorted({r[2] for r in learn})}
    out = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows)).collect()}
    for d, text, *_ in rows:
        s = [0] * 4 + [int(x) for x in language_id.PLACES[np.frombuffer(text.encode().lower(), dtype=np.uint8)]]
        nats = {x: sum(-math.log(max(p(s[i - 4 : i], s[i]), 1e-12)) for i in range(4, len(s))) for x, p in models.items()}
        best = min(nats, key=lambda x: (nats[x], x))
        assert out[d]["lang_pred"] == best
        assert out[d]["score"] == pytest.approx(1 / sum(math.exp(nats[best] - v) for v in nats.values()), rel=1e-2)


def test_held_out_accuracy_and_inputs(spark):
    rows = documents(random.Random(2))
    out = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r["held_out"]} == {r[0] for r in held}
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97
    # what a document says of itself beside its text does not matter
    again = {r["doc_id"]: r for r in language_id.identify(frame(spark, [(d, t, "fr" if zlib.crc32(str(d).encode()) % 4 == 2 else x, "other") for d, t, x, _ in rows])).collect()}
    assert all(again[i]["lang_pred"] == r["lang_pred"] and again[i]["score"] == r["score"] for i, r in out.items())


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = documents(rng, 80) + [(d + 1000 if d is not None else None, t, None, None) for d, t in awkward(rng)] + [(2000, "123 456 !!", "en", None), (2001, None, "de", None)]
    out = language_id.identify(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1001, 1002, 1003, 2000, 2001))
    assert all(0 <= r["score"] <= 1 for r in out)


def test_a_long_text_is_read_whole(spark):
    text = "the and of to " * 60_000 + "der die und das nicht ist " * 60_000
    rows = documents(random.Random(4), 80)
    langs, symbols, table = language_id.fit(frame(spark, rows).select("text", "lang"), 2)
    out = language_id.predict(frame(spark, [(1, text)]).select("doc_id", "text"), langs, symbols, table, 2).first()
    whole = table[language_id.grams(symbols[np.frombuffer(text.encode(), dtype=np.uint8)], 2)].sum(0, dtype=np.float64)
    assert out["lang_pred"] == langs[int(whole.argmin())] == "de"


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "text", None)]])
def test_nothing_to_learn_from(spark, rows):
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(frame(spark, rows)).collect()] == [("und", 0.0)] * len(rows)


def test_query_over_the_table(spark, small):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.QUERIES["op10_language_id"](spark, small).collect()
    assert {r["doc_id"] for r in out} == {*truth}
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) / len(held) > 0.9


def test_stage_keeps_clean_documents(spark):
    rows = documents(random.Random(5), 120) + [(900, None, "en"), (901, "12345 67890", "en"), (902, "", "en")]
    docs = frame(spark, rows)
    out = language_id.language_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(range(120))


def test_columns_with_the_names_of_results(spark):
    docs = frame(spark, documents(random.Random(9), 60)).withColumnsRenamed({"name": "lang_pred", "row": "score", "word": "__letter", "hash": "own"})
    out = language_id.language_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 60 and out.select("lang_pred").distinct().first()[0] == "x"


def test_a_sample_of_each_language(spark):
    rows = documents(random.Random(10), 300) + [(900, "och det att som", "sv", "s")]
    docs = frame(spark, rows).select("text", "lang")
    langs, some = language_id.some_of_each(docs, 40)
    counts = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    assert langs == ["de", "en", "fr", "sv"] and counts["sv"] == 1 and all(15 < counts[x] < 80 for x in ("de", "en", "fr"))


def test_more_than_64_languages_and_rare_scripts(spark):
    rng = random.Random(6)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for k in range(70)}
    text = lambda x, n=12: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(k, text(x, 30), x, "s") for k, x in enumerate([*words] * 4)]
    # two scripts of few documents, whose bytes are rare among all
    words["el"], words["ru"] = "και το να με για".split(), "и в не на что".split()
    rows += [(1000 + k, text(x, 5), x, "s") for k, x in enumerate(["el", "ru"] * 2)]
    langs, symbols, table = language_id.fit(frame(spark, rows).select("text", "lang"))
    assert langs == sorted(words)
    asked = [(k, text(x), x, "s") for k, x in enumerate(words)]
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame(spark, asked).select("doc_id", "text"), langs, symbols, table).collect()}
    assert out == {k: x for k, _, x, _ in asked}
