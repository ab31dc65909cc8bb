from collections import Counter, defaultdict

import corpus_pipeline
from ruleframe.llm import language_id, shingle_join
from ruleframe.llm.common import Scratch
from tests.llm.test_line_dedup import brute as lines_by_brute_force
from tests.llm.test_packing import check as packed
from tests.llm.test_shingle_join import brute as near_by_brute_force


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "shingle_join", "mixing", "packing"]


def test_each_stage_on_what_the_one_before_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 2500 or text is null")
    columns, scratch, kept = docs.columns, Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.collect()
    texts = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    # language: what has no text goes, clean documents stay
    before = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 2500").count()
    assert 0.9 * before < len(kept["language_id"]) <= before
    # lines
    wanted = [(d, t) for d, t, _ in lines_by_brute_force(spark, texts(kept["language_id"]), 2, 20) if t is not None and t.strip(" ")]
    assert Counter(texts(kept["line_dedup"])) == Counter(wanted)
    # near-duplicates: the smallest of each group
    groups = near_by_brute_force(texts(kept["line_dedup"]), 5, (80, 100))
    assert Counter(r["doc_id"] for r in kept["shingle_join"]) == Counter(d for d, _, c in groups if d == c)
    # mixing: every document once at least, small sources up to twice as often
    reads = Counter(r["doc_id"] for r in kept["mixing"])
    assert {*reads} == {r["doc_id"] for r in kept["shingle_join"]}
    tokens = defaultdict(int)
    for r in kept["mixing"]:
        tokens[r["source"]] += len(r["text"].split())
    # packing: an exact round trip
    rows = texts(kept["mixing"])
    assert packed(rows, kept["packing"], 2048) > 0.85


def test_run_gives_what_the_stages_give(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_empty_table(spark, small, tmp_path):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert language_id.language_stage(spark, empty, "").count() == 0
    assert shingle_join.near_stage(spark, empty, "").count() == 0
