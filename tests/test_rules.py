import pytest
import yaml

from ruleframe import sinks
from ruleframe.operators import leaves
from ruleframe.plans import rules as R
from ruleframe.plans.engine import Analyzer, unquoted

FILES = [("src/a.txt", "one\ntwo old api\nthree"), ("src/b.txt", "old api\nold api again"), ("docs/c.md", "nothing here"), ("src/d.properties", "url=jdbc:x")]


def search(pattern, **more):
    return {"builtin.filecontent": {"pattern": pattern, **more}}


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def run(files, data, **options):
    return Analyzer(files=files, **options.pop("tables", {})).run([R.rule(x, "set", []) for x in data], **options)


def hits(result):
    return sorted((r["rule_id"], r["uri"], r["line_no"]) for r in result.incidents.collect())


@pytest.mark.parametrize("bad", [{"ruleID": "a\nb"}, {"ruleID": "a;b"}, {"ruleID": ""}, {"ruleID": "x"}, {"ruleID": "x", "message": "m"}, {"ruleID": "x", "when": search("a")}])
def test_bad_rules(bad):
    with pytest.raises(R.RuleError):
        R.rule(bad, "set", [])


@pytest.mark.parametrize("when", [{"and": []}, {"and": [search("a") | {"as": "x"}, search("b") | {"as": "x"}]}, {"or": [search("a") | {"as": "x", "from": "x"}]}, {"a": 1, "b": 2}])
def test_bad_conditions(when):
    with pytest.raises(R.RuleError):
        R.condition(when)


def test_producers_come_before_consumers_and_orphans_go():
    parts = R.condition({"and": [search("c") | {"from": "y"}, search("b") | {"as": "y", "from": "x"}, search("a") | {"as": "x"}, search("d") | {"from": "nobody"}]}).value
    assert [p.value["pattern"] for p in parts] == ["a", "b", "c"]


def test_loading_a_tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "ruleset.yaml").write_text(yaml.safe_dump({"name": "mine", "labels": ["l=1"]}))
    (tmp_path / "a.yaml").write_text(yaml.safe_dump([{"ruleID": "r1", "message": "m", "category": "Mandatory", "when": search("x")}, {"ruleID": "bad;id", "message": "m", "when": search("x")}]))
    (tmp_path / "a.test.yaml").write_text("not: rules")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "sub" / "b.yml").write_text(yaml.safe_dump([{"ruleID": "r2", "tag": ["T=a"], "category": "odd", "when": search("y")}]))
    out = {r.rule_id: r for r in R.load(str(tmp_path))}
    assert {k: (r.ruleset, r.category, r.labels) for k, r in out.items()} == {"r1": ("mine", "mandatory", ["l=1"]), "r2": (R.DEFAULT_RULESET, "potential", [])}
    (tmp_path / "b.yaml").write_text(yaml.safe_dump([{"ruleID": "r", "message": "m", "when": search("x")}] * 2))
    with pytest.raises(R.RuleError):
        R.load(str(tmp_path))


def test_gates(files):
    old, none = search("old api"), search("zzz")
    cases = {
        "and": {"and": [old, search("three")]}, "and-no": {"and": [old, none]}, "or": {"or": [old, none]}, "not": {"and": [search("three"), none | {"not": True}]},
        "not-no": {"and": [search("three"), old | {"not": True}]}, "lone-not": none | {"not": True}, "ignore": {"and": [search("three"), old | {"ignore": True}]}, "nested": {"or": [{"and": [old, none]}, search("three")]},
        # a part holds or not apart from the incidents that it shows
        "nested-not": {"and": [search("three"), {"or": [none | {"not": True}, search("yyy")]}]}, "nested-ignore": {"and": [search("three"), {"and": [old | {"ignore": True}]}]}, "nested-no": {"and": [search("three"), {"or": [none, search("yyy")]}]},
        "nested-negated": {"and": [search("three"), {"and": [old, none], "not": True, "ignore": True}]}, "deep": {"and": [search("three"), {"or": [{"and": [none | {"not": True}, {"or": [none, old | {"ignore": True}]}]}]}]},
    }
    out = run(files, [{"ruleID": k, "message": "m", "when": w} for k, w in cases.items()])
    by = {}
    for rule, uri, line in hits(out):
        by.setdefault(rule, []).append((uri, line))
    three, olds = [("src/a.txt", 3)], [("src/a.txt", 2), ("src/b.txt", 1), ("src/b.txt", 2)]
    assert by == {"and": sorted(olds + three), "or": olds, "not": three, "ignore": three, "nested": sorted(olds + three), "nested-not": three, "nested-ignore": three, "nested-negated": three, "deep": three}
    assert {r["rule_id"] for r in out.unmatched.collect()} == {"and-no", "not-no", "lone-not", "nested-no"}


def test_chains_scopes_limits_and_selectors(files, spark):
    chained = {"and": [{"builtin.file": {"pattern": "*.txt"}, "as": "f", "ignore": True}, search("o", filepaths="{{f.filepaths}}") | {"from": "f"}]}
    data = [{"ruleID": "c", "message": "at {{lineNumber}}", "labels": ["k=v"], "when": chained}, {"ruleID": "s", "message": "m", "labels": ["k=w"], "when": search("o")}]
    assert {u for _, u, _ in hits(run(files, data[:1]))} == {"src/a.txt", "src/b.txt"}
    out = run(files, data, selectors=["k=v"])
    assert {r for r, *_ in hits(out)} == {"c"} and [r["rule_id"] for r in out.skipped.collect()] == ["s"]
    assert len(hits(run(files, data[:1], most_incidents=2))) == 2
    assert {u for _, u, _ in hits(run(files, data[:1], excluded=["b[.]txt$"]))} == {"src/a.txt"}
    assert {u for _, u, _ in hits(run(files, data[:1], included=spark.createDataFrame([("src/b.txt",)], "path string")))} == {"src/b.txt"}


def test_unknown_searches(files):
    other = {"nodejs.other": {"x": 1}}
    out = run(files, [{"ruleID": "gone", "message": "m", "when": other}, {"ruleID": "and", "message": "m", "when": {"and": [other, search("old")]}}, {"ruleID": "or", "message": "m", "when": {"or": [other, search("old api again")]}}])
    assert hits(out) == [("or", "src/b.txt", 2)] and out.unmatched.count() == 0
    assert run(files, []).violations.count() == 0


def test_tags_reach_rules_that_ask_for_them(files, spark):
    data = [
        {"ruleID": "tagger", "tag": ["Lang=A, B", "found {{matchingText}}"], "when": search("old api again")},
        {"ruleID": "asks", "message": "m", "effort": 2, "when": {"builtin.hasTags": ["A", "B"]}}, {"ruleID": "asks-more", "message": "m", "when": {"builtin.hasTags": ["A", "C"]}},
    ]
    out = run(files, data)
    assert {r["tag"] for r in out.tags.collect()} == {"A", "B", "found old api again"}
    assert {r for r, *_ in [(x["rule_id"],) for x in out.incidents.collect()]} == {"tagger", "asks"}
    more = run(files, data, tables={"tags": spark.createDataFrame([("C",)], "tag string")})
    assert "asks-more" in {x["rule_id"] for x in more.incidents.collect()}


def test_custom_variables_snippets_and_report(files, tmp_path):
    data = [{"ruleID": "v", "message": "{{word}} {{other}}", "effort": 1, "when": search("old api"), "customVariables": [{"pattern": "old (?P<w>[a-z]+)", "name": "word", "nameOfCaptureGroup": "w", "defaultValue": "-"}, {"pattern": "zzz", "name": "other", "defaultValue": "none"}]}]
    out = run(files, data, snippets=1, context=1)
    assert {r["message"] for r in out.incidents.collect()} == {"api none"}
    first = out.violations.first()
    assert first["kind"] == "violation" and first["incidents"][0]["code_snip"] == "2  two old api\n3  three\n"
    assert sum(i["code_snip"] is not None for i in first["incidents"]) == 2  # one for each file
    sinks.write_report(out, str(tmp_path / "out.yaml"))
    report = yaml.safe_load((tmp_path / "out.yaml").read_text())
    assert report[0]["name"] == "set" and len(report[0]["violations"]["v"]["incidents"]) == 3
    sinks.write_tables(out, str(tmp_path / "tables"))
    assert sinks.exit_code(out, True) == 3 and sinks.exit_code(out, False) == 0


def test_capability_schema():
    schema = sinks.capability_schema({"builtin.file": {"pattern": "string"}})["components"]["schemas"]
    assert {"builtin.file", "and", "or", "rule"} <= {*schema}


@pytest.mark.parametrize("pattern,lines", [("^import x", [2]), ("old$", [1, 3]), (r"\Aimport", [2]), (r"old(?!\W)", [1, 3]), ("^$", [4]), ("^import\\s+x", [2]), (r"old\s*$", [1, 3])])
def test_a_pattern_finds_the_same_alone_and_beside_another(spark, pattern, lines):
    content = spark.createDataFrame([("a", "is old\nimport x\nvery old\n"), ("b", "see import")], "path string, content string")
    for patterns in ({"r": pattern}, {"r": pattern, "other": "zzz"}):
        found = [(r["uri"], r["line_no"]) for r in leaves.filecontent(content, patterns).collect()]
        assert sorted({n for u, n in found if u == "a"}) == lines and not any(u == "b" for u, _ in found)


def test_all_content_searches_share_one_scan(spark, tmp_path):
    """The files are read once however many rules there are; what follows reads the stored incidents."""
    spark.createDataFrame(FILES, "path string, content string").write.parquet(str(tmp_path / "files"))
    table = spark.read.parquet(str(tmp_path / "files"))
    data = [{"ruleID": f"r{k}", "message": "m", "when": {"and": [search("old api"), search("t[a-z]+ee") | {"as": "x"}, search("o", filepaths="{{x.filepaths}}") | {"from": "x"}]}} for k in range(20)]
    out = run(table, data)
    plan = out.incidents._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and len(hits(out)) == 20 * 5


def test_literals_in_rules_count_where_they_overlap(files, spark):
    rows = spark.createDataFrame([("a", "bananana\nanana xanan")], "path string, content string")
    found = leaves.filecontent(rows, {"r": "anan", "s": "a[n]an", "t": "n\\nan"})
    assert sorted((r["rule_id"], r["line_no"]) for r in found.collect()) == [("r", 1), ("r", 1), ("r", 2), ("r", 2), ("s", 1), ("s", 2), ("s", 2)]


@pytest.mark.parametrize(("given", "wanted"), [('"a"', "a"), ('""a""', '"a"'), ('a\\"', 'a\\"'), ("a", "a")])
def test_quotes_of_patterns(given, wanted):
    assert unquoted(given) == wanted


def test_xml_of_any_form(spark):
    rows = [("a.xml", '<?xml version="1.0"?>\n<p xmlns="http://x" xmlns:q="http://y">\n <q:d>\n  <v>hi</v>\n </q:d><e k="1"/></p>'), ("b.xml", "<p><d></p>"), ("c.xml", "no & <x"), ("d.xml", "<d><v>two</v><!-- <bad> --></d>"), ("e.xml", ""), ("f.xml", "<a><b></a></b>"), ("g.xml", None)]
    table = spark.createDataFrame(rows, "path string, content string")
    of = lambda path: sorted((r["uri"], r["line_no"], r["variables"]["innerText"]) for r in leaves.xml(table, "r", path).collect())
    assert of("//q:d/v") == of("//d/v") == [("a.xml", 4, "hi"), ("d.xml", 1, "two")]
    assert [x[2] for x in of("/p/e/@k")] == ["1"]


def test_json_at_any_depth(spark):
    rows = [("a.json", '{"a":{"b":{"c":{"k":1}}}}'), ("b.json", '{"a":[{"k":"x"},{"k":[1,2]}],"k":{"k":true}}'), ("c.json", "{bad"), ("d.json", None)]
    table = spark.createDataFrame(rows, "path string, content string")
    of = lambda path: sorted((r["uri"], r["variables"]["matchingJSON"]) for r in leaves.json(table, "r", path).collect())
    assert of("//k") == [("a.json", "1"), ("b.json", "[1,2]"), ("b.json", "true"), ("b.json", "x"), ("b.json", '{"k":true}')]
    assert of("/a/b/c/k") == [("a.json", "1")]


def test_multiline_grep(spark):
    rows = [("a", "one\n\ttwo \n three\nfour"), ("b", "three\none"), ("c", None)]
    table = spark.createDataFrame(rows, "path string, content string")
    of = lambda pattern, window=3: sorted((r["uri"], r["line_no"]) for r in leaves.multiline_grep(table, "r", pattern, window).collect())
    assert of("one.two") == [("a", 1)] and of("two\nthree") == [("a", 1)] and of("three\nfour", 2) == [("a", 3)] and of("one.*four") == [] and of("one.*four", 9) == [("a", 1)]
    assert of(leaves.element_pattern("  one\n two"), 5) == [("a", 1)]
