import datetime
import io
import json
import random
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from ruleframe import cli, sinks
from ruleframe.operators import dependencies as D
from ruleframe.operators import leaves
from ruleframe.sources import archives, dependencies, files
from ruleframe.sources.symbols import language_of, symbols
from ruleframe.streaming import changes, progress


def test_a_tree_is_read_without_excluded_and_large_files(spark, tmp_path):
    for name, data in {"src/a.txt": b"one\r\ntwo", "node_modules/b.txt": b"x", "big.txt": b"y" * 50, "sub/c.txt": "日本".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r["path"]: r["content"] for r in files.read_tree(spark, str(tmp_path), most_bytes=40).collect()}
    assert found == {"src/a.txt": "one\ntwo", "sub/c.txt": "日本"}
    assert "node_modules/b.txt" in {r["path"] for r in files.read_tree(spark, str(tmp_path), excluded=[]).collect()}


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_inside_archives(spark, tmp_path):
    inner = zipped({"org/x/A.class": b"\xca\xfe", "META-INF/maven/g/a/pom.properties": b"groupId=g\nartifactId=a\nversion=1.2\n"})
    (tmp_path / "app.war").write_bytes(zipped({"WEB-INF/lib/in.jar": inner, "WEB-INF/classes/p/B.class": b"x", "index.jsp": b"<p>", "../evil": b"no"}))
    (tmp_path / "broken.jar").write_bytes(b"no archive")
    out = archives.read_archives(spark, str(tmp_path))
    assert {(r["path"], r["depth"]) for r in out.collect()} == {("WEB-INF/lib/in.jar", 0), ("WEB-INF/classes/p/B.class", 0), ("index.jsp", 0), ("org/x/A.class", 1), ("META-INF/maven/g/a/pom.properties", 1)}
    assert [(r["name"], r["version"]) for r in archives.embedded_coordinates(out).collect()] == [("g.a", "1.2")]
    placed = {r["path"]: r["to"] for r in out.filter("depth = 0").select("path", archives.project_path(F.col("path")).alias("to")).collect()}
    assert placed == {"WEB-INF/lib/in.jar": None, "WEB-INF/classes/p/B.class": "src/main/java/p/B.java", "index.jsp": "src/main/webapp/index.jsp"}


def test_symbols_of_other_languages(spark):
    rows = [("a.py", "import os.path\nclass A:\n    def run(self):\n        go(1)"), ("b.go", 'import "fmt"\ntype T struct {}\nfunc (t T) Do() { fmt.Println(1) }'), ("c.ts", "import {x} from 'lib/y'\nclass C {}"), ("d.txt", "class No")]
    found = {(r["uri"], r["location"], r["name"]) for r in symbols(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert {("a.py", "IMPORT", "os.path"), ("a.py", "TYPE", "A"), ("a.py", "METHOD", "run"), ("b.go", "IMPORT", "fmt"), ("b.go", "TYPE", "T"), ("b.go", "METHOD", "Do"), ("b.go", "METHOD_CALL", "fmt.Println"), ("c.ts", "IMPORT", "lib/y"), ("c.ts", "TYPE", "C")} <= found
    assert not any(u == "d.txt" for u, *_ in found)
    assert spark.range(1).select(language_of(F.lit("x/A.java")).alias("l")).first()["l"] == "java"


def test_build_tool():
    assert dependencies.build_tool({"gradlew", "pom.xml"}) == "gradle" and dependencies.build_tool({"a.war", "pom.xml"}) == "binary"
    assert dependencies.build_tool({"pom.xml"}) == "maven" and dependencies.build_tool({"x"}) is None


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.java").write_text("import com.old.Api;\nclass A { }\n")
    (tmp_path / "rules.yaml").write_text(yaml.safe_dump([{"ruleID": "r", "message": "uses {{name}}", "effort": 1, "when": {"java.referenced": {"pattern": "com.old*", "location": "IMPORT"}}}]))
    out = tmp_path / "out.yaml"
    args = cli.parser().parse_args(["analyze", "--rules", str(tmp_path / "rules.yaml"), "--input", str(tmp_path / "in"), "--output", str(out), "--error-on-violation", "--tables", str(tmp_path / "t")])
    assert cli.analyze(spark, args) == sinks.VIOLATIONS_FOUND
    incident = yaml.safe_load(out.read_text())[0]["violations"]["r"]["incidents"][0]
    assert incident["message"] == "uses com.old.Api" and incident["line_no"] == 1 and "import com.old.Api" in incident["code_snip"]
    (tmp_path / "tree.txt").write_text("[INFO] top:app:jar:1\n[INFO] +- g:a:jar:2:compile\n[INFO] |  \\- g:b:jar:3:compile\n")
    args = cli.parser().parse_args(["deps", "--listing", str(tmp_path / "tree.txt"), "--output", str(out), "--tree", "--open-source", "^g[.]a"])
    assert cli.list_dependencies(spark, args) == 0
    rows = yaml.safe_load(out.read_text())[0]["dependencies"]
    assert [(r["name"], r["labels"], r.get("addedDeps")) for r in rows] == [("g.a", ["open-source"], [{"name": "g.b"}]), ("g.b", ["internal"], None)]


def test_changes_are_searched_again(spark, tmp_path):
    evaluate = lambda df: leaves.filecontent(df, {"r": "bad"})
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    steps = [[("a", "bad\nok\nbad", False, 1), ("b", "ok", False, 2)], [("a", "ok", False, 3), ("b", "x\nbad", False, 4), ("b", "bad", False, 5)], [("c", "bad", True, 6)]]
    wanted = [{("a", 1), ("a", 3)}, {("b", 1)}, {("b", 1), ("c", 1)}]
    for n, (rows, want) in enumerate(zip(steps, wanted, strict=True)):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "content", "saved", "seq"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(changes.CHANGE).json(str(source))
        q = changes.keep_fresh(stream, str(store), evaluate, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
        assert {(r["uri"], r["line_no"]) for r in spark.read.parquet(str(store / str(n))).collect()} == want


def test_deep_dependency_files_meet_their_prefix(spark):
    jar = "file:///home/u/.m2/repository/org/apache/logging/log4j/log4j-core/2.17.1"
    rows = [("r", f"{jar}/a/B.class", 1, {}, True), ("r", "file:///home/u/.m2/repository/org/apache/logging/log4j/log4j-core/2.17.0/a/B.class", 1, {}, True), ("r", "src/C.java", 1, {}, False)]
    found = spark.createDataFrame(rows, "rule_id string, uri string, line_no int, variables map<string,string>, is_dep boolean")
    kept = D.of_selected(found, spark.createDataFrame([(jar,)], "prefix string")).collect()
    assert {r["uri"] for r in kept} == {rows[0][1], "src/C.java"}


def test_flatten_lists_the_whole_graph_or_fails(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "parent string, child string")
    root = spark.createDataFrame([("n0",)], "node string")
    assert {(r["node"], r["depth"]) for r in D.flatten(spark, chain, root, 6).collect()} == {(f"n{k}", k) for k in range(7)}
    with pytest.raises(Exception, match="longer than 5 steps"):
        D.flatten(spark, chain, root, 5).count()


def test_flatten_counts_paths_that_nobody_could_list(spark):
    # 21 layers of two nodes, each of which leads to both of the next: 2^21 paths, more than Spark's own recursion lists
    layers = spark.createDataFrame([(f"{k}{a}", f"{k + 1}{b}") for k in range(21) for a in "xy" for b in "xy"], "parent string, child string")
    out = D.flatten(spark, layers, spark.createDataFrame([("0x",)], "node string"))
    assert {tuple(r) for r in out.collect()} == {("0x", "0x", 0, 1)} | {("0x", f"{k}{a}", k, 2 ** (k - 1)) for k in range(1, 22) for a in "xy"}
    with pytest.raises(Exception, match="longer than 9 steps"):  # a cycle
        D.flatten(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), spark.createDataFrame([("a",)], "node string"), 9).count()


def test_throttling_holds_no_group_in_memory(spark):
    # the plan has no list of a key's events; the rows are those of a loop over each key's events in time order
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=rng.randrange(60_000)), rng.randrange(10), 9) for _ in range(3000)]
    rows += [("hot", datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=k * 7), k % 8, 9) for k in range(25_000)]
    out = progress.throttled(spark.createDataFrame(rows, "key string, ts timestamp, current long, total long").repartition(5))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    wanted, last = [], {}
    for key, ts, current, total in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        if key not in last or current == total or ts - last[key] >= datetime.timedelta(milliseconds=500):
            last[key] = ts
            wanted.append((key, ts, current, total))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)


def test_throttled_stream_as_in_batch(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:0{s}.{ms:03d}", c, 9) for s, ms, c in [(0, 0, 1), (0, 200, 2), (0, 499, 3), (0, 500, 4), (1, 100, 5), (1, 200, 9), (1, 300, 6)]]
    schema = "key string, ts timestamp, current long, total long"
    path = tmp_path / "events"
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(dict(zip(("key", "ts", "current", "total"), r, strict=True))) for r in rows))
    batch = {r["current"] for r in progress.throttled(spark.read.schema(schema).json(str(path))).collect()}
    assert batch == {1, 4, 5, 9}
    lines = io.StringIO()
    spark.streams.addListener(listener := sinks.ProgressLines(lines))
    q = progress.throttle_stream(spark.readStream.schema(schema).json(str(path))).writeStream.format("memory").queryName("throttled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(listener)
    assert {r["current"] for r in spark.table("throttled").collect()} == batch
