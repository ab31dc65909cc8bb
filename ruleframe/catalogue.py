"""One query for each operator of the rule engine, bound to the test tables, with DuckDB SQL for the same result.

Files are the documents (path ``source/doc_id.lang``), markup files the pages, JSON files the events' properties; a dependency
is a line item (file: order, name: part type, version: from the part's size and the quantity), a change stream the conversations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ruleframe.functions import labels as L
from ruleframe.functions import text as T
from ruleframe.functions.versions import semver, version
from ruleframe.operators import combine as C
from ruleframe.operators import dependencies as D
from ruleframe.operators import emit, leaves
from ruleframe.sources import dependencies as SD
from ruleframe.sources import files as S
from ruleframe.sources.symbols import kind_name
from ruleframe.streaming import changes, progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return S.documents_as_files(read(spark, sf, "documents"))


def flat(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "uri", "line_no", F.map_values("variables")[0].alias("found"))


FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS path, coalesce(text, '') AS content, n_chars AS size FROM documents)"
LINES = FILES + ", arr AS (SELECT path, string_split(content, chr(10)) AS a FROM files), lines AS (SELECT path, i::int AS line_no, a[i] AS line FROM (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM arr))"


def hits_sql(rule: str, pattern: str, where: str = "true") -> str:
    """Matches of a pattern line by line, with chosen name."""
    return f"SELECT '{rule}' AS rule_id, path AS uri, line_no, unnest(regexp_extract_all(line, '{pattern}', 0)) AS found FROM lines WHERE {where}"


# ---- sources and scopes -------------------------------------------------------------------------------------------------


@query("scan_lines", f"WITH {LINES} SELECT path, count(*) AS n_lines, sum(length(line))::bigint AS chars, max(line_no) AS last_line FROM lines GROUP BY path")
def scan_lines(spark, sf):
    lines = S.lines(files(spark, sf))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").alias("last_line"))


@query("file_by_pattern", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, 'src1[0-9]/[0-9]*7[.]en$')")
def file_by_pattern(spark, sf):
    return leaves.file(files(spark, sf), "r", "src1[0-9]/[0-9]*7[.]en$").select(F.col("uri").alias("path"))


@query("file_by_glob", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '[.]de$')")
def file_by_glob(spark, sf):
    return leaves.file(files(spark, sf), "r", "*.de").select(F.col("uri").alias("path"))


@query("file_by_name", f"WITH {FILES} SELECT path FROM files WHERE regexp_replace(path, '^.*/', '') IN ('17.en', '8.en')")
def file_by_name(spark, sf):
    f = files(spark, sf)
    return f.filter(T.path_matches(F.col("path"), "17.en") | T.path_matches(F.col("path"), "8.en")).select("path")


@query("scope_include_exclude", f"WITH {FILES} SELECT path FROM files WHERE (path LIKE 'src1/%' OR path LIKE 'src2/%') AND NOT regexp_matches(path, '[.]fr$')")
def scope_include_exclude(spark, sf):
    f = files(spark, sf)
    p = F.col("path")
    return f.filter((T.within_base(p, "src1") | T.within_base(p, "src2/")) & ~T.path_matches(p, r"[.]fr$")).select("path")


@query("scope_precedence", f"WITH {FILES} SELECT path, 'rule' AS scope FROM files WHERE path LIKE 'src3/%' AND NOT regexp_matches(path, '[.]es$') UNION ALL SELECT path, 'provider' FROM files WHERE NOT regexp_matches(path, '[.]en$') UNION ALL SELECT path, 'condition' FROM files WHERE path LIKE 'src3/%' AND regexp_matches(path, '[.]de$')")
def scope_precedence(spark, sf):
    f, p = files(spark, sf).select("path"), F.col("path")
    rule, provider = S.Scope(("src3",), ("[.]es$",)), S.Scope((), ("[.]en$",))
    named = [("rule", S.in_scope(p, (), rule, provider)), ("provider", S.in_scope(p, (), S.Scope(), provider)), ("condition", S.in_scope(p, ("[.]de$",), rule, provider))]
    return reduce(DataFrame.unionAll, [f.filter(c).select("path", F.lit(n).alias("scope")) for n, c in named])


@query("default_exclusions", f"WITH {FILES} SELECT 'vendor/' || path AS path, true AS excluded FROM files UNION ALL SELECT path, false FROM files")
def default_exclusions(spark, sf):
    f = files(spark, sf).select("path")
    both = f.unionAll(f.select(F.concat(F.lit("vendor/"), "path").alias("path")))
    return both.select("path", S.in_excluded_dir(F.col("path")).alias("excluded"))


@query("size_guard", f"WITH {FILES} SELECT path, size FROM files WHERE size <= 1500")
def size_guard(spark, sf):
    return files(spark, sf).filter(F.col("size") <= 1500).select("path", "size")


# ---- content searches ---------------------------------------------------------------------------------------------------

WORD = "[A-Za-z]*tion[a-z]*ed[a-z]*"


@query("filecontent_lines", f"WITH {LINES} {hits_sql('r', WORD)}")
def filecontent_lines(spark, sf):
    return flat(leaves.filecontent(files(spark, sf), {"r": WORD}))


@query(
    "filecontent_literal_overlap",
    f"""WITH {FILES}, spots AS (SELECT path, content, unnest(range(1, length(content) - 2)) AS i FROM files WHERE contains(content, 'anan'))
    SELECT 'r' AS rule_id, path AS uri, (1 + length(left(content, i - 1)) - length(replace(left(content, i - 1), chr(10), '')))::int AS line_no, 'anan' AS found FROM spots WHERE substr(content, i, 4) = 'anan'""",
)
def filecontent_literal_overlap(spark, sf):
    return flat(leaves.literal(files(spark, sf), "r", "anan"))


@query(
    "filecontent_multiline",
    f"WITH {FILES} SELECT 'r' AS rule_id, path AS uri, unnest(regexp_extract_all(content, '[a-z]+[.]\\nAn[a-z]*', 0)) AS found FROM files",
)
def filecontent_multiline(spark, sf):
    return flat(leaves.filecontent(files(spark, sf), {"r": "[a-z]+[.]\\nAn[a-z]*"})).drop("line_no")


@query(
    "filecontent_multiline_lines",
    f"""WITH {LINES}, nxt AS (SELECT path, line_no, line, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines)
    SELECT 'r' AS rule_id, path AS uri, line_no FROM nxt WHERE regexp_matches(line, '[a-z][.]$') AND regexp_matches(n, '^An')""",
)
def filecontent_multiline_lines(spark, sf):
    # what follows is only looked at: a line "An." both ends one place and begins the next
    return leaves.filecontent(files(spark, sf), {"r": "[a-z][.](?=\\nAn)"}).select("rule_id", "uri", "line_no")


ENGLISH = "regexp_matches(path, '[.]en$')"


@query("filecontent_file_pattern", f"WITH {LINES} {hits_sql('r', WORD, where=ENGLISH)}")
def filecontent_file_pattern(spark, sf):
    return flat(leaves.filecontent(files(spark, sf), {"r": WORD}, "[.]en$"))


RULES = {"license": "[Ll]icensed? under [A-Za-z ]+", "digits": "[0-9]{8,}", "title": "^[A-Z][a-z]+ [a-z]+ ation"}


@query("filecontent_multi_rule", f"WITH {LINES} " + " UNION ALL ".join(hits_sql(r, p) for r, p in RULES.items()))
def filecontent_multi_rule(spark, sf):
    return flat(leaves.filecontent(files(spark, sf), RULES))


@query("whole_word", f"WITH {LINES} SELECT path AS uri, line_no FROM lines WHERE regexp_matches(line, '(^|[^0-9A-Za-z_$#])the($|[^0-9A-Za-z_$#])')")
def whole_word(spark, sf):
    return S.lines(files(spark, sf)).filter(F.col("line").rlike(T.whole_word("the"))).select(F.col("path").alias("uri"), "line_no")


@query("html_href", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[A-Z][^\"]*)\"', 1)) AS found FROM pages")
def html_href(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return leaves.attribute(p, "r", "href", "^/[A-Z]").select(F.col("uri").alias("page_id"), F.map_values("variables")[0].alias("found"))


@query("markup_attribute", "SELECT page_id, unnest(regexp_extract_all(html, 'lang=\"([a-z]+)\"', 1)) AS found FROM pages")
def markup_attribute(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return leaves.attribute(p, "r", "lang", "^[a-z]+$").select(F.col("uri").alias("page_id"), F.map_values("variables")[0].alias("found"))


@query("xml_wellformed_xpath", "SELECT p_partkey || '.xml' AS uri, p_brand AS found FROM part UNION ALL SELECT p_partkey || '.xml', p_type FROM part WHERE p_size > 25")
def xml_wellformed_xpath(spark, sf):
    p = read(spark, sf, "part")
    tag = lambda name, c: F.concat(F.lit(f"<{name}><v> "), c, F.lit(f"</v></{name}>"))
    xml = F.concat(F.lit("<part>"), tag("dep", F.col("p_brand")), F.when(F.col("p_size") > 25, tag("dep", F.col("p_type"))).otherwise(""), F.lit("</part>"))
    f = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"), xml.alias("content"))
    return flat(leaves.xml(f, "r", "//dep/v")).select("uri", "found")


@query("json_path", "SELECT event_id::varchar AS uri, json_extract_string(props, '$.k') AS found FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_path(spark, sf):
    f = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"))
    return flat(leaves.json(f, "r", "/k")).select("uri", "found")


@query("json_any_depth", "SELECT event_id::varchar AS uri, json_extract_string(props, '$.k') AS found FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_any_depth(spark, sf):
    nested = F.concat(F.lit('{"a": '), "props", F.lit("}"))
    f = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), nested.alias("content"))
    return flat(leaves.json(f, "r", "//k")).select("uri", "found")


# ---- tags, resources, dependencies, symbols -----------------------------------------------------------------------------

TAGS = "tags AS (SELECT DISTINCT source AS file, lang AS tag FROM documents)"


def tag_table(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("file"), F.col("lang").alias("tag")).distinct()


@query("has_tags", f"WITH {TAGS} SELECT file AS uri, 'de,es,fr' AS found FROM tags WHERE tag IN ('de', 'es', 'fr') GROUP BY file HAVING count(DISTINCT tag) = 3")
def has_tags(spark, sf):
    return flat(leaves.has_tags(tag_table(spark, sf), "r", ["fr", "de", "es"], "file")).select("uri", "found")


DEPRECATIONS = [("d1", "Brand#1", "SMALL", "v1.3", "v1.6", "x"), ("d2", "Brand#2", "LARGE", "v1.9.1", "", "y"), ("d3", "Brand#3", "SMALL", "1.2", "v1.4", None), ("d4", "Brand#1", "LARGE", "", "", "")]


@query(
    "k8s_style_deprecation",
    """WITH res AS (SELECT p_partkey || '' AS uri, left(p_brand, 7) AS api_version, CASE WHEN p_size > 25 THEN 'LARGE' ELSE 'SMALL' END AS kind FROM part)
    SELECT CASE WHEN api_version = 'Brand#1' THEN 'd1' ELSE 'd3' END AS rule_id, uri FROM res WHERE kind = 'SMALL' AND api_version IN ('Brand#1', 'Brand#3')""",
)
def k8s_style_deprecation(spark, sf):
    res = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("uri"), F.lit(0).alias("doc_idx"), F.substring("p_brand", 1, 7).alias("api_version"), F.when(F.col("p_size") > 25, "LARGE").otherwise("SMALL").alias("kind"), F.lit(1).alias("kind_line"))
    rules = spark.createDataFrame(DEPRECATIONS, "rule_id string, api_version string, kind string, deprecated_in string, removed_in string, replacement string")
    return leaves.k8s_deprecated(res, rules, "v1.4.2").select("rule_id", "uri")


@query(
    "k8s_resources",
    "SELECT p_partkey || '.yaml' AS uri, d::int AS doc_idx, CASE WHEN d = 0 THEN 'apps/v1' ELSE 'v1' END AS api_version, (CASE WHEN d = 0 THEN 1 ELSE 5 END)::int AS api_line, CASE WHEN d = 0 THEN 'Deployment' ELSE 'Service' END AS kind, (CASE WHEN d = 0 THEN 2 ELSE 6 END)::int AS kind_line FROM part, (VALUES (0), (1)) v(d)",
)
def k8s_resources(spark, sf):
    text = F.concat(F.lit("apiVersion: apps/v1\nkind: Deployment\nname: "), F.col("p_name"), F.lit('\n---\napiVersion: "v1"\nkind: Service # comment\n'))
    return leaves.k8s_resources(read(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("path"), text.alias("content")))


DEPS = """deps AS (SELECT 'order/' || l_orderkey AS file_uri, p_type AS name, p_size || '.' || l_quantity::int || '.0.Final' AS version, s_name AS resolved_id, l_linestatus = 'F' AS indirect, l_returnflag AS type
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
RANK = "(regexp_extract(version, '^([0-9]+)', 1)::bigint * 1000 + regexp_extract(version, '^[0-9]+[.]([0-9]+)', 1)::bigint)"


def deps(spark, sf):
    li, part, sup = (read(spark, sf, x) for x in ("lineitem", "part", "supplier"))
    joined = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    v = F.concat_ws(".", F.col("p_size").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("0.Final"))
    return joined.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("file_uri"), F.col("p_type").alias("name"), v.alias("version"), F.col("s_name").alias("resolved_id"), (F.col("l_linestatus") == "F").alias("indirect"), F.col("l_returnflag").alias("type"))


@query("dependency_bounds", f"WITH {DEPS} SELECT file_uri AS uri, name, version FROM deps WHERE regexp_matches(name, '^(STANDARD|SMALL)') AND {RANK} BETWEEN 10005 AND 30000")
def dependency_bounds(spark, sf):
    return leaves.dependency(deps(spark, sf), "r", name_regex="^(STANDARD|SMALL)", lower="10.5", upper="v30").select("uri", F.col("variables")["name"].alias("name"), F.col("variables")["version"].alias("version"))


@query("dependency_name_regex", f"WITH {DEPS} SELECT file_uri AS uri, name, version FROM deps WHERE regexp_matches(name, 'S[A-Z]*L')")
def dependency_name_regex(spark, sf):
    return leaves.dependency(deps(spark, sf), "r", name_regex="S[A-Z]*L").select("uri", F.col("variables")["name"].alias("name"), F.col("variables")["version"].alias("version"))


@query("dependency_first_hit", f"WITH {DEPS}, top AS (SELECT min(name) AS n FROM deps) SELECT file_uri AS uri, min(version) AS version FROM deps, top WHERE name = n GROUP BY file_uri")
def dependency_first_hit(spark, sf):
    d = deps(spark, sf)
    name = read(spark, sf, "part").agg(F.min("p_type")).first()[0]
    return leaves.dependency(d, "r", name=name).select("uri", F.col("variables")["version"].alias("version"))


@query("dep_dedup_direct_wins", f"WITH {DEPS} SELECT file_uri, name, version, resolved_id, min(indirect) AS indirect FROM deps GROUP BY ALL")
def dep_dedup_direct_wins(spark, sf):
    return D.distinct_dependencies(deps(spark, sf))


EDGES = "edges AS (SELECT DISTINCT 'c' || c_custkey AS parent, 'o' || o_orderkey AS child FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%' UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def edges(spark, sf):
    o, c, li = (read(spark, sf, x) for x in ("orders", "customer", "lineitem"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    a = o.filter("o_orderpriority LIKE '1%'").join(c, F.col("o_custkey") == F.col("c_custkey")).select(key("c", "c_custkey").alias("parent"), key("o", "o_orderkey").alias("child"))
    b = li.filter("l_linenumber = 1").select(key("o", "l_orderkey").alias("parent"), key("p", "l_partkey").alias("child"))
    n = c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child"))
    return a.union(b).union(n).distinct()


@query("dep_flatten_recursive", f"WITH RECURSIVE {EDGES}, walk(root, node, depth) AS (SELECT parent, parent, 0 FROM (SELECT DISTINCT parent FROM edges WHERE parent LIKE 'n%') UNION ALL SELECT root, child, depth + 1 FROM walk JOIN edges ON parent = node) SELECT root, node, depth, count(*) AS paths FROM walk GROUP BY ALL")
def dep_flatten_recursive(spark, sf):
    e = edges(spark, sf)
    return D.flatten(spark, e, e.filter("parent LIKE 'n%'").select(F.col("parent").alias("node")).distinct())


@query("dep_two_level_dag", f"WITH {EDGES} SELECT d.child AS direct, array_to_string(list(b.child ORDER BY b.child) FILTER (b.child IS NOT NULL), ',') AS indirect FROM edges d LEFT JOIN edges b ON b.parent = d.child WHERE d.parent = 'n3' GROUP BY 1")
def dep_two_level_dag(spark, sf):
    return D.two_levels(edges(spark, sf), "n3").select("direct", F.when(F.size("indirect") > 0, F.array_join("indirect", ",")).alias("indirect"))


@query("dep_labels", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^PROMO') THEN CASE WHEN regexp_matches(p_type, 'STEEL$') THEN 'metal,open-source' ELSE 'open-source' END WHEN regexp_matches(p_type, 'STEEL$') THEN 'internal,metal' ELSE 'internal' END AS labels FROM part")
def dep_labels(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name"))
    return D.labelled(d, {"^PROMO": "open-source", "STEEL$": "metal"}).select("p_partkey", F.array_join("labels", ",").alias("labels"))


@query(
    "dep_label_selector_prefix",
    f"WITH {FILES}, inc AS (SELECT path AS uri, path LIKE '%.en' AS is_dep FROM files) SELECT uri, is_dep FROM inc WHERE NOT is_dep OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey <= 12 AND inc.uri LIKE 'src' || s_suppkey || '/%')",
)
def dep_label_selector_prefix(spark, sf):
    found = leaves.incidents(files(spark, sf), "r", "path").withColumn("is_dep", F.col("uri").endswith(".en"))
    chosen = read(spark, sf, "supplier").filter("s_suppkey <= 12").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("prefix"))
    return D.of_selected(found, chosen).select("uri", "is_dep")


@query("dep_location", "SELECT p_partkey || '/pom.xml' AS path, 'g.' || p_brand || '.' || p_partkey AS name, (2)::int AS line_no FROM part")
def dep_location(spark, sf):
    text = F.concat(F.lit("<dependency>\n <groupId>g."), "p_brand", F.lit("</groupId>\n\n <artifactId>"), F.col("p_partkey").cast("string"), F.lit("</artifactId>\n</dependency>"))
    f = read(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/pom.xml")).alias("path"), text.alias("content"))
    return D.locations(S.lines(f))


@query("pom_dependencies", "SELECT p_partkey || '/pom.xml' AS path, 'g.' || p_partkey AS name, CASE WHEN p_size > 25 THEN '7.' || p_size ELSE '1.0' END AS version FROM part")
def pom_dependencies(spark, sf):
    text = F.concat(
        F.lit("<project><properties><v.x>7."), F.col("p_size").cast("string"), F.lit("</v.x></properties>\n<dependency>\n<groupId>g</groupId><artifactId>"), F.col("p_partkey").cast("string"),
        F.lit("</artifactId><version>"), F.when(F.col("p_size") > 25, "${v.x}").otherwise("1.0"), F.lit("</version></dependency></project>"),
    )
    return SD.pom_dependencies(read(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/pom.xml")).alias("path"), text.alias("content")))


@query("sha_lookup", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'sha:' || p_partkey WHEN p_size > 20 THEN 'pom:' || p_partkey ELSE 'unknown:' || p_name || ':0.0.0-SNAPSHOT' END AS gav FROM part")
def sha_lookup(spark, sf):
    p = read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    jars = p.select("p_partkey", key.alias("content"), F.col("p_name").alias("file_name"), F.when(F.col("p_size") > 20, F.concat(F.lit("pom:"), key)).alias("embedded"))
    index = p.filter("p_size > 40").select(F.sha1(key).alias("sha1"), F.concat(F.lit("sha:"), key).alias("gav"))
    return D.sha_lookup(jars, index).select("p_partkey", "gav")


@query("maven_coord_parse", "SELECT p_partkey, 'org.' || p_brand AS name, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_size || '.1' END AS version, CASE WHEN p_size % 3 = 2 THEN 'sources' ELSE '' END AS classifier, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'compile' END AS type FROM part")
def maven_coord_parse(spark, sf):
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    three = F.concat(F.lit("org:"), brand, F.lit(":jar"))
    five = F.concat(three, F.lit(":"), size, F.lit(".1:compile"))
    six = F.concat(three, F.lit(":sources:"), size, F.lit(".1:compile"))
    line = F.when(F.col("p_size") % 3 == 0, three).when(F.col("p_size") % 3 == 1, five).otherwise(six)
    return read(spark, sf, "part").select("p_partkey", SD.maven_coordinate(line).alias("c")).select("p_partkey", "c.*")


@query("gradle_dep_parse", "SELECT p_partkey, 'g.' || p_brand AS name, CASE WHEN p_size > 25 THEN (p_size + 1)::varchar ELSE p_size::varchar END AS version FROM part")
def gradle_dep_parse(spark, sf):
    size = F.col("p_size")
    line = F.concat(F.lit("g:"), "p_brand", F.lit(":"), size.cast("string"), F.when(size > 25, F.concat(F.lit(" -> "), (size + 1).cast("string"))).otherwise(""), F.lit(" (*)"))
    return read(spark, sf, "part").select("p_partkey", SD.gradle_coordinate(line).alias("c")).select("p_partkey", "c.*")


@query("go_dep_parse", "SELECT p_partkey, 'x/' || p_brand AS name, 'v1.' || p_size AS version FROM part")
def go_dep_parse(spark, sf):
    line = F.concat(F.lit("x/"), "p_brand", F.lit("@v1."), F.col("p_size").cast("string"))
    return read(spark, sf, "part").select("p_partkey", SD.go_module(line).alias("c")).select("p_partkey", "c.*")


@query(
    "tree_depth_parent",
    """WITH t AS (SELECT conv_id, turn, (turn % 3)::int AS depth FROM conversations), p AS (SELECT *, max(CASE WHEN depth = 0 THEN turn END) OVER w AS p0, max(CASE WHEN depth = 1 THEN turn END) OVER w AS p1 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, depth, CASE depth WHEN 1 THEN p0 WHEN 2 THEN p1 END AS parent FROM p""",
)
def tree_depth_parent(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).cast("int").alias("depth"))
    return SD.tree_parents(rows, "conv_id", "turn", "depth", "turn")


@query("version_order", "SELECT p_partkey, p_size >= 12 AS new_enough FROM part")
def version_order(spark, sf):
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".RELEASE"))
    return read(spark, sf, "part").select("p_partkey", (version(v) >= version(F.lit("11.9.9"))).alias("new_enough"))


@query("semver_validity", "SELECT p_partkey, p_size % 2 = 0 AS valid FROM part")
def semver_validity(spark, sf):
    v = F.concat(F.when(F.col("p_size") % 2 == 0, "v1.").otherwise("1."), F.col("p_size").cast("string"))
    return read(spark, sf, "part").select("p_partkey", semver(v).isNotNull().alias("valid"))


def symbols(spark, sf):
    li = read(spark, sf, "lineitem")
    note = F.array(F.struct(F.concat(F.lit("note."), "l_returnflag").alias("name"), F.create_map(F.lit("value"), F.col("l_linestatus")).alias("elements")))
    kind = F.when(F.col("l_linenumber") == 1, "Module").otherwise("Class")
    where = F.when(F.col("l_linenumber") <= 2, "IMPORT").otherwise("TYPE")
    return li.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("uri"), F.concat(F.lit("com.part.P"), F.col("l_partkey").cast("string")).alias("name"), kind.alias("kind"), where.alias("location"), F.col("l_linenumber").alias("start_line"), note.alias("annotations"))


@query("referenced_import", "SELECT 'order/' || l_orderkey AS uri, 'com.part.P' || l_partkey AS name, (l_linenumber + 1)::int AS line_no FROM lineitem WHERE l_partkey::varchar LIKE '12%' AND l_linenumber = 1")
def referenced_import(spark, sf):
    return leaves.referenced(symbols(spark, sf), "r", "com.part.P12*", "import").select("uri", F.col("variables")["name"].alias("name"), "line_no")


@query("referenced_annotated", "SELECT 'order/' || l_orderkey AS uri, 'com.part.P' || l_partkey AS name, (l_linenumber + 1)::int AS line_no FROM lineitem WHERE l_partkey::varchar LIKE '%7' AND l_linenumber > 2 AND l_returnflag = 'R' AND l_linestatus = 'F'")
def referenced_annotated(spark, sf):
    return leaves.referenced(symbols(spark, sf), "r", "*.P*7", "TYPE", ("note.R", {"value": "^F$"})).select("uri", F.col("variables")["name"].alias("name"), "line_no")


@query("symbol_reference_join", "SELECT DISTINCT 'order/' || l_orderkey AS uri, (l_linenumber + 1)::int AS line_no FROM lineitem JOIN part ON l_partkey = p_partkey WHERE regexp_matches(p_type, '(?i)^promo') AND NOT l_orderkey::varchar LIKE '%7'")
def symbol_reference_join(spark, sf):
    decl = read(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("name"))
    sub = F.when(F.col("l_orderkey").cast("string").endswith("7"), "order/vendor/").otherwise("order/")
    refs = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.concat(sub, F.col("l_orderkey").cast("string")).alias("uri"), F.col("l_linenumber").alias("line"))
    return leaves.references(decl, refs, "r", "promo.*", "order", ["vendor"]).select("uri", "line_no")


@query(
    "innermost_symbol",
    """WITH s AS (SELECT o_custkey AS uri, 'o' || o_orderkey AS name, (o_orderkey % 50)::bigint AS a, (o_orderkey % 50 + o_orderkey % 17)::bigint AS b FROM orders), p AS (SELECT c_custkey AS uri, (c_custkey % 60)::bigint AS line FROM customer)
    SELECT p.uri, p.line, first(name ORDER BY b - a, a, name) AS symbol FROM p LEFT JOIN s ON p.uri = s.uri AND line BETWEEN a AND b GROUP BY 1, 2""",
)
def innermost_symbol(spark, sf):
    k = F.col("o_orderkey")
    s = read(spark, sf, "orders").select(F.col("o_custkey").alias("uri"), F.concat(F.lit("o"), k.cast("string")).alias("name"), (k % 50).alias("start_line"), (k % 50 + k % 17).alias("end_line"))
    p = read(spark, sf, "customer").select(F.col("c_custkey").alias("uri"), (F.col("c_custkey") % 60).alias("line"))
    return leaves.innermost_symbol(p, s)


# ---- combination --------------------------------------------------------------------------------------------------------


def per_source(spark, sf, rule_column: str, pattern: str) -> DataFrame:
    """Content incidents with the source as rule id, so that one plan evaluates a condition for every source."""
    found = leaves.filecontent(files(spark, sf), {"x": pattern})
    return found.withColumn("rule_id", F.substring_index("uri", "/", 1))


A, B, NONE = "[A-Za-z]*nesth[a-z]*", "[A-Za-z]*sth[a-z]*er", "zzzz+q"
PARTS = f"WITH {LINES}, a AS (SELECT split_part(path, '/', 1) AS rule_id, path AS uri, line_no, unnest(regexp_extract_all(line, '{A}', 0)) AS found FROM lines), b AS (SELECT split_part(path, '/', 1) AS rule_id, path AS uri, line_no, unnest(regexp_extract_all(line, '{B}', 0)) AS found FROM lines) "


def gate(spark, sf, every: bool, **flags) -> DataFrame:
    a, b = per_source(spark, sf, "source", A), per_source(spark, sf, "source", B)
    return flat(C.combine([C.Part(a), C.Part(b, **flags)], every))


@query("and_union_gate", PARTS + "SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rule_id IN (SELECT rule_id FROM a) AND rule_id IN (SELECT rule_id FROM b)")
def and_union_gate(spark, sf):
    return gate(spark, sf, True)


@query("or_union_gate", PARTS + "SELECT * FROM a UNION ALL SELECT * FROM b")
def or_union_gate(spark, sf):
    return gate(spark, sf, False)


@query("not_exists_gate", PARTS + "SELECT * FROM a WHERE rule_id NOT IN (SELECT rule_id FROM b)")
def not_exists_gate(spark, sf):
    return gate(spark, sf, True, negate=True)


@query("ignore_gate", PARTS + "SELECT * FROM a WHERE rule_id IN (SELECT rule_id FROM b)")
def ignore_gate(spark, sf):
    return gate(spark, sf, True, ignore=True)


@query("chain_semi_join", f"WITH {LINES} {hits_sql('r', A, 'path IN (SELECT path FROM lines WHERE regexp_matches(line, ' + chr(39) + B + chr(39) + '))')}")
def chain_semi_join(spark, sf):
    f = files(spark, sf)
    return flat(leaves.filecontent(C.only_files_of(f, leaves.filecontent(f, {"p": B})), {"r": A}))


@query("chain_three", f"WITH {LINES} {hits_sql('r', A, 'regexp_matches(path, ' + chr(39) + '[.]en$' + chr(39) + ') AND path IN (SELECT path FROM lines WHERE regexp_matches(line, ' + chr(39) + B + chr(39) + '))')}")
def chain_three(spark, sf):
    f = files(spark, sf)
    one = leaves.file(f, "p", "*.en")
    two = leaves.filecontent(C.only_files_of(f, one), {"q": B})
    return flat(leaves.filecontent(C.only_files_of(f, two), {"r": A}))


@query("scope_filter_incidents", f"WITH {LINES}, h AS ({hits_sql('r', A)}) SELECT * FROM h WHERE uri IN (SELECT path FROM files WHERE size > 1000) AND NOT regexp_matches(uri, '^src1')")
def scope_filter_incidents(spark, sf):
    f = files(spark, sf)
    return flat(C.keep_paths(leaves.filecontent(f, {"r": A}), f.filter("size > 1000").select("path"), ["^src1"]))


@query("file_union", f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'src1/%' UNION SELECT path FROM files WHERE path LIKE '%.fr'")
def file_union(spark, sf):
    f = files(spark, sf).select("path")
    return f.filter(T.within_base(F.col("path"), "src1")).union(f.filter(F.col("path").endswith(".fr"))).distinct()


@query("file_intersect", f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'src1/%' AND path LIKE '%.fr'")
def file_intersect(spark, sf):
    f = files(spark, sf).select("path")
    return f.filter(T.within_base(F.col("path"), "src1")).join(f.filter(F.col("path").endswith(".fr")), "path", "left_semi")


@query("file_except", f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'src1/%' AND NOT path LIKE '%.fr'")
def file_except(spark, sf):
    f = files(spark, sf).select("path")
    return f.filter(T.within_base(F.col("path"), "src1")).join(f.filter(F.col("path").endswith(".fr")), "path", "left_anti")


@query("provider_fan_in", "SELECT src, n FROM (SELECT 'documents' AS src, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages)")
def provider_fan_in(spark, sf):
    a = read(spark, sf, "documents").select(F.lit("documents").alias("src"))
    return a.unionByName(read(spark, sf, "pages").select(F.lit("pages").alias("src"))).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


# ---- selectors ----------------------------------------------------------------------------------------------------------


def doc_labels(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("org.x/source="), "source"), F.lit("doc"), F.lit("bad=_x")).alias("labels"))


@query("label_selector_and_or_not", "SELECT doc_id FROM documents WHERE (lang = 'en' OR lang = 'de') AND source <> 'src3'")
def label_selector_and_or_not(spark, sf):
    return doc_labels(spark, sf).filter(L.label_selector(F.col("labels"), "(lang=en || lang=de) && !org.x/source=src3 && doc && !bad")).select("doc_id")


@query("label_include_override", "SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 = 1 THEN false ELSE lang = 'fr' END")
def label_include_override(spark, sf):
    d = doc_labels(spark, sf)
    extra = F.when(F.col("doc_id") % 7 == 0, f"{L.INCLUDE}=always").when(F.col("doc_id") % 7 == 1, f"{L.INCLUDE}=never").otherwise("x")
    return d.withColumn("labels", F.array_append("labels", extra)).filter(L.label_selector(F.col("labels"), "lang=fr")).select("doc_id")


@query("label_version_range", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size <= 20 WHEN 1 THEN p_size >= 20 WHEN 2 THEN p_size = 20 ELSE false END AS matches FROM part")
def label_version_range(spark, sf):
    size = F.col("p_size")
    sign = F.when(size % 4 == 0, "+").when(size % 4 == 1, "-").otherwise("")
    value = F.concat(F.when(size % 4 == 3, "jdk").otherwise("eap"), size.cast("string"), sign)
    return read(spark, sf, "part").select("p_partkey", L.value_matches(value, F.lit("eap20")).alias("matches"))


@query("incident_selector", "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src5'")
def incident_selector(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.create_map(F.lit("package"), F.concat(F.lit("com."), "lang", F.lit(".x")), F.lit("file"), F.concat(F.lit("file:///"), "source"), F.lit("src"), F.col("source")).alias("variables"))
    return d.filter(L.incident_selector(F.col("variables"), "package=com.en && !src=src5 && !file")).select("doc_id")


@query("skipped_rules", "SELECT source AS rule_id FROM documents GROUP BY source HAVING count(*) FILTER (lang = 'es') <= 5")
def skipped_rules(spark, sf):
    many = F.when(F.count_if(F.col("lang") == "es") > 5, "lang=es").otherwise("lang=other")
    r = read(spark, sf, "documents").groupBy(F.col("source").alias("rule_id")).agg(F.array(many).alias("labels"))
    return r.filter(~L.label_selector(F.col("labels"), "lang=es")).select("rule_id")


# ---- messages, snippets, limits, grouping -------------------------------------------------------------------------------


@query("template_message", f"WITH {LINES}, h AS ({hits_sql('r', WORD)}) SELECT uri, line_no, 'found <' || found || '> &quot;' || found || '&quot; at ' || line_no || '' AS message FROM h")
def template_message(spark, sf):
    found = leaves.filecontent(files(spark, sf), {"r": WORD})
    found = found.withColumn("variables", F.map_concat("variables", F.create_map(F.lit("quoted"), F.concat(F.lit('"'), F.col("variables")["matchingText"], F.lit('"')))))
    out = emit.with_message(found, {"r": "found <{{matchingText}}> {{ quoted }} at {{{lineNumber}}}{{nothing}}"})
    return out.select("uri", "line_no", "message")


@query("custom_variable", "SELECT doc_id, CASE WHEN regexp_matches(text, 'under (the [A-Z][A-Za-z]+)') THEN regexp_extract(text, 'under (the [A-Z][A-Za-z]+)', 1) ELSE 'none' END AS license FROM documents")
def custom_variable(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.custom_variable(F.col("text"), "under (?P<x>the [A-Z][A-Za-z]+)", "none", "x").alias("license"))


@query("tag_parse", "SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [lang, source] WHEN doc_id % 3 = 1 THEN [lang] ELSE [] END) AS tag FROM documents")
def tag_parse(spark, sf):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("Lang="), "lang", F.lit(", "), "source")).when(k == 1, F.col("lang")).otherwise("a=b=c")
    return read(spark, sf, "documents").select("doc_id", F.explode(T.tags_of(raw)).alias("tag"))


@query(
    "code_snippet",
    f"""WITH {FILES}, arr AS (SELECT path, string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) AS a FROM files), lines AS (SELECT path, len(a) AS size, i::int AS line_no, a[i] AS line FROM (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM arr)),
    h AS (SELECT path, line_no FROM lines WHERE regexp_matches(line, '{B}')), n AS (SELECT h.path, h.line_no, l.size, l.line_no AS k, l.line, length((h.line_no + 2)::varchar) AS w FROM h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 3)
    SELECT path AS uri, line_no, string_agg(lpad(k::varchar, greatest(w, length(k::varchar))::int, ' ') || '  ' || line, chr(10) ORDER BY k) || CASE WHEN max(size) < line_no + 3 THEN chr(10) ELSE '' END AS code_snip FROM n GROUP BY 1, 2""",
)
def code_snippet(spark, sf):
    f = files(spark, sf)
    found = leaves.filecontent(f, {"r": B}).select("rule_id", "uri", "line_no").distinct().withColumn("message", F.lit(""))
    return emit.with_snippets(found, f, 2, 0).select("uri", "line_no", "code_snip")


@query(
    "multiline_grep",
    f"WITH {LINES}, w AS (SELECT path, line_no, string_agg(trim(replace(line, chr(9), '')), chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM lines) SELECT path AS uri, greatest(1, min(line_no) - 2)::int AS line_no FROM w WHERE regexp_matches(t, '[a-z][.]\\nAn', 's') GROUP BY path",
)
def multiline_grep(spark, sf):
    return leaves.multiline_grep(files(spark, sf), "r", "[a-z][.]\\nAn").select("uri", "line_no")


@query("incident_limit", f"WITH {LINES}, h AS (SELECT DISTINCT 'r-' || split_part(path, '.', 2) AS rule_id, path AS uri, line_no FROM lines WHERE regexp_matches(line, '{A}')) SELECT rule_id, uri, line_no FROM h QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY uri, line_no) <= 5")
def incident_limit(spark, sf):
    found = leaves.filecontent(files(spark, sf), {"r": A}).withColumn("message", F.lit("")).withColumn("rule_id", F.concat(F.lit("r-"), F.substring_index("uri", ".", -1)))
    return emit.limited(found.dropDuplicates(["rule_id", "uri", "line_no"]), 5).select("rule_id", "uri", "line_no")


@query("snippet_limit", f"WITH {LINES}, h AS (SELECT DISTINCT path AS uri, line_no FROM lines WHERE regexp_matches(line, '{A}')) SELECT uri, line_no, row_number() OVER (PARTITION BY uri ORDER BY line_no) <= 1 AS has_snippet FROM h")
def snippet_limit(spark, sf):
    f = files(spark, sf)
    found = leaves.filecontent(f, {"r": A}).select("rule_id", "uri", "line_no").distinct().withColumn("message", F.lit(""))
    return emit.with_snippets(found, f, 1, 1).select("uri", "line_no", F.col("code_snip").isNotNull().alias("has_snippet"))


@query("incident_dedup", f"WITH {LINES}, h AS ({hits_sql('r', WORD)}) SELECT DISTINCT rule_id, uri, line_no, 'm ' || lower(found) AS message FROM h")
def incident_dedup(spark, sf):
    found = leaves.filecontent(files(spark, sf), {"r": WORD}).withColumn("message", F.concat(F.lit("m "), F.lower(F.col("variables")["matchingText"])))
    return emit.distinct_incidents(found).select("rule_id", "uri", "line_no", "message")


RULE_TABLE = [("set1", "license", "licences", "Mandatory", 3, ["a=b"], [], "m"), ("set1", "digits", "numbers", "odd", 0, ["c"], [], "m"), ("set2", "title", "titles", None, None, [], [], "m"), ("set2", "never", "nothing", "optional", 1, [], [], "m")]
RULE_SQL = "rules AS (SELECT * FROM (VALUES ('set1', 'license', 'mandatory', 3), ('set1', 'digits', 'potential', 0), ('set2', 'title', 'potential', NULL), ('set2', 'never', 'optional', 1)) v(ruleset, rule_id, category, effort))"
FOUND = f"WITH {LINES}, {RULE_SQL}, h AS ({' UNION ALL '.join(hits_sql(r, p) for r, p in RULES.items())}), d AS (SELECT DISTINCT rule_id, uri, line_no FROM h)"


def rule_table(spark):
    from ruleframe.plans.rules import SCHEMA

    return spark.createDataFrame(RULE_TABLE, SCHEMA)


def rule_incidents(spark, sf):
    found = leaves.filecontent(files(spark, sf), RULES)
    return emit.distinct_incidents(emit.with_message(found, {r: f"{r} at {{{{lineNumber}}}}" for r in RULES}))


@query(
    "violations_by_rule",
    f"{FOUND} SELECT ruleset, rule_id, category, CASE WHEN coalesce(effort, 0) = 0 THEN 'insight' ELSE 'violation' END AS kind, count(*) AS n_incidents, first(uri || ':' || line_no ORDER BY uri, line_no) AS first_incident FROM rules JOIN d USING (rule_id) GROUP BY ALL",
)
def violations_by_rule(spark, sf):
    out = emit.violations(emit.limited(rule_incidents(spark, sf), 0), rule_table(spark))
    first = F.col("incidents")[0]
    return out.select("ruleset", "rule_id", "category", "kind", "n_incidents", F.concat(first["uri"], F.lit(":"), first["line_no"].cast("string")).alias("first_incident"))


@query("ruleset_summary", f"{FOUND}, c AS (SELECT rule_id, count(*) AS n FROM d GROUP BY 1) SELECT ruleset, count(n) AS matched, count(*) - count(n) AS unmatched, coalesce(sum(n), 0)::bigint AS incidents FROM rules LEFT JOIN c USING (rule_id) GROUP BY ruleset")
def ruleset_summary(spark, sf):
    n = rule_incidents(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    out = rule_table(spark).join(n, "rule_id", "left").groupBy("ruleset")
    return out.agg(F.count("n").alias("matched"), F.count_if(F.col("n").isNull()).alias("unmatched"), F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"))


@query("unmatched_rules", f"{FOUND} SELECT ruleset, rule_id FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM d)")
def unmatched_rules(spark, sf):
    return emit.unmatched(rule_incidents(spark, sf), rule_table(spark))


@query("insight_vs_violation", f"{FOUND} SELECT CASE WHEN coalesce(effort, 0) = 0 THEN 'insight' ELSE 'violation' END AS kind, count(DISTINCT rule_id) AS n_rules, count(*) AS incidents FROM rules JOIN d USING (rule_id) GROUP BY 1")
def insight_vs_violation(spark, sf):
    out = emit.violations(rule_incidents(spark, sf), rule_table(spark))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("n_incidents").alias("incidents"))


@query("sorted_output", f"{FOUND} SELECT rule_id, uri, line_no, row_number() OVER (PARTITION BY rule_id ORDER BY uri, line_no)::int AS position FROM d")
def sorted_output(spark, sf):
    out = emit.violations(rule_incidents(spark, sf), rule_table(spark))
    return out.select("rule_id", F.posexplode("incidents").alias("p", "i")).select("rule_id", "i.uri", "i.line_no", (F.col("p") + 1).alias("position"))


@query("rule_labels", "SELECT DISTINCT 'lang=' || lang AS label FROM documents UNION SELECT DISTINCT 'source=' || source FROM documents")
def rule_labels(spark, sf):
    d = read(spark, sf, "documents").select(F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source")).alias("labels"))
    return d.select(F.explode("labels").alias("label")).distinct()


@query("path_normalise", f"WITH {FILES} SELECT path, 'mnt/x/' || path AS mapped FROM files")
def path_normalise(spark, sf):
    uri = F.concat(F.lit("file:///data/./a%20b//"), "path")
    out = T.map_prefix(T.normal_path(uri), [("/data/a", "no"), ("/data/a b", "mnt/x")])
    return files(spark, sf).select("path", out.alias("mapped"))


# ---- streams and metrics (batch form; the streaming form is in tests) ---------------------------------------------------


@query(
    "overlay_latest_wins",
    """WITH c AS (SELECT conv_id, arg_max(text, turn) AS content, max(turn) % 2 = 1 AS saved FROM conversations GROUP BY conv_id)
    SELECT doc_id::varchar AS path, CASE WHEN c.conv_id IS NOT NULL AND NOT saved THEN c.content ELSE coalesce(text, '') END AS content FROM documents LEFT JOIN c ON conv_id = doc_id
    UNION ALL SELECT conv_id::varchar, content FROM c WHERE NOT saved AND conv_id NOT IN (SELECT doc_id FROM documents)""",
)
def overlay_latest_wins(spark, sf):
    base = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    stream = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("text").alias("content"), (F.col("turn") % 2 == 1).alias("saved"), F.col("turn").alias("seq"))
    return changes.overlay(base, stream)


@query(
    "throttle_events",
    """WITH RECURSIVE e AS (SELECT user_id AS key, ts, event_id % 10 AS current, 9::bigint AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 10) AS n FROM events),
    w(key, n, ts, current, last, passes) AS (SELECT key, n, ts, current, ts, true FROM e WHERE n = 1 UNION ALL
      SELECT e.key, e.n, e.ts, e.current, CASE WHEN e.current = e.total OR epoch_ms(e.ts) - epoch_ms(w.last) >= 86400000 THEN e.ts ELSE w.last END, e.current = e.total OR epoch_ms(e.ts) - epoch_ms(w.last) >= 86400000 FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT key, count(*) AS n, max(epoch_ms(ts)) AS last_ms FROM w WHERE passes GROUP BY key""",
)
def throttle_events(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 10).alias("current"), F.lit(9).cast("long").alias("total"))
    return progress.throttled(e, 86_400_000).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.floor((F.unix_micros(F.max("ts")) + 500) / 1000).alias("last_ms"))


METRICS = "(round(value * 100))::bigint AS v"


def metric_rows(spark, sf):
    e = read(spark, sf, "events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    return progress.metrics(e, ["event_type"], "v", "event_id", [1000, 5000, 10000])


@query("metric_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def metric_count(spark, sf):
    return metric_rows(spark, sf).select("event_type", "n")


@query("metric_sum", f"SELECT event_type, sum(v)::bigint AS total FROM (SELECT event_type, {METRICS} FROM events) GROUP BY 1")
def metric_sum(spark, sf):
    return metric_rows(spark, sf).select("event_type", "total")


@query("metric_latest", f"SELECT event_type, arg_max(v, event_id) AS latest FROM (SELECT event_type, event_id, {METRICS} FROM events) GROUP BY 1")
def metric_latest(spark, sf):
    return metric_rows(spark, sf).select("event_type", "latest")


@query("metric_histogram", f"SELECT event_type, b AS bound, count(*) FILTER (v <= b) AS n FROM (SELECT event_type, {METRICS} FROM events), (VALUES (1000), (5000), (10000)) t(b) GROUP BY 1, 2")
def metric_histogram(spark, sf):
    bounds = F.array(F.lit(1000), F.lit(5000), F.lit(10000))
    return metric_rows(spark, sf).select("event_type", F.explode(F.arrays_zip(bounds.alias("bound"), F.col("buckets").alias("n"))).alias("x")).select("event_type", "x.bound", "x.n")


@query("progress_percent", "SELECT event_id, round((event_id % 10) * 100.0 / 9, 3)::double AS pct FROM events")
def progress_percent(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(progress.percent((F.col("event_id") % 10).cast("double"), F.lit(9.0)), 3).alias("pct"))


@query("prometheus_text", "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_text(spark, sf):
    return progress.prometheus(metric_rows(spark, sf), "events_total", ["event_type"], "n")


# ---- listings, symbols and archives -------------------------------------------------------------------------------------


@query(
    "maven_tree",
    """SELECT p_partkey || '.txt' AS path, v.depth::int AS depth, v.name AS name, v.version AS version, v.parent AS parent FROM part,
    LATERAL (VALUES (0, 'g.a' || p_partkey, p_size || '.0', NULL), (1, 'g.b', '2', 'g.a' || p_partkey), (1, 'h.c', p_size || '', 'g.a' || p_partkey), (0, 'g.z', '9', NULL)) v(depth, name, version, parent)""",
)
def maven_tree(spark, sf):
    part = read(spark, sf, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("[INFO] Scanning\n[INFO] top:app:jar:1.0\n[INFO] +- g:a"), key, F.lit(":jar:"), size, F.lit(".0:compile\n[INFO] |  +- g:b:jar:2:compile\n[INFO] |  \\- h:c:jar:sources:"), size,
        F.lit(":test\n[INFO] \\- g:z:jar:9:runtime\n[INFO] BUILD SUCCESS"),
    )
    listing = S.lines(part.select(F.concat(key, F.lit(".txt")).alias("path"), text.alias("content")))
    return SD.maven_listing(listing).select("path", "depth", "name", "version", "parent")


@query(
    "gradle_tree",
    """SELECT p_partkey || '.txt' AS path, v.depth::int AS depth, v.name AS name, v.version AS version, v.parent AS parent FROM part,
    LATERAL (VALUES (0, 'g.a', p_size || '.1', NULL), (1, 'g.b', '3', 'g.a'), (2, 'g.d', '4', 'g.b'), (1, 'g.f', '7', 'g.a')) v(depth, name, version, parent)""",
)
def gradle_tree(spark, sf):
    text = F.concat(F.lit("runtimeClasspath\n+--- g:a:"), F.col("p_size").cast("string"), F.lit(".1\n|    \\--- g:b:2 -> 3\n|         \\--- g:d:4\n|    +--- g:e:6 (*)\n|    \\--- g:f:7\n\\--- h:c:5 (n)\n\n(*) - repeated"))
    listing = S.lines(read(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), text.alias("content")))
    return SD.gradle_listing(listing).select("path", "depth", "name", "version", "parent")


@query("dependency_json", "SELECT p_partkey || '/x' AS file_uri, 'n' || p_partkey AS name, p_size || '' AS version, p_size > 25 AS indirect FROM part UNION ALL SELECT p_partkey || '/x', 'common', '1', false FROM part")
def dependency_json(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    one = F.concat(F.lit('{"name": "n'), key, F.lit('", "version": "'), size, F.lit('", "indirect": '), (F.col("p_size") > 25).cast("string"), F.lit("}"))
    value = F.concat(F.lit('{"'), key, F.lit('/x": ['), one, F.lit(', {"name": "common", "version": "1"}]}'))
    return SD.dependency_json(read(spark, sf, "part").select(value.alias("value"))).select("file_uri", "name", "version", "indirect")


@query("unresolved_sources", "SELECT 'g:p' || p_partkey || ':jar:' || p_size AS coordinate FROM part WHERE p_size % 3 <> 0")
def unresolved_sources(spark, sf):
    coordinate = F.concat(F.lit("g:p"), F.col("p_partkey").cast("string"), F.lit(":jar"))
    size = F.col("p_size").cast("string")
    bare = F.concat(F.lit("[INFO]    "), coordinate, F.lit(":sources:"), size, F.lit(" not found"))
    absent = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("[WARN] Could not find artifact "), coordinate, F.lit(":"), size, F.lit(" in central"))).otherwise("[INFO] fine")
    return SD.unresolved_sources(read(spark, sf, "part").select(F.explode(F.array(bare, absent, bare)).alias("line")))


@query("path_coordinate", "SELECT p_partkey, 'org.' || lower(left(p_brand, 5)) || '.p' || p_partkey AS name, '0.0.0' AS version, 'g/h/p' || p_partkey || '/' || p_size || '/p' || p_partkey || '-' || p_size || '.jar' AS jar FROM part")
def path_coordinate(spark, sf):
    from ruleframe.sources import archives

    p = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    path = F.concat(F.lit("/org/"), F.lower(F.substring("p_brand", 1, 5)), F.lit("/"), p, F.lit("/Z.class"))
    rows = read(spark, sf, "part").select("p_partkey", archives.path_coordinate(path).alias("c"), SD.repository_path(F.lit("g.h"), p, F.col("p_size").cast("string")).alias("jar"))
    return rows.select("p_partkey", "c.*", "jar")


@query(
    "source_symbols",
    """SELECT p_partkey || '/A.java' AS uri, v.name AS name, v.location AS location, v.line::int AS start_line FROM part,
    LATERAL (VALUES ('com.p' || p_partkey, 'PACKAGE', 0), ('java.util.List', 'IMPORT', 1), ('Api', 'ANNOTATION', 2), ('A' || p_size, 'TYPE', 3), ('Base', 'INHERITANCE', 3), ('B', 'CONSTRUCTOR_CALL', 4), ('B', 'METHOD_CALL', 4), ('x.run', 'METHOD_CALL', 5)) v(name, location, line)""",
)
def source_symbols(spark, sf):
    from ruleframe.sources.symbols import symbols as found

    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("package com.p"), key, F.lit(";\nimport java.util.List;\n@Api\nclass A"), size, F.lit(" extends Base {\n  B b = new B(1);\n  x.run(b); }\n"))
    f = read(spark, sf, "part").select(F.concat(key, F.lit("/A.java")).alias("path"), text.alias("content"))
    return found(f).select("uri", "name", "location", "start_line")


@query("annotated_symbols", "SELECT p_partkey || '/A.java' AS uri, 'A' || p_size AS name FROM part WHERE p_size > 25")
def annotated_symbols(spark, sf):
    from ruleframe.sources.symbols import symbols as found

    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit('@Bean(url = "jdbc:'), F.when(F.col("p_size") > 25, "old").otherwise("new"), F.lit('", n = 3)\nclass A'), size, F.lit(" { }\n"))
    f = read(spark, sf, "part").select(F.concat(key, F.lit("/A.java")).alias("path"), text.alias("content"))
    return leaves.referenced(found(f), "r", "A*", "TYPE", ("Bean", {"url": "^jdbc:old$"})).select("uri", F.col("variables")["name"].alias("name"))


@query("relative_uri", f"WITH {FILES} SELECT path, path AS relative FROM files")
def relative_uri(spark, sf):
    return files(spark, sf).select("path", T.relative_to(F.concat(F.lit("file:///data/app/"), "path"), "/data/app/").alias("relative"))


@query("span_times", "SELECT s.event_id AS span, s.user_id AS parent, epoch_ms(e.ts) - epoch_ms(s.ts) AS ms FROM events s JOIN events e ON e.event_id = s.event_id + 1 WHERE s.event_id % 2 = 0 AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR AND epoch_us(e.ts) % 1000 = epoch_us(s.ts) % 1000")
def span_times(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("span"), F.col("user_id").alias("parent"), "ts")
    ends = e.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("span"), "ts")
    same = starts.join(ends.select("span", F.col("ts").alias("end")), "span").filter("unix_micros(end) % 1000 = unix_micros(ts) % 1000")
    return progress.span_times(same.select("span", "parent", "ts"), ends, "6 hours")


@query("rule_engine", f"WITH {LINES}, h AS (SELECT DISTINCT path, line_no FROM lines WHERE regexp_matches(line, '{A}')), b AS (SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '{B}')) SELECT 'chained' AS rule_id, count(*) AS n_incidents, 'violation' AS kind FROM h WHERE path IN (SELECT path FROM b) UNION ALL SELECT 'plain', count(*), 'insight' FROM h")
def rule_engine(spark, sf):
    """Rules as a user writes them, through the engine: a plain search, and one that searches what another has found."""
    from ruleframe.plans.engine import Analyzer
    from ruleframe.plans.rules import rule

    search = lambda pattern, **more: {"builtin.filecontent": {"pattern": pattern, **more}}
    rules = [
        {"ruleID": "plain", "message": "m", "when": search(A)},
        {"ruleID": "chained", "message": "m {{lineNumber}}", "effort": 1, "when": {"and": [search(B) | {"as": "p", "ignore": True}, search(A, filepaths="{{p.filepaths}}") | {"from": "p"}]}},
    ]
    result = Analyzer(files=files(spark, sf)).run([rule(r, "set", []) for r in rules], most_incidents=0)
    return result.violations.select("rule_id", "n_incidents", "kind")


# ---- rules as a whole, and leaves over what is not well-formed ----------------------------------------------------------------


def analyzed(spark, sf, rules: list[dict], table: DataFrame | None = None, **tables) -> DataFrame:
    from ruleframe.plans.engine import Analyzer
    from ruleframe.plans.rules import rule

    out = Analyzer(files=files(spark, sf) if table is None else table, **tables).run([rule(r | {"message": "m"}, "set", []) for r in rules], most_incidents=0)
    return out.incidents.select("rule_id", "uri", "line_no")


def search(pattern: str, **more) -> dict:
    return {"builtin.filecontent": {"pattern": pattern}} | more


@query(
    "nested_gate",
    f"WITH {LINES}, a AS (SELECT DISTINCT path AS uri, line_no FROM lines WHERE regexp_matches(line, '{A}')), b AS (SELECT DISTINCT path AS uri, line_no FROM lines WHERE regexp_matches(line, '{B}')) "
    "SELECT 'not' AS rule_id, * FROM a UNION ALL SELECT 'ignored', * FROM b UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b)",
)
def nested_gate(spark, sf):
    return analyzed(spark, sf, [
        {"ruleID": "not", "when": {"and": [search(A), {"or": [search(NONE, **{"not": True}), search("yyyy+q")]}]}},
        {"ruleID": "ignored", "when": {"and": [search(B), {"and": [search(A, ignore=True)]}]}},
        {"ruleID": "neither", "when": {"and": [search(A), {"or": [search(NONE), search("yyyy+q")]}]}},
        {"ruleID": "either", "when": {"or": [{"and": [search(A), search(NONE)]}, search(B)]}},
    ])


@query("xml_malformed", "SELECT p_partkey || '.xml' AS uri, 2 AS line_no, p_brand AS found FROM part WHERE p_size % 3 = 0")
def xml_malformed(spark, sf):
    p = read(spark, sf, "part")
    good = F.concat(F.lit('<?xml version="1.0"?>\n<q:part xmlns:q="http://x"><q:v>'), "p_brand", F.lit("</q:v></q:part>"))
    text = F.when(F.col("p_size") % 3 == 0, good).when(F.col("p_size") % 3 == 1, F.concat(F.lit("<part><v>"), "p_brand", F.lit("</part>"))).otherwise("a < b & c")
    f = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"), text.alias("content"))
    return flat(leaves.xml(f, "r", "/q:part/q:v")).select("uri", "line_no", "found")


@query("json_deep", "SELECT event_id::varchar AS uri, json_extract_string(props, '$.k') AS found FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT event_id::varchar, 'x' FROM events")
def json_deep(spark, sf):
    nested = F.concat(F.lit('{"a": {"b": [{"c": {"d": '), "props", F.lit('}}, {"k": "x"}]}}'))
    f = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), nested.alias("content"))
    return flat(leaves.json(f, "r", "//k")).select("uri", "found")


@query("k8s_rule", "SELECT 'old' AS rule_id, p_partkey || '.yaml' AS uri, 2 AS line_no FROM part WHERE p_size > 25")
def k8s_rule(spark, sf):
    text = F.when(F.col("p_size") > 25, "apiVersion: extensions/v1beta1\nkind: Ingress\n").otherwise("apiVersion: v1\nkind: Pod\n")
    f = read(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("path"), text.alias("content"))
    fields = {"apiVersion": "extensions/v1beta1", "kind": "Ingress", "deprecatedIn": "v1.14", "removedIn": "v1.22", "replacementAPI": "networking.k8s.io/v1"}
    return analyzed(spark, sf, [{"ruleID": "old", "when": {"yaml.k8sResourceMatched": fields}}], f, k8s_version="v1.25")


@query("node_references", "SELECT DISTINCT 'r' AS rule_id, 'ws/' || l_orderkey || '.ts' AS uri, (l_linenumber + 1)::int AS line_no FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 AND p_brand LIKE '%3'")
def node_references(spark, sf):
    p, l = read(spark, sf, "part"), read(spark, sf, "lineitem")
    scope = F.when(F.col("p_size") > 40, "node_modules/@lib/ui/").otherwise("node_modules/other/")
    declarations = p.select(F.concat(scope, F.lit("index.d.ts")).alias("uri"), F.concat(F.lit("Sym"), F.regexp_extract("p_brand", ".$", 0)).alias("name"), F.col("p_partkey").alias("symbol_id"))
    refs = l.select(F.concat(F.lit("ws/"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("uri"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("symbol_id"))
    return analyzed(spark, sf, [{"ruleID": "r", "when": {"nodejs.referenced": {"pattern": "@lib/ui#Sym3"}}}], files(spark, sf).limit(0), declarations=declarations, refs=refs, workspace="ws", dependency_dirs=["node_modules"])


@query("prerelease_bounds", "SELECT p_partkey FROM part WHERE p_size % 4 IN (1, 3)")
def prerelease_bounds(spark, sf):
    from ruleframe.functions.versions import within_bounds

    k = F.col("p_size") % 4
    v = F.when(k == 0, "1.0.0-rc1").when(k == 1, "1.0.0").when(k == 2, "1.0.0.0.9").otherwise("1.0.0.0.7-beta")
    return read(spark, sf, "part").filter(within_bounds(v, "1.0.0", "1.0.0.0.8")).select("p_partkey")


@query("long_prefix", "SELECT p_partkey || '' AS rule_id FROM part WHERE p_size > 25")
def long_prefix(spark, sf):
    p = read(spark, sf, "part")
    folder = F.concat(F.lit("file:///home/u/.m2/repository/org/apache/a/b/c/d/e/f/"), F.when(F.col("p_size") > 25, "kept").otherwise("gone"))
    found = p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.concat(folder, F.lit("/x/1.0/x-1.0.jar")).alias("uri"), F.lit(1).alias("line_no"), F.create_map().cast("map<string,string>").alias("variables"), F.lit(True).alias("is_dep"))
    return D.of_selected(found, spark.createDataFrame([("file:///home/u/.m2/repository/org/apache/a/b/c/d/e/f/kept/x/",)], "prefix string")).select("rule_id")


@query("symbol_kinds", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'File' WHEN 5 THEN 'Class' WHEN 12 THEN 'Function' WHEN 26 THEN 'TypeParameter' ELSE '' END AS kind FROM part WHERE p_size IN (1, 5, 12, 26, 27, 50)")
def symbol_kinds(spark, sf):
    return read(spark, sf, "part").filter(F.col("p_size").isin(1, 5, 12, 26, 27, 50)).select("p_partkey", kind_name(F.col("p_size")).alias("kind"))


@query("complete_artifacts", "SELECT DISTINCT p_brand AS artifact, p_size || '' AS version FROM part WHERE p_size % 2 = 0")
def complete_artifacts(spark, sf):
    size = F.col("p_size")
    rows = read(spark, sf, "part").select(F.lit("g").alias("group"), F.col("p_brand").alias("artifact"), F.when(size % 2 == 0, size.cast("string")).otherwise("").alias("version"), F.lit("jar").alias("packaging"))
    return SD.complete_artifacts(rows).select("artifact", "version")
