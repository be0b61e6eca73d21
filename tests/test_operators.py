"""Semantics that differ from plain SQL, and cases that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import scalars as S
from graphloom.operators import contract, edits, graph, history, journal, logs, providers, results, scripts, search, selection, selects, store, validate
from graphloom.plans import fixpoint, pattern
from graphloom.plans.pattern import Condition
from graphloom.sources import files
from graphloom.streaming import journal as stream

ATTEMPT = "id string, batch_id string, duration_ms long, status string, cache string, started_at_unix_ms long"
TARGET = "id string, package string, name string, kind string, deps array<string>, providers array<string>, capabilities array<string>, attrs string"


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def app(spark):
    rows = [
        ("apps/App", "apps", "App", "app", ["apps/Core", "apps/Core", "gone/X"], ["bundle"], ["build", "run"], json.dumps({"info": {"id": "com.x"}, "list": ["a", "b"], "n": 1, "f": 1.0})),
        ("apps/Core", "apps", "Core", "library", ["apps/Util"], ["module"], ["build"], "{}"),
        ("apps/Util", "apps", "Util", "library", [], ["module"], ["build"], "{}"),
        ("apps/Tests", "apps", "Tests", "test", ["apps/Core"], [], ["build", "test"], "{}"),
    ]
    return spark.createDataFrame(rows, TARGET)


def test_estimate_takes_the_newest_real_runs(spark):
    rows = [("1", "b", 10, "passed", "miss", 1), ("2", "b", 30, "passed", "miss", 2), ("3", "b", 1000, "passed", "hit", 3), ("4", "b", 2, "failed", "miss", 4)]
    rows += [("5", "c", 10, "passed", None, 1), ("6", "c", 31, "passed", None, 2), ("7", "d", -5, "passed", None, 1)]
    rows += [(f"e{i}", "e", 1 if i >= 5 else 9_999, "passed", None, i) for i in range(25)]
    got = dict(values(history.duration_estimates(spark.createDataFrame(rows, ATTEMPT))))
    assert got == {"b": 20, "c": 20, "d": 0, "e": 1}


def test_newest_comes_oldest_first_and_needs_a_limit(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, t long")
    assert [r["id"] for r in history.newest(df, "t", 2).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        history.newest(df, "t", 0)


def test_patterns_are_two_valued(spark, app):
    nodes = graph.nodes(app)
    def ids(*groups):
        return {r[0] for r in pattern.node(nodes, "t", "target").where(*groups).returns(id="t.id").collect()}
    assert ids([Condition("t", "attrs.info.id", "=", "com.x")]) == {"apps/App"}
    assert ids([Condition("t", "attrs.info.id", "<>", "com.x")]) == {"apps/Core", "apps/Util", "apps/Tests"}
    assert ids([Condition("t", "attrs.info.id", "=", None)]) == set()
    assert ids([Condition("t", "attrs.list", "contains", "b")]) == {"apps/App"}
    assert ids([Condition("t", "attrs.n", "=", 1)]) == {"apps/App"} and ids([Condition("t", "attrs.f", "=", 1)]) == set()
    assert ids([Condition("x", "id", "<>", "y")]) == set() and len(ids()) == 4
    assert pattern.node(nodes, "t", "target").returns("t.id", n="t.name").columns == ["t.id", "n"]
    assert ids([Condition("t", "id", "ends", "Tests")], [Condition("t", "kind", "in", ["app"])]) == {"apps/Tests", "apps/App"}


def test_one_hop_is_a_bag_and_any_depth_a_set(spark, app):
    nodes, edges = graph.nodes(app), graph.edges(app)
    start = pattern.node(nodes, "a", "Target", kind="app")
    one = pattern.related(nodes, edges, start, "DEPENDS_ON", pattern.node(nodes, "b")).returns(b="b.name")
    assert values(one) == [("Core",), ("Core",)]
    far = pattern.related(nodes, edges, start, "DEPENDS_ON", pattern.node(nodes, "b"), any_depth=True).returns(b="b.name")
    assert values(far) == [("Core",), ("Util",)]
    test = pattern.related(nodes, edges, pattern.node(nodes, "a", "Target"), "EXPOSES", pattern.node(nodes, "c", "capability", name="test"))
    assert values(test.returns(a="a.name")) == [("Tests",)]


def test_closures_cycles_and_depths(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "start long")
    assert values(fixpoint.closure(ring, seeds), "node") == [(2,), (3,)]
    assert values(fixpoint.reverse_closure(ring, seeds), "node") == [(1,), (2,), (3,), (4,)]
    assert values(fixpoint.cycle_members(ring)) == [(1,), (2,), (3,)]
    two = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)], "src long, dst long")
    assert values(fixpoint.cycle_members(two)) == [(1,), (2,), (3,), (4,), (5,)]
    nodes = spark.createDataFrame([("root",), ("short",), ("long-b",), ("long-a",)], "node string")
    tree = spark.createDataFrame([("root", "short"), ("root", "long-b"), ("long-b", "long-a")], "src string, dst string")
    assert dict(values(fixpoint.critical_depth(nodes, tree))) == {"root": 1, "short": 2, "long-b": 2, "long-a": 3}
    assert fixpoint.is_acyclic(tree)
    numbers = spark.range(1, 30).selectExpr("id AS node")
    behind = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(20, 21), (21, 22), (22, 20), (3, 21)], "src long, dst long")
    for cyclic in (ring, behind):
        with pytest.raises(ValueError):
            fixpoint.critical_depth(numbers, cyclic)


def test_long_chains_take_few_rounds(spark):
    n = 5_000
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    far, rounds = fixpoint._closure(edges, spark.sql("SELECT 0L AS start UNION ALL SELECT 4990L"))
    assert rounds <= 20
    assert {r["start"]: (r["n"], r["h"]) for r in far.groupBy("start").agg(F.count("*").alias("n"), F.max("value").alias("h")).collect()} == {0: (n + 1, n), 4990: (11, 10)}
    deep, rounds = fixpoint._longest(edges)
    assert rounds <= 20 and deep.filter("value <> node").isEmpty() and deep.count() == n + 1
    # a ladder has no chains: its edges are squared
    rungs = 300
    ladder = spark.range(rungs).selectExpr("id", "explode(array(0, 1)) a", "0 z").selectExpr("id * 2 + a AS src", "explode(array((id + 1) * 2, (id + 1) * 2 + 1)) AS dst")
    far, rounds = fixpoint._closure(ladder, spark.sql("SELECT 0L AS start"))
    assert rounds <= 20 and far.count() == 2 * rungs + 1 and far.filter("value <> node div 2").isEmpty()
    assert dict(values(fixpoint.critical_depth(spark.sql("SELECT 600L AS node"), ladder))) == {600: 301}


@pytest.mark.parametrize("seed", [1])
def test_loops_against_plain_searches(spark, seed):
    import random

    rng = random.Random(seed)
    n = 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range([30, 45, 70][seed])] + [(n + i, n + i + 1) for i in range(12)] + [(n + 12, rng.randrange(n)), (rng.randrange(n), n), (60, 61), (61, 62), (62, 60)]
    pairs += pairs[:3]
    df = spark.createDataFrame(pairs, "src long, dst long")
    nodes = sorted({x for p in pairs for x in p})
    reach = {}
    for s in nodes:
        hops, frontier = {s: 0}, [s]
        while frontier:
            frontier = sorted({b for a, b in pairs if a in frontier and b not in hops})
            hops |= {b: max(hops.values()) + 1 for b in frontier} if frontier else {}
        reach[s] = hops
    seeds = rng.sample(nodes, 4)
    got = fixpoint.closure(df, spark.createDataFrame([(s,) for s in seeds], "start long"))
    assert values(got) == sorted((s, v, h) for s in seeds for v, h in reach[s].items() if v != s)
    on_cycle = {s for s in nodes if any(a in reach[s] and b == s for a, b in pairs)}
    groups = {frozenset(v for v in on_cycle if v in reach[s] and s in reach[v]) for s in on_cycle}
    by: dict = {}
    for r in fixpoint.cycles(df).collect():
        by.setdefault(r["cycle"], []).append(r["node"])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups))
    paths = {r["cycle"]: r["nodes"] for r in fixpoint.cycle_paths(df).collect()}
    assert sorted(paths) == sorted(map(min, groups))
    for start, way in paths.items():
        ring = [*way, start]
        assert way[0] == start and all(p in pairs for p in zip(ring, ring[1:]))
        assert len(way) == min(reach[start][a] + 1 for a, b in pairs if b == start and a in reach[start])


def test_groups_of_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (8, 9), (0, 1), (10, 11), (11, 12), (12, 10), (12, 11)]
    df = spark.createDataFrame(edges, "src long, dst long")
    by: dict = {}
    for r in fixpoint.cycles(df).collect():
        by.setdefault(r["cycle"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [[1, 2, 3], [4, 5], [7], [10, 11, 12]]
    assert values(validate.dependency_cycles(df.selectExpr("CAST(src AS string) src", "CAST(dst AS string) dst")), "target") == [("1",), ("10",), ("4",), ("7",)]


def test_affected_tests(spark, app):
    edges, tests = graph.depends_on(app), app.filter("kind = 'test'")
    patterns = spark.createDataFrame([("apps/Util", "apps/util/*.c"), ("apps/Tests", "apps/tests/t.c"), ("apps/App", "/abs/*"), ("apps/App", "../up/*")], "id string, pattern string")
    def run(*paths, of=app):
        changed = spark.createDataFrame([(p,) for p in paths], "path string")
        got = selection.affected(changed, patterns, of, edges, tests, ["manifest.toml", "rules/*.star"])
        return {r["id"]: (r["reasons"], r["full_scope"]) for r in got.collect()}, sorted(map(tuple, selection.full_scope(changed, patterns, of, ["manifest.toml", "rules/*.star"]).collect()))
    assert run("./apps/util/deleted.c") == ({"apps/Tests": ("depends on apps/Util for apps/util/deleted.c", False)}, [])
    assert run("apps/tests/t.c") == ({"apps/Tests": ("owns apps/tests/t.c", False)}, [])
    assert run("elsewhere/x", "/abs/x", "../up/x") == ({"apps/Tests": ("", True)}, [("../up/x", "no owner"), ("/abs/x", "no owner"), ("elsewhere/x", "no owner")])
    assert run("rules/a.star", "apps/tests/t.c")[0] == {"apps/Tests": ("owns apps/tests/t.c", True)} and run("manifest.toml")[1] == [("manifest.toml", "graph definition")]
    assert "owns apps/readme" in run("apps/readme")[0]["apps/Tests"][0]
    # A package's manifest belongs to its package; without an owner in between nothing else runs.
    assert run("apps/manifest.toml")[1] == [] and "owns apps/manifest.toml" in run("apps/manifest.toml")[0]["apps/Tests"][0]
    assert run()[0] == {"apps/Tests": ("full run", True)}


def test_nearest_package_is_that_of_the_directory(spark):
    targets = spark.createDataFrame([("t1", "a"), ("t2", "a/b"), ("t3", "App"), ("t4", "")], "id string, package string")
    paths = spark.createDataFrame([("a/b",), ("App",), ("a/b/c/d",), ("z/x",), ("manifest.toml",)], "path string")
    assert values(selection.nearest_packages(paths, targets), "path", "package") == [("App", ""), ("a/b", "a"), ("a/b/c/d", "a/b"), ("manifest.toml", "")]


def test_file_batches_fall_back_to_the_target(spark):
    df = spark.createDataFrame([("a", "u1", "f"), ("a", "u2", "f"), ("b", "u1", "f"), ("b", "u2", "")], "target string, unit string, file string")
    assert values(selection.file_batches(df)) == [("a", "f", "u1,u2"), ("b", "b", "u1,u2")]


def test_eviction_keeps_to_the_budget(spark):
    blobs = spark.createDataFrame([("d1", 10, 1), ("d2", 10, 2), ("d3", 10, 3), ("d4", 10, 4)], "digest string, size long, modified long")
    acts = spark.createDataFrame([("a1", 1, 1), ("a2", 1, 2)], "id string, size long, modified long")
    refs = spark.createDataFrame([("a1", "d1"), ("a2", "d1"), ("a2", "d2")], "id string, ref string")
    assert values(store.orphans(blobs, refs), "digest") == [("d3",), ("d4",)]
    assert values(store.evict_orphans(blobs, refs, 42, 35), "digest") == [("d3",)]
    assert values(store.evict_actions(blobs, acts, refs, 22, 21)) == [("a1", 1, 0)]
    assert values(store.gc_report(blobs, acts, refs, 100)) == [(42, 42, 0, 0)]
    assert values(store.gc_report(blobs, acts, refs, 5)) == [(42, 0, 4, 2)]


def test_results(spark):
    rows = [("t", "a", 1, 1, "failed"), ("t", "a", 2, 1, "flaky"), ("t", "b", 1, 2, "todo"), ("t", "c", 1, 3, None)]
    df = spark.createDataFrame(rows, "target string, case_id string, batch long, position long, status string")
    merged = results.merge_cases(df)
    assert values(results.counters(merged.filter("case_id <> 'c'"), "target")) == [("t", 2, 1, 0, 1, 1)]
    assert values(results.counters(df.filter("case_id = 'c'"), "target")) == [("t", 1, 0, 1, 0, 0)]
    planned = spark.createDataFrame([("t", "a"), ("t", "z")], "target string, case_id string")
    assert values(results.with_missing(df.filter("case_id = 'b'"), planned)) == [("t", "a", "missing"), ("t", "b", "todo"), ("t", "z", "missing")]
    assert values(results.missing_units(planned, df)) == [("t", "z")]


def test_results_over_batches(spark):
    plan = spark.createDataFrame([("t", "b1", 1, ["a", "s"]), ("t", "b2", 2, ["a", "c"]), ("t", "b3", 3, []), ("u", "b4", 1, []), ("v", "b5", 1, [])], "target string, batch string, position long, units array<string>")
    runs = spark.createDataFrame([("b1", True, None, None), ("b2", True, "passed", "r2"), ("b4", True, "passed", None), ("b5", True, None, "x")], "batch string, success boolean, status string, runner string")
    cases = spark.createDataFrame([("b2", "a", 1, "flaky"), ("b2", "a", 2, "todo"), ("b4", "q", 1, None)], "batch string, case_id string, place long, status string")
    batches = results.batch_runs(plan, runs)
    merged = results.merged_cases(batches, cases)
    assert values(merged, "target", "case_id", "status")[:3] == [("t", "a", "todo"), ("t", "s", "passed"), ("t", "t::batch:b3", "failed")]
    # A batch that did not run fails its target; a case without a status counts as failed; a run without results keeps its verdict.
    assert dict(values(results.all_passed(batches))) == {"t": False, "u": True, "v": True}
    got = {r["target"]: (r["runner"], r["status"], r["total"], r["passed"], r["failed"], r["skipped"]) for r in results.merged_results(batches, cases).collect()}
    assert got == {"t": ("r2", "failed", 3, 1, 1, 1), "u": ("unknown", "failed", 1, 0, 1, 0), "v": ("unknown", "passed", 1, 1, 0, 0)}
    left = spark.createDataFrame([("b2", "logs", "l"), ("b2", "logs", "l"), ("b1", "logs", "x")], "batch string, field string, path string")
    assert values(results.artifacts(batches, left)) == [("t", "logs", "l")]
    document = results.results_document(results.merged_results(batches, cases), merged, results.artifacts(batches, left), "v1")
    assert values(results.contract_violations(document.filter("target <> 'u'"), "v1")) == []
    assert values(results.units_of(document), "target", "unit")[0] == ("t", "a")


def test_sarif(spark):
    place = {"physicalLocation": {"artifactLocation": {"uri": "file:///src/a%20b.c"}, "region": {"startLine": 3, "startColumn": 1}}}
    run = {"tool": {"driver": {"name": "lint", "rules": [{"id": "R1", "helpUri": "http://h"}]}}, "results": [{"ruleId": "R1", "level": "odd", "message": {"text": "m"}, "locations": [place]}, {"ruleId": "R2", "level": "error", "message": {"text": "n"}}]}
    got = results.sarif_findings(spark.createDataFrame([(json.dumps({"runs": [run]}),)], "report string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("lint", "R1", "warning", "m", "src/a b.c", 3, 1, "http://h"), ("lint", "R2", "error", "n", None, None, None, None)], key=str)
    assert values(results.fails_at(got, "tool", "error")) == [("lint", True)]


def test_changes_since(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (5, "c"), (6, None)], "generation long, path string")
    def since(a, b):
        return sorted(tuple(r) for r in journal.changes_since(df, a, b).collect())
    assert since(0, 3) == [(True, "a"), (True, "b")] and since(3, 3) == [(True, None)]
    assert since(3, 5) == since(4, 6) == since(9, 6) == [(False, None)]


def test_logs(spark):
    lines = spark.createDataFrame([("stdout", 1, "x"), ("stdout", 2, "y"), ("stderr", 1, None)], "source string, order long, message string")
    got = logs.records(lines, [])
    assert values(got, "cursor", "level") == [("stderr:000000000000", "error"), ("stdout:000000000000", "info"), ("stdout:000000000001", "info")]
    assert values(logs.matching_logs(got, after="stdout:000000000000"), "cursor") == [("stdout:000000000001",)]
    assert logs.first_events(got, ["cursor"], 0).count() == 1 and logs.first_events(got, ["cursor"], 0, at_least_one=False).count() == 0


def test_rules(spark, app):
    assert values(validate.missing_dependencies(app), "target", "message") == [("apps/App", "no target gone/X")]
    assert values(validate.duplicate_targets(app.unionAll(app.limit(1))), "code") == [("duplicate_target",)]
    schema = spark.createDataFrame([("app", "n", True, [], [], "float"), ("app", "list", False, [], [], "list<string>"), ("library", "x", True, [], [], "string")], "kind string, name string, required boolean, allowed array<string>, disallowed array<string>, type string")
    assert values(validate.type_mismatches(app, schema), "target", "attribute") == [("apps/App", "n")]
    assert values(validate.missing_attributes(app, schema), "target") == [("apps/Core",), ("apps/Util",)]
    assert values(validate.unknown_attributes(app, schema), "attribute") == [("f",), ("info",)]
    shown = app.withColumn("visibility", F.when(F.col("name") == "Core", F.array(F.lit("subtree:lib"))).otherwise(F.array(F.lit("public"))))
    assert values(validate.invisible_dependencies(shown), "target") == [("apps/App",), ("apps/App",), ("apps/Tests",)]
    sources = spark.createDataFrame([("apps/App", "a.c"), ("apps/App", "b.c")], "id string, path string")
    assert values(validate.missing_sources(sources.unionAll(spark.createDataFrame([("apps/App", "*.c"), ("apps/App", "x/*.c")], sources.schema)), spark.createDataFrame([("a.c",)], "path string")), "message") == [("no file b.c",), ("no file x/*.c",)]
    roles = spark.createDataFrame([("app", "deps", ["other"]), ("test", "extra", ["module"])], "kind string, role string, accepts array<string>")
    assert values(validate.incompatible_providers(app, roles), "target") == [("apps/App",), ("apps/App",)]
    assert values(validate.unexpected_dependencies(app, roles), "target") == [("apps/Core",)]


def test_scalars(spark):
    df = spark.createDataFrame([("2GiB",), ("1k",), ("1kB",), ("7",), ("1.5m",), ("3xb",)], "t string")
    assert [r[0] for r in df.select(S.parse_size(F.col("t"))).collect()] == [2 << 30, 1024, 1000, 7, None, None]
    one = spark.range(1)
    def of(*columns):
        return tuple(one.select(*columns).first())
    assert of(S.cut_bytes(F.lit("aé"), 2)["text"], S.cut_bytes(F.lit("aé"), 3)["truncated"]) == ("a", False)
    assert of(S.is_digest(F.lit("A" * 64)), S.is_digest(F.lit("a" * 64))) == (False, True)
    assert of(S.arch(F.lit("aarch64")), S.operating_system(F.lit("darwin")), S.workers(F.lit(0), 4)) == ("arm64", "macos", 1)
    assert of(S.first_distinct(F.array(*map(F.lit, "bab"))), S.worker_memory(F.lit(7), F.lit(0))) == (["b", "a"], 7)
    assert of(P.relative_reference(F.lit("a/b"), F.lit("../c")), P.relative_reference(F.lit(""), F.lit("../c"))) == ("a/c", None)
    assert of(P.target_id(F.lit(""), F.lit("x")), P.area(F.lit(".git/x")), P.area(F.lit(".cache/out/y"))) == ("x", None, "output")
    assert of(P.included(F.lit("a/b"), [], ["a*"]), P.included(F.lit("a/b"), ["a/*"], [])) == (False, True)
    assert of(P.usable_pattern(F.lit("../x")), P.usable_pattern(F.lit("a/*"))) == (False, True)


def test_search(spark):
    df = spark.createDataFrame([("apple_app", "an app"), ("apple_test", "tests"), ("rust_test", "tests"), ("go_lib", "a library"), ("node", "the runner of specs")], "kind string, docs string")
    def kinds(q):
        return {r[0] for r in search.matching(df, q).select("kind").collect()}
    assert kinds("the apple target") == {"apple_app", "apple_test"}
    # Several families: these, and kinds that mention another word, unless it is generic.
    assert kinds("rust go app") == {"rust_test", "go_lib"} and kinds("rust go spec") == {"rust_test", "go_lib", "node"}
    assert kinds("test") == {"apple_test", "rust_test"} and kinds("libra") == {"go_lib"} and kinds("the") == {"node"} and len(kinds("?!")) == 5
    catalog = df.selectExpr("*", "array(named_struct('slug', 's', 'name', 'n')) AS examples")
    assert values(search.example_of(catalog, "node", "s")) == [("s", "n")] and search.schema_of(catalog, "node").count() == 1
    for wrong in (lambda: search.schema_of(catalog, "x"), lambda: search.example_of(catalog, "node", "x")):
        with pytest.raises(LookupError):
            wrong()


def test_selects():
    value = {"a": [{"select": {"x": 1, "default": {"select": {"y": 2}}}}], "b": {"select": {"y": 3}, "other": 4}}
    assert selects.resolve(value, ["x", "default"]) == {"a": [1], "b": value["b"]}
    assert selects.resolve(value, ["y", "default"]) == {"a": [2], "b": value["b"]}
    with pytest.raises(LookupError):
        selects.resolve(value, ["default"])


def test_providers_and_functions(spark):
    rows = [("a", ["c", "b", "gone", "b"], {"tools": ["b"]}, []), ("b", [], {}, ["p"]), ("c", ["b"], {}, ["q", "r"])]
    df = spark.createDataFrame(rows, "id string, deps array<string>, dependencies map<string,array<string>>, providers array<string>")
    got = values(providers.dependencies_by_role(df, df.select("id")), "id", "role", "pos", "dep")
    assert got == [("a", "deps", 0, "c"), ("a", "deps", 1, "b"), ("a", "deps", 2, "b"), ("a", "tools", 0, "b"), ("c", "deps", 0, "b")]
    known = providers.Functions()
    known.register("count", lambda key, frame: frame.groupby("role", as_index=False).size().assign(id=key)[["id", "role", "size"]], "id string, role string, size long")
    with pytest.raises(ValueError):
        known.register("count", None, "")
    with pytest.raises(LookupError):
        known.apply("none", df)
    edges = providers.dependencies_by_role(df, df.select("id"))
    assert values(known.apply("count", edges)) == [("a", "deps", 3), ("a", "tools", 1), ("c", "deps", 1)]
    known.register("twice", lambda _, frame: frame[["id"]].loc[frame.index.repeat(2)], "id string")
    assert values(known.expand("twice", df.select("id"))) == [("a",), ("a",), ("b",), ("b",), ("c",), ("c",)]


def test_expansion_ends_and_finds_repeats(spark):
    known = providers.Functions()

    def halves(_, frame):
        some = frame[frame["n"] > 1]
        return some.assign(id=some["id"] + "/h", n=some["n"] // 2)[["id", "n"]]

    known.register("halves", halves, "id string, n long")
    known.register("same", lambda _, frame: frame, "id string, n long")
    df = spark.createDataFrame([("a", 5), ("b", 1)], "id string, n long")
    assert values(providers.expanded(df, known, "halves")) == [("a", 5), ("a/h", 2), ("a/h/h", 1), ("b", 1)]
    for name, most in (("halves", 3), ("same", 100)):
        with pytest.raises(ValueError):
            providers.expanded(df, known, name, most)


def test_journal_of_batches_is_numbered_again_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, text in enumerate(('{"area":"a","path":"y"}\n{"area":"b","path":"q"}\n{"area":"a","path":"x"}', '{"area":"a","path":"b"}')):
        (tmp_path / "in" / f"{k}.json").write_text(text)
        for out, check in (("out", "check"), ("again", "check2")):
            stream.journal_stream(stream.tail(spark, str(tmp_path / "in"), "area string, path string"), str(tmp_path / out), str(tmp_path / check))
    want = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "b"), ("b", 1, "q")]
    assert values(spark.read.parquet(str(tmp_path / "out")), "area", "generation", "path") == values(spark.read.parquet(str(tmp_path / "again")), "area", "generation", "path") == want


def test_scripts(spark):
    text = '#!/bin/sh -x\n# task needs "b"\r\n\n-- TASK   cwd "x y"\n; task bogus "1"\n# taskforce needs "z"\nrun\n# task needs "late"\n'
    df = spark.createDataFrame([("a", text), ("b", '#!/usr/bin/env -S node\n# task needs "a"'), ("c", "no shebang"), ("d", '#!x\n# task needs "c"')], "path string, text string")
    notes = scripts.annotations(df)
    assert values(notes.filter("path = 'a'"), "directive", "value") == [("cwd", "x y"), ("invalid", '; task bogus "1"'), ("needs", "b")]
    assert values(scripts.runtimes(df), "path", "runtime") == [("a", "/bin/sh"), ("b", "node"), ("c", None), ("d", "x")]
    start = lambda p: spark.createDataFrame([(p,)], "start string")
    assert values(scripts.needed_scripts(notes, start("d"))) == [("d", "c")]
    with pytest.raises(ValueError):
        scripts.needed_scripts(notes, start("a"))


def test_contract(spark):
    listing = lambda *rows: spark.createDataFrame([("x", *r) for r in rows], "action string, path string, print string")
    declared = lambda *paths: spark.createDataFrame([("x", p) for p in paths], "action string, path string")
    empty = listing(("q", "1")).limit(0)
    private = (empty, listing(("out", "dir"), ("out/deep", "dir"), ("out/deep/o", "1"), ("tmp", "1")))
    shared = (listing(("src", "dir"), ("src/a", "1"), ("src/b", "1"), ("lib/c", "1"), ("lib", "dir")), listing(("src", "dir"), ("src/a", "2"), ("lib/c", "3"), ("lib", "dir")))
    errors = spark.createDataFrame([("x", "cannot read lib/c, src/a or lib")], "action string, text string")
    links = spark.createDataFrame([("x", "out/deep/l", False)], "action string, path string, inside boolean")
    got = values(contract.violations(declared("src/a", "src/b"), declared("out/deep/", "none"), private, shared, errors, links), "code", "path")
    assert got == [
        ("declared_input_deleted", "src/b"), ("declared_input_modified", "src/a"), ("missing_output", "none"), ("symlink_escape", "out/deep/l"),
        ("undeclared_read", "lib/c"), ("undeclared_write", "lib/c"), ("undeclared_write", "tmp"),
    ]


def test_edits_are_all_or_nothing(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string")
    good = spark.createDataFrame([("create", "c", "3"), ("update", "a", None), ("delete", "b", None)], "op string, id string, v string")
    assert values(edits.apply(now, good, ["v"])) == [("a", "1"), ("c", "3")]
    with pytest.raises(ValueError):
        edits.apply(now, good.unionAll(spark.createDataFrame([("create", "a", "x")], good.schema)), ["v"])


def test_files(spark, tmp_path):
    where = str(tmp_path / "store")
    assert files.read_or_empty(spark, where, "id string, n long").count() == 0
    rows = spark.createDataFrame([("a", 1)], "id string, n long")
    files.append(rows, where)
    assert values(files.read_or_empty(spark, where, "id string, n long")) == [("a", 1)]
    with pytest.raises(ValueError):
        files.append(rows, where)
    assert files.read_ndjson(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "x.ndjson").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert values(files.read_ndjson(spark, str(tmp_path / "x.ndjson"), "a long")) == [(1,), (2,)]
    (tmp_path / "bad.ndjson").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_ndjson(spark, str(tmp_path / "bad.ndjson"), "a long").collect()
    (tmp_path / "w" / "apps").mkdir(parents=True)
    (tmp_path / "w" / ".hid").mkdir()
    for d in ("apps", ".hid"):
        (tmp_path / "w" / d / "manifest.toml").write_text('[[target]]\nname = "A"\nkind = "app"\ndeps = ["x/y"]\n[target.attrs]\nn = 1\n')
    assert values(files.read_manifests(spark, str(tmp_path / "w")), "id", "attrs") == [("apps/A", '{"n": 1}')]
    paths = spark.createDataFrame([("p/a.toml",), ("p/b.lock",), ("q/a.toml",)], "path string")
    markers = spark.createDataFrame([("both", "a.toml"), ("both", "b.lock"), ("one", "a.toml")], "project string, marker string")
    found = files.marker_projects(paths, markers)
    assert values(found) == [("p", "both"), ("p", "one"), ("q", "one")]
    assert files.project_package(found, "both") == "p" and files.project_package(found, "one", "q") == "q"
    with pytest.raises(ValueError):
        files.project_package(found, "one")
    with pytest.raises(LookupError):
        files.project_package(found, "two")
    texts = spark.createDataFrame([("a", "x", "1234"), ("a", "y", "12")], "owner string, path string, text string")
    assert files.bounded_texts(texts, 4, 6).count() == 2
    for each, all_of in ((3, 9), (4, 5)):
        with pytest.raises(ValueError):
            files.bounded_texts(texts, each, all_of)


def test_stream_numbers_changes_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, text in enumerate(('{"area":"a","path":"x"}\n{"area":"b","path":"y"}', '{"area":"a","path":"z"}')):
        (tmp_path / "in" / f"{k}.json").write_text(text)
        changes = stream.tail(spark, str(tmp_path / "in"), "area string, path string")
        stream.drain(stream.number_changes(changes), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert values(got, "area", "generation", "path") == [("a", 1, "x"), ("a", 2, "z"), ("b", 1, "y")]


def test_sizes_pointers_and_status(spark):
    df = spark.createDataFrame([("99999999999t", '{"a": {"0": 5, "it\'s": [1, {"x.y": "z"}]}, "": 3}', 0)], "size string, doc string, code int")
    point = lambda p: S.json_pointer(F.col("doc"), p)
    got = df.select(S.parse_size(F.col("size")), S.status_of(F.col("code")), S.status_of(F.lit(-1)), point("/a/0"), point("/a/it's/0"), point("/a/it's/1/x.y"), point("/"), point("/a/1"), point("/a/it's/00")).first()
    assert list(got) == [None, "passed", "failed", "5", "1", "z", "3", None, None]


def test_typed_literals_and_whole_nodes(spark):
    rows = [("p/t", "p", "t", "lib", ["p/u"], ["m"], ["build"], '{"on": true, "tags": ["a", "b"], "mixed": [1, "1", null], "f": 1.0, "none": null}', {"tools": ["p/u", "p/gone"]})]
    rows.append(("p/u", "p", "u", "lib", [], [], [], "{}", {}))
    df = spark.createDataFrame(rows, TARGET + ", dependencies map<string,array<string>>")
    nodes, edges = graph.nodes(df), graph.edges(df)
    def holds(path, op, value):
        return {r[0] for r in pattern.node(nodes, "t", "Target").where([Condition("t", path, op, value)]).returns("t.id").collect()} == {"p/t"}
    for path, op, value in [
        ("attrs.on", "=", True), ("attrs.on", "in", [False, True]), ("attrs.tags", "=", ["a", "b"]), ("attrs.tags", "in", [["a", "b"]]), ("attrs.mixed", "contains", 1), ("attrs.mixed", "contains", "1"), ("attrs.mixed", "=", [1, "1", None]),
        ("attrs.mixed", "contains", None), ("attrs.f", "=", 1.0), ("attrs.none", "=", None), ("capabilities", "contains", "build"), ("deps", "=", ["p/u"]), ("dependency_edges.tools", "contains", "p/gone"),
    ]:
        assert holds(path, op, value), (path, op, value)
    for path, op, value in [("attrs.on", "<>", True), ("attrs.on", "=", "true"), ("attrs.tags", "=", ["b", "a"]), ("attrs.tags", "=", ["a"]), ("attrs.tags", "contains", 1), ("attrs.f", "=", 1), ("attrs.gone", "=", None), ("attrs.on", "in", [1, "true"])]:
        assert not holds(path, op, value), (path, op, value)
    assert len(pattern.node(nodes, "t", "Target", kind="lib").rows.collect()) == 2
    whole = pattern.node(nodes, "c", "Capability").returns(c="c", id="c.id", target="c.target").collect()
    assert [tuple(r) for r in whole] == [('{"name":"build","output_groups":[],"requires_outputs":[],"target":"p/t"}', None, "p/t")]
    assert list(json.loads(pattern.node(nodes, "t", "Target", id="p/t").returns(t="t").first()["t"])) == ["attrs", "capabilities", "dependency_edges", "deps", "id", "kind", "name", "package", "providers", "srcs", "visibility"]
    assert values(edges.filter("type = 'DEPENDS_ON'"), "src", "dst") == [("p/t", "p/u"), ("p/t", "p/u")]


def test_items_are_carried_once_each(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("d", "c"), ("d", "c")], "src string, dst string")
    items = spark.createDataFrame([("b", "x"), ("c", "x"), ("c", None), ("c", None), ("z", "y")], "node string, item string")
    got = {(r["node"], r["item"]): r["hops"] for r in fixpoint.carried(items, edges).collect()}
    assert got == {("b", "x"): 0, ("c", "x"): 0, ("a", "x"): 1, ("d", "x"): 1, ("c", None): 0, ("b", None): 1, ("a", None): 2, ("d", None): 1, ("z", "y"): 0}
    assert fixpoint.carried(items.limit(0), edges).count() == 0 and fixpoint.carried(items, edges.limit(0)).count() == 4


def test_items_over_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).selectExpr("id + 1 AS src", "id AS dst")
    got = fixpoint.carried(spark.createDataFrame([(0, "x"), (100, "x"), (100, "y")], "node long, item string"), edges)
    assert {(r["item"], r["n"], r["far"]) for r in got.groupBy("item").agg(F.count("node").alias("n"), F.max("hops").alias("far")).collect()} == {("x", n, n - 101), ("y", n - 100, n - 101)}


def test_plan_documents(spark):
    def plan(paths, tests, batches=None):
        paths = spark.createDataFrame([(p,) for p in paths], "path string")
        batches = batches and spark.createDataFrame(batches, "target string, filters array<string>")
        lines = selection.plan_lines(paths, paths.filter("path > 'b'"), spark.createDataFrame(tests, "id string, kind string, reasons array<string>"), batches)
        return lines, selection.document_id(lines).first()["plan_id"]

    one, first = plan(["b", "a", "c", "a"], [("t", "k", ["r2", "r1", "r2"]), ("s", "k", [])])
    two, second = plan(["c", "b", "a"], [("s", "k", []), ("t", "k", ["r1"]), ("t", "k", ["r2"])])
    assert first == second and values(one) == values(two)
    lines = {(r["section"], r["line"]) for r in one.collect()}
    assert {line for s, line in lines if s == "tests"} == {'{"id":"s","kind":"k","reasons":[]}', '{"id":"t","kind":"k","reasons":["r1","r2"]}'}
    assert {line for s, line in lines if s == "unmatched"} == {'{"path":"c"}'}
    import hashlib

    ident = hashlib.sha256(b'test-batch\0["t",[]]').hexdigest()
    assert ("batches", f'{{"id":"{ident}","target":"t","test_filters":[]}}') in lines
    others = [plan(["a"], [("t", "k", ["r1"])], [("t", f)]) for f in (["y", "x", "y"], ["x", "y"], ["x"])]
    assert others[0][1] == others[1][1] != others[2][1]
    quoted = spark.range(1).select(selection.batch_id(F.lit('a"]b'), F.array(F.lit("x")))).first()[0]
    assert quoted == hashlib.sha256(b'test-batch\0["a\\"]b",["x"]]').hexdigest()


def test_kinds_are_found_by_examples_and_references(spark):
    schema = "kind string, docs string, examples array<struct<slug:string,use_when:string>>, references array<struct<system:string,symbol:string>>"
    rows = [("node_app", "d", [("s", "starting a server")], None), ("go_tool", "d", None, [("bazel", "rule_x")]), ("c_lib", None, [], [])]
    catalog = spark.createDataFrame(rows, schema)
    found = lambda text, *columns: {r[0] for r in search.matching(catalog, text, *columns).select("kind").collect()}
    assert (found("serve"), found("bazel"), found("rule"), found("rust")) == ({"node_app"}, {"go_tool"}, {"go_tool"}, set())
    assert found("serve", ("kind", "docs")) == set()
