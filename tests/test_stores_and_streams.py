"""Stores as files, receipts, resolvers, patterns found by their literals, and streams with state."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import logs, receipts, resolvers, selection, store
from graphloom.sources import files
from graphloom.sources import store as S
from graphloom.streaming import tracker


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# Stores


def test_putting_twice_leaves_one_blob(spark, tmp_path):
    path, schema = str(tmp_path / "blobs"), "digest string, size long, modified long"
    assert S.contents(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", 2, 1), (None, 9, 9)], schema)
    assert values(S.put(rows, path)) == [("a", 1, 3), ("b", 2, 1)]
    before = values(S.contents(spark, path, schema))
    S.put(rows, path)
    S.put(spark.createDataFrame([("c", 7, 7)], schema), path)
    assert values(S.contents(spark, path, schema)) == [*before, ("c", 7, 7)]
    assert spark.read.parquet(path).count() == 3
    none = spark.createDataFrame([], "id string, size long")
    assert values(store.stats(S.contents(spark, path, schema), none), "what", "n", "bytes") == [("actions", 0, 0), ("blobs", 3, 10)]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "blobs"), "digest string, size long"
    with monkeypatch.context() as m:  # neither sees what the other has written
        m.setattr(S, "read_or_empty", lambda spark, path, schema: spark.createDataFrame([], schema))
        S.put(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
        S.put(spark.createDataFrame([("b", 2), ("c", 3)], schema), path)
    assert spark.read.parquet(path).count() == 4
    assert values(S.contents(spark, path, schema)) == [("a", 1), ("b", 2), ("c", 3)]
    S.compacted(spark, path, schema)
    assert spark.read.parquet(path).count() == 3 and values(S.contents(spark, path, schema)) == [("a", 1), ("b", 2), ("c", 3)]


def test_records_with_one_id(spark, tmp_path):
    path, schema = str(tmp_path / "evidence"), "id string, status string"
    S.append_records(spark.createDataFrame([("1", "passed"), ("2", None)], schema), path)
    S.append_records(spark.createDataFrame([("1", "passed"), ("3", "failed")], schema), path)
    assert values(S.contents(spark, path, schema, "id")) == [("1", "passed"), ("2", None), ("3", "failed")]
    for bad in ([("2", "failed")], [("4", "a"), ("4", "b")]):
        with pytest.raises(ValueError):
            S.append_records(spark.createDataFrame(bad, schema), path)
    assert S.contents(spark, path, schema, "id").count() == 3


def test_walk_of_a_store_folder(spark, tmp_path):
    a, b, c = (x * 64 for x in "abc")
    for digest, size in ((a, 10), (b, 20), (c, 30)):
        (tmp_path / "cas" / digest[:2]).mkdir(parents=True)
        (tmp_path / "cas" / digest[:2] / digest[2:]).write_bytes(b"x" * size)
    (tmp_path / "cas" / "aa" / ".tmp-1").write_bytes(b"half")
    (tmp_path / "cas" / "stray").write_bytes(b"?????")
    acts = tmp_path / "actions"
    acts.mkdir()
    result = {"exit_code": 0, "outputs": {"o": a}, "stdout": b}
    for name, text in (("one.json", json.dumps(result)), ("corrupt.json", json.dumps(result)[:-3]), ("foreign.json", '{"outputs": {"o": "x"}, "exit_code": 0}'), ("bare.json", '{"outputs": {}}'), (".tmp-two.json", "{}"), ("note.txt", "hi")):
        (acts / name).write_text(text)
    for i, p in enumerate([*sorted((tmp_path / "cas").rglob("*")), *sorted(acts.iterdir())]):
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    blobs, actions = S.walk_blobs(spark, str(tmp_path / "cas")), S.walk_actions(spark, str(acts))
    assert values(blobs, "digest", "size") == sorted([(a, 10), (b, 20), (c, 30), (None, 5)], key=str)
    got = {r["id"]: sorted(r["refs"]) for r in actions.collect()}
    assert got == {"one": sorted([a, b]), "corrupt": [], "foreign": [], "bare": []}
    refs = S.references(actions)
    assert values(store.stats(blobs, actions), "what", "n")[0] == ("actions", 4)
    total = blobs.agg(F.sum("size")).first()[0] + actions.agg(F.sum("size")).first()[0]
    gone = store.evict_orphans(blobs, refs, total, 0)
    assert values(gone, "digest") == sorted([(c,), (None,)], key=str)
    left = total - 35
    out = {r["id"]: r["released"] for r in store.evict_actions(blobs, actions, refs, left, 0).collect()}
    assert out == {"one": 30, "corrupt": 0, "foreign": 0, "bare": 0}
    report = store.gc_report(blobs, actions, refs, 0).first()
    assert (report["bytes_before"], report["bytes_after"], report["removed_blobs"], report["removed_actions"]) == (total, 0, 4, 4)


def test_documents_and_results_as_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "id": "a",\n "n": 1\n}')
    assert values(files.read_documents(spark, str(tmp_path), "id string, n int")) == [("a", 1)]
    files.write_by_target(spark.createDataFrame([("t", "c1"), ("t", "c2"), ("u", "c3")], "target string, case_id string"), str(tmp_path / "out"))
    assert values(spark.read.json(str(tmp_path / "out")), "target", "case_id") == [("t", "c1"), ("t", "c2"), ("u", "c3")]


def test_sessions_are_described(spark, tmp_path):
    for name, text in (("s1", '{"sessionId": "s1",\n "runtime": {"kind": "test"}}'), ("s2", "[1]"), ("s3", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(text)
    sessions = files.read_sessions(spark, str(tmp_path))
    row = logs.describe(sessions, "s1").first()
    assert row["session"] == "s1" and json.loads(row["document"])["runtime"] == {"kind": "test"}
    for wrong, error in (("s2", ValueError), ("s3", LookupError), ("s4", LookupError)):
        with pytest.raises(error):
            logs.describe(sessions, wrong)


# Receipts


RECEIPT = "key string, schema string, target string, sandbox string, instance string, source_generation long, output_generation long, environment map<string,string>, host_paths map<string,string>, source_digests map<string,string>, executable string, outputs array<string>"


def test_the_first_reason_of_ten(spark):
    changes = spark.createDataFrame([(1, "old"), (3, None), (4, "a"), (5, "b"), (6, "a")], "generation long, path string")
    world = receipts.World(
        receipts.Position("i", 6, 2), changes, spark.createDataFrame([("a", "A2"), ("b", "B2"), ("c", "C")], "path string, digest string"), spark.createDataFrame([("out/x",), ("out/x",)], "path string"),
        spark.createDataFrame([("PATH", "/bin"), ("NONE", None)], "name string, value string"), spark.createDataFrame([("/bin/cc", "f1")], "path string, fingerprint string"), "exe", "v5",
    )
    good = {"schema": "v5", "target": "t", "sandbox": "s", "instance": "i", "source_generation": 6, "output_generation": 2, "environment": {"PATH": "/bin", "UNSET": None}, "host_paths": {"/bin/cc": "f1"}, "source_digests": {}, "executable": "exe", "outputs": ["out/x"]}
    ab = {"a": "A2", "b": "B2", "z": "Z"}
    cases = {
        "hit": ({}, None), "moved": ({"source_generation": 3, "source_digests": ab}, None), "later": ({"source_generation": 4, "source_digests": ab}, None), "only a": ({"source_generation": 5, "source_digests": {"a": "A2"}}, None),
        "schema": ({"schema": "v4", "target": "u"}, "schema"), "target": ({"target": "u", "sandbox": "x"}, "target"), "sandbox": ({"sandbox": "x"}, "sandbox"), "instance": ({"instance": "j", "output_generation": 1}, "filesystem tracker"),
        "stale": ({"source_generation": 3, "source_digests": {**ab, "a": "A1"}}, "source change"), "unnamed": ({"source_generation": 4, "source_digests": {"a": "A2"}}, "source change"), "lost": ({"source_generation": 2, "source_digests": ab}, "source change"),
        "future": ({"source_generation": 7, "source_digests": ab}, "source change"), "output change": ({"output_generation": 1, "environment": {"PATH": "x"}}, "output change"), "environment": ({"environment": {"PATH": "x"}, "host_paths": {"/y": "q"}}, "environment"),
        "unset": ({"environment": {"UNSET": "1"}}, "environment"), "host path": ({"host_paths": {"/y": "q"}, "executable": "e"}, "host path"), "executable": ({"executable": "e", "outputs": ["no"]}, "executable"), "output": ({"outputs": ["out/x", "no"]}, "output"),
    }
    rows = [tuple({"key": k, **good, **change}[c.split()[0]] for c in RECEIPT.replace("map<string,string>", "m").split(", ")) for k, (change, _) in cases.items()]
    wanted = spark.createDataFrame([(k, "t", "s") for k in [*cases, "none"]], "key string, target string, sandbox string")
    got = {r["key"]: r for r in receipts.checked(wanted, spark.createDataFrame(rows, RECEIPT), world).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {**{k: reason for k, (_, reason) in cases.items()}, "none": None}
    assert {reason for _, reason in cases.values()} == {None, *receipts.REASONS}
    assert got["none"]["cache"] == "miss" and got["hit"]["cache"] == "hit"
    assert (got["moved"]["source_generation"], got["moved"]["source_digests"]) == (6, {}) and got["stale"]["source_generation"] == 3


# Resolvers


def shards_class():
    class Shards:
        """Makes what its target's attribute ``make`` lists."""

        def eval(self, id: str, package: str, name: str, attrs: str):
            for item, key, value in json.loads(attrs).get("make", []):
                yield item, key, None if value is None else json.dumps(value)

    return Shards


@pytest.fixture(scope="module")
def shards(spark):
    resolvers.register(spark, "graphloom_test_shards", shards_class())
    return {"sharded": "graphloom_test_shards"}


def owner(spark, *rows):
    full = [(f"{p}/{n}", p, n, kind, deps, [], json.dumps({"make": make})) for p, n, kind, deps, make in rows]
    return spark.createDataFrame(full, "id string, package string, name string, kind string, deps array<string>, srcs array<string>, attrs string")


def test_what_resolvers_make_is_merged(spark, shards):
    inner = {"kind": "sharded", "attrs": {"make": [["target", "leaf", {"kind": "lib"}]]}}
    df = owner(spark, ("p", "o", "sharded", ["p/x"], [["target", "x", {"kind": "lib", "deps": ["q/z"]}], ["target", "in", inner], ["attr", "count", 2], ["attr", 'a"b', [1.0]]]),
               ("p", "r", "sharded", [], [["target", "y", {"kind": "lib"}], ["target", "w", {"kind": "lib"}], ["root", "y", None], ["root", "./o", None]]), ("p", "plain", "lib", [], []))
    got = {r["id"]: r for r in resolvers.resolved(df, shards).collect()}
    assert sorted(got) == ["p/in", "p/leaf", "p/o", "p/plain", "p/r", "p/w", "p/x", "p/y"]
    assert got["p/o"]["deps"] == ["p/x", "p/in"] and got["p/r"]["deps"] == ["p/o", "p/y"] and got["p/in"]["deps"] == ["p/leaf"] and got["p/x"]["deps"] == ["q/z"]
    attrs = json.loads(got["p/o"]["attrs"])
    assert attrs["count"] == 2 and attrs['a"b'] == [1.0] and len(attrs["make"]) == 4
    assert (got["p/leaf"]["owner"], got["p/in"]["owner"], got["p/plain"]["owner"]) == ("p/in", "p/o", None)


@pytest.mark.parametrize("make, says", [
    ([["attr", "make", 1]], "declared"), ([["attr", "n", 1], ["attr", "n", 2]], "twice"), ([["target", "x", {"kind": "lib"}]] * 2, "emitted twice"),
    ([["target", "o", {"kind": "lib"}]], "emitted twice"), ([["root", "//x", None]], "no root"), ([["target", f"t{i}", {"kind": "lib"}] for i in range(9)], "more than"),
])
def test_what_resolvers_must_not_make(spark, shards, make, says):
    with pytest.raises(ValueError, match=says):
        resolvers.resolved(owner(spark, ("p", "o", "sharded", [], make)), shards, most=9).count()


def test_a_resolver_is_registered_once(spark, shards):
    with pytest.raises(ValueError):
        resolvers.register(spark, "graphloom_test_shards", shards_class())


# Patterns without folder or ending


def test_patterns_are_found_by_their_literals(spark):
    import re

    paths = [f"{a}/{b}/{c}" for a in ("src", "lib", "en") for b in ("en", "de", "x") for c in ("main.c", "index", "a", "test_main.py")] + ["top", "en", "日本/語/x"]
    patterns = ["*/en/*", "*/*", "**", "*", "**/main*", "*a*", "[sl]*/en/index", "*zzz*", "?ib/de/a", "**/en/**", "*本/語/*", "*.c", "src/*"]
    changed = spark.createDataFrame([(p,) for p in paths], "path string")
    df = spark.createDataFrame([(f"t{i}", p) for i, p in enumerate(patterns)], "id string, pattern string")
    rx = {r["pattern"]: r["rx"] for r in df.select("pattern", selection.glob_regex(F.col("pattern")).alias("rx")).collect()}
    want = sorted((p, f"t{i}") for i, g in enumerate(patterns) for p in paths if re.search(rx[g].replace(r"\z", r"\Z"), p))
    got = selection.pattern_owners(changed, df)
    assert values(got, "path", "id") == sorted(want, key=str) and len(want) > 60
    one = selection.pattern_owners(changed, spark.createDataFrame([("t", "*/en/*")], "id string, pattern string"))
    assert "_gram" in one._jdf.queryExecution().optimizedPlan().toString()


# Streams


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def _run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start(str(out)).awaitTermination()


def test_tracker_numbers_on_and_knows_its_instance(spark, tmp_path):
    schema = "instance string, area string, path string"
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"

    def run():
        _run(tracker.numbered_changes(spark.readStream.schema(schema).json(str(source)), most=4), out, check)

    _write(spark, source, [("i", "source", "a"), ("i", "source", "b"), ("i", "output", "x"), ("j", "source", "q")], schema)
    run()
    _write(spark, source, [("i", "source", "c"), ("i", "source", "a"), ("i", "source", None), ("i", "source", "d")], schema)
    run()  # a restart
    run()  # nothing new
    rows = spark.read.parquet(str(out))
    assert sorted(r["generation"] for r in rows.filter("instance = 'i' AND area = 'source'").collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["path"] or "" for r in rows.filter("instance = 'i' AND area = 'source' AND generation > 2").collect()) == ["", "a", "c", "d"]
    last, recent = tracker.tracked(spark, str(check))
    assert values(last) == [("i", "output", 1), ("i", "source", 6), ("j", "source", 1)]
    assert sorted(r["generation"] for r in recent.filter("instance = 'i' AND area = 'source'").collect()) == [3, 4, 5, 6]
    lost = recent.filter("instance = 'i' AND area = 'source' AND path IS NULL").first()["generation"]

    def since(*position, area="source"):
        current, found = tracker.snapshot_since(spark, str(check), "i", area, position or None)
        return current, found if found is None else sorted(r["path"] for r in found.collect())

    assert since() == (6, None) and since("j", 6) == (6, None) and since("i", 7) == (6, None) and since("i", 1) == (6, None) and since("i", 6) == (6, [])
    after = {r["path"] for r in recent.filter(F.col("generation") > lost).collect() if r["path"]}
    assert since("i", lost) == (6, sorted(after)) and since("i", lost - 1) == (6, None) and since("i", 0, area="output") == (1, ["x"])


def test_log_stream_goes_on_with_its_cursors(spark, tmp_path):
    root, out, check = tmp_path / "logs", tmp_path / "out", tmp_path / "check"

    def put(source, name, text, at):
        (root / source).mkdir(parents=True, exist_ok=True)
        (root / source / name).write_text(text)
        os.utime(root / source / name, (at, at))

    def run(out, check):
        _run(tracker.log_stream(spark, str(root)), out, check)

    now = int(time.time()) - 100
    put("stdout", "1", "one\ntwo\r\n", now)
    put("stderr", "1", "bad\n\nworse", now)
    put("stdout", "0", "three\n", now + 1)
    run(out, check)
    put("stdout", "2", "four\nfive\n", now + 2)
    put("stderr", "2", "", now + 2)
    run(out, check)
    run(tmp_path / "whole", tmp_path / "check2")
    got = spark.read.parquet(str(out))
    assert values(got) == values(spark.read.parquet(str(tmp_path / "whole")))
    assert values(got, "cursor", "message") == [
        ("stderr:000000000000", "bad"), ("stderr:000000000001", ""), ("stderr:000000000002", "worse"), ("stdout:000000000000", "one"), ("stdout:000000000001", "two"),
        ("stdout:000000000002", "three"), ("stdout:000000000003", "four"), ("stdout:000000000004", "five"),
    ]
    late = logs.matching_logs(got, source="stdout", after="stdout:000000000002")
    assert [r["message"] for r in logs.first_events(late, ["cursor"], 1).collect()] == ["four"]
    filtered = logs.matching_logs(tracker.log_stream(spark, str(root)), levels=["error"], text="bad")
    _run(filtered, tmp_path / "errors", tmp_path / "check3")
    assert values(spark.read.parquet(str(tmp_path / "errors")), "message") == [("bad",)]
