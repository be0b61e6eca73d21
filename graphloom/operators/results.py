"""Test results and lint findings: merging, counting, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import file_uri_path, safe_path
from graphloom.functions.scalars import severity_of_level, severity_rank

SKIPPED = ("skipped", "pending", "todo", "disabled")

#: Fixed shape of a SARIF report, as far as findings need it.
SARIF = """runs array<struct<
  tool struct<driver struct<name string, rules array<struct<id string, helpUri string>>>>,
  results array<struct<ruleId string, level string, message struct<text string>, locations array<struct<
    physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine bigint, startColumn bigint>>>>>>>>"""


def counters(cases: DataFrame, key: str) -> DataFrame:
    """Counts by key: a flaky case counts as passed and as flaky; an unknown status as failed."""
    skipped, passed = F.col("status").isin(*SKIPPED), F.col("status").isin("passed", "flaky")
    return cases.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"),
        F.count_if(F.coalesce(~passed & ~skipped, F.lit(True))).alias("failed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(F.col("status") == "flaky").alias("flaky"),
    )


def merge_cases(cases: DataFrame) -> DataFrame:
    """The last batch's row of each (target, case_id); within a batch the last position."""
    w = Window.partitionBy("target", "case_id").orderBy(F.col("batch").desc(), F.col("position").desc(), F.col("status").desc())
    return cases.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_missing(cases: DataFrame, planned: DataFrame) -> DataFrame:
    """``cases`` plus a ``missing`` case for each planned (target, case_id) that has none."""
    absent = missing_units(planned, cases)
    return cases.select("target", "case_id", "status").unionAll(absent.withColumn("status", F.lit("missing")))


def batch_runs(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """(target, batch, position, units, success, status, runner): every batch of a plan with its run.

    ``plan``: target, batch, position, units (array). ``runs``: batch, success, status, runner;
    the status is null where a run left no results. A batch without a run did not succeed.
    """
    ran = runs.select("batch", "success", "status", "runner")
    joined = plan.select("target", "batch", "position", "units").join(ran, "batch", "left")
    return joined.withColumn("success", F.coalesce("success", F.lit(False)))


def synthetic_cases(batches: DataFrame) -> DataFrame:
    """(target, case_id, position, status): a case for each unit of a batch without results, with the verdict of its run.

    A batch without units has one case for itself.
    """
    own = F.concat("target", F.lit("::batch:"), "batch")
    units = F.when(F.size("units") > 0, F.col("units")).otherwise(F.array(own))
    verdict = F.when(F.col("success"), "passed").otherwise("failed")
    return batches.filter("status IS NULL").select("target", F.explode(units).alias("case_id"), "position", verdict.alias("status"))


def merged_cases(batches: DataFrame, cases: DataFrame) -> DataFrame:
    """(target, case_id, status): one case for each id of a target over its batches of ``batch_runs``.

    The last reported case of an id wins, by its batch's position and its own (``cases``:
    batch, case_id, place, status). Of an id that no batch reports, the first synthetic one stays.
    """
    with_results = batches.filter("status IS NOT NULL").select("target", "batch", "position")
    real = with_results.join(cases.select("batch", "case_id", "place", F.col("status").alias("_s")), "batch")
    real = real.select("target", "case_id", F.lit(True).alias("real"), "position", F.col("place").cast("long").alias("place"), F.col("_s").alias("status"))
    made = synthetic_cases(batches).select("target", "case_id", F.lit(False).alias("real"), -F.col("position"), F.lit(0).cast("long"), "status")
    order = F.struct("real", "position", "place")
    return real.unionAll(made).groupBy("target", "case_id").agg(F.max_by("status", order).alias("status"))


def all_passed(batches: DataFrame) -> DataFrame:
    """(target, all_passed): true if every batch of ``batch_runs`` ran with success and no results say otherwise."""
    good = F.col("success") & F.coalesce(F.col("status") == "passed", F.lit(True))
    return batches.groupBy("target").agg(F.bool_and(good).alias("all_passed"))


def merged_results(batches: DataFrame, cases: DataFrame) -> DataFrame:
    """(target, runner, status, total, passed, failed, skipped, flaky): the results of each target over its batches.

    The runner is that of the first batch that names one, else ``unknown``.
    """
    counts = counters(merged_cases(batches, cases), "target")
    first = F.min_by("runner", F.when(F.col("runner").isNotNull() & F.col("status").isNotNull(), F.col("position")))
    runner = batches.groupBy("target").agg(F.coalesce(first, F.lit("unknown")).alias("runner"))
    out = all_passed(batches).join(runner, "target").join(counts, "target", "left")
    each = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "passed", "failed", "skipped", "flaky")]
    status = F.when(F.col("all_passed") & (F.coalesce("failed", F.lit(0)) == 0), "passed").otherwise("failed")
    return out.select("target", "runner", status.alias("status"), *each)


def artifacts(batches: DataFrame, files: DataFrame) -> DataFrame:
    """(target, field, path): the files (batch, field, path) of a target's batches with results, each once."""
    with_results = batches.filter("status IS NOT NULL").select("target", "batch")
    return with_results.join(files, "batch").select("target", "field", "path").distinct()


def results_document(merged: DataFrame, cases: DataFrame, files: DataFrame, schema: str) -> DataFrame:
    """(target, document): the merged results of each target as one JSON text.

    A document lists its target's cases and files, in order of their ids and paths.
    """
    case = F.struct(F.col("case_id").cast("string").alias("id"), F.col("case_id").cast("string").alias("name"), F.col("target").alias("suite"), "status",
                    F.array(F.struct("status")).alias("attempts"), F.lit("{}").alias("runner_metadata"))
    listed = cases.groupBy("target").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    of = lambda field: F.sort_array(F.collect_set(F.when(F.col("field") == field, F.col("path")))).alias(field)
    kept = files.groupBy("target").agg(of("logs"), of("native_results"), of("coverage"))
    both = merged.join(listed, "target", "left").join(kept, "target", "left")
    none = F.array().cast("array<string>")
    document = F.struct(
        F.lit(schema).alias("schema"), "target", F.struct(F.col("runner").alias("type"), F.lit("{}").alias("metadata")).alias("runner"), "status",
        F.struct("total", "passed", "failed", "skipped", "flaky").alias("summary"), F.coalesce("cases", F.array().cast(listed.schema["cases"].dataType)).alias("cases"),
        F.struct(F.coalesce("logs", none).alias("logs"), F.coalesce("native_results", none).alias("native_results"), F.when(F.size("coverage") > 0, F.col("coverage")).alias("coverage")).alias("artifacts"),
    )
    # Empty objects are written as texts above: a struct can't be empty.
    return both.select("target", F.replace(F.to_json(document), F.lit('"{}"'), F.lit("{}")).alias("document"))


def document_summary(documents: DataFrame, json_col: str = "document") -> DataFrame:
    """(source_schema, target, runner, status, summary, artifacts): a document without its cases, fields as JSON or text.

    A field that a document lacks is null.
    """
    get = lambda name: F.get_json_object(json_col, f"$.{name}")
    return documents.select(get("schema").alias("source_schema"), *[get(n).alias(n) for n in ("target", "runner", "status", "summary", "artifacts")])


#: Fixed shape of a document's cases, as far as units need it.
CASES = "array<struct<id string, name string, suite string, file string>>"


def units_of(documents: DataFrame, json_col: str = "document") -> DataFrame:
    """(target, unit, name, suite, file): a unit for each case of each document; names default to ids, suites to targets."""
    case = F.from_json(F.get_json_object(json_col, "$.cases"), CASES)
    rows = documents.select("target", F.explode(case).alias("c"))
    return rows.select("target", F.col("c.id").alias("unit"), F.coalesce("c.name", "c.id").alias("name"), F.coalesce("c.suite", F.col("target").cast("string")).alias("suite"), F.col("c.file").alias("file"))


def test_manifest(targets: DataFrame, stored_units: DataFrame, documents: DataFrame) -> DataFrame:
    """(target, source, unit, name, suite, file): the units of every test target, a row each.

    A stored manifest (rows of ``stored_units``) decides; else the cases of its results; a
    target with neither has one row without a unit, to be run whole.
    """
    ids = targets.select(F.col("id").alias("target")).distinct()
    kept = stored_units.select("target", F.lit("stored").alias("source"), "unit", "name", "suite", "file").join(ids, "target", "left_semi")
    rest = ids.join(kept.select("target"), "target", "left_anti")
    derived = units_of(documents).join(rest, "target", "left_semi").select("target", F.lit("normalized_results").alias("source"), "unit", "name", "suite", "file")
    bare = rest.join(documents.select("target"), "target", "left_anti")
    none = [F.lit(None).cast("string").alias(c) for c in ("unit", "name", "suite", "file")]
    return kept.unionAll(derived).unionAll(bare.select("target", F.lit("whole_target_fallback").alias("source"), *none))


def test_records(targets: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, kind, deps, runner, labels, results_path) of the targets with the test capability.

    ``metadata``: id and info, a JSON text with runner, labels and outputs. Where it says
    nothing of them, labels are empty and results lie at the target's usual path.
    """
    tests = targets.filter(F.exists("capabilities", lambda c: c == "test")).select("id", "kind", "deps")
    both = tests.join(metadata.select("id", "info"), "id", "left")
    labels = F.coalesce(F.from_json(F.get_json_object("info", "$.labels"), "array<string>"), F.array().cast("array<string>"))
    usual = F.concat(F.lit(".cache/out/"), safe_path(F.col("id")), F.lit("/test/test_results.json"))
    return both.select(
        "id", "kind", "deps", F.get_json_object("info", "$.runner.type").alias("runner"), labels.alias("labels"),
        F.coalesce(F.get_json_object("info", "$.outputs.results"), usual).alias("results_path"),
    )


def contract_violations(documents: DataFrame, schema: str, json_col: str = "document") -> DataFrame:
    """(target, message): what a results document lacks of its contract.

    Schema and target must be as expected, text and number fields there and of their type,
    lists lists, and each case must have an id, name, suite, status and at least one attempt
    with a status. A text that is no JSON object has one message.
    """
    root = F.try_parse_json(json_col)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(root, path, "variant")), F.lit("VOID"))
    text = lambda path: F.try_variant_get(root, path, "string")
    is_object = kind("$").startswith("OBJECT")
    checks = [
        ("schema", (kind("$.schema") == "STRING") & (text("$.schema") == schema)),
        ("target", (kind("$.target") == "STRING") & (text("$.target") == F.col("target").cast("string"))),
        ("status", kind("$.status") == "STRING"),
        ("runner.type", kind("$.runner.type") == "STRING"),
        ("runner.metadata", kind("$.runner.metadata").startswith("OBJECT")),
    ]
    whole = lambda path: (kind(path) == "BIGINT") & (F.try_variant_get(root, path, "long") >= 0)
    checks += [(f"summary.{n}", whole(f"$.summary.{n}")) for n in ("total", "passed", "failed", "skipped", "flaky")]
    checks += [(f"artifacts.{n}", kind(f"$.artifacts.{n}").isin("ARRAY<STRING>", "ARRAY<VOID>")) for n in ("logs", "native_results")]
    checks += [("artifacts.coverage", kind("$.artifacts.coverage").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"))]
    checks += [("cases", kind("$.cases").startswith("ARRAY"))]
    of = "array<struct<id string, name string, suite string, status string, file string, attempts array<struct<status string>>, runner_metadata map<string,string>>>"
    cases = F.from_json(F.get_json_object(json_col, "$.cases"), of)
    bad_case = F.exists(
        cases,
        lambda c: c.isNull() | c["id"].isNull() | c["name"].isNull() | c["suite"].isNull() | c["status"].isNull() | c["runner_metadata"].isNull()
        | (F.coalesce(F.size(c["attempts"]), F.lit(0)) <= 0) | F.exists(c["attempts"], lambda a: a["status"].isNull()),
    )
    checks += [("case", ~kind("$.cases").startswith("ARRAY") | ~F.coalesce(bad_case, F.lit(False)))]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in checks]))
    messages = F.when(F.coalesce(is_object, F.lit(False)), failed).otherwise(F.array(F.lit("not an object")))
    return documents.select("target", F.explode(messages).alias("message"))


def missing_units(requested: DataFrame, cases: DataFrame) -> DataFrame:
    """Requested (target, case_id) that no case answers."""
    return requested.select("target", "case_id").distinct().join(cases.select("target", "case_id"), ["target", "case_id"], "left_anti")


def sarif_findings(reports: DataFrame, json_col: str = "report") -> DataFrame:
    """(tool, rule_id, severity, message, path, line, column, help_uri) of every result of SARIF reports."""
    runs = reports.select(F.explode(F.from_json(json_col, SARIF)["runs"]).alias("run"))
    each = runs.select(F.col("run.tool.driver").alias("d"), F.explode("run.results").alias("r"))
    help_uri = F.filter(F.coalesce("d.rules", F.array()), lambda x: x["id"] == F.col("r.ruleId"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return each.select(
        F.col("d.name").alias("tool"),
        F.col("r.ruleId").alias("rule_id"),
        severity_of_level(F.col("r.level")).alias("severity"),
        F.col("r.message.text").alias("message"),
        file_uri_path(place["artifactLocation"]["uri"]).alias("path"),
        place["region"]["startLine"].alias("line"),
        place["region"]["startColumn"].alias("column"),
        F.get(help_uri, F.lit(0))["helpUri"].alias("help_uri"),
    )


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Findings in order of path, line, rule and message, missing ones first."""
    return findings.orderBy(*[F.col(c).asc_nulls_first() for c in ("path", "line", "rule_id", "message")])


def lint_summary(findings: DataFrame) -> DataFrame:
    """One row: findings in all and by severity; those of severity none count in all only."""
    each = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("note", "warning", "error")]
    return findings.agg(F.count(F.lit(1)).alias("total"), *each)


def fails_at(findings: DataFrame, key: str, threshold: str) -> DataFrame:
    """(key, fails): true if a finding is of the threshold's severity or worse."""
    least = severity_rank(F.lit(threshold))
    return findings.groupBy(key).agg(F.coalesce(F.max(severity_rank(F.col("severity"))) >= least, F.lit(False)).alias("fails"))
