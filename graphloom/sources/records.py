"""The library's record types over the input tables, and the same records in SQL.

Each projection is a few narrow columns of one table, so column pruning and filters reach
the scan. ``SQL`` holds a common table expression for each, for comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

#: Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone.
MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
NO_STRINGS = "cast(array() as array<string>)"


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch attempts from events: one batch a user."""
    k = F.get_json_object("props", "$.k").cast("long") % 3
    started = F.expr(MILLIS)
    duration = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("a"), _text("event_id")).alias("id"),
        F.concat(F.lit("b"), _text("user_id")).alias("batch_id"),
        F.concat(F.lit("customer/"), _text("user_id")).alias("target"),
        F.lit(1).cast("long").alias("attempt"),
        started.alias("started_at_unix_ms"),
        (started + duration).alias("finished_at_unix_ms"),
        duration.alias("duration_ms"),
        F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"),
        F.when(k == 0, "hit").when(k == 1, "miss").alias("cache"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records from events: a user's event type is the subject's capability."""
    k = F.get_json_object("props", "$.k").cast("long") % 3
    exit_code = F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), _text("event_id")).alias("id"),
        F.concat(F.lit("customer/"), _text("user_id")).alias("subject_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("subject_capability"),
        exit_code.alias("exit_code"),
        F.when(exit_code == 0, "passed").otherwise("failed").alias("status"),
        F.when(k == 0, "hit").when(k == 1, "miss").otherwise("bypass").alias("cache"),
        F.sha2(_text("event_id"), 256).alias("action_digest"),
        F.sha2(F.concat(F.lit("in"), (F.col("event_id") % 7).cast("string")), 256).alias("input_digest"),
        F.expr(MILLIS).alias("created_at_unix_ms"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of six packages; supplier targets also name a depot that doesn't exist."""
    none = F.expr(NO_STRINGS)

    def rows(name: str, key: str, kind: Column, deps: Column, providers: Column, capabilities: Column, attrs: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}/"), _text(key)).alias("id"),
            F.lit(name).alias("package"),
            _text(key).alias("name"),
            kind.alias("kind"),
            deps.alias("deps"),
            providers.alias("providers"),
            capabilities.alias("capabilities"),
            attrs.alias("attrs"),
        )

    def dep(package: str, key: str) -> Column:
        return F.concat(F.lit(f"{package}/"), _text(key))

    parent = F.concat(F.lit("part/"), F.floor(F.col("p_partkey") / 2).cast("string"))
    brand = F.to_json(F.struct(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("info")))
    parts = [
        rows("region", "r_regionkey", F.lit("region"), none, none, none, F.to_json(F.struct(F.col("r_name").alias("label")))),
        rows("nation", "n_nationkey", F.lit("nation"), F.array(dep("region", "n_regionkey")), none, none, F.to_json(F.struct(F.col("n_name").alias("label")))),
        rows("customer", "c_custkey", F.lower("c_mktsegment"), F.array(dep("nation", "c_nationkey")), none, none, F.lit("{}")),
        rows("supplier", "s_suppkey", F.lit("supplier"), F.array(dep("nation", "s_nationkey"), dep("depot", "s_suppkey")), none, none, F.lit("{}")),
        rows("orders", "o_orderkey", F.lit("order"), F.array(dep("customer", "o_custkey")), none, F.array("o_orderstatus"), F.lit("{}")),
        rows("part", "p_partkey", F.lit("part"), F.when(F.col("p_partkey") > 0, F.array(parent)).otherwise(none), F.array("p_brand"), none, brand),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def deep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): part k depends on part k div 2; a tree of logarithmic depth."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k > 0).select(k.alias("src"), F.floor(k / 2).cast("long").alias("dst"))


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): part k depends on part (7 k + 3) mod the number of parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    n = parts.count()
    return parts.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n).alias("dst"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(digest, size, modified), one row for each document."""
    return table(spark, sf_dir, "documents").select(
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified")
    )


def unique_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs of different content: the oldest of each digest."""
    return blobs(spark, sf_dir).groupBy("digest").agg(F.min("size").alias("size"), F.min("modified").alias("modified"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, size, modified, ref): an action each turn of a conversation, referring to two documents' blobs, from all over the table."""
    documents = table(spark, sf_dir, "documents")
    n = max(documents.count(), 1)
    first, second = F.col("conv_id") * 37 + F.col("turn") * 11, F.col("conv_id") * 53 + 7
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", _text("conv_id"), _text("turn")).alias("id"),
        F.length("text").cast("long").alias("size"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("modified"),
        F.explode(F.array(first % n, second % n)).alias("_doc"),
    )
    refs = documents.select(F.col("doc_id").alias("_doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("ref"))
    return turns.join(refs, "_doc").drop("_doc")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(generation, area, path): changes of one area, numbered without gaps; errors lost their path."""
    area = F.when(F.col("event_type").isin("click", "view"), "output").otherwise("source")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("generation"), area.alias("area"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("user/"), _text("user_id"))).alias("path"),
    )
    return rows


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, source, line_no, message): the lines of a conversation; users write to stdout."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"),
        F.when(F.col("role") == "user", "stdout").otherwise("stderr").alias("source"),
        F.col("turn").alias("order"),
        F.col("text").alias("message"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, batch, case_id, status): test cases from lineitem; later lines are later batches."""
    status = (
        F.when(F.col("l_quantity") % 8 == 0, "flaky").when(F.col("l_quantity") % 7 == 0, "skipped").when(F.col("l_quantity") % 11 == 0, "todo")
        .when(F.col("l_returnflag") == "R", "failed").otherwise("passed")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target"), F.col("l_linenumber").cast("long").alias("batch"), F.col("l_partkey").alias("case_id"),
        F.col("l_orderkey").alias("position"), status.alias("status"),
    )


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, batch, position, units): a batch for each line number of a supplier; some name no units."""
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    units = F.when((supplier + line) % 3 == 0, F.expr(NO_STRINGS)).otherwise(F.array(F.concat(F.lit("u"), supplier.cast("string")), F.concat(F.lit("u"), line.cast("string"))))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    return rows.select(supplier.alias("target"), F.concat_ws("/", supplier.cast("string"), line.cast("string")).alias("batch"), line.alias("position"), units.alias("units"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, success, status, runner) of the batches that ran; a null status means no results."""
    t, p = F.col("target"), F.col("position")
    status = F.when((t * 3 + p) % 7 == 0, F.lit(None)).when((t + p) % 9 == 0, "failed").otherwise("passed")
    rows = plan(spark, sf_dir).filter((t + p * 2) % 11 != 0)
    return rows.select("batch", ((t + p) % 5 != 0).alias("success"), status.alias("status"), F.when(p % 2 == 0, F.concat(F.lit("r"), p.cast("string"))).alias("runner"))


def batch_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, case_id, place, status): cases as batches report them; ids come back in several batches."""
    rows = cases(spark, sf_dir)
    return rows.select(
        F.concat_ws("/", F.col("target").cast("string"), F.col("batch").cast("string")).alias("batch"),
        F.concat(F.lit("u"), (F.col("case_id") % 200).cast("string")).alias("case_id"), F.col("position").alias("place"), "status",
    )


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, field, path): the logs and native results that batches left."""
    field = F.when(F.col("l_returnflag") == "A", "logs").when(F.col("l_returnflag") == "R", "native_results").otherwise("coverage")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", _text("l_suppkey"), _text("l_linenumber")).alias("batch"), field.alias("field"),
        F.concat(F.lit("f/"), (F.col("l_orderkey") % 5).cast("string")).alias("path"),
    )


SQL = {
    "attempts": """attempts AS (SELECT 'a' || event_id AS id, 'b' || user_id AS batch_id, 'customer/' || user_id AS target, 1::BIGINT AS attempt,
  (epoch_us(ts) // 1000) AS started_at_unix_ms, (epoch_us(ts) // 1000) + floor(value)::BIGINT AS finished_at_unix_ms, floor(value)::BIGINT AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status,
  CASE (json_extract_string(props, '$.k')::BIGINT) % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END AS cache FROM events)""",
    "evidence": """evidence AS (SELECT 'e' || event_id AS id, 'customer/' || user_id AS subject_id,
  CASE WHEN event_type <> 'view' THEN event_type END AS subject_capability, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS exit_code,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status,
  CASE (json_extract_string(props, '$.k')::BIGINT) % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE 'bypass' END AS cache,
  sha256(event_id::VARCHAR) AS action_digest, sha256('in' || (event_id % 7)) AS input_digest, (epoch_us(ts) // 1000) AS created_at_unix_ms FROM events)""",
    "targets": """targets AS (
  SELECT 'region/' || r_regionkey AS id, 'region' AS package, r_regionkey::VARCHAR AS name, 'region' AS kind, []::VARCHAR[] AS deps, []::VARCHAR[] AS providers,
    []::VARCHAR[] AS capabilities, '{"label":"' || r_name || '"}' AS attrs FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, 'nation', n_nationkey::VARCHAR, 'nation', ['region/' || n_regionkey], [], [], '{"label":"' || n_name || '"}' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'customer', c_custkey::VARCHAR, lower(c_mktsegment), ['nation/' || c_nationkey], [], [], '{}' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_suppkey::VARCHAR, 'supplier', ['nation/' || s_nationkey, 'depot/' || s_suppkey], [], [], '{}' FROM supplier
  UNION ALL SELECT 'orders/' || o_orderkey, 'orders', o_orderkey::VARCHAR, 'order', ['customer/' || o_custkey], [], [o_orderstatus], '{}' FROM orders
  UNION ALL SELECT 'part/' || p_partkey, 'part', p_partkey::VARCHAR, 'part', CASE WHEN p_partkey > 0 THEN ['part/' || (p_partkey // 2)] ELSE [] END, [p_brand], [],
    '{"info":{"brand":"' || p_brand || '","size":' || p_size || '}}' FROM part)""",
    "edges": """edges AS (SELECT t.id AS src, d.id AS dst FROM (SELECT id, unnest(deps) AS dep FROM targets) t JOIN targets d ON d.id = t.dep)""",
    "deep": "deep AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0)",
    "cyclic": "cyclic AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part)",
    "blobs": "blobs AS (SELECT sha256(coalesce(text, '')) AS digest, n_chars AS size, doc_id AS modified FROM documents)",
    "unique_blobs": "unique_blobs AS (SELECT digest, min(size) AS size, min(modified) AS modified FROM blobs GROUP BY digest)",
    "actions": """actions AS (SELECT t.id, t.size, t.modified, sha256(coalesce(d.text, '')) AS ref FROM (
    SELECT conv_id || '/' || turn AS id, length(text)::BIGINT AS size, conv_id * 100 + turn AS modified,
      unnest([(conv_id * 37 + turn * 11) % (SELECT count(*) FROM documents), (conv_id * 53 + 7) % (SELECT count(*) FROM documents)]) AS doc FROM conversations) t JOIN documents d ON d.doc_id = t.doc)""",
    "journal": """journal AS (SELECT event_id AS generation, CASE WHEN event_type IN ('click', 'view') THEN 'output' ELSE 'source' END AS area,
    CASE WHEN event_type <> 'error' THEN 'user/' || user_id END AS path FROM events)""",
    "log_lines": """log_lines AS (SELECT conv_id AS session, CASE WHEN role = 'user' THEN 'stdout' ELSE 'stderr' END AS source, turn AS "order", text AS message FROM conversations)""",
    "cases": """cases AS (SELECT l_suppkey AS target, l_linenumber::BIGINT AS batch, l_partkey AS case_id, l_orderkey AS position,
    CASE WHEN l_quantity % 8 = 0 THEN 'flaky' WHEN l_quantity % 7 = 0 THEN 'skipped' WHEN l_quantity % 11 = 0 THEN 'todo'
      WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS status FROM lineitem)""",
    "plan": """plan AS (SELECT DISTINCT l_suppkey AS target, l_suppkey || '/' || l_linenumber AS batch, l_linenumber::BIGINT AS position,
    CASE WHEN (l_suppkey + l_linenumber) % 3 = 0 THEN []::VARCHAR[] ELSE ['u' || l_suppkey, 'u' || l_linenumber] END AS units FROM lineitem)""",
    "runs": """runs AS (SELECT batch, (target + position) % 5 <> 0 AS success, CASE WHEN (target * 3 + position) % 7 = 0 THEN NULL WHEN (target + position) % 9 = 0 THEN 'failed' ELSE 'passed' END AS status,
    CASE WHEN position % 2 = 0 THEN 'r' || position END AS runner FROM plan WHERE (target + 2 * position) % 11 <> 0),
  batches AS (SELECT p.*, coalesce(r.success, false) AS success, r.status, r.runner FROM plan p LEFT JOIN runs r USING (batch))""",
    "merged": """batch_cases AS (SELECT target || '/' || batch AS batch, 'u' || case_id % 200 AS case_id, position AS place, status FROM cases),
  every AS (SELECT b.target, c.case_id, 1 AS real, b.position, c.place, c.status FROM batches b JOIN batch_cases c USING (batch) WHERE b.status IS NOT NULL
    UNION ALL SELECT target, unnest(CASE WHEN len(units) > 0 THEN units ELSE [target || '::batch:' || batch] END), 0, -position, 0, CASE WHEN success THEN 'passed' ELSE 'failed' END FROM batches WHERE status IS NULL),
  merged AS (SELECT target, case_id, status FROM (SELECT *, row_number() OVER (PARTITION BY target, case_id ORDER BY real DESC, position DESC, place DESC) AS n FROM every) WHERE n = 1)""",
    "files": """batch_files AS (SELECT l_suppkey || '/' || l_linenumber AS batch, CASE l_returnflag WHEN 'A' THEN 'logs' WHEN 'R' THEN 'native_results' ELSE 'coverage' END AS field, 'f/' || l_orderkey % 5 AS path FROM lineitem),
  artifacts AS (SELECT DISTINCT b.target, f.field, f.path FROM batches b JOIN batch_files f USING (batch) WHERE b.status IS NOT NULL)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of the named records."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
