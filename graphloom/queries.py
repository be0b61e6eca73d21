"""Named queries over the input tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import scalars as S
from graphloom.operators import contract, digests, edits, graph, history, journal, logs, providers, receipts, resolvers, results, scripts, search, selection, selects, store, validate
from graphloom.plans import fixpoint, pattern
from graphloom.plans.pattern import Condition
from graphloom.sources import files
from graphloom.sources import records as R
from graphloom.sources.records import with_
from graphloom.sources import store as store_files
from graphloom.sources.tables import new_folder, stored, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



# History


@query(
    with_("attempts")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY started_at_unix_ms DESC, id DESC) AS n FROM attempts
  WHERE status = 'passed' AND (cache IS NULL OR cache <> 'hit'))
SELECT batch_id, floor(median(greatest(duration_ms, 0)))::BIGINT AS estimate_ms FROM r WHERE n <= 20 GROUP BY batch_id"""
)
def duration_estimates(spark, sf):
    return history.duration_estimates(R.attempts(spark, sf))


@query(with_("attempts") + " SELECT id, batch_id, status, started_at_unix_ms FROM attempts ORDER BY started_at_unix_ms DESC, id DESC LIMIT 25")
def newest_attempts(spark, sf):
    return history.newest(R.attempts(spark, sf), "started_at_unix_ms", 25).select("id", "batch_id", "status", "started_at_unix_ms")


@query(with_("evidence") + """ SELECT id, concat_ws(':', subject_id, subject_capability) AS subject, status FROM evidence
  WHERE subject_id = 'customer/7' OR coalesce(subject_id || ':' || subject_capability = 'customer/7', false)""")
def evidence_by_subject(spark, sf):
    rows = R.evidence(spark, sf).filter(history.subject_matches("customer/7"))
    return rows.select("id", history.subject_display().alias("subject"), "status")


@query(with_("evidence") + """ SELECT id, status FROM evidence WHERE subject_id || ':' || subject_capability = 'customer/3:click'
  ORDER BY created_at_unix_ms DESC, id DESC LIMIT 10""")
def evidence_by_capability(spark, sf):
    rows = R.evidence(spark, sf).filter(history.subject_matches("customer/3:click"))
    return history.newest(rows, "created_at_unix_ms", 10).select("id", "status")


@query(with_("attempts") + " SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status <> 'passed') AS failed FROM attempts")
def run_counts(spark, sf):
    return history.run_counts(R.attempts(spark, sf))


@query(
    with_("attempts")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY started_at_unix_ms DESC, id DESC) AS n FROM attempts
  WHERE status = 'passed' AND (cache IS NULL OR cache <> 'hit')),
e AS (SELECT batch_id, floor(median(greatest(duration_ms, 0)))::BIGINT AS estimate_ms FROM r WHERE n <= 20 GROUP BY batch_id),
b AS (SELECT DISTINCT batch_id FROM attempts)
SELECT batch_id, coalesce(estimate_ms, 0) AS estimate_ms, row_number() OVER (ORDER BY coalesce(estimate_ms, 0) DESC, batch_id) AS pos FROM b LEFT JOIN e USING (batch_id)"""
)
def longest_first(spark, sf):
    attempts = R.attempts(spark, sf)
    return history.longest_first(attempts, history.duration_estimates(attempts))


@query(
    with_("evidence")
    + """, w AS (SELECT subject_id, cache, lag(cache) OVER w AS b, row_number() OVER w AS i FROM evidence
  WINDOW w AS (PARTITION BY subject_id ORDER BY created_at_unix_ms, id))
SELECT subject_id, count(*) FILTER (i > 1 AND cache IS DISTINCT FROM b) AS n_changes FROM w GROUP BY subject_id"""
)
def adjacent_changes(spark, sf):
    return history.adjacent_changes(R.evidence(spark, sf), "subject_id", ["created_at_unix_ms", "id"], "cache")


@query(with_("attempts") + " SELECT id FROM attempts WHERE id = '' OR attempt < 1 OR finished_at_unix_ms < started_at_unix_ms")
def invalid_attempts(spark, sf):
    return history.invalid_attempts(R.attempts(spark, sf))


@query("""SELECT CASE WHEN event_id % 11 = 0 THEN '' ELSE 'a' || event_id END AS id, event_id AS event FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR (event_id % 17 = 0 AND floor(value) > 0)""")
def invalid_attempts_of_each_kind(spark, sf):
    """Attempts without an id, without a number, or that end before they start."""
    k = F.substring("id", 2, 20).cast("long")
    rows = R.attempts(spark, sf).withColumn("_e", k)
    broken = rows.select(
        "_e", F.when(k % 11 == 0, "").otherwise(F.col("id")).alias("id"), F.when(k % 13 == 0, 0).otherwise(F.col("attempt")).alias("attempt"), "started_at_unix_ms",
        F.when(k % 17 == 0, F.col("started_at_unix_ms") - F.col("duration_ms")).otherwise(F.col("finished_at_unix_ms")).alias("finished_at_unix_ms"),
    )
    return broken.filter(history.is_invalid_attempt()).select("id", F.col("_e").alias("event"))


# Graph and patterns


@query(
    with_("targets")
    + """ SELECT id, 'Target' AS label, name FROM targets
UNION ALL SELECT id || '#capability#' || c, 'Capability', c FROM (SELECT id, unnest(capabilities) AS c FROM targets)
UNION ALL SELECT id || '#provider#' || p, 'Provider', p FROM (SELECT id, unnest(providers) AS p FROM targets)"""
)
def graph_nodes(spark, sf):
    return graph.nodes(R.targets(spark, sf)).select("id", "label", "name")


@query(
    with_("targets", "edges")
    + """ SELECT src, dst, 'DEPENDS_ON' AS type FROM edges
UNION ALL SELECT id, id || '#capability#' || c, 'EXPOSES' FROM (SELECT id, unnest(capabilities) AS c FROM targets)
UNION ALL SELECT id, id || '#provider#' || p, 'EMITS' FROM (SELECT id, unnest(providers) AS p FROM targets)"""
)
def graph_edges(spark, sf):
    return graph.edges(R.targets(spark, sf))


@query("SELECT 'orders/' || o_orderkey AS src, 'supplier/' || s_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F'")
def one_hop(spark, sf):
    """Duplicate edges stay: the pattern's matches are a bag."""
    name = lambda t, c: F.concat(F.lit(f"{t}/"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")

    def nodes_of(t: str, key: str, label: str, props) -> DataFrame:
        return table(spark, sf, t).select(name(t, key).alias("id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("name"), F.lit(t).alias("kind"), none.alias("package"), props.alias("props"))

    orders = nodes_of("orders", "o_orderkey", "Order", F.to_json(F.struct(F.col("o_orderstatus").alias("status"))))
    nodes = orders.unionAll(nodes_of("supplier", "s_suppkey", "Supplier", F.lit("{}")))
    edges = table(spark, sf, "lineitem").select(name("orders", "l_orderkey").alias("src"), name("supplier", "l_suppkey").alias("dst"), F.lit("FROM").alias("type"))
    left, right = pattern.node(nodes, "o", "Order", status="F"), pattern.node(nodes, "s", "Supplier")
    return pattern.related(nodes, edges, left, "FROM", right).returns(src="o.id", dst="s.id")


def _graph(spark, sf):
    targets = R.targets(spark, sf)
    return graph.nodes(targets), graph.edges(targets)


@query(with_("targets", "edges") + " SELECT dst AS nation, src AS dependent FROM edges WHERE dst LIKE 'nation/%'")
def one_hop_reverse(spark, sf):
    nodes, edges = _graph(spark, sf)
    left, right = pattern.node(nodes, "n", "target", kind="nation"), pattern.node(nodes, "d", "Target")
    return pattern.related(nodes, edges, left, "DEPENDS_ON", right, reverse=True).returns(nation="n.id", dependent="d.id")


@query(with_("targets") + " SELECT id, package, name, kind, len(deps)::BIGINT AS n_deps, array_to_string(capabilities, ',') AS capabilities FROM targets WHERE kind = 'order'")
def targets_by_kind(spark, sf):
    return graph.of_kind(R.targets(spark, sf), "order")


@query(with_("targets") + " SELECT id FROM targets WHERE list_contains(capabilities, 'F')")
def capability_match(spark, sf):
    return graph.with_capability(R.targets(spark, sf), "F")


@query(with_("targets") + " SELECT count(*) AS n_targets, count(DISTINCT package) AS n_packages, count(*) = 0 AS is_empty FROM targets")
def workspace_summary(spark, sf):
    return graph.workspace_summary(R.targets(spark, sf))


@query(with_("targets") + " SELECT DISTINCT package FROM targets")
def workspace_packages(spark, sf):
    return graph.packages(R.targets(spark, sf))


@query(with_("targets") + " SELECT unnest(capabilities) AS capability FROM targets WHERE id = 'orders/3'")
def capabilities_of_target(spark, sf):
    return graph.capabilities_of(R.targets(spark, sf), "orders/3")


@query(with_("targets") + " SELECT id, kind, attrs FROM targets WHERE id = 'part/17'")
def target_lookup(spark, sf):
    return graph.lookup(R.targets(spark, sf), "part/17").select("id", "kind", "attrs")


@query(with_("targets") + " SELECT id, name FROM targets WHERE kind = 'part' AND name = '17'")
def pattern_node(spark, sf):
    nodes, _ = _graph(spark, sf)
    return pattern.node(nodes, "t", "TARGET", kind="part", name="17").returns(id="t.id", name="t.name")


@query(
    with_("targets")
    + """ SELECT id, json_extract_string(attrs, '$.info.size') AS size FROM targets
WHERE (json_extract_string(attrs, '$.info.brand') IN ('Brand#1', 'Brand#11', 'Brand#23') AND id LIKE '%1%') OR (kind = 'supplier' AND name LIKE '1%')"""
)
def pattern_in_contains(spark, sf):
    nodes, _ = _graph(spark, sf)
    some = [Condition("t", "attrs.info.brand", "in", ["Brand#1", "Brand#11", "Brand#23"]), Condition("t", "id", "contains", "1")]
    others = [Condition("t", "kind", "=", "supplier"), Condition("t", "name", "starts", "1")]
    return pattern.node(nodes, "t", "Target").where(some, others).returns(id="t.id", size="t.attrs.info.size")


@query(with_("targets") + " SELECT id FROM targets WHERE NOT coalesce(json_extract_string(attrs, '$.info.size') = '5', false)")
def pattern_not_equal_missing(spark, sf):
    """A missing property differs from everything."""
    nodes, _ = _graph(spark, sf)
    return pattern.node(nodes, "t", "Target").where([Condition("t", "attrs.info.size", "<>", 5)]).returns(id="t.id")


@query(with_("targets") + " SELECT id, NULL::VARCHAR AS other FROM targets WHERE id LIKE 'customer/%' AND id LIKE '%7' ")
def pattern_prefix_suffix(spark, sf):
    nodes, _ = _graph(spark, sf)
    both = [Condition("t", "id", "starts", "customer/"), Condition("t", "id", "ends", "7")]
    return pattern.node(nodes, "t", "Target").where(both, [Condition("x", "id", "<>", "y")]).returns(id="t.id", other="x.id")


@query(with_("targets") + """ SELECT '{"attrs":' || attrs || ',"capabilities":[],"dependency_edges":{},"deps":["' || deps[1] || '"],"id":"' || id || '","kind":"nation","name":"' || name
  || '","package":"nation","providers":[],"srcs":[],"visibility":[]}' AS node FROM targets WHERE kind = 'nation'""")
def pattern_whole_node(spark, sf):
    nodes, _ = _graph(spark, sf)
    return pattern.node(nodes, "t", "Target", kind="nation").returns(node="t")


@query(
    with_("targets", "edges", recursive=True)
    + """, c AS (SELECT id AS start, id AS node FROM targets WHERE id IN ('part/1000', 'part/77', 'orders/3')
  UNION SELECT c.start, e.dst FROM c JOIN edges e ON e.src = c.node)
SELECT start AS src, node AS dst FROM c WHERE start <> node"""
)
def pattern_transitive(spark, sf):
    nodes, edges = _graph(spark, sf)
    left = pattern.node(nodes, "a", "Target").where([Condition("a", "id", "in", ["part/1000", "part/77", "orders/3"])])
    got = pattern.related(nodes, edges, left, "DEPENDS_ON", pattern.node(nodes, "b", "Target"), any_depth=True)
    return got.returns(src="a.id", dst="b.id")


@query(with_("targets") + " SELECT id, '[\"' || capabilities[1] || '\"]' AS capabilities, '[\"' || deps[1] || '\"]' AS deps FROM targets WHERE list_contains(capabilities, 'F')")
def pattern_capabilities(spark, sf):
    """Lists of a target are properties: ``capabilities CONTAINS 'F'``."""
    nodes, _ = _graph(spark, sf)
    return pattern.node(nodes, "t", "Target").where([Condition("t", "capabilities", "contains", "F")]).returns(id="t.id", capabilities="t.capabilities", deps="t.deps")


@query("""SELECT 'part/' || p_partkey AS id, p_size::VARCHAR AS size, p_size >= 25 AS is_large, p_size IN (7, 9) AS is_in, p_partkey % 3 = 0 AS has_tags, p_partkey % 3 <> 0 AS other_tags, p_size = 8 AS is_eight, true AS no_text
FROM part""")
def pattern_typed_literals(spark, sf):
    """Booleans, numbers and lists are compared by kind and value: every condition splits the parts into those it holds for and the others."""
    rows = table(spark, sf, "part")
    tags = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    attrs = F.to_json(F.struct((F.col("p_size") >= 25).alias("large"), F.col("p_size").alias("size"), tags.alias("tags")))
    targets = R.targets(spark, sf).filter("kind = 'part'").drop("attrs").join(rows.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), attrs.alias("attrs")), "id")
    bound = pattern.node(graph.nodes(targets), "t", "Target", kind="part")
    holds = {
        "is_large": Condition("t", "attrs.large", "=", True), "is_in": Condition("t", "attrs.size", "in", [7, 9, "8", 10.0]), "has_tags": Condition("t", "attrs.tags", "=", ["a", "b"]),
        "other_tags": Condition("t", "attrs.tags", "<>", ["a", "b"]), "is_eight": Condition("t", "attrs.size", "=", 8), "no_text": Condition("t", "attrs.size", "<>", "8"),
    }
    marked = bound.rows.select("t", *[c.column({"t"}).alias(n) for n, c in holds.items()])
    return marked.select(F.col("t.id").alias("id"), F.get_json_object("t.props", "$.attrs.size").alias("size"), *holds)


_ROLES = """roles AS (SELECT 'orders/' || o_orderkey AS src, unnest(['part/' || o_orderkey % 50, 'gone/1']) AS dst FROM orders)"""


def _with_data_role(spark, sf) -> DataFrame:
    """Targets whose orders also depend, as data, on a part and on something that doesn't exist."""
    part = F.concat(F.lit("part/"), (F.col("name").cast("long") % 50).cast("string"))
    role = F.create_map(F.lit("data"), F.array(part, F.lit("gone/1")))
    return R.targets(spark, sf).withColumn("dependencies", F.when(F.col("kind") == "order", role).otherwise(F.from_json(F.lit("{}"), "map<string,array<string>>")))


@query(with_("targets", "edges") + f", {_ROLES} SELECT src, dst, 'DEPENDS_ON' AS type FROM edges UNION ALL SELECT r.src, r.dst, 'DEPENDS_ON' FROM roles r JOIN targets t ON t.id = r.dst")
def role_edges(spark, sf):
    """Dependencies by role are edges, too, where the target exists."""
    return graph.depends_on(_with_data_role(spark, sf))


@query(with_("targets") + f", {_ROLES} SELECT r.dst AS part, r.src AS dependent FROM roles r JOIN targets t ON t.id = r.dst WHERE r.dst = 'part/7'")
def pattern_role_dependents(spark, sf):
    """What depends on a part by a role."""
    targets = _with_data_role(spark, sf)
    nodes, edges = graph.nodes(targets), graph.edges(targets)
    left, right = pattern.node(nodes, "p", "Target", id="part/7"), pattern.node(nodes, "d", "Target", kind="order")
    return pattern.related(nodes, edges, left, "DEPENDS_ON", right, reverse=True).returns(part="p.id", dependent="d.id")


@query(
    with_("cyclic", recursive=True)
    + """, c AS (SELECT src AS start, dst AS node FROM cyclic UNION SELECT c.start, d.dst FROM c JOIN cyclic d ON d.src = c.node),
least AS (SELECT start FROM c GROUP BY start HAVING bool_or(node = start) AND min(node) = start),
walk AS (SELECT start, start AS node, start::VARCHAR AS path FROM least
  UNION ALL SELECT w.start, d.dst, w.path || ' -> ' || d.dst FROM walk w JOIN cyclic d ON d.src = w.node WHERE d.dst <> w.start)
SELECT 'dependency_cycle' AS code, w.start AS target, 'dependency cycle: ' || w.path || ' -> ' || w.start AS message FROM walk w JOIN cyclic d ON d.src = w.node AND d.dst = w.start"""
)
def v_cycle_path(spark, sf):
    """One real cycle for each group of parts that reach each other, from its least part."""
    return validate.dependency_cycle_paths(R.cyclic_edges(spark, sf)).select("code", "target", "message")


# Closures and paths

@query(
    with_("deep", recursive=True)
    + """, c AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT c.start, d.dst FROM c JOIN deep d ON d.src = c.node)
SELECT start, node FROM c WHERE start <> node"""
)
def closure_deep(spark, sf):
    seeds = table(spark, sf, "part").select(F.col("p_partkey").alias("start"))
    return fixpoint.closure(R.deep_edges(spark, sf), seeds).select("start", "node")


@query(
    with_("cyclic", recursive=True)
    + """, c AS (SELECT p_partkey AS start, p_partkey AS node FROM part WHERE p_partkey IN (1, 2, 5) UNION SELECT c.start, d.dst FROM c JOIN cyclic d ON d.src = c.node)
SELECT start, node FROM c WHERE start <> node"""
)
def closure_cyclic(spark, sf):
    seeds = table(spark, sf, "part").filter("p_partkey IN (1, 2, 5)").select(F.col("p_partkey").alias("start"))
    return fixpoint.closure(R.cyclic_edges(spark, sf), seeds).select("start", "node")


@query(
    with_("targets", "edges", recursive=True)
    + """, c AS (SELECT id AS start, id AS node FROM targets WHERE kind = 'region' UNION SELECT c.start, e.src FROM c JOIN edges e ON e.dst = c.node)
SELECT start, node FROM c"""
)
def reverse_closure(spark, sf):
    targets = R.targets(spark, sf)
    owners = targets.filter("kind = 'region'").select(F.col("id").alias("start"))
    return fixpoint.reverse_closure(graph.depends_on(targets), owners).select("start", "node")


@query(
    with_("targets", "edges", recursive=True)
    + """, f AS (SELECT e.* FROM edges e JOIN targets t ON t.id = e.src WHERE t.kind IN ('order', 'part')),
c AS (SELECT id AS start, id AS node FROM targets WHERE id IN ('orders/1', 'orders/2', 'part/500') UNION SELECT c.start, f.dst FROM c JOIN f ON f.src = c.node)
SELECT start, node FROM c"""
)
def closure_of_kinds(spark, sf):
    """Only targets of some kinds are followed; roots are part of the result."""
    targets = R.targets(spark, sf)
    roots = targets.filter(F.col("id").isin("orders/1", "orders/2", "part/500")).select(F.col("id").alias("start"))
    return fixpoint.closure_of_kinds(targets, graph.depends_on(targets), roots, ["order", "part"])


@query(
    with_("deep", recursive=True)
    + """, w AS (SELECT p_partkey AS node, 1::BIGINT AS depth FROM part UNION SELECT d.dst, w.depth + 1 FROM w JOIN deep d ON d.src = w.node)
SELECT node, max(depth) AS depth FROM w GROUP BY node"""
)
def critical_depth(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return fixpoint.critical_depth(nodes, R.deep_edges(spark, sf))


@query(
    with_("deep", recursive=True)
    + """, w AS (SELECT p_partkey AS node, 0::BIGINT AS depth FROM part UNION SELECT d.src, w.depth + 1 FROM w JOIN deep d ON d.dst = w.node)
SELECT node, max(depth) AS depth FROM w GROUP BY node"""
)
def topo_levels(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return fixpoint.levels(nodes, R.deep_edges(spark, sf))


@query(
    with_("deep", recursive=True)
    + """, w AS (SELECT p_partkey AS node, 1::BIGINT AS depth FROM part UNION SELECT d.dst, w.depth + 1 FROM w JOIN deep d ON d.src = w.node)
SELECT node, max(depth) AS depth FROM w GROUP BY node"""
)
def ready_order(spark, sf):
    """Parts as they are taken when ready: the deepest first."""
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return fixpoint.ready_order(nodes, R.deep_edges(spark, sf))


@query(
    with_("cyclic", recursive=True)
    + """, c AS (SELECT src AS start, dst AS node FROM cyclic UNION SELECT c.start, d.dst FROM c JOIN cyclic d ON d.src = c.node)
SELECT start AS node FROM c WHERE start = node"""
)
def cycle_members(spark, sf):
    return fixpoint.cycle_members(R.cyclic_edges(spark, sf))


# Selection


def _page_paths(spark, sf) -> DataFrame:
    """(path): host and path of all pages, as changed paths."""
    return table(spark, sf, "pages").select(F.regexp_extract("url", r"\Ahttps?://([^?#]*)", 1).alias("path"))


def _page_packages(spark, sf) -> DataFrame:
    """(id, package): a target for each host that isn't a blog's, and one for each language folder of hosts whose name has an m."""
    place = F.regexp_extract("url", r"\Ahttps?://([^/?#]*)", 1)
    folder = F.regexp_extract("url", r"\Ahttps?://([^/?#]*/[^/?#]*)/", 1)
    rows = table(spark, sf, "pages").filter(~F.col("url").contains("//blog."))
    both = rows.select(place.alias("package")).unionAll(rows.filter(folder.contains("m.")).select(folder.alias("package")))
    return both.filter("package <> ''").distinct().select(F.concat("package", F.lit("#site")).alias("id"), "package")


_PAGES_SQL = """WITH paths AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
rows_ AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://([^/?#]*/[^/?#]*)/', 1) AS folder FROM pages WHERE NOT contains(url, '//blog.')),
packages AS (SELECT DISTINCT package FROM (SELECT host AS package FROM rows_ UNION ALL SELECT folder FROM rows_ WHERE contains(folder, 'm.')) WHERE package <> ''),
dirs AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM paths),
held AS (SELECT path, package, rank() OVER (PARTITION BY path ORDER BY length(package) DESC) AS r FROM dirs JOIN packages ON dir = package OR starts_with(dir, package || '/'))"""


@query(_PAGES_SQL + " SELECT path, package, package || '#site' AS id FROM held WHERE r = 1")
def nearest_package(spark, sf):
    return selection.nearest_packages(_page_paths(spark, sf), _page_packages(spark, sf))


@query(_PAGES_SQL + " SELECT path FROM paths WHERE path NOT IN (SELECT path FROM held)")
def unmatched_paths(spark, sf):
    changed = _page_paths(spark, sf)
    return selection.unmatched(changed, selection.nearest_packages(changed, _page_packages(spark, sf)))


@query(
    """SELECT DISTINCT path, id FROM (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)
JOIN (VALUES ('en', '^.*/en/.*$'), ('de-1', '^.*/de/1.*$'), ('html', '^.*\\.html$')) AS p(id, rx) ON regexp_matches(path, rx)"""
)
def pattern_owners(spark, sf):
    patterns = spark.sql("SELECT * FROM VALUES ('en', '*/en/*'), ('de-1', '*/de/1*'), ('html', '*.html'), ('none', 'a/b.html') AS t(id, pattern)")
    return selection.pattern_owners(_page_paths(spark, sf), patterns)


@query("SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path, 'own' AS id FROM pages")
def unsafe_patterns(spark, sf):
    """Absolute patterns and those that go up match nothing, whatever they would match otherwise."""
    pages = _page_paths(spark, sf)
    own = pages.select(F.lit("own").alias("id"), F.concat(F.lit("./"), F.col("path")).alias("pattern"))
    wrong = pages.select(F.lit("absolute").alias("id"), F.concat(F.lit("/"), F.col("path")).alias("pattern")).unionAll(
        pages.select(F.lit("up").alias("id"), F.concat(F.lit("x/../"), F.col("path")).alias("pattern"))
    )
    return selection.pattern_owners(pages, own.unionAll(wrong).unionAll(spark.sql("SELECT 'all' AS id, '/*' AS pattern UNION ALL SELECT 'all', '../*'")))


_CHANGED = """ch AS (SELECT 'part/' || p_partkey AS path FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'part/x/' || p_partkey FROM part WHERE p_partkey < 5
  UNION ALL SELECT 'nowhere/x' UNION ALL SELECT 'rules/a.star')"""


def _changed(spark, sf) -> DataFrame:
    """(path): paths of targets, paths inside a package, one that nothing owns, and a configured module."""
    part = table(spark, sf, "part").select("p_partkey")
    own = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("./part/"), F.col("p_partkey").cast("string")).alias("path"))
    inside = part.filter("p_partkey < 5").select(F.concat(F.lit("part/x/"), F.col("p_partkey").cast("string")))
    return own.unionAll(inside).unionAll(spark.sql("SELECT * FROM VALUES ('nowhere/x'), ('rules/a.star')"))


_DEFINITIONS = [selection.DEFINITION, "rules/*.star"]


@query(
    with_("targets", "edges", recursive=True)
    + f""", {_CHANGED},
declared AS (SELECT path, path AS id FROM ch WHERE path IN (SELECT id FROM targets)),
own AS (SELECT * FROM declared UNION ALL SELECT ch.path, t.id FROM ch JOIN targets t ON t.package = 'part' AND ch.path LIKE 'part/%' WHERE ch.path NOT IN (SELECT path FROM declared)),
starts AS (SELECT DISTINCT id FROM own),
c AS (SELECT id AS start, id AS node FROM starts UNION SELECT c.start, e.src FROM c JOIN edges e ON e.dst = c.node),
r AS (SELECT DISTINCT c.node AS id, CASE WHEN c.node = c.start THEN 'owns ' || own.path ELSE 'depends on ' || c.start || ' for ' || own.path END AS reason FROM c JOIN own ON own.id = c.start),
g AS (SELECT id, array_to_string(list_sort(list(reason)), '; ') AS reasons FROM r GROUP BY id)
SELECT t.id, coalesce(reasons, '') AS reasons, true AS full_scope FROM targets t LEFT JOIN g USING (id) WHERE t.kind = 'part'"""
)
def affected_targets(spark, sf):
    """Parts are tests; each is the declared owner of the path of its name."""
    targets = R.targets(spark, sf)
    patterns = targets.select("id", F.col("id").alias("pattern"))
    return selection.affected(_changed(spark, sf), patterns, targets, graph.depends_on(targets), targets.filter("kind = 'part'"), _DEFINITIONS)


@query(
    with_("targets", "edges", recursive=True)
    + """, own AS (SELECT id FROM targets WHERE id IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)),
c AS (SELECT id AS start, id AS node FROM own UNION SELECT c.start, e.src FROM c JOIN edges e ON e.dst = c.node)
SELECT c.node AS id, string_agg('depends on ' || c.start || ' for ' || c.start, '; ' ORDER BY c.start) AS reasons, false AS full_scope FROM c JOIN targets t ON t.id = c.node WHERE t.kind = 'order' GROUP BY 1"""
)
def affected_dependents(spark, sf):
    """Every path has an owner, so only the tests that depend on one of these run."""
    targets = R.targets(spark, sf)
    patterns = targets.select("id", F.col("id").alias("pattern"))
    changed = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"))
    return selection.affected(changed, patterns, targets, graph.depends_on(targets), targets.filter("kind = 'order'"))


@query(f"WITH {_CHANGED} SELECT path, 'graph definition' AS reason FROM ch WHERE path LIKE 'rules/%' UNION ALL SELECT path, 'no owner' FROM ch WHERE path = 'nowhere/x'")
def manifest_change(spark, sf):
    """The changed paths for which all tests run."""
    targets = R.targets(spark, sf)
    return selection.full_scope(_changed(spark, sf), targets.select("id", F.col("id").alias("pattern")), targets, _DEFINITIONS)


@query(with_("plan") + " SELECT target, row_number() OVER (PARTITION BY target ORDER BY position, batch) AS pos, batch AS batch_id FROM plan")
def batches_by_target(spark, sf):
    return selection.batches_by_target(R.plan(spark, sf).withColumnRenamed("batch", "batch_id"))


@query(with_("plan", "runs") + " SELECT batch AS batch_id, success, position FROM runs JOIN plan USING (batch)")
def plan_order(spark, sf):
    """What has run, in the order of the plan."""
    ran = R.runs(spark, sf).select(F.col("batch").alias("batch_id"), "success")
    return selection.restore_plan_order(ran, R.plan(spark, sf).withColumnRenamed("batch", "batch_id"))


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey AS target, l_returnflag AS file, l_returnflag || l_linestatus AS unit FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT target, file AS batch, string_agg(unit, ',' ORDER BY unit) AS units FROM u GROUP BY 1, 2 UNION ALL SELECT s_suppkey, s_suppkey::VARCHAR, '' FROM supplier WHERE s_suppkey NOT IN (SELECT target FROM u)"""
)
def planned_units(spark, sf):
    """Batches of all suppliers; those with odd keys have no known units."""
    units = table(spark, sf, "lineitem").filter("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("target"), F.concat("l_returnflag", "l_linestatus").alias("unit"), F.col("l_returnflag").alias("file"))
    return selection.planned_units(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), units)


@query(
    """WITH u AS (SELECT l_suppkey AS target, l_returnflag || l_linestatus AS unit, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 7 THEN NULL ELSE l_returnflag END AS file FROM lineitem),
w AS (SELECT target, bool_or(file IS NULL OR file = '') AS whole FROM u GROUP BY target)
SELECT target, CASE WHEN whole THEN target::VARCHAR ELSE file END AS batch, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units FROM u JOIN w USING (target) GROUP BY 1, 2"""
)
def file_batches(spark, sf):
    units = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("target"), F.concat("l_returnflag", "l_linestatus").alias("unit"),
        F.when(~((F.col("l_suppkey") % 5 == 0) & (F.col("l_linenumber") == 7)), F.col("l_returnflag")).alias("file"),
    )
    return selection.file_batches(units)


def _set_digest_sql(rows: str, key: str, label: str, line: str, domain: str) -> str:
    """SQL of ``digests.set_digest``: parts by a digest of the label, then a fold of the parts."""
    return f"""WITH s AS (SELECT {key} AS k, {label} AS label, {line} AS line FROM {rows}),
p AS (SELECT k, substr(sha256(label), 1, 3) AS part, sha256(string_agg(line || chr(10), '' ORDER BY label, line)) AS digest, count(*) AS n FROM s GROUP BY 1, 2),
f AS (SELECT k, sha256('{domain}' || chr(10) || string_agg(part || chr(10) || digest || chr(10), '' ORDER BY part)) AS digest, sum(n)::BIGINT AS n FROM p GROUP BY k)"""


@query(_set_digest_sql("(SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)", "1", "path", "path", "plan") + " SELECT digest AS plan_id FROM f")
def plan_id(spark, sf):
    return selection.plan_id(_page_paths(spark, sf))


_PLAN_LINES = """lines AS (
  SELECT DISTINCT 'changed' AS section, path AS key, '{"path":"' || path || '"}' AS line FROM pp UNION ALL
  SELECT DISTINCT 'unmatched', path, '{"path":"' || path || '"}' FROM pp WHERE NOT contains(path, '/en/') UNION ALL
  SELECT 'tests', id || chr(0) || kind, '{"id":"' || id || '","kind":"' || kind || '","reasons":[' || string_agg(DISTINCT '"' || reason || '"', ',' ORDER BY '"' || reason || '"') || ']}'
  FROM st GROUP BY id, kind UNION ALL
  SELECT 'batches', sha256('test-batch' || chr(0) || pair), '{"id":"' || sha256('test-batch' || chr(0) || pair) || '","target":"' || id || '","test_filters":' || filters || '}'
  FROM (SELECT id, filters, '["' || id || '",' || filters || ']' AS pair FROM (SELECT id, '[' || string_agg(DISTINCT '"' || filter || '"', ',' ORDER BY '"' || filter || '"') || ']' AS filters FROM st GROUP BY id)))"""
_PLAN_PARTS = """pp AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
st AS (SELECT 'supplier/' || l_suppkey AS id, 'test_' || l_linestatus AS kind, 'line ' || l_linenumber AS reason, l_returnflag AS filter FROM lineitem)"""


def _plan_lines(spark, sf) -> DataFrame:
    """A plan: paths of pages, tests of suppliers with the reasons of all their lines, a batch a supplier with its flags as filters."""
    paths = _page_paths(spark, sf)
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("test_"), F.col("l_linestatus")).alias("kind"),
        F.array_repeat(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), 2).alias("reasons"), "l_returnflag",
    )
    batches = lines.groupBy(F.col("id").alias("target")).agg(F.collect_set("l_returnflag").alias("filters"))
    return selection.plan_lines(paths, paths.filter("NOT contains(path, '/en/')"), lines, batches)


@query(f"WITH {_PLAN_PARTS}, {_PLAN_LINES} SELECT section, key, line FROM lines")
def plan_lines(spark, sf):
    """The plan document, entry by entry."""
    return _plan_lines(spark, sf)


@query(
    f"WITH {_PLAN_PARTS}, {_PLAN_LINES}, "
    + _set_digest_sql("lines", "1", "section || chr(0) || key", "line", "test-plan").removeprefix("WITH ")
    + " SELECT digest AS plan_id, n AS entries FROM f"
)
def plan_document_id(spark, sf):
    """The id of the plan document does not depend on the order or repetition of anything in it."""
    return selection.document_id(_plan_lines(spark, sf))


# Store


@query(
    with_("blobs", "unique_blobs", "actions")
    + """ SELECT 'blobs' AS what, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM unique_blobs
UNION ALL SELECT 'actions', count(*), coalesce(sum(size), 0)::BIGINT FROM (SELECT DISTINCT id, size FROM actions)"""
)
def store_stats(spark, sf):
    actions = R.actions(spark, sf).select("id", "size").distinct()
    return store.stats(R.unique_blobs(spark, sf), actions).select("what", "n", "bytes")


@query(with_("actions") + " SELECT ref AS digest, count(*) AS n FROM actions GROUP BY ref")
def blob_refcount(spark, sf):
    return store.refcounts(R.actions(spark, sf))


@query(with_("blobs", "unique_blobs", "actions") + " SELECT digest, size FROM unique_blobs WHERE digest NOT IN (SELECT ref FROM actions)")
def orphan_blobs(spark, sf):
    return store.orphans(R.unique_blobs(spark, sf), R.actions(spark, sf)).select("digest", "size")


_GC_SQL = (
    with_("blobs", "unique_blobs", "actions")
    + """, acts AS (SELECT DISTINCT id, size, modified FROM actions),
total AS (SELECT (SELECT sum(size) FROM unique_blobs) + (SELECT sum(size) FROM acts) AS t),
o AS (SELECT digest, size, coalesce(sum(size) OVER (ORDER BY modified, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM unique_blobs WHERE digest NOT IN (SELECT ref FROM actions)),
lasts AS (SELECT a.ref, arg_max(a.id, (a.modified, a.id)) AS id FROM actions a GROUP BY a.ref),
rel AS (SELECT l.id, sum(u.size) AS released FROM lasts l JOIN unique_blobs u ON u.digest = l.ref GROUP BY l.id),
aw AS (SELECT acts.id, acts.size, coalesce(released, 0) AS released,
  coalesce(sum(acts.size + coalesce(released, 0)) OVER (ORDER BY modified, acts.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM acts LEFT JOIN rel ON rel.id = acts.id),
left_ AS (SELECT t - (SELECT coalesce(sum(size), 0) FROM o) AS t FROM total)"""
)


def _gc(spark, sf):
    refs = stored(R.actions(spark, sf), "refs")
    blobs, acts = stored(R.unique_blobs(spark, sf), "blobs"), refs.select("id", "size", "modified").distinct()
    size = lambda df: df.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    return blobs, acts, refs, size(blobs) + size(acts), size


@query(_GC_SQL + " SELECT digest, size FROM o, total WHERE t - b > t - 500000")
def gc_tier1(spark, sf):
    """Orphans to remove for a budget half a million bytes under what is stored."""
    blobs, _, refs, total, _ = _gc(spark, sf)
    return store.evict_orphans(blobs, refs, total, total - 500_000)


@query(_GC_SQL + " SELECT id, size, released::BIGINT AS released FROM aw, left_ WHERE left_.t - b > left_.t // 2")
def gc_tier2(spark, sf):
    """Actions to remove, once orphans are gone, until half of the rest is left."""
    blobs, acts, refs, total, size = _gc(spark, sf)
    rest = total - size(store.orphans(blobs, refs))
    return store.evict_actions(blobs, acts, refs, rest, rest // 2)


@query(
    _GC_SQL
    + """, gone AS (SELECT aw.* FROM aw, left_, total WHERE left_.t > total.t // 4 AND left_.t - b > total.t // 4),
ro AS (SELECT o.* FROM o, total WHERE t - b > t // 4)
SELECT t::BIGINT AS bytes_before, (t - (SELECT coalesce(sum(size), 0) FROM ro) - (SELECT coalesce(sum(size + released), 0) FROM gone))::BIGINT AS bytes_after,
  ((SELECT count(*) FROM ro) + (SELECT count(*) FROM lasts WHERE id IN (SELECT id FROM gone)))::BIGINT AS removed_blobs,
  (SELECT count(*) FROM gone)::BIGINT AS removed_actions FROM total"""
)
def gc_report(spark, sf):
    blobs, acts, refs, total, _ = _gc(spark, sf)
    return store.gc_report(blobs, acts, refs, total // 4)


@query(with_("blobs") + " SELECT digest, count(*) AS copies, min(modified) AS first FROM blobs GROUP BY digest")
def dedupe_blobs(spark, sf):
    return store.put_blobs(R.blobs(spark, sf))


@query(with_("attempts") + " SELECT batch_id, arg_max(id, (started_at_unix_ms, id)) AS id FROM attempts GROUP BY batch_id HAVING batch_id NOT IN ('b1', 'b2')")
def latest_action(spark, sf):
    """Upserts by batch; two keys are forgotten."""
    last = store.put_latest(R.attempts(spark, sf), "batch_id", ["started_at_unix_ms", "id"])
    return store.forget(last, spark.sql("SELECT * FROM VALUES ('b1'), ('b2') AS t(batch_id)"), "batch_id").select("batch_id", "id")


@query(
    """SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.v, r.v) AS v, CASE WHEN l.doc_id IS NOT NULL THEN 'local' ELSE 'remote' END AS tier
FROM (SELECT doc_id, 'q' || quality AS v FROM labels) l FULL JOIN (SELECT doc_id, lang AS v FROM documents) r ON l.doc_id = r.doc_id"""
)
def tiered_lookup(spark, sf):
    local = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    return store.tiered(local, table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")), "doc_id", "v")


# Digests


def _components(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("source", F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("label"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(_set_digest_sql("documents", "source", "doc_id::VARCHAR", "doc_id::VARCHAR || ' ' || sha256(coalesce(text, ''))", "fingerprint") + " SELECT k AS source, digest, n FROM f")
def fingerprint(spark, sf):
    return digests.fingerprint(_components(spark, sf), "source")


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def category_counts(spark, sf):
    return digests.category_counts(_components(spark, sf))


@query(
    """WITH d AS (SELECT conv_id, turn AS i, sha256(text) AS d FROM conversations)
SELECT conv_id, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256('target' || chr(10) || string_agg(i::VARCHAR || chr(10) || d || chr(10), '' ORDER BY i, d)) END AS digest FROM d GROUP BY conv_id"""
)
def target_digest(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("index"), F.sha2("text", 256).alias("digest"))
    return digests.target_digest(turns, "conv_id")


@query(with_("evidence") + " SELECT subject_id, arg_max(cache, CASE cache WHEN 'bypass' THEN 2 WHEN 'miss' THEN 1 ELSE 0 END) AS cache FROM evidence GROUP BY subject_id")
def cache_state(spark, sf):
    return digests.cache_state(R.evidence(spark, sf), "subject_id")


@query(
    with_("attempts")
    + """, h AS (SELECT batch_id, min(duration_ms) FILTER (started_at_unix_ms % 2 = 0) AS a, min(duration_ms) FILTER (started_at_unix_ms % 2 = 1) AS b FROM attempts GROUP BY batch_id)
SELECT batch_id, a AS before, b AS after FROM h WHERE a IS DISTINCT FROM b"""
)
def run_diff(spark, sf):
    """Two runs of each batch, by parity of their start; what differs or is on one side only."""
    half = lambda p: R.attempts(spark, sf).filter(F.col("started_at_unix_ms") % 2 == p).groupBy("batch_id").agg(F.min("duration_ms").alias("v"))
    return digests.differences(half(0), half(1), "batch_id", "v")


@query(_set_digest_sql("documents", "lang", "source || '/' || doc_id", "sha256(coalesce(text, '')) || '  ' || source || '/' || doc_id", "tree") + " SELECT k AS tree, digest FROM f")
def tree_manifest(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("lang").alias("tree"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    )
    return digests.tree_manifest(files, "tree")


@query(
    """SELECT p_partkey, sha256('part' || chr(0) || '{"name":"' || p_name || '","size":' || p_size || '}') AS id,
  strlen(p_name) || ':' || p_name || strlen(p_brand) || ':' || p_brand AS key FROM part"""
)
def stable_ids(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.stable_id("part", F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("id"), S.length_prefixed(F.col("p_name"), F.col("p_brand")).alias("key")
    )


@query(
    """WITH s AS (SELECT doc_id, n_chars AS a, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS b, lang, sha256(coalesce(text, '')) AS digest FROM documents)
SELECT doc_id, CASE WHEN a = b AND doc_id % 4 <> 0 THEN digest END AS digest FROM s"""
)
def digest_cache(spark, sf):
    """Digests are kept for files whose length and mode are as they were."""
    docs = table(spark, sf, "documents")
    now = docs.select("doc_id", F.col("n_chars").alias("len"), F.col("lang").alias("mode"))
    grown = F.col("n_chars") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    cached = docs.filter("doc_id % 4 <> 0").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), grown.alias("len"), F.col("lang").alias("mode"))
    return digests.unchanged_digests(now, cached, "doc_id", ["len", "mode"]).select("doc_id", "digest")


# Results


@query(
    with_("cases")
    + """ SELECT target, count(*) AS total, count(*) FILTER (status IN ('passed', 'flaky')) AS passed,
  count(*) FILTER (status NOT IN ('passed', 'flaky', 'skipped', 'pending', 'todo', 'disabled')) AS failed,
  count(*) FILTER (status IN ('skipped', 'pending', 'todo', 'disabled')) AS skipped, count(*) FILTER (status = 'flaky') AS flaky FROM cases GROUP BY target"""
)
def result_counters(spark, sf):
    return results.counters(R.cases(spark, sf), "target")


@query(with_("cases") + " SELECT target, case_id, arg_max(status, (batch, position, status)) AS status FROM cases GROUP BY ALL")
def case_merge(spark, sf):
    return results.merge_cases(R.cases(spark, sf)).select("target", "case_id", "status")


def _batches(spark, sf) -> DataFrame:
    return results.batch_runs(R.plan(spark, sf), R.runs(spark, sf))


_BATCHES = with_("cases", "plan", "runs", "merged", "files")
_COUNTS = """, n AS (SELECT target, count(*) AS total, count(*) FILTER (status IN ('passed', 'flaky')) AS passed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status IN ('skipped', 'todo')) AS skipped, count(*) FILTER (status = 'flaky') AS flaky FROM merged GROUP BY target),
v AS (SELECT target, bool_and(success AND coalesce(status = 'passed', true)) AS ok, coalesce(arg_min(runner, position) FILTER (runner IS NOT NULL AND status IS NOT NULL), 'unknown') AS runner FROM batches GROUP BY target),
res AS (SELECT v.target, runner, CASE WHEN ok AND failed = 0 THEN 'passed' ELSE 'failed' END AS status, total, passed, failed, skipped, flaky FROM v JOIN n USING (target))"""


@query(_BATCHES + " SELECT target, batch, success, status, runner FROM batches")
def batch_runs(spark, sf):
    """Every batch of the plan with its run; one that has none did not succeed."""
    return _batches(spark, sf).select("target", "batch", "success", "status", "runner")


@query(_BATCHES + " SELECT target, bool_and(success AND coalesce(status = 'passed', true)) AS all_passed FROM batches GROUP BY target")
def all_passed(spark, sf):
    return results.all_passed(_batches(spark, sf))


@query(_BATCHES + " SELECT target, case_id, -position AS position, status FROM every WHERE real = 0")
def synthetic_cases(spark, sf):
    return results.synthetic_cases(_batches(spark, sf))


@query(_BATCHES + " SELECT target, case_id, status FROM merged")
def merged_cases(spark, sf):
    return results.merged_cases(_batches(spark, sf), R.batch_cases(spark, sf))


@query(_BATCHES + _COUNTS + " SELECT * FROM res")
def merged_results(spark, sf):
    return results.merged_results(_batches(spark, sf), R.batch_cases(spark, sf))


@query(_BATCHES + " SELECT target, field, path FROM artifacts")
def artifact_union(spark, sf):
    return results.artifacts(_batches(spark, sf), R.batch_files(spark, sf))


_DOCUMENT = "results.v1"


def _documents(spark, sf) -> DataFrame:
    """(target, document): the results of every supplier as JSON."""
    batches = stored(_batches(spark, sf), "batches")
    cases, merged = results.merged_cases(batches, R.batch_cases(spark, sf)), results.merged_results(batches, R.batch_cases(spark, sf))
    return results.results_document(merged, cases, results.artifacts(batches, R.batch_files(spark, sf)), _DOCUMENT)


@query(
    _BATCHES
    + _COUNTS
    + """, a AS (SELECT target, coalesce('"' || string_agg(path, '","' ORDER BY path) FILTER (field = 'logs') || '"', '') AS l, coalesce('"' || string_agg(path, '","' ORDER BY path) FILTER (field = 'native_results') || '"', '') AS r,
  '"' || string_agg(path, '","' ORDER BY path) FILTER (field = 'coverage') || '"' AS c FROM artifacts GROUP BY target)
SELECT 'results.v1' AS source_schema, target::VARCHAR AS target, '{"type":"' || runner || '","metadata":{}}' AS runner, status,
  '{"total":' || total || ',"passed":' || passed || ',"failed":' || failed || ',"skipped":' || skipped || ',"flaky":' || flaky || '}' AS summary,
  '{"logs":[' || coalesce(l, '') || '],"native_results":[' || coalesce(r, '') || ']' || coalesce(',"coverage":[' || c || ']', '') || '}' AS artifacts FROM res LEFT JOIN a USING (target)"""
)
def results_summary(spark, sf):
    """What a results document says but for its cases."""
    return results.document_summary(_documents(spark, sf))


@query(
    _BATCHES
    + """ SELECT s_suppkey AS target, 'stored' AS source, 's' || s_suppkey AS unit, 'kept' AS name, NULL AS suite, 'a.c' AS file FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT target, 'normalized_results', case_id, case_id, target::VARCHAR, NULL FROM merged WHERE target % 4 IN (1, 2)
UNION ALL SELECT s_suppkey, 'whole_target_fallback', NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 4 = 3 OR (s_suppkey % 4 IN (1, 2) AND s_suppkey NOT IN (SELECT target FROM merged))"""
)
def test_manifest(spark, sf):
    """Units of every supplier: of a quarter they are stored, of half they follow from results, the rest are run whole."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    kept = suppliers.filter("id % 4 = 0").select(
        F.col("id").alias("target"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("unit"), F.lit("kept").alias("name"), F.lit(None).cast("string").alias("suite"), F.lit("a.c").alias("file")
    )
    return results.test_manifest(suppliers, kept, _documents(spark, sf).filter("target % 4 IN (1, 2)"))


@query(
    with_("targets")
    + """ SELECT id, kind, array_to_string(deps, ',') AS deps, CASE WHEN k % 3 = 0 THEN 'r' || k % 5 END AS runner, CASE WHEN k % 3 = 0 THEN 'a,b' ELSE '' END AS labels,
  CASE WHEN k % 3 = 0 THEN 'x/' || k ELSE '.cache/out/' || id || '/test/test_results.json' END AS results_path
FROM (SELECT *, name::BIGINT AS k FROM targets WHERE kind = 'order' AND list_contains(capabilities, 'F'))"""
)
def test_records(spark, sf):
    """Orders with status F are tests; a third of all orders have metadata, another third an empty one."""
    targets = R.targets(spark, sf).filter("kind = 'order'").withColumn("capabilities", F.transform("capabilities", lambda c: F.when(c == "F", "test").otherwise(c)))
    k = F.col("name").cast("long")
    full = F.to_json(F.struct(F.struct(F.concat(F.lit("r"), (k % 5).cast("string")).alias("type")).alias("runner"), F.array(F.lit("a"), F.lit("b")).alias("labels"), F.struct(F.concat(F.lit("x/"), F.col("name")).alias("results")).alias("outputs")))
    metadata = targets.filter(k % 3 < 2).select("id", F.when(k % 3 == 0, full).otherwise(F.lit('{"runner":{}}')).alias("info"))
    got = results.test_records(targets, metadata)
    return got.withColumns({"deps": F.array_join("deps", ","), "labels": F.array_join("labels", ",")})


@query(
    """WITH s AS (SELECT s_suppkey AS target, s_suppkey % 8 AS k FROM supplier)
SELECT target, unnest(CASE k WHEN 0 THEN ['not an object'] WHEN 1 THEN ['schema', 'status'] WHEN 2 THEN ['target'] WHEN 3 THEN ['summary.total'] WHEN 4 THEN ['case'] WHEN 5 THEN ['artifacts.logs', 'artifacts.coverage'] WHEN 6 THEN ['cases'] ELSE [] END) AS message FROM s"""
)
def v_results_contract(spark, sf):
    """Documents that break the contract in seven ways, and good ones."""
    k, target = F.col("s_suppkey") % 8, F.col("s_suppkey").cast("string")
    case = '{"id":"a","name":"a","suite":"s","status":"passed","attempts":[%s],"runner_metadata":{}}'
    whole = '{"schema":"%s","target":"@","status":%s,"runner":{"type":"t","metadata":{}},"summary":{"total":%s,"passed":1,"failed":0,"skipped":0,"flaky":0},"cases":%s,"artifacts":{"logs":%s,"native_results":[]%s}}'
    attempt = '{"status":"passed"}'
    good = (_DOCUMENT, '"passed"', "1", f"[{case % attempt}]", '["l"]', "")
    change = lambda **by: F.replace(F.lit(whole % tuple(by.get(f"_{i}", g) for i, g in enumerate(good))), F.lit("@"), target)
    document = (
        F.when(k == 0, F.lit("[1]")).when(k == 1, change(_0="other", _1="7")).when(k == 2, F.lit(whole % good)).when(k == 3, change(_2="-1")).when(k == 4, change(_3=f"[{case % ''}]"))
        .when(k == 5, change(_4="[1]", _5=',"coverage":"x"')).when(k == 6, change(_3='{}')).otherwise(change())
    )
    return results.contract_violations(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"), document.alias("document")), _DOCUMENT)


@query(
    with_("cases")
    + """, p AS (SELECT DISTINCT l_suppkey AS target, l_partkey + d AS case_id FROM lineitem, (VALUES (0), (1)) AS v(d))
SELECT target, case_id, 'missing' AS status FROM p WHERE (target, case_id) NOT IN (SELECT (target, case_id) FROM cases)"""
)
def missing_cases(spark, sf):
    """Planned are the cases there are and, for each, the one of the next part."""
    lines = table(spark, sf, "lineitem")
    planned = lines.select(F.col("l_suppkey").alias("target"), F.explode(F.array(F.col("l_partkey"), F.col("l_partkey") + 1)).alias("case_id"))
    return results.with_missing(R.cases(spark, sf), planned).filter("status = 'missing'")


_FINDINGS = "findings AS (SELECT user_id AS tool, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'note' ELSE 'none' END AS severity FROM events)"


def _findings(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "error").when(kind == "purchase", "warning").when(kind == "signup", "note").otherwise("none")
    return table(spark, sf, "events").select(F.col("user_id").alias("tool"), severity.alias("severity"))


@query(f"WITH {_FINDINGS} SELECT count(*) AS total, count(*) FILTER (severity = 'note') AS notes, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors FROM findings")
def lint_summary(spark, sf):
    return results.lint_summary(_findings(spark, sf))


@query(f"WITH {_FINDINGS} SELECT tool, bool_or(severity IN ('warning', 'error')) AS fails FROM findings GROUP BY tool")
def lint_fails(spark, sf):
    return results.fails_at(_findings(spark, sf), "tool", "warning")


# Validation


@query("SELECT 'duplicate_target' AS code, 'brand/' || p_brand AS target, 'declared ' || count(*) || ' times' AS message FROM part GROUP BY p_brand HAVING count(*) > 1")
def v_duplicate(spark, sf):
    declared = table(spark, sf, "part").select(F.concat(F.lit("brand/"), F.col("p_brand")).alias("id"))
    return validate.duplicate_targets(declared).select("code", "target", "message")


def _roles(spark) -> DataFrame:
    """What each role of a kind accepts: parts take brands, orders nothing; suppliers have a role besides; the other kinds say nothing."""
    return spark.sql("SELECT * FROM VALUES ('part', 'deps', array('Brand#1', 'Brand#12', 'Brand#23')), ('order', 'deps', array()), ('supplier', 'tools', array('Brand#2')) AS t(kind, role, accepts)")


def _with_roles(targets: DataFrame) -> DataFrame:
    """``targets`` whose suppliers name parts as tools and data, and whose nations name a role ``deps``."""
    k = F.col("name")
    tools = F.create_map(F.lit("tools"), F.array(F.concat(F.lit("part/"), k)), F.lit("data"), F.array(F.concat(F.lit("part/"), k), F.lit("part/none")))
    roles = F.when(F.col("kind") == "supplier", tools).when(F.col("kind") == "nation", F.create_map(F.lit("deps"), F.array(F.lit("region/0"))))
    return targets.withColumn("dependencies", F.coalesce(roles, F.create_map().cast("map<string,array<string>>")))


@query(
    with_("targets")
    + """ SELECT 'missing_dependency' AS code, id AS target, 'deps' AS attribute, 'no target ' || dep AS message FROM (SELECT id, unnest(deps) AS dep FROM targets) WHERE dep NOT IN (SELECT id FROM targets)
UNION ALL SELECT 'missing_dependency', id, 'dependencies.data', 'no target part/none' FROM targets WHERE kind = 'supplier'"""
)
def v_missing_dep(spark, sf):
    return validate.missing_dependencies(_with_roles(R.targets(spark, sf)))


@query(
    with_("targets", "edges")
    + """ SELECT 'incompatible_dependency_provider' AS code, e.src AS target, e.dst || ' gives none of Brand#1,Brand#12,Brand#23' AS message
FROM edges e JOIN targets d ON d.id = e.dst WHERE e.src LIKE 'part/%' AND NOT list_has_any(d.providers, ['Brand#1', 'Brand#12', 'Brand#23'])
UNION ALL SELECT 'incompatible_dependency_provider', e.src, e.dst || ' gives none of Brand#2' FROM edges e WHERE e.src LIKE 'supplier/%'
UNION ALL SELECT 'incompatible_dependency_provider', s.id, 'part/' || s.name || ' gives none of Brand#2' FROM targets s JOIN targets p ON p.id = 'part/' || s.name WHERE s.kind = 'supplier' AND NOT list_contains(p.providers, 'Brand#2')"""
)
def v_provider(spark, sf):
    """A supplier's plain dependencies may be what any of its roles accepts; roles that it doesn't declare are left out."""
    return validate.incompatible_providers(_with_roles(R.targets(spark, sf)), _roles(spark)).select("code", "target", "message")


@query(
    with_("targets", "edges")
    + """ SELECT 'unexpected_dependency' AS code, e.src AS target, 'kind ' || t.kind || ' takes no ' || e.dst AS message FROM edges e JOIN targets t ON t.id = e.src WHERE t.kind NOT IN ('part', 'supplier')
UNION ALL SELECT 'unexpected_dependency', id, 'kind nation takes no region/0' FROM targets WHERE kind = 'nation'"""
)
def v_unexpected(spark, sf):
    """Kinds that accept no provider, or say nothing of dependencies, have none."""
    return validate.unexpected_dependencies(_with_roles(R.targets(spark, sf)), _roles(spark)).select("code", "target", "message")


@query(
    with_("targets")
    + """ SELECT 'unknown_dependency_role' AS code, id AS target, 'dependencies.data' AS attribute FROM targets WHERE kind = 'supplier' UNION ALL SELECT 'unknown_dependency_role', id, 'dependencies.deps' FROM targets WHERE kind = 'nation'"""
)
def v_unknown_role(spark, sf):
    return validate.unknown_roles(_with_roles(R.targets(spark, sf)), _roles(spark)).select("code", "target", "attribute")


def _referring(spark, sf) -> DataFrame:
    """Parts with an attribute ``main`` that refers to a target: rightly, relatively, to none, malformed, or by a select()."""
    k, name = F.col("name").cast("long") % 6, F.col("name")
    plain = F.when(k == 0, F.concat(F.lit("part/"), name)).when(k == 1, F.concat(F.lit("./"), name)).when(k == 2, F.concat(F.lit("part/x"), name)).when(k == 3, F.lit("a:b")).when(k == 4, F.lit(""))
    select = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("part/y"), name).alias("mac"), F.concat(F.lit("part/"), name).alias("default")).alias("select")).alias("main")))
    return R.targets(spark, sf).filter("kind = 'part'").withColumn("attrs", F.when(k == 5, select).otherwise(F.to_json(F.struct(plain.alias("main")))))


def _main(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('part', 'main', 'target', true, false), ('region', 'label', 'string', false, true) AS t(kind, name, type, implemented, configurable)")


@query(
    """SELECT 'missing_target_attribute' AS code, 'part/' || p_partkey AS target, 'no target part/' || CASE p_partkey % 6 WHEN 2 THEN 'x' ELSE 'y' END || p_partkey AS message FROM part WHERE p_partkey % 6 IN (2, 5)"""
)
def v_missing_target_attr(spark, sf):
    return validate.missing_target_attributes(_referring(spark, sf), _main(spark)).select("code", "target", "message")


@query("SELECT 'invalid_target_attribute' AS code, 'part/' || p_partkey AS target, 'a:b' AS message FROM part WHERE p_partkey % 6 = 3")
def v_invalid_target_attr(spark, sf):
    return validate.invalid_target_attributes(_referring(spark, sf), _main(spark)).select("code", "target", "message")


@query("SELECT 'select_on_non_configurable_attr' AS code, 'part/' || p_partkey AS target, 'main' AS attribute FROM part WHERE p_partkey % 6 = 5")
def v_select(spark, sf):
    return validate.selects_not_allowed(_referring(spark, sf), _main(spark)).select("code", "target", "attribute")


@query("SELECT 'unimplemented_attr' AS code, 'region/' || r_regionkey AS target, 'label' AS attribute FROM region")
def v_unimplemented(spark, sf):
    return validate.unimplemented_attributes(R.targets(spark, sf), _main(spark)).select("code", "target", "attribute")


@query(
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages), h AS (SELECT DISTINCT host FROM p WHERE host <> '')
SELECT 'missing_source' AS code, path AS target, 'no file ' || path || '.bak' AS message FROM p
UNION ALL SELECT 'missing_source', host, 'no file ' || host || '/fr/*' FROM h WHERE host NOT IN (SELECT host FROM p WHERE starts_with(path, host || '/fr/'))"""
)
def v_sources(spark, sf):
    """Every page is a source that exists and one that doesn't; every host has a pattern for its pages in French."""
    pages = _page_paths(spark, sf).distinct()
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", r"\Ahttps?://([^/?#]*)", 1).alias("id")).filter("id <> ''").distinct()
    sources = pages.select(F.col("path").alias("id"), F.explode(F.array("path", F.concat("path", F.lit(".bak")))).alias("path"))
    return validate.missing_sources(sources.unionAll(hosts.select("id", F.concat("id", F.lit("/fr/*")))), pages).select("code", "target", "message")


@query(
    with_("cyclic", recursive=True)
    + """, c AS (SELECT src AS start, dst AS node FROM cyclic UNION SELECT c.start, d.dst FROM c JOIN cyclic d ON d.src = c.node),
g AS (SELECT a.start AS node, min(a.node) AS least FROM c a JOIN c b ON a.start = b.node AND a.node = b.start GROUP BY 1)
SELECT 'dependency_cycle' AS code, least AS target, count(*) || ' targets depend on each other' AS message FROM g GROUP BY least"""
)
def v_cycle(spark, sf):
    return validate.dependency_cycles(R.cyclic_edges(spark, sf)).select("code", "target", "message")


@query("SELECT 'invalid_visibility' AS code, 'part/' || p_partkey AS target, CASE p_partkey % 9 WHEN 6 THEN 'package:a//b' WHEN 7 THEN 'subtree:' ELSE 'x:y' END AS message FROM part WHERE p_partkey % 9 >= 6")
def v_invalid_visibility(spark, sf):
    rules = ("public", "private", "package:a/b", "subtree:a", "a/b", "./b", "package:a//b", "subtree:", "x:y")
    rule = F.get(F.array(*map(F.lit, rules)), (F.col("name").cast("long") % 9).cast("int"))
    return validate.invalid_visibility(R.targets(spark, sf).filter("kind = 'part'").withColumn("visibility", F.array(rule))).select("code", "target", "message")


@query(
    """SELECT CASE p_partkey % 5 WHEN 0 THEN 'target_name_required' WHEN 1 THEN 'invalid_target_name' ELSE 'target_kind_required' END AS code, 'part/' || p_partkey AS target FROM part WHERE p_partkey % 5 < 3"""
)
def v_names(spark, sf):
    k = F.col("name").cast("long") % 5
    named = R.targets(spark, sf).filter("kind = 'part'").withColumn("kind", F.when(k == 2, " ").otherwise(F.col("kind"))).withColumn("name", F.when(k == 0, " ").when(k == 1, "a b").otherwise(F.col("name")))
    return validate.invalid_names(named).select("code", "target")


@query("SELECT 'unknown_status' AS code, 'a' || event_id AS target, event_type AS message FROM events WHERE event_type IN ('click', 'view')")
def v_enum(spark, sf):
    """Attempts whose status is no status: here some events' types are taken for it."""
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"), F.when(kind.isin("click", "view"), kind).otherwise("error").alias("status"))
    return validate.unknown_values(rows, "status", "attempt_status").select("code", "target", "message")


@query(with_("evidence") + " SELECT 'fingerprint_mismatch' AS code, id AS target FROM evidence WHERE substr(id, 2)::BIGINT % 17 IN (0, 1)")
def v_fingerprint(spark, sf):
    """Evidence whose fingerprint is of other inputs, or that lacks its input digest."""
    k = F.substring("id", 2, 20).cast("long") % 17
    print_ = F.when(k == 0, F.sha2("id", 256)).when(k != 2, F.col("input_digest"))
    rows = R.evidence(spark, sf).withColumn("fingerprint_digest", print_).withColumn("input_digest", F.when(k != 1, F.col("input_digest")))
    return validate.fingerprint_mismatches(rows).select("code", "target")


@query(
    """WITH d AS (SELECT source AS action, doc_id AS k, 'in/' || doc_id AS path, lang FROM documents)
SELECT action, 'undeclared_write' AS code, 'tmp/' || k AS path FROM d WHERE k % 10 = 0
UNION ALL SELECT DISTINCT action, 'missing_output', 'gone' FROM d
UNION ALL SELECT action, 'declared_input_deleted', path FROM d WHERE k % 3 = 0 AND k % 21 = 0
UNION ALL SELECT action, 'declared_input_modified', path FROM d WHERE k % 3 = 0 AND k % 21 <> 0 AND k % 5 = 0
UNION ALL SELECT action, 'undeclared_write', path FROM d WHERE k % 3 <> 0 AND k % 5 = 0
UNION ALL SELECT action, 'undeclared_read', path FROM d WHERE k % 3 <> 0 AND k % 7 = 0
UNION ALL SELECT action, 'symlink_escape', 'out/' || lang || '/' || k FROM d WHERE k % 11 = 0"""
)
def contract_audit(spark, sf):
    """An action a source: it writes out/, now and then tmp/, changes and deletes inputs, and fails to read what it didn't declare."""
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(F.col("source").alias("action"), "doc_id", F.concat(F.lit("in/"), k.cast("string")).alias("path"), F.concat_ws("/", F.lit("out"), "lang", k.cast("string")).alias("made"))
    inputs = docs.filter(k % 3 == 0).select("action", "path")
    outputs = docs.select("action", F.explode(F.array(F.lit("out/"), F.lit("gone"))).alias("path")).distinct()
    made = docs.select("action", F.col("made").alias("path")).unionAll(docs.select("action", F.lit("out"))).distinct()
    after = made.unionAll(docs.filter(k % 10 == 0).select("action", F.concat(F.lit("tmp/"), k.cast("string")))).withColumn("print", F.lit("p"))
    before = docs.select("action", "path", F.lit("1").alias("print"))
    later = docs.filter((k % 3 != 0) | (k % 21 != 0)).select("action", "path", F.when(k % 5 == 0, "2").otherwise("1").alias("print"))
    errors = docs.filter(k % 7 == 0).select("action", F.concat(F.lit("cannot open "), F.col("path"), F.lit(": no such file")).alias("text"))
    links = docs.select("action", F.col("made").alias("path"), (k % 11 != 0).alias("inside"))
    return contract.violations(inputs, outputs, (after.limit(0), after), (before, later), errors, links)


@query(
    with_("targets", "edges")
    + """ SELECT 'dependency_not_visible' AS code, e.src AS target, e.dst || ' is not visible' AS message FROM edges e
WHERE (e.dst LIKE 'nation/%' AND e.src NOT LIKE 'customer/%') OR (e.dst LIKE 'customer/%' AND e.src NOT LIKE 'customer/%')"""
)
def v_visibility(spark, sf):
    rule = F.when(F.col("kind") == "nation", F.array(F.lit("package:customer"))).when(F.col("package") == "customer", F.array(F.lit("private"))).otherwise(F.expr(R.NO_STRINGS))
    return validate.invisible_dependencies(R.targets(spark, sf).withColumn("visibility", rule)).select("code", "target", "message")


@query(with_("targets") + " SELECT 'dependency_count_mismatch' AS code, id AS target, len(deps) || ' dependencies' AS message FROM targets WHERE (kind = 'supplier' AND len(deps) > 1) OR (kind = 'part' AND len(deps) < 1)")
def v_counts(spark, sf):
    limits = spark.sql("SELECT * FROM VALUES ('supplier', 0, 1), ('part', 1, CAST(NULL AS INT)) AS t(kind, min_count, max_count)")
    return validate.dependency_counts(R.targets(spark, sf), limits).select("code", "target", "message")


def _schema(spark) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES ('region', 'label', true, array('ASIA', 'EUROPE'), array('AFRICA'), 'string'), ('nation', 'label', true, array(), array(), 'integer'),
        ('supplier', 'address', true, array(), array(), 'string') AS t(kind, name, required, allowed, disallowed, type)"""
    )


@query(
    with_("targets")
    + """ SELECT 'attr_value_not_allowed' AS code, id AS target, json_extract_string(attrs, '$.label') AS message FROM targets WHERE kind = 'region' AND json_extract_string(attrs, '$.label') NOT IN ('ASIA', 'EUROPE')
UNION ALL SELECT 'attr_value_disallowed', id, json_extract_string(attrs, '$.label') FROM targets WHERE kind = 'region' AND json_extract_string(attrs, '$.label') = 'AFRICA'
UNION ALL SELECT 'missing_required_attr', id, 'required' FROM targets WHERE kind = 'supplier'
UNION ALL SELECT 'unknown_attr', id, 'not in the schema' FROM targets WHERE kind = 'part'
UNION ALL SELECT 'attr_type_mismatch', id, 'not integer' FROM targets WHERE kind = 'nation'
UNION ALL SELECT 'unknown_target_kind', id, 'no kind ' || kind FROM targets WHERE kind = 'order'"""
)
def diagnostics_all(spark, sf):
    targets, schema = R.targets(spark, sf), _schema(spark)
    kinds = targets.filter("kind <> 'order'").select("kind").distinct()
    found = validate.diagnostics(
        validate.disallowed_values(targets, schema), validate.missing_attributes(targets, schema), validate.unknown_attributes(targets, schema),
        validate.type_mismatches(targets, schema), validate.unknown_kinds(targets, kinds), validate.invalid_names(targets),
    )
    return found.select("code", "target", "message")


@query(
    """SELECT CASE p_partkey % 5 WHEN 0 THEN 'target_name_required' WHEN 1 THEN 'invalid_target_name' WHEN 2 THEN 'target_kind_required' ELSE 'unknown_target_kind' END AS code, 'part/' || p_partkey AS target
FROM part WHERE p_partkey % 5 < 4"""
)
def v_names_first(spark, sf):
    """A target without a name or kind has no other finding, whatever else is wrong with it."""
    k = F.substring("id", 6, 20).cast("long") % 5
    name = F.when(k == 0, " ").when(k == 1, "a b").otherwise(F.col("name"))
    kind = F.when(k == 2, " ").when((k == 3) | (k < 2), "odd").otherwise(F.col("kind"))
    targets = R.targets(spark, sf).filter("kind = 'part'").withColumns({"name": name, "kind": kind})
    kinds = spark.createDataFrame([("part",)], "kind string")
    return validate.diagnostics(validate.invalid_names(targets), validate.unknown_kinds(validate.well_named(targets), kinds)).select("code", "target")


# Receipts and stores


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT p_partkey AS k, n - 1 - p_partkey % 7 AS g, n FROM part, n)
SELECT 'r' || k AS key, CASE WHEN k % 13 = 0 THEN 'schema' WHEN k % 19 = 0 THEN 'target' WHEN k % 23 = 0 THEN 'sandbox' WHEN k % 29 = 0 THEN 'filesystem tracker'
  WHEN k % 7 > 0 AND (k % 11 = 0 OR k % 17 = 0) THEN 'source change' WHEN k % 31 = 0 THEN 'output change' WHEN k % 15 = 0 THEN 'environment' WHEN k % 37 = 0 THEN 'host path'
  WHEN k % 41 = 0 THEN 'executable' WHEN k % 43 = 0 THEN 'output' END AS reason,
  CASE WHEN k % 13 = 0 OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 OR (k % 7 > 0 AND (k % 11 = 0 OR k % 17 = 0)) OR k % 31 = 0 OR k % 15 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0 THEN g ELSE n - 1 END AS generation
FROM r"""
)
def receipt_checks(spark, sf):
    """Receipts of parts held against the documents as a journal of sources: every reason occurs."""
    documents = table(spark, sf, "documents").select("doc_id")
    n = documents.count()
    path = lambda g: F.concat(F.lit("src/"), (g % 50).cast("string"))
    k = F.col("p_partkey")
    of = lambda what, wrong, right: F.when(what, wrong).otherwise(F.lit(right))
    newest = [path(F.lit(n - 1 - j)) for j in range(6)]
    digests = [F.when((k % 11 == 0) if j == 0 else F.lit(False), "old").otherwise(F.sha2(p, 256)) for j, p in enumerate(newest)]
    named = F.map_from_arrays(F.array(*newest), F.array(*digests))
    found = table(spark, sf, "part").select(
        F.concat(F.lit("r"), k.cast("string")).alias("key"), of(k % 13 == 0, "v4", "v5").alias("schema"), of(k % 19 == 0, "other", "t").alias("target"), of(k % 23 == 0, "none", "strict").alias("sandbox"),
        of(k % 29 == 0, "before", "now").alias("instance"), (n - 1 - k % 7).alias("source_generation"), F.when(k % 31 == 0, 3).otherwise(4).cast("long").alias("output_generation"),
        F.create_map(F.lit("PATH"), of(k % 15 == 0, "/old", "/bin"), F.lit("UNSET"), F.lit(None).cast("string")).alias("environment"), F.create_map(F.lit("/bin/cc"), of(k % 37 == 0, "f0", "f1")).alias("host_paths"),
        F.map_filter(named, lambda p, _: (k % 17 != 0) | (p != newest[0])).alias("source_digests"), of(k % 41 == 0, "old", "exe").alias("executable"), F.array(F.lit("out/a"), of(k % 43 == 0, "out/none", "out/b")).alias("outputs"),
    )
    changes = documents.select(F.col("doc_id").alias("generation"), path(F.col("doc_id")).alias("path"))
    world = receipts.World(
        receipts.Position("now", n - 1, 4), changes, changes.select("path", F.sha2("path", 256).alias("digest")).distinct(), spark.createDataFrame([("out/a",), ("out/b",)], "path string"),
        spark.createDataFrame([("PATH", "/bin")], "name string, value string"), spark.createDataFrame([("/bin/cc", "f1")], "path string, fingerprint string"), "exe", "v5",
    )
    wanted = found.select("key", F.lit("t").alias("target"), F.lit("strict").alias("sandbox"))
    return receipts.checked(wanted, found, world).select("key", "reason", F.col("source_generation").alias("generation"))


@query(with_("blobs") + " SELECT digest, min(size) AS size FROM blobs GROUP BY digest")
def stored_blobs(spark, sf):
    """All documents put into a store of files, half of them twice: one blob for each content."""
    path, blobs = new_folder(spark, "blobs"), R.blobs(spark, sf).select("digest", "size")
    store_files.put(blobs.filter("size % 2 = 0"), path)
    store_files.put(blobs, path)
    return store_files.contents(spark, path, "digest string, size long")


class _Parts:
    """A resolver: a nation becomes two offices, of which the first is its root; the nation learns their number."""

    def eval(self, id: str, package: str, name: str, attrs: str):
        for k in (1, 2):
            yield "target", f"{name}-{k}", '{"kind":"office","deps":["' + id + '"],"attrs":{"floor":' + str(k) + "}}"
        yield "root", f"{name}-1", None
        yield "attr", "offices", "2"


@query(
    with_("targets")
    + """ SELECT id, kind, array_to_string(CASE WHEN kind = 'nation' THEN list_append(deps, id || '-1') ELSE deps END, ',') AS deps,
  CASE WHEN kind = 'nation' THEN attrs[1 : len(attrs) - 1] || ',"offices":2}' ELSE attrs END AS attrs, NULL::VARCHAR AS owner FROM targets
UNION ALL SELECT id || '-' || k, 'office', id, '{"floor":' || k || '}', id FROM targets, (VALUES (1), (2)) v(k) WHERE kind = 'nation'"""
)
def resolved_targets(spark, sf):
    """Targets and what a table function, joined laterally, makes of the nations."""
    if not spark.catalog.functionExists("graphloom_offices"):
        resolvers.register(spark, "graphloom_offices", _Parts)
    targets = R.targets(spark, sf).withColumn("srcs", F.array().cast("array<string>"))
    return resolvers.resolved(targets, {"nation": "graphloom_offices"}, most=10**12).select("id", "kind", F.array_join("deps", ",").alias("deps"), "attrs", "owner")


# Journal and logs


@query(with_("journal") + " SELECT DISTINCT true AS known, path FROM journal WHERE generation > (SELECT max(generation) FROM journal WHERE path IS NULL)")
def changes_since(spark, sf):
    """All changes since the last one that lost its path."""
    changes = R.journal(spark, sf)
    lost, last = changes.agg(F.max(F.when(F.col("path").isNull(), F.col("generation"))), F.max("generation")).first()
    return journal.changes_since(changes, lost, last)


@query("SELECT false AS known, NULL::VARCHAR AS path")
def changes_unknown(spark, sf):
    """A record in between lost its path, so nothing is known of the changes since the start."""
    changes = R.journal(spark, sf)
    return journal.changes_since(changes, 0, changes.agg(F.max("generation")).first()[0])


@query(with_("journal") + " SELECT area, min(generation) AS first, max(generation) AS last, max(generation) - min(generation) + 1 - count(DISTINCT generation) AS missing FROM journal GROUP BY area")
def journal_gaps(spark, sf):
    return journal.gaps(R.journal(spark, sf))


@query(with_("journal") + " SELECT generation, area FROM (SELECT *, max(generation) OVER (PARTITION BY area) AS top FROM journal) WHERE generation > top - 500")
def journal_retained(spark, sf):
    return journal.retained(R.journal(spark, sf), 500).select("generation", "area")


_LOGS = (
    with_("log_lines")
    + """, logs AS (SELECT session, source || ':' || lpad((row_number() OVER (PARTITION BY session, source ORDER BY "order", message) - 1)::VARCHAR, 12, '0') AS cursor,
  source, CASE WHEN source = 'stderr' THEN 'error' ELSE 'info' END AS level, message FROM log_lines)"""
)


def _logs(spark, sf) -> DataFrame:
    return logs.records(R.log_lines(spark, sf), ["session"])


@query(_LOGS + " SELECT session, cursor, level FROM logs")
def log_records(spark, sf):
    return _logs(spark, sf).select("session", "cursor", "level")


@query(_LOGS + " SELECT session, cursor FROM logs WHERE level IN ('error', 'warning') AND contains(coalesce(message, ''), 'the')")
def log_filter(spark, sf):
    return logs.matching_logs(_logs(spark, sf), levels=["error", "warning"], text="the").select("session", "cursor")


@query(_LOGS + " SELECT session, cursor FROM logs WHERE cursor > 'stderr:000000000001' ORDER BY cursor, session LIMIT 40")
def keyset_page(spark, sf):
    """Cursors compare as text: a place on stderr lies before all of stdout."""
    return logs.first_events(logs.matching_logs(_logs(spark, sf), after="stderr:000000000001"), ["cursor", "session"], 40).select("session", "cursor")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1")
def event_first_n(spark, sf):
    """A limit of 0 still gives one event."""
    events = table(spark, sf, "events").select("event_id", "event_type", F.lit("run").alias("domain"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("cursor"))
    return logs.first_events(logs.matching_events(events, "run", "error", "x"), ["event_id"], 0).select("event_id", "event_type")


@query(
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN source IN ('src1', 'src2') THEN 'source' END AS reason FROM documents"""
)
def receipt_reason(spark, sf):
    checks = {"short": F.col("n_chars") >= 100, "language": F.col("lang") == "en", "source": ~F.col("source").isin("src1", "src2")}
    return table(spark, sf, "documents").select("doc_id", journal.receipt_reason(checks).alias("reason"))


@query("SELECT page_id::VARCHAR AS path FROM pages WHERE page_id % 6 = 0 OR page_id % 11 = 0 AND page_id % 2 = 0")
def reconcile(spark, sf):
    """Changed paths (even ids) whose digest differs (by 6) or is gone (by 11)."""
    pages = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"))
    before = pages.withColumn("digest", F.sha2("path", 256))
    after = before.filter("page_id % 11 <> 0").withColumn("digest", F.when(F.col("page_id") % 3 == 0, F.sha2(F.concat("path", F.lit("x")), 256)).otherwise(F.col("digest")))
    return journal.reconcile(pages.filter("page_id % 2 = 0"), before, after)


# Text and scalars


@query("SELECT p_partkey, p_type FROM part WHERE string_split(lower(replace(p_type, ' ', '_')), '_')[1] = 'standard'")
def kind_search(spark, sf):
    return search.matching(_catalog(spark, sf), "the STANDARD target").select("p_partkey", "p_type")


def _catalog(spark, sf) -> DataFrame:
    """A kind for each part: ``type_colour_thing``, with docs and an example."""
    kind = F.concat_ws("_", F.lower("p_type"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")))
    example = F.array(F.struct(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_brand").alias("name")))
    return table(spark, sf, "part").select("p_partkey", "p_type", kind.alias("kind"), F.concat(F.lit("made by "), F.col("p_brand")).alias("docs"), example.alias("examples"))


_CATALOG = "WITH c AS (SELECT *, lower(p_type) || '_' || replace(lower(p_name), ' ', '_') AS kind, 'made by ' || p_brand AS docs FROM part)"


@query(_CATALOG + " SELECT p_partkey, kind FROM c WHERE lower(p_type) IN ('standard', 'small') OR contains(kind, 'ring') OR contains(kind, 'the') OR regexp_matches(docs, 'the|ring')")
def kind_search_families(spark, sf):
    """Two families and a word that isn't generic: the families, and kinds that mention the word."""
    return search.matching(_catalog(spark, sf), "the standard, small: ring test").select("p_partkey", "kind")


@query(_CATALOG + " SELECT p_partkey, kind FROM c WHERE contains(lower(p_name), 'widget')")
def kind_search_segment(spark, sf):
    return search.matching(_catalog(spark, sf), "a widget, a ring").select("p_partkey", "kind")


@query(_CATALOG + " SELECT p_partkey, kind FROM c WHERE contains(lower(docs), '17') OR contains(kind, 'idge') OR contains('e' || p_partkey, '17')")
def kind_search_words(spark, sf):
    """No family and no segment: kinds with a word that holds a term, in their docs or their examples, too."""
    return search.matching(_catalog(spark, sf), "idge 17").select("p_partkey", "kind")


@query(_CATALOG + " SELECT kind, docs, 'e' || p_partkey AS examples FROM c")
def kind_summaries(spark, sf):
    return search.summaries(_catalog(spark, sf)).withColumn("examples", F.array_join("examples", ","))


@query("SELECT 'e7' AS slug, p_brand AS name FROM part WHERE p_partkey = 7")
def kind_example(spark, sf):
    catalog = _catalog(spark, sf).withColumn("kind", F.concat_ws("_", "kind", F.col("p_partkey").cast("string")))
    kind = catalog.filter("p_partkey = 7").first()["kind"]
    return search.example_of(catalog, kind, "e7")


@query(
    """SELECT p_partkey, p_size * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1000 WHEN 3 THEN 1048576 WHEN 4 THEN 1000000000 ELSE NULL END::BIGINT AS bytes FROM part"""
)
def parse_size(spark, sf):
    units = F.get(F.array(*map(F.lit, ("", "k", "KB", " MiB", "gB", "x"))), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.parse_size(F.concat(F.col("p_size").cast("string"), units)).alias("bytes"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mac' ELSE 'any' END AS chosen FROM part")
def select_branch(spark, sf):
    both = F.create_map(F.lit("macos"), F.lit("mac"), F.lit("default"), F.lit("any"))
    branches = F.when(F.col("p_partkey") % 3 == 0, both).otherwise(F.create_map(F.lit("default"), F.lit("any")))
    return table(spark, sf, "part").select("p_partkey", S.first_branch(branches, ["ios", "macos"]).alias("chosen"))


@query("SELECT p_partkey, array_to_string([t FOR t IN regexp_split_to_array(lower(p_name || ' / ' || p_type), '[^a-z0-9]+') IF t <> ''], '|') AS tokens FROM part")
def tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.tokens(F.concat_ws(" / ", "p_name", "p_type")), "|").alias("tokens"))


@query(
    """WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, list_last(string_split(path, '/')) AS base, contains(path, '/en/') OR path = 'en' AS is_en FROM u"""
)
def path_parts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"\Ahttps?://([^?#]*)", 1).alias("path"))
    return pages.select("page_id", P.parent(F.col("path")).alias("parent"), P.basename(F.col("path")).alias("base"), P.matches_any(F.col("path"), ["*/en/*", "en"]).alias("is_en"))


@query("SELECT c_custkey, coalesce(c_name, 'null') || ' | ' || coalesce(c_mktsegment, 'null') || ' | null' AS line, '''' || replace(c_name, '''', '''\"''\"''') || '''' AS quoted FROM customer")
def human_rows(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.human_row(F.col("c_name"), F.col("c_mktsegment"), F.lit(None)).alias("line"), S.shell_quote(F.col("c_name")).alias("quoted"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/b/x' WHEN 1 THEN 'a/x' WHEN 2 THEN 'x' WHEN 3 THEN NULL END AS id FROM documents"""
)
def relative_refs(spark, sf):
    refs = F.get(F.array(*map(F.lit, ("./x", "../x", "../../x", "a:x"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf, "documents").select("doc_id", P.relative_reference(F.lit("a/b"), refs).alias("id"))


@query(
    """SELECT doc_id, NOT (a IN (10, 127) OR a BETWEEN 224 AND 239 OR (a = 172 AND b BETWEEN 16 AND 31)) AS public
FROM (SELECT doc_id, doc_id % 256 AS a, doc_id % 32 AS b FROM documents)"""
)
def public_address(spark, sf):
    ip = F.format_string("%d.%d.7.9", F.col("doc_id") % 256, F.col("doc_id") % 32)
    return table(spark, sf, "documents").select("doc_id", P.is_public_ipv4(ip).alias("public"))


_IPV6 = ("::1", "::", "fc00::1", "fe80::9:%d", "2001:db8::1", "2607:f8b0::%d", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "ff02::1", "1:2:3", "2a00:1450:4001:81b::200e", "8.8.4.4")
_URLS = ("https://example.com/%d", "http://example.com", "https://localhost/x", "https://a.localhost:8443/", "https://10.1.2.3/x", "https://8.8.8.8:443/?q=%d", "https://[::1]/", "https://[2607:f8b0::1]/x", "https://u@example.org", "nonsense")


@query("SELECT doc_id, doc_id % 12 IN (5, 7, 10, 11) AS public_ip, doc_id % 10 IN (0, 5, 7, 8) AS public_url FROM documents")
def public_hosts(spark, sf):
    """Addresses of both kinds, and web addresses."""
    k = F.col("doc_id")
    pick = lambda some: F.replace(F.get(F.array(*map(F.lit, some)), (k % len(some)).cast("int")), F.lit("%d"), (k % 10).cast("string"))
    return table(spark, sf, "documents").select("doc_id", P.is_public_ip(pick(_IPV6)).alias("public_ip"), P.is_public_url(pick(_URLS)).alias("public_url"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN CASE p_partkey % 4 WHEN 0 THEN 'a/b-1.c/' ELSE '.x/' END || p_partkey END AS safe, p_partkey % 4 IN (0, 1) AS code,
  p_partkey % 4 = 2 AS skipped FROM part"""
)
def path_rules(spark, sf):
    """Ids as safe paths, endings, and what a walk leaves out."""
    k = (F.col("p_partkey") % 4).cast("int")
    ident = F.concat(F.get(F.array(*map(F.lit, ("a/b-1.c/", "a/../", "a b/", ".x/"))), k), F.col("p_partkey").cast("string"))
    file = F.get(F.array(*map(F.lit, ("a/x.c", "b/x.cc", "a/node_modules/x.js", "x"))), k)
    return table(spark, sf, "part").select(
        "p_partkey", P.safe_path(ident).alias("safe"), P.has_extension(file, [".c", ".cc"]).alias("code"), P.excluded_walk(file, ["q"], ["node_modules"]).alias("skipped")
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'macos-arm64,macos-aarch64,macos,arm64,aarch64' WHEN 1 THEN 'linux-x86_64,linux,x86_64' ELSE '' END AS tokens,
  CASE c_custkey % 3 WHEN 0 THEN 'arm64' WHEN 1 THEN 'amd64' ELSE 'riscv' END AS arch, CASE c_custkey % 3 WHEN 0 THEN 'macos' WHEN 1 THEN 'linux' ELSE 'plan9' END AS system,
  '''' || replace(c_name, '''', '''''') || '''' AS quoted FROM customer"""
)
def platforms(spark, sf):
    k = (F.col("c_custkey") % 3).cast("int")
    system, machine = (F.get(F.array(*map(F.lit, some)), k) for some in (("darwin", "linux", "plan9"), ("aarch64", "x86_64", "riscv")))
    named = S.operating_system(system)
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(S.platform_tokens(named, machine), ",").alias("tokens"), S.arch(machine).alias("arch"), named.alias("system"), S.powershell_quote(F.col("c_name")).alias("quoted")
    )


@query("SELECT p_partkey, p_brand AS brand, p_size::VARCHAR AS second, NULL::VARCHAR AS missing, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS decoded FROM part")
def json_and_base64(spark, sf):
    """JSON pointers, and base64 texts of which half are broken."""
    doc = F.to_json(F.struct(F.struct(F.col("p_brand").alias("br/and")).alias("info"), F.array(F.lit(0), F.col("p_size")).alias("list")))
    coded = F.concat(F.base64(F.encode("p_name", "UTF-8")), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("!"))
    return table(spark, sf, "part").select(
        "p_partkey", S.json_pointer(doc, "/info/br~1and").alias("brand"), S.json_pointer(doc, "/list/1").alias("second"), S.json_pointer(doc, "/none/x").alias("missing"),
        S.decoded_base64(coded).cast("string").alias("decoded"),
    )


@query(
    """SELECT c_custkey, greatest(1, least(c_custkey, 8)) AS workers, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE greatest(1, (c_custkey * 100) // greatest(c_custkey % 7, 1)) END AS memory,
  CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE greatest(1, least(8, c_custkey // 16)) END AS parallel FROM customer"""
)
def worker_limits(spark, sf):
    k = F.col("c_custkey")
    memory = F.when(k % 5 == 0, F.lit(0).cast("long")).otherwise(k)
    return table(spark, sf, "customer").select(
        "c_custkey", S.workers(k, 8).alias("workers"), S.worker_memory(memory * 100, k % 7).alias("memory"), S.parallel_actions(F.lit(8).cast("long"), memory, F.lit(16)).alias("parallel")
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'env' WHEN 1 THEN 'value' ELSE 'path' END AS kind, CASE c_custkey % 3 WHEN 2 THEN 'a=' || c_custkey ELSE 'N' END AS name,
  CASE c_custkey % 3 WHEN 1 THEN 'v=' || c_custkey END AS value, sha256('N' || chr(0) || c_custkey) AS digest FROM customer"""
)
def input_specs(spark, sf):
    """Inputs given as text, and digests of variables."""
    k = F.col("c_custkey").cast("string")
    spec = F.get(F.array(F.lit("env:N"), F.concat(F.lit("value:N=v="), k), F.concat(F.lit("a="), k)), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", digests.input_spec(spec).alias("s"), digests.env_digest(F.lit("N"), k).alias("digest")).select("c_custkey", "s.*", "digest")


@query("SELECT doc_id FROM documents WHERE doc_id % 8 = 0 OR doc_id % 13 = 0")
def path_drift(spark, sf):
    """Recorded files that are gone (by 8) or have another print (by 13); new files don't count."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("print"))
    now = docs.filter("doc_id % 8 <> 0").withColumn("print", F.col("print") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0))
    return digests.drifted(docs, now.unionAll(docs.select(-F.col("doc_id") - 1, "print")), "doc_id", "print")


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a":["' || p_brand || '","x"],"b":{"c":1}}' WHEN 1 THEN '{"a":"any"}' END AS attrs FROM part"""
)
def resolved_attrs(spark, sf):
    """select() in lists, by default, and without a branch that matches."""
    both = F.concat(F.lit('{"a":[{"select":{"linux":"l","macos":"'), F.col("p_brand"), F.lit('"}},"x"],"b":{"select":{"macos-arm64":{"c":{"select":{"default":1}}},"macos":2}}}'))
    k = F.col("p_partkey") % 3
    attrs = F.when(k == 0, both).when(k == 1, '{"a":{"select":{"default":"any"}}}').otherwise('{"a":{"select":{"linux":1}}}')
    return selects.resolved(table(spark, sf, "part").select("p_partkey", attrs.alias("attrs")), ["macos-arm64", "macos"])


# Providers, scripts, projects


@query(
    with_("targets")
    + """ SELECT id, 'deps' AS role, 0::BIGINT AS pos, 'nation/' || (SELECT s_nationkey FROM supplier WHERE s_suppkey::VARCHAR = name) AS dep, '' AS providers FROM targets WHERE kind = 'supplier'
UNION ALL SELECT t.id, r.role, 0, 'part/' || t.name, p.providers[1] FROM targets t JOIN (VALUES ('tools'), ('data')) AS r(role) ON true JOIN targets p ON p.id = 'part/' || t.name WHERE t.kind = 'supplier'"""
)
def providers_by_role(spark, sf):
    """What suppliers get from their dependencies, role by role; targets that aren't there are left out."""
    targets = _with_roles(R.targets(spark, sf))
    got = providers.dependencies_by_role(targets, targets.select("id")).filter(F.col("id").startswith("supplier/"))
    return got.withColumn("providers", F.array_join("providers", ","))


@query(
    with_("deep", recursive=True)
    + """, w AS (SELECT p_partkey AS start, p_partkey AS node, 0::BIGINT AS hops FROM part UNION SELECT w.start, d.dst, w.hops + 1 FROM w JOIN deep d ON d.src = w.node)
SELECT start AS id, p_brand AS value, min(hops) AS hops FROM w JOIN part ON p_partkey = node GROUP BY 1, 2"""
)
def collected_providers(spark, sf):
    """The brands of every part and of all it depends on, each at its nearest place."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    return providers.collected(own, R.deep_edges(spark, sf))


def _scripts(spark, sf) -> DataFrame:
    """(path, text): a script for each part, which needs that of half its number."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("s/"), c.cast("string"), F.lit(".sh"))
    need = F.when(k > 0, F.concat(F.lit('# task needs "'), name(F.floor(k / 2).cast("long")), F.lit('"\n'))).otherwise("")
    text = F.concat(F.lit("#!/usr/bin/env -S bash -e\n# plain comment\n\n"), need, F.lit('  // TASK input "in.txt"  \n; task output out\necho\n# task env "X"\n'))
    return table(spark, sf, "part").select(name(k).alias("path"), text.alias("text"))


@query(
    """SELECT 's/' || p_partkey || '.sh' AS path, 'needs' AS directive, 's/' || p_partkey // 2 || '.sh' AS value FROM part WHERE p_partkey > 0
UNION ALL SELECT 's/' || p_partkey || '.sh', 'input', 'in.txt' FROM part UNION ALL SELECT 's/' || p_partkey || '.sh', 'invalid', '; task output out' FROM part"""
)
def script_annotations(spark, sf):
    """Annotations end at the first line that is no comment."""
    return scripts.annotations(_scripts(spark, sf)).select("path", "directive", "value")


@query("SELECT 's/' || p_partkey || '.sh' AS path, 'bash' AS runtime, '-e' AS args FROM part")
def script_runtimes(spark, sf):
    return scripts.runtimes(_scripts(spark, sf)).withColumn("args", F.array_join("args", " "))


@query(
    with_("deep", recursive=True)
    + """, c AS (SELECT p_partkey AS start, p_partkey AS node FROM part WHERE p_partkey >= 100 UNION SELECT c.start, d.dst FROM c JOIN deep d ON d.src = c.node)
SELECT 's/' || start || '.sh' AS start, 's/' || node || '.sh' AS node FROM c WHERE start <> node"""
)
def script_needs(spark, sf):
    """Which scripts those from number 100 on need, over any number of steps."""
    roots = table(spark, sf, "part").filter("p_partkey >= 100").select(F.concat(F.lit("s/"), F.col("p_partkey").cast("string"), F.lit(".sh")).alias("start"))
    return scripts.needed_scripts(scripts.annotations(_scripts(spark, sf)), roots)


@query(
    """SELECT 'd' || p_partkey AS package, 'both' AS project FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'd' || p_partkey, 'one' FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT 'd' || p_partkey || '/vendor', 'one' FROM part WHERE p_partkey % 3 = 2 AND false UNION ALL SELECT 'd' || p_partkey || '/sub', 'one' FROM part WHERE p_partkey % 3 = 2"""
)
def native_projects(spark, sf):
    """Folders with all marker files of a project; the shallowest only, not in folders left out, and not too deep."""
    k = F.col("p_partkey")
    files_of = F.when(k % 3 == 0, F.array(*map(F.lit, ("a.toml", "b.lock", "sub/a.toml")))).when(k % 3 == 1, F.array(*map(F.lit, ("a.toml", ".hid/b.lock", "sub/a.toml")))).otherwise(
        F.array(*map(F.lit, ("sub/a.toml", "vendor/a.toml", "x/y/z/a.toml", "b.lock")))
    )
    paths = table(spark, sf, "part").select(F.concat(F.lit("d"), k.cast("string"), F.lit("/")).alias("d"), F.explode(files_of).alias("f")).select(F.concat("d", "f").alias("path"))
    markers = spark.sql("SELECT * FROM VALUES ('both', 'a.toml'), ('both', 'b.lock'), ('one', 'a.toml') AS t(project, marker)")
    rules = spark.sql("SELECT * FROM VALUES ('both', 4, array('vendor'), false), ('one', 4, array('vendor'), true) AS t(project, max_depth, exclude, stop)")
    return files.marker_projects(paths, markers, rules)


@query(
    """SELECT user_id AS path, event_id AS line, event_type AS rule_id, 'm' AS message FROM events"""
)
def sorted_findings(spark, sf):
    found = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.col("event_type").alias("rule_id"), F.lit("m").alias("message"))
    return results.sorted_findings(found)


@query(
    """WITH e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' END AS op FROM customer)
SELECT 'c' || c_custkey AS id, CASE WHEN op = 'update' THEN 'new' ELSE c_mktsegment END AS value FROM customer JOIN e USING (c_custkey) WHERE op IS DISTINCT FROM 'delete'
UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation"""
)
def edited_targets(spark, sf):
    """A batch that creates, changes and deletes; one change keeps the value as it is."""
    now = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("value"), "c_custkey")
    k = F.col("c_custkey") % 3
    old = now.filter(k < 2).select(F.when(k == 0, "update").otherwise("delete").alias("op"), "id", F.when(k == 0, "new").alias("value"))
    new = table(spark, sf, "nation").select(F.lit("create").alias("op"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("value"))
    return edits.apply(now.select("id", "value"), old.unionAll(new), ["value"])
