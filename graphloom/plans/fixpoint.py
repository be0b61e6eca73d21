"""Recursive graph queries as loops of joins over stored tables.

All take ``edges`` (src, dst), where src depends on dst. Duplicate edges are allowed.

Two means keep the rounds to about the logarithm of the longest path. Chains (nodes with one
way in and one out) are contracted by pointer jumping into one edge with their length as
weight. Over what is left, values are spread along edges; after a few plain rounds the edges
are squared, so that round k goes 2^k edges at once, as long as the square has few pairs
(``GROWTH``). Graphs whose squares are large are bushy, and have short paths or are
spread with the largest power at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import Current, Rounds, stored

#: Rounds with the edges as they are, before they are squared.
PLAIN_ROUNDS = 6
#: Rounds after which the longest paths of a graph whose powers are too large to take are held against a search for cycles.
LAST_CHECK = 24
#: How many times the pairs of the edges (or of ``SMALL``, if that is more) their powers may have.
GROWTH, SMALL = 4, 100_000


def _distinct(edges: DataFrame) -> DataFrame:
    return stored(edges.select("src", "dst").distinct(), "edges")


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass(frozen=True)
class Contracted:
    """A graph without its chains.

    ``edges`` (src, dst, w) join the nodes that are left; ``inner`` (node, first, head, off)
    says of a chain's nodes the chain's first node, the node before that, and how far from
    there; ``tails`` (first, tail) where a chain leads; ``rings`` (node, cycle) are nodes of
    chains that bite their own tail, and the least of each.
    """

    edges: DataFrame
    inner: DataFrame
    tails: DataFrame
    rings: DataFrame
    rounds: int


def _contract(edges: DataFrame, best, fixed: DataFrame | None = None) -> Contracted | None:
    """``edges`` (src, dst, w; no self-loops, no duplicates) without chains; None if there are none. Nodes in ``fixed`` (node) stay."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"), F.min("src").alias("up"), F.min("w").alias("w"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_out")).filter("_out = 1")
    single = into.filter("_in = 1").join(out, "node", "left_semi").select("node", "up", "w")
    if fixed is not None:
        single = single.join(fixed, "node", "left_anti")
    keep = Current(edges.sparkSession, "single")
    single = keep.put(single, n=F.count(F.lit(1)))
    if not keep.got["n"]:
        return None
    above = single.select(F.col("node").alias("_n"))
    inside = F.col("_n").isNotNull()
    start = single.join(above, single["up"] == above["_n"], "left").select(
        "node", F.when(inside, F.col("up")).otherwise(F.col("node")).alias("to"), F.when(inside, F.col("w")).otherwise(F.lit(0)).cast("long").alias("off"),
        (~inside).alias("done"), F.col("node").alias("least"), F.lit(True).alias("new"),
    )
    jumps = Current(edges.sparkSession, "jumps")
    counts = {"n": F.count_if(~F.col("done")), "new": F.count_if(F.col("new") & ~F.col("done"))}
    table, rounds = jumps.put(start, **counts), 0
    left = jumps.got["n"]
    while left:
        rounds += 1
        table = jumps.put(_jumped(_jumped(table)), **counts)
        if jumps.got["n"] == left and not jumps.got["new"]:
            break  # what is left goes round in rings, and knows the least of its ring
        left = jumps.got["n"]
    rings = table.filter("not done").select("node", F.col("least").alias("cycle"))
    first = single.select(F.col("node").alias("first"), F.col("up").alias("head"), F.col("w").alias("_w"))
    inner = stored(table.filter("done").join(first, table["to"] == first["first"]).select("node", "first", "head", (F.col("off") + F.col("_w")).alias("off")), "inner")
    leaving = edges.join(single.select(F.col("node").alias("dst")), "dst", "left_anti")
    met = leaving.join(inner.withColumnRenamed("node", "src"), "src", "left")
    met = stored(met.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"), "first"), "met")
    core = met.groupBy("src", "dst").agg(best("w").alias("w"))
    tails = met.filter("first IS NOT NULL").select("first", F.col("dst").alias("tail"))
    return Contracted(stored(core, "core"), inner, tails, rings, rounds)


def _jumped(table: DataFrame) -> DataFrame:
    """Every pointer of a chain goes twice as far. Open pointers have different ends, so no key is hot."""
    told = table.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("off").alias("_off"), F.col("done").alias("_done"), F.col("least").alias("_least"))
    met = table.filter("not done").join(told, "to").select(
        "node", F.col("_to").alias("to"), (F.col("off") + F.col("_off")).alias("off"), F.col("_done").alias("done"),
        F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("new"),
    )
    return table.filter("done").unionAll(met)


def _squared(power: DataFrame, best, rings: bool) -> DataFrame:
    """(src, dst, w): two steps of ``power`` as one; ways back to where they began are left out unless ``rings``."""
    after = power.select(F.col("src").alias("dst"), F.col("dst").alias("_end"), F.col("w").alias("_w"))
    both = power.join(after, "dst")
    both = both if rings else both.filter("src <> _end")
    return both.groupBy("src", F.col("_end").alias("dst")).agg(best(F.col("w") + F.col("_w")).alias("w"))


def _pairs_of_square(power: DataFrame) -> int:
    into = power.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
    out = power.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
    return into.join(out, "node").agg(F.sum(F.col("_in").cast("double") * F.col("_out"))).first()[0] or 0


def _spread(values: DataFrame, edges: DataFrame, best, better, along, keys: tuple[str, ...] = ("node",), most: int | None = None, check=None) -> tuple[DataFrame, int] | None:
    """(keys, value) after values are spread along ``edges`` (src, dst, w) until none gets better, and the number of rounds.

    ``along(value, w)`` is what a value is after an edge or several, ``best`` the aggregate that
    keeps one of two, ``better(new, old)`` says whether it would be the new one. With ``most``
    rounds None is given if it takes more; ``check(rounds, power, new values)`` is called after
    each round that found better ones, and ways back to where they began are squared, too.
    """
    keys, spark = list(keys), edges.sparkSession
    all_of = Rounds(spark, "spread")
    power, rounds = edges, 0
    frontier = all_of.add(values.select(*keys, "value"))
    powers = Current(spark, "powers")
    limit, squares = None, True
    while True:
        rounds += 1
        if rounds > PLAIN_ROUNDS and squares:
            limit = limit or GROWTH * max(edges.count(), SMALL // GROWTH)
            squares = _pairs_of_square(power) <= limit
            if squares:
                power = powers.put(_squared(power, best, check is not None))
        known = all_of.all().groupBy(*keys).agg(best("value").alias("_old"))
        # a greater power goes on from all that is known, the same one from what is new
        doubled = rounds > PLAIN_ROUNDS and squares
        begin = known.withColumnRenamed("_old", "value") if doubled else frontier
        told = begin.join(power, begin["node"] == power["src"]).withColumn("_v", along(F.col("value"), F.col("w")))
        told = told.select(*[k for k in keys if k != "node"], F.col("dst").alias("node"), "_v").groupBy(*keys).agg(best("_v").alias("value"))
        risen = told.join(known, keys, "left").filter(F.col("_old").isNull() | better(F.col("value"), F.col("_old")))
        frontier = all_of.add(risen.select(*keys, "value"))
        if not all_of.added:
            return all_of.all().groupBy(*keys).agg(best("value").alias("value")), rounds
        if rounds == most:
            return None
        if check:
            check(rounds, power, frontier)


def _plus(value: Column, w: Column) -> Column:
    return value + w


def _closure(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, int]:
    """(start, node, value) of what seeds reach, themselves with 0, and the number of rounds."""
    edges = stored(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("w", F.lit(1).cast("long")), "edges")
    seeds = stored(seeds.select("start").distinct(), "seeds")
    begin = seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("value"))
    shallow = _spread(begin, edges, F.min, lambda new, old: new < old, _plus, ("start", "node"), most=PLAIN_ROUNDS)
    if shallow:
        return shallow
    small = _contract(edges, F.min, seeds.select(F.col("start").alias("node")))
    far, rounds = _spread(begin, small.edges if small else edges, F.min, lambda new, old: new < old, _plus, ("start", "node"))
    if small is None:
        return far, rounds
    far = stored(far, "far")
    inner = small.inner.select(F.col("node").alias("_n"), F.col("head").alias("node"), "off")
    inside = far.join(inner, "node").select("start", F.col("_n").alias("node"), (F.col("value") + F.col("off")).alias("value"))
    return far.unionAll(inside), rounds + small.rounds


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, node, hops): what each seed (start) reaches, itself left out even on a cycle."""
    far, _ = _closure(edges, seeds)
    return far.filter("start <> node").select("start", "node", F.col("value").cast("int").alias("hops"))


def reached_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds (node) and all that any of them reaches, whichever it is."""
    edges = stored(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("w", F.lit(0)), "edges")
    begin = seeds.select("node", F.lit(True).alias("value")).distinct()
    return _spread(begin, edges, F.max, lambda new, old: F.lit(False), lambda value, _: value)[0].select("node")


def carried(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, item, hops): the items (node, item) of each node and of all it depends on, each item once, at its nearest place.

    Items go against the edges, not nodes: work grows with the different items that a node
    gets, however many nodes have the same. Null items are items like others.
    """
    back = _reversed(edges).filter("src <> dst").distinct().withColumn("w", F.lit(1).cast("long"))
    # A null would not meet itself again: items travel inside an array.
    begin = items.select(F.array("item").alias("_item"), "node", F.lit(0).cast("long").alias("value")).distinct()
    far, _ = _spread(begin, stored(back, "edges"), F.min, lambda new, old: new < old, _plus, ("_item", "node"))
    return far.select("node", F.get("_item", F.lit(0)).alias("item"), F.col("value").alias("hops"))


def reverse_closure(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(start, node, hops): the owners themselves (hops 0) and all that depend on them."""
    own = owners.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    return own.unionAll(closure(_reversed(edges), owners))


def closure_of_kinds(targets: DataFrame, edges: DataFrame, roots: DataFrame, kinds: list[str]) -> DataFrame:
    """(start, node): the roots and what they reach through targets (id, kind) of some kinds only."""
    followed = targets.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("src"))
    through = edges.join(followed, "src", "left_semi")
    return roots.select("start", F.col("start").alias("node")).unionAll(closure(through, roots).select("start", "node"))


def _longest(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, value): the most edges of a path that ends in each node, and the number of rounds. ValueError on a cycle."""
    edges = stored(edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")), "edges")
    small = _contract(edges, F.max)
    core = small.edges if small else edges
    if edges.filter("src = dst").limit(1).count() or (small and not small.rings.unionAll(core.filter("src = dst").select("src", "dst")).isEmpty()):
        raise ValueError("the graph has a cycle")

    n = edges.count()

    def check(rounds: int, power: DataFrame, frontier: DataFrame) -> None:
        """On a cycle a power of the edges leads back to where it began, or paths get longer than there are edges."""
        long = rounds > PLAIN_ROUNDS and (frontier.agg(F.max("value")).first()[0] > n or not power.filter("src = dst").isEmpty())
        if long or (rounds == LAST_CHECK and not is_acyclic(core)):
            raise ValueError("the graph has a cycle")

    tops = core.select(F.col("src").alias("node")).distinct().join(core.select(F.col("dst").alias("node")), "node", "left_anti")
    if tops.isEmpty() and not core.isEmpty():
        raise ValueError("the graph has a cycle")
    begin = tops.withColumn("value", F.lit(0).cast("long"))
    far, rounds = _spread(begin, core, F.max, lambda new, old: new > old, _plus, check=check)
    met = far.select("node")
    unmet = core.select(F.col("dst").alias("node")).join(met, "node", "left_anti")
    if not unmet.isEmpty():  # behind no node without a way in
        raise ValueError("the graph has a cycle")
    if small is None:
        return far, rounds
    far = stored(far, "far")
    inner = small.inner.select(F.col("node").alias("_n"), F.col("head").alias("node"), "off")
    return far.unionAll(far.join(inner, "node").select(F.col("_n").alias("node"), (F.col("value") + F.col("off")).alias("value"))), rounds + small.rounds


def longest_path(nodes: DataFrame, edges: DataFrame, at_least: int = 1) -> DataFrame:
    """(node, depth): ``at_least`` for a node that no edge enters, else 1 more than the deepest node before it.

    Raises ValueError on a cycle, after about as many rounds as paths would take.
    """
    far, _ = _longest(edges)
    return nodes.join(far, "node", "left").select("node", (F.coalesce("value", F.lit(0)) + at_least).cast("long").alias("depth"))


def critical_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): 1 for a node that nothing depends on, else 1 more than its deepest dependent."""
    return longest_path(nodes, edges)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): 0 for a node without dependencies, else 1 more than its highest dependency."""
    return longest_path(nodes, _reversed(edges), at_least=0)


def ready_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth), the deepest first, ties by node: in which order ready nodes are taken."""
    return critical_depth(nodes, edges).orderBy(F.col("depth").desc(), "node")


def _raked(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(edges, how many): without those from a node without a way in or to one without a way out, as long as a tenth goes each time."""
    while count:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        keep = Current(edges.sparkSession, "raked")
        less = keep.put(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst", "w"), n=F.count(F.lit(1)))
        left = keep.got["n"]
        if left == count:
            break
        edges, slow, count = less, left > 0.9 * count, left
        if slow:
            break
    return edges, count


def _groups(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, cycle), edges): groups of nodes that reach each other, at least one a colour, and the edges that may hold others.

    Nodes draw a place by hash; a node's colour is the first of the nodes that reach it. What
    leads back to a colour's own node inside the colour is one group, and other groups lie
    inside a colour, too.
    """
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    places = nodes.select("node", F.struct(F.xxhash64("node").alias("place"), F.col("node").alias("name")).alias("value"))
    colour, _ = _spread(places, edges, F.max, lambda new, old: new > old, lambda value, _: value)
    colour = stored(colour.select("node", F.col("value.name").alias("colour")), "colours")
    of_src, of_dst = colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
    inside = stored(edges.join(of_src, "src").join(of_dst, "dst").filter("_a = _b").select("src", "dst", "w"), "inside")
    roots = colour.filter("node = colour").select("node", F.col("colour").alias("value"))
    back, _ = _spread(roots, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), F.max, lambda new, old: new > old, lambda value, _: value)
    back = stored(back.select("node", F.col("value").alias("cycle")), "groups")
    more = back.groupBy("cycle").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    gone = back.select("node")
    rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return back.join(more, "cycle", "left_semi").select("node", "cycle"), stored(rest.select("src", "dst", "w"), "rest")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): the nodes that reach themselves, and a name for those that reach each other.

    Ends are raked off and chains contracted in turn; groups of what is left are found by
    colours. A chain's nodes then belong to the group of both its ends, if that is one.
    """
    spark = edges.sparkSession
    edges = _distinct(edges)
    rest = stored(edges.filter("src <> dst").withColumn("w", F.lit(0)), "rest")
    found = Rounds(spark, "cycles")
    found.add(edges.filter("src <> src").select(F.col("src").alias("node"), F.col("src").alias("cycle")))
    chains: list[tuple[DataFrame, DataFrame]] = []  # each contraction's (node, head, tail) and self-loops (node)
    count = rest.count()
    while count:
        rest, count = _raked(rest, count)
        small = _contract(rest, F.min) if count else None
        if small:
            found.add(small.rings)
            chains.append((small.inner.join(small.tails, "first").select("node", "head", "tail"), small.edges.filter("src = dst").select(F.col("src").alias("node"))))
            rest = small.edges.filter("src <> dst")
        elif count:
            groups, rest = _groups(rest)
            found.add(groups)
        count = rest.count() if count else 0

    def alone(loops: DataFrame) -> None:
        """Nodes with a way back to themselves that are in no larger group are one of their own."""
        found.add(loops.select("node").distinct().join(found.all(), "node", "left_anti").select("node", F.col("node").alias("cycle")))

    for inner, loops in reversed(chains):
        alone(loops)
        known = found.all()
        heads, tails = known.select(F.col("node").alias("head"), "cycle"), known.select(F.col("node").alias("tail"), F.col("cycle").alias("_c"))
        found.add(inner.join(heads, "head").join(tails, "tail").filter("cycle = _c").select("node", "cycle"))
    alone(edges.filter("src = dst").select(F.col("src").alias("node")))
    return found.all()


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node): the nodes that reach themselves."""
    return cycles(edges).select("node")


def is_acyclic(edges: DataFrame) -> bool:
    """True if no node reaches itself."""
    return cycles(edges).isEmpty()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(cycle, nodes): for each group of nodes that reach each other a shortest way from its least node (cycle) back to it, that node first.

    Ties go to the least last node, and to the least node before each. The list is one value.
    """
    edges = _distinct(edges)
    group = stored(cycles(edges), "groups")
    least = group.groupBy("cycle").agg(F.min("node").alias("least"))
    of = stored(group.join(least, "cycle").select("node", "least"), "least")
    both = edges.join(of.select(F.col("node").alias("src"), F.col("least").alias("_a")), "src").join(of.select(F.col("node").alias("dst"), F.col("least").alias("_b")), "dst")
    inside = stored(both.filter("_a = _b").select("src", "dst", F.col("_a").alias("least")), "inside")
    far, _ = _closure(inside, of.select(F.col("least").alias("start")))
    far = stored(far.select(F.col("start").alias("least"), "node", F.col("value").alias("hops")), "far")
    last = inside.filter("dst = least").join(far.withColumnRenamed("node", "src"), ["least", "src"]).groupBy("least").agg(F.min(F.struct("hops", "src")).alias("_l"))
    last = stored(last.select("least", F.col("_l.src").alias("last")), "last")
    there, here = far.select(F.col("node").alias("dst"), F.col("hops").alias("_h")), far.select(F.col("node").alias("src"), "hops")
    before = inside.filter("src <> dst").join(there, "dst").join(here, "src").filter("_h = hops + 1").groupBy("dst").agg(F.min("src").alias("src"))
    way, _ = _closure(before.select(F.col("dst").alias("src"), F.col("src").alias("dst")), last.select(F.col("last").alias("start")))
    steps = way.join(last.withColumnRenamed("last", "start"), "start").select("least", F.struct((-F.col("value")).alias("i"), "node").alias("_s"))
    return steps.groupBy(F.col("least").alias("cycle")).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["node"]).alias("nodes"))
