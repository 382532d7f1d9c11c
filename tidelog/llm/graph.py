"""Connected components and candidate links with DataFrame functions only. Nodes are longs, so that all aggregates have buffers of fixed width."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, materialise

#: Least and most bits of the filter in :func:`possible` (at most 8 MB to broadcast), and bits for each wanted key between them.
FILTER_BITS, MOST_FILTER_BITS, BITS_A_KEY = 1 << 20, 1 << 26, 16
#: Further rounds of comparing with leaders, at most, and how many pairs a member may stand in before one is tried.
ROUNDS, PAIRS_A_MEMBER = 2, 16


def connected_components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long): the smallest node reachable.

    Each round takes the least label of the neighbours and then the label of the label, so that chains shorten by half
    or more. Labels are written to the shared folder after each round. No edges give no rows; loops and repeated edges do no harm.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    both = work.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "neighbours")
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        after = work.table(met.join(jump, "label").select("node", F.least("label", "further").alias("component"), "was"), "labels")
        work.drop(labels)
        labels = after.drop("was")
        if after.filter(F.col("component") != F.col("was")).isEmpty():
            work.drop(both)
            return labels


def possible(rows: DataFrame, key: Column, wanted: DataFrame, n: int | None = None) -> DataFrame:
    """The rows whose key may be among ``wanted`` (one column, about ``n`` rows): a one-hash filter, at most 8 MB, is broadcast. An exact join follows elsewhere."""
    bits = FILTER_BITS
    while n is not None and bits < min(n * BITS_A_KEY, MOST_FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(bits))
    words = wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("long").alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("__bits"))
    own = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = rows.withColumn("__word", F.floor(own / 64).cast("long")).withColumn("__bit", F.pmod(own, F.lit(64)).cast("int"))
    found = marked.join(F.broadcast(words), "__word")
    return found.filter(F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__bit")).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)


def linked_groups(nodes: DataFrame, may_link: Callable[[Callable, Callable], Column], verify: Callable[[DataFrame, Scratch], DataFrame], sharper: Callable[[DataFrame, Scratch], DataFrame] | None = None, may_link_sharper: Callable[[Callable, Callable], Column] | None = None, first: int = 1, within: Scratch | None = None) -> DataFrame:
    """(node, component) of all nodes with a verified link; no link between two components is left out.

    ``nodes`` has a row for each node: node (long), keys (array of long: the buckets that it stands in) and facts; ``may_link`` is
    a cheap necessary condition on two nodes' facts; ``verify`` adds ``linked`` to pairs (a, b).

    First, in one of ``first`` buckets (by hash; more where linked nodes share many buckets), every member is compared with one leader. Links within a component then need no more comparison. In buckets that
    still hold several components, members outside the bucket's largest component are compared with other leaders, and components are joined,
    round after round while comparing all of them would take many more pairs than there are members; a round adds two pairs a member at most. In the
    end the members that are still outside are compared with all members of other components, so that no link depends on the rounds. For that step
    ``sharper`` may give a table of nodes more facts, and ``may_link_sharper`` a condition on them. The result is a working table of ``within``, if that is given.
    """
    with Scratch(nodes.sparkSession) as work:
        groups = _linked_groups(nodes, may_link, verify, sharper, may_link_sharper, first, work)
        return materialise(groups, "groups") if within is None else within.table(groups, "groups")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _linked_groups(nodes: DataFrame, may_link: Callable, verify: Callable, sharper: Callable | None, may_link_sharper: Callable | None, first: int, work: Scratch) -> DataFrame:
    facts = [c for c in nodes.columns if c not in ("node", "keys")]

    def candidates(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in facts)), side)
        return work.table(pairs.filter(may_link(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b"), "candidates")

    def links_among(pairs: DataFrame) -> DataFrame:
        # links are told apart only when they have been written: a filter would be pushed into the expressions that find them
        return work.table(verify(pairs, work), "links").filter("linked").select("a", "b")

    members = nodes.select(F.explode("keys").alias("bucket"), "node")
    several = members.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").select("bucket", "lead")
    members = work.table(members.join(work.table(several, "buckets"), "bucket"), "members")
    held = work.table(nodes.join(members.select("node").distinct(), "node"), "facts")
    led = members.filter((F.col("node") != F.col("lead")) & (F.pmod(F.xxhash64("bucket"), F.lit(first)) == 0))
    tried = candidates(led.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    links = links_among(tried)
    components = connected_components(links, work)
    for number in range(ROUNDS + 1):
        placed = members.select("bucket", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max_by("component", "n").alias("largest")).filter("parts > 1")
        rest = work.table(placed.join(mixed, "bucket").withColumn("outside", F.col("component") != F.col("largest")), "mixed")
        cost = rest.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0)).alias("pairs")).first()
        if number == ROUNDS or cost["pairs"] <= PAIRS_A_MEMBER * cost["members"]:
            break
        order = F.xxhash64(F.lit(number), "node")
        leaders = rest.groupBy("bucket").agg(F.min_by("node", F.when(~F.col("outside"), order)).alias("l0"), F.min_by("node", F.when(F.col("outside"), order)).alias("l1"))
        shared = rest.filter("outside").select("bucket", "node").join(leaders, "bucket").select("node", F.explode(F.array("l0", "l1")).alias("lead"))
        fresh = candidates(shared.filter("node <> lead").select(*_ordered("node", "lead")).distinct().join(tried, ["a", "b"], "left_anti"))
        found, tried = links_among(fresh), tried.union(fresh)
        if found.isEmpty():
            break
        links = links.union(found)
        components = connected_components(links, work)
        work.drop(rest)
    if not cost["pairs"]:
        return components
    if sharper is not None:
        held = held.join(sharper(rest.select("node").distinct(), work), "node")
        may_link, facts = may_link_sharper, [c for c in held.columns if c not in ("node", "keys")]
    held = rest.select("bucket", "node", "component", "largest", "outside").join(held, "node")
    x, y = (held.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in held.columns if c != "bucket")) for side in "xy")
    once = (F.col("y_component") == F.col("x_largest")) | (F.col("x_node") < F.col("y_node"))
    condition = (x["bucket"] == y["bucket"]) & (F.col("x_component") != F.col("y_component")) & once & may_link(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
    # a pair that shares several buckets is made in the first of them alone
    condition = condition & (F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0)) == x["bucket"])
    more = x.filter("x_outside").join(y, condition).select("x_node", *_ordered("x_node", "y_node"))
    more = work.table(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return components
    # two partners of each outside member first: where they link it, its other pairs need no look
    partner = F.when(F.col("a") == F.col("x_node"), F.col("b")).otherwise(F.col("a"))
    some = more.groupBy("x_node").agg(F.min(partner).alias("l0"), F.max(partner).alias("l1")).select("x_node", F.explode(F.array("l0", "l1")).alias("lead"))
    some = work.table(some.select(*_ordered("x_node", "lead")).distinct(), "candidates")
    links = links.union(links_among(some))
    components = connected_components(links, work)
    left = more.select("a", "b").distinct().join(some, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        left = left.join(components.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    apart = ~F.coalesce("a_component", "a").eqNullSafe(F.coalesce("b_component", "b"))
    left = work.table(left.filter(apart).select("a", "b"), "candidates")
    found = links_among(left)
    return components if found.isEmpty() else connected_components(links.union(found), work)
