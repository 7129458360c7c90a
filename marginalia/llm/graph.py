"""Groups of near copies without all pairs: hubs, components, and a search over what is left.

Candidates come as rows (key, node): nodes that share a key may be linked. All pairs of a key would grow
with the square of its nodes, so the links are found in turns that lose no connection:

1. *Hubs.* Of a key's nodes the one that meets most others over all its keys is its hub: an original has more in common
   with its variants than they have with each other. The hub meets the key's other nodes, except those that are in its component already. The caller verifies the pairs; all links so far give components. A hub has then met its whole
   key and leaves it. Keys whose nodes are now all in one component need nothing more, as any further link of
   theirs joins what is joined; the others take their next hub, for a few turns.
2. *Dealt groups*, where the caller has no search of its own. A key of at most ``DEALT`` nodes meets whole and is then done. The
   others' nodes of about one ``size`` are dealt at random into groups of about ``DEALT``, inside which nodes of different components meet. Where
   copies of a lost original link to many of each other, a few turns join them, and their other pairs need no meeting. Turns go on while
   one in ``WORTH`` of the pairs is a link, at most ``deals`` times.
3. *The rest.* In keys that still hold several components, nodes of different ones meet by the caller's own search, or
   within the key. There a key's nodes are dealt into tiles of about ``TILE``, at most ``HANDS``, any two of which are one task's work, and a pair is bounded and
   compared inside the join, in the least key that it shares: only links come out as rows.

Each turn but the last is linear in the rows of the keys still open. Every pair of a key was met, or was in one component, or
failed the bound or the search, so no link of a key is lost. Without a search the last turn's comparisons, though not its rows, still take the square of a
key's nodes that have no link: to know that they have none is to compare them. Its input is a row for each node and tile of the key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import materialise, release, told

#: Nodes of a dealt group. Dealing goes on while one pair in WORTH is a link.
DEALT, WORTH = 8, 20
#: Nodes of a key in a tile of the last turn. Any two tiles meet in a task.
TILE = 128
#: Tiles that a key has at most, so that a node is no more rows than that; the tiles of larger keys are larger.
HANDS = 32
#: Files of links and labels few enough to be sent to all tasks.
FILES = 8


def components(links: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that can be reached, for nodes that have a link.

    Labels fall to the smallest label of a neighbour and then to that label's own label, so a path of
    length n takes about log n rounds. Every round is written to the shared folder and read back; only
    the number of changed labels comes to the driver. Labels of at most ``broadcast_rows`` links are sent to all tasks.
    """
    pairs = links.select("a", "b").where("a <> b")
    few = pairs.count() <= broadcast_rows
    sent = F.broadcast if few else lambda df: df
    kept = lambda df, label: materialise(df.coalesce(FILES) if few else df, label)
    both = kept(pairs.union(pairs.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = kept(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(sent(labels.toDF("other", "c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = near.join(sent(labels), "node").select("node", "component", F.least("component", "c").alias("next"))
        jumped = lower.join(sent(labels.toDF("next", "far")), "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("changed"))
        moved = kept(jumped, "labels")
        release(labels)
        labels = told(moved.drop("changed"), moved)
        if moved.where("changed").isEmpty():
            release(both)
            return labels


def shared_keys(keys: DataFrame, alike: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, a, z, n of the keys with two nodes or more: smallest and largest node and the rows (one per node).

    Where the keys carry a number ``load`` of the node, ``alike`` is asked about the differing bits of the only two nodes of
    a key and drops the key if they fail it, so that chance meetings end here. A null load passes.
    """
    loads = [F.bit_xor("load").alias("x"), F.count("load").alias("known")] if alike else []
    found = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n"), *loads).where("a < z")
    if alike:
        found = found.where((F.col("n") > 2) | (F.col("known") < 2) | alike(F.col("x"))).drop("x", "known")
    return materialise(found, "shared-keys")


def _of_keys(keys: DataFrame, chosen: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of ``keys`` with a chosen key; a choice of at most ``broadcast_rows`` is sent to the rows."""
    return keys.join(F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen, "key")


def _open(members: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, node, component) -> the same with n, the key's rows, without the keys that have only one component."""
    members = materialise(members, "members")
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "n")
    keys = materialise(keys, "open-keys")
    found = materialise(_of_keys(members, keys, broadcast_rows), "open-members")
    release(members, keys)
    return found


def _with_hubs(members: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, node, component) -> the same with hub and hub_component, without the keys that have only one component."""
    rows = _open(members, broadcast_rows)
    met = rows.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = rows.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node", "component")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.component").alias("hub_component"))
    found = materialise(rows.join(hubs, "key").select("key", "node", "component", "hub", "hub_component"), "hub-members")
    release(rows)
    return found


def linked_components(
    keys: DataFrame, payload: DataFrame | Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame] | Callable[[str, str, bool], Column], *,
    alike: Callable[[Column], Column] | None = None, rest: Callable[[DataFrame], DataFrame] | None = None, turns: int = 2, deals: int = 4, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(node, component) of the nodes with a link; ``verify`` keeps the pairs (a, b) that are links.

    ``payload`` has a row per node with what the bound ``near`` reads. ``alike`` is explained at ``shared_keys``. ``rest`` gets
    (node, component) of the nodes still in question and gives every pair (a, b) of different components that may be linked;
    without it they meet in dealt groups and then in their keys; ``payload`` is then asked for the nodes that share a key, and has also their ``size`` and
    what ``verify`` reads, which tells of two sides, as ``near`` does, whether they are a link; its third argument is whether most pairs will be. ``turns`` is the number of hubs that a key takes before the rest is searched,
    ``deals`` the most times that its nodes are dealt.
    """
    shared = shared_keys(keys, alike)
    two = shared.where("n = 2").select("a", F.col("z").alias("b"))
    members = _of_keys(keys.select("key", "node"), shared.where("n > 2").select("key"), broadcast_rows).withColumn("component", F.col("node"))
    if rest:
        bounds = payload
    else:
        members = materialise(members, "members")
        wanted = materialise(members.select("node").union(two.select("a")).union(two.select("b")).distinct(), "nodes-met")
        payload = payload(wanted)
        payload = payload if hasattr(payload, "written_to") else materialise(payload, "payload")
        release(wanted)
        bounds = payload.drop("form", "wide")
    x, y = bounds.alias("x"), bounds.alias("y")
    a_b = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    first = None if rest else members
    links = labels = None
    met: list[DataFrame] = []
    ends: list[DataFrame] = []

    def confirmed_pairs(pairs: DataFrame, likely: bool) -> DataFrame:
        """Pairs that ``verify`` tells to be links; both ends are sent what it reads."""
        both = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        ends.append(both)
        read = payload.join(F.broadcast(both) if both.count() <= 4 * broadcast_rows else both, "node", "left_semi").select("node", "size", "form", "wide")
        side = lambda c: read.select(F.col("node").alias(c), F.struct("size", "form", "wide").alias(f"of_{c}"))
        # dealt anew, as pairs are little to read and much to compare
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return pairs.join(side("a"), "a").repartition(parts, "b").join(side("b").repartition(parts, "b"), "b").where(verify("of_a", "of_b", likely)).select("a", "b")

    def link(close: DataFrame, likely: bool = False) -> tuple[int, int]:
        """Verifies pairs, takes their links into the components, and counts both."""
        close = materialise(close, "close")
        release(met.pop() if met else None)
        n = close.count(), take(verify(close) if rest else confirmed_pairs(close, likely))
        release(close, ends.pop() if ends else None)
        return n

    def take(found: DataFrame) -> int:
        nonlocal links, labels
        found = materialise(found, "near-links")
        n = found.count()
        if links is None or n:
            links = found if links is None else links.unionByName(found)
            before, labels = labels, components(links, broadcast_rows)
            release(before)
        return n

    def near_pairs(pairs: DataFrame) -> DataFrame:
        met.append(materialise(pairs.distinct(), "met"))
        return met[-1].join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(near("x", "y")).select("a", "b")

    def within(loaded: DataFrame, *together: str) -> DataFrame:
        """Pairs of different components that agree on ``together`` and pass the bound."""
        same = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in together])
        return loaded.alias("x").join(loaded.alias("y"), same & (F.col("x.component") < F.col("y.component")) & near("x", "y")).select(*a_b).distinct()

    def tiled(members: DataFrame) -> DataFrame:
        """Links between the different components of each key."""
        own = members.withColumn("open", F.collect_list("key").over(Window.partitionBy("node")))
        hands = F.least(F.ceil(F.col("n") / TILE), F.lit(HANDS)).cast("long")
        # written once, so that the shuffles that bring a node's text are gone before its rows are dealt
        held = materialise(own.join(payload, "node").withColumn("hands", hands).withColumn("hand", F.pmod(F.xxhash64("node"), "hands")), "held")
        pair = lambda o: F.struct(F.least("hand", o).alias("low"), F.greatest("hand", o).alias("high"))
        dealt = held.select("*", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("hands") - 1), pair)).alias("tile")).select("*", "tile.low", "tile.high").drop("tile")
        u, v = dealt.alias("x"), dealt.alias("y")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
        # nodes of one hand meet in its own tile only, and a pair in the least of its keys
        once = (F.col("x.low") == F.col("x.high")) | (F.col("x.hand") != F.col("y.hand"))
        least = F.col("x.key") == F.array_min(F.array_intersect("x.open", "y.open"))
        return u.join(v, same & (F.col("x.component") < F.col("y.component")) & once & near("x", "y") & least & verify("x", "y", False)).select(*a_b)

    def labelled(left: DataFrame) -> DataFrame:
        return left.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))

    hubs = None
    for turn in range(turns):
        before, hubs = hubs, _with_hubs(members, broadcast_rows)
        release(before, first)
        members = hubs
        if turn and members.isEmpty():
            return labels
        pairs = members.where("component <> hub_component").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        link(near_pairs(pairs if turn else pairs.union(two)), likely=True)
        members = labelled(members.where("node <> hub"))
    members = _open(members, broadcast_rows)
    release(hubs, shared)
    if rest:
        if not members.isEmpty():
            link(near_pairs(rest(members.select("node", "component").distinct())))
        return labels
    for turn in range(deals):
        loaded = members.join(bounds, "node").withColumn("band", F.when(F.col("n") > DEALT, F.floor(F.log("size") * 20)).otherwise(0))
        bands = loaded.groupBy("key", "band").agg(F.ceil(F.count("*") / DEALT).alias("hands"))
        dealt = loaded.join(bands, ["key", "band"]).withColumn("hand", F.when(F.col("n") > DEALT, F.pmod(F.xxhash64("node", F.lit(turn)), "hands")).otherwise(0))
        pairs, n = link(within(dealt, "key", "band", "hand"))
        before, members = members, _open(labelled(members.where(F.col("n") > DEALT)), broadcast_rows)
        release(before)
        if n * WORTH < pairs or members.isEmpty():
            break
    if not members.isEmpty():
        take(tiled(members))
    return labels
