"""Overlap digraph of an assembly graph: two nodes per segment, two edges per link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lookups import lookup
from ..plans.storage import AlternatingTable, materialize

_SHALLOW = 12  # rounds of a search before nodes are taken out of the graph
_LEAST_SHARE = 20  # a level that takes out less than one node in so many is the last


def node_name(name: str | Column, orient: str | Column) -> Column:
    return F.concat(F.col(name) if isinstance(name, str) else name, orient if isinstance(orient, Column) else F.lit(orient))


def flip(orient: str | Column) -> Column:
    """The other orientation: + becomes -, - becomes +."""
    return F.translate(orient, "+-", "-+")


def invert_link(links: DataFrame) -> DataFrame:
    """Both orientations of a link flipped, its ends left in place."""
    return links.withColumn("from_strand", flip("from_strand")).withColumn(
        "to_strand", flip("to_strand")
    )


def vertices(segments: DataFrame) -> DataFrame:
    """node, segment, orient; a segment listed twice still gives its nodes once."""
    return (
        segments.select(F.col("name").alias("segment"))
        .distinct()
        .withColumn("orient", F.explode(F.array(F.lit("+"), F.lit("-"))))
        .select(node_name("segment", F.col("orient")).alias("node"), "segment", "orient")
    )


def edges(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Directed edges src -> dst of both strands; links to unknown segments are left out.

    Repeated links stay repeated.
    """
    names = segments.select("name").distinct()
    known = links
    for end in ("from_name", "to_name"):
        known = known.join(names.select(F.col("name").alias(end)), end, "left_semi")
    forward = F.struct(
        node_name("from_name", F.col("from_strand")).alias("src"),
        node_name("to_name", F.col("to_strand")).alias("dst"),
    )
    backward = F.struct(
        node_name("to_name", flip("to_strand")).alias("src"),
        node_name("from_name", flip("from_strand")).alias("dst"),
    )
    return known.select(F.explode(F.array(forward, backward)).alias("_e")).select("_e.*")


def out_degrees(edge_table: DataFrame, vertex_table: DataFrame) -> DataFrame:
    counts = edge_table.groupBy(F.col("src").alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    return vertex_table.join(counts, F.col("node") == F.col("_src"), "left").select(
        "node", F.coalesce("_n", F.lit(0)).alias("out_degree")
    )


def named_segments(segments: DataFrame) -> DataFrame:
    """Names of the segments that carry a sequence."""
    return segments.where("seq is not null").select("name").distinct()


def segment_lengths(segments: DataFrame) -> DataFrame:
    """Length of each segment that states one in its LN tag."""
    return segments.select("name", F.col("tags")["LN"]["i"].alias("length")).where("length is not null")


def bfs_distances(
    edge_table: DataFrame,
    source: str,
    jump_complement_at_sink: bool = False,
    include_source: bool = True,
) -> DataFrame:
    """Fewest edges from ``source`` to every node it reaches: node, distance.

    Unbranched paths are contracted first: pointers along them double their
    reach each round, so a path of a million nodes takes about twenty.  The
    search then goes over the branching nodes with path lengths as weights,
    one round for each branching on the way, and the paths' inner nodes get
    their distances at the end.  A search that is not over after a few rounds
    takes out branching nodes too, so rounds grow with the logarithm of depth.  With ``jump_complement_at_sink`` a node
    without outgoing edges goes on from its other strand at distance one more.

    With ``include_source`` off the source is listed only if a cycle leads back
    to it, at the length of the shortest one.
    """
    spark = edge_table.sparkSession
    steps = edge_table.select("src", "dst").distinct()
    if jump_complement_at_sink:
        sinks = steps.select("dst").union(spark.createDataFrame([(source,)], "dst string")).distinct()
        sinks = sinks.join(steps.select(F.col("src").alias("dst")), "dst", "left_anti")
        other = F.concat(F.expr("substr(dst, 1, length(dst) - 1)"), flip(F.expr("right(dst, 1)")))
        steps = steps.unionByName(sinks.select(F.col("dst").alias("src"), other.alias("dst")))
    steps = materialize(steps, "steps")
    inner = materialize(_unbranched(steps, source), "inner")
    hops, placed = _contracted(steps, inner)
    reached = _weighted_search(hops, source)
    listed = reached if include_source else reached.where(F.col("node") != source).unionByName(
        hops.join(reached, F.col("src") == F.col("node")).where(F.col("dst") == source)
        .agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        .where("distance is not null")
        .select(F.lit(source).alias("node"), "distance")
    )
    along = placed.join(reached, F.col("head") == F.col("node")).select(
        F.col("inner").alias("node"), (F.col("distance") + F.col("place")).alias("distance")
    )
    return listed.unionByName(along)


def _unbranched(steps: DataFrame, source: str) -> DataFrame:
    """Nodes other than the source with one edge in and one out: inner, before, after."""
    into = steps.groupBy(F.col("dst").alias("inner")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("before")).where("n = 1")
    out = steps.groupBy(F.col("src").alias("_from")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("after")).where("n = 1")
    return (
        into.join(out.select("_from", "after"), F.col("inner") == F.col("_from"))
        .where((F.col("inner") != source) & (F.col("inner") != F.col("before")))
        .select("inner", "before", "after")
    )


def _contracted(steps: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted hops between branching nodes, and each inner node's head and place after it.

    Inner nodes on a cycle without a branching have no head and are left out:
    no other node leads to them.
    """
    known = inner.select(F.col("inner").alias("_known"))
    # pointer: the node before, until that is the first inner node of its path
    state = inner.join(known, F.col("before") == F.col("_known"), "left").select(
        "inner",
        F.when(F.col("_known").isNotNull(), F.col("before")).otherwise(F.col("inner")).alias("first"),
        F.when(F.col("_known").isNotNull(), 1).otherwise(0).cast("bigint").alias("place"),
        F.col("_known").isNull().alias("done"),
    )
    table = AlternatingTable(inner.sparkSession, "paths")
    state = table.replace(state)
    for _ in range(inner.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        ahead = state.select(
            F.col("inner").alias("_at"), F.col("first").alias("_first"), F.col("place").alias("_place"), F.col("done").alias("_done")
        )
        moved = state.where("not done").join(ahead, F.col("first") == F.col("_at")).select(
            "inner", F.col("_first").alias("first"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done")
        )
        state = table.replace(state.where("done").unionByName(moved))
    state = state.where("done").select(F.col("inner").alias("_node"), "first", "place")
    paths = materialize(state.join(inner, F.col("_node") == F.col("inner")).select("inner", "first", "place", "before", "after"), "paths")
    # only the first inner node of a path has a branching node before it
    ends = paths.groupBy("first").agg(
        F.min_by("before", "place").alias("head"), F.max_by("after", "place").alias("dst"), F.max("place").alias("_last")
    )
    placed = paths.join(ends.select(F.col("first").alias("_path"), "head"), F.col("first") == F.col("_path")).select(
        "inner", "head", (F.col("place") + 1).alias("place")
    )
    direct = (
        steps.join(known, F.col("src") == F.col("_known"), "left_anti")
        .join(known, F.col("dst") == F.col("_known"), "left_anti")
        .select("src", "dst", F.lit(1).cast("bigint").alias("weight"))
    )
    over = ends.select(F.col("head").alias("src"), "dst", (F.col("_last") + 2).alias("weight"))
    hops = direct.unionByName(over).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return materialize(hops, "hops"), materialize(placed, "placed")


def _weighted_search(hops: DataFrame, source: str) -> DataFrame:
    """Least distance from ``source`` over weighted hops: node, distance.

    A shallow search ends in a few rounds.  For a deep one, nodes are taken
    out of the graph level by level with shortcuts in their place, what is
    left is searched, and the levels get their distances in reverse order.
    """
    best, over = _search_rounds(hops, source, _SHALLOW)
    if over:
        return best
    core, levels = _taken_out(hops, source)
    best, _ = _search_rounds(core, source)
    for into in reversed(levels):
        start = best.select(F.col("node").alias("_node"), "distance")
        found = into.join(start, F.col("src") == F.col("_node")).groupBy(F.col("dst").alias("node"))
        best = materialize(best.unionByName(found.agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))), "best")
    return best


def _taken_out(hops: DataFrame, source: str) -> tuple[DataFrame, list[DataFrame]]:
    """Hops between the nodes that stay, and by level the hops into the nodes taken out.

    A node may go if the shortcuts through it are no more than its own hops,
    so the graph never grows.  Of neighbouring ones only that with the
    smallest hash goes, so a level's hops come from nodes that stay for it.
    Distances between the remaining nodes are those of the whole graph.
    """
    levels: list[DataFrame] = []
    hops = materialize(hops.where("src != dst"), "hops")
    while True:
        degrees = (
            hops.select(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(hops.select(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))
            .groupBy("node")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        )
        light = (F.col("a") * F.col("b") <= F.col("a") + F.col("b")) & (F.col("node") != source)
        degrees = materialize(degrees.select("node", light.alias("light")), "degrees")
        may = degrees.where("light").select("node")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), F.col(c)), F.col(c))
        both = hops.join(may.select(F.col("node").alias("src")), "src", "left_semi").join(may.select(F.col("node").alias("dst")), "dst", "left_semi")
        later = both.select(F.when(rank("src") > rank("dst"), F.col("src")).otherwise(F.col("dst")).alias("node"))
        gone = materialize(may.join(later, "node", "left_anti"), "gone")
        n_gone = gone.count()
        if not n_gone or n_gone * _LEAST_SHARE < degrees.count():
            return hops, levels
        marked = hops.join(gone.select(F.col("node").alias("_from")), F.col("src") == F.col("_from"), "left")
        marked = marked.join(gone.select(F.col("node").alias("_into")), F.col("dst") == F.col("_into"), "left")
        marked = materialize(marked, "marked")
        into = marked.where("_into is not null").select("src", "dst", "weight")
        onward = marked.where("_from is not null").select("_from", F.col("dst").alias("_to"), F.col("weight").alias("_more"))
        short = (
            into.join(onward, F.col("dst") == F.col("_from"))
            .where("src != _to")
            .select("src", F.col("_to").alias("dst"), (F.col("weight") + F.col("_more")).alias("weight"))
        )
        rest = marked.where("_into is null and _from is null").select("src", "dst", "weight")
        kept = rest.unionByName(short).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        levels.append(into)
        hops = materialize(kept, "hops")


def _search_rounds(hops: DataFrame, source: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """Distances after at most ``most`` rounds and whether they are final; only improved nodes go on in a round."""
    spark = hops.sparkSession
    schema = "node string, distance bigint"
    best_table, front_table = AlternatingTable(spark, "best"), AlternatingTable(spark, "front")
    front = front_table.replace(spark.createDataFrame([(source, 0)], schema))
    best = best_table.replace(front)
    widest = hops.agg(F.max(F.octet_length("src"))).first()[0] or 1
    size, done = 1, 0
    while size:
        if done == most:
            return best, False
        done += 1
        start = front.select(F.col("node").alias("_node"), "distance")
        found = lookup(hops, start, {"src": "_node"}, size, string_bytes=widest)
        found = found.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        old = best.select(F.col("node").alias("_old"), F.col("distance").alias("_least"))
        better = found.join(old, F.col("node") == F.col("_old"), "left").where("_least is null or distance < _least")
        front = front_table.replace(better.select("node", "distance"))
        size = front.count()
        if size:
            best = best_table.replace(best.unionByName(front).groupBy("node").agg(F.min("distance").alias("distance")))
    return best, True


def reachable(
    edge_table: DataFrame, vertex_table: DataFrame, source: str, count_cycles: bool = False
) -> DataFrame:
    """Per node whether a path leads there from ``source``: node, reachable.

    The source does not reach itself unless ``count_cycles`` is set and a
    cycle leads back to it.
    """
    known = vertex_table.where(F.col("node") == source).select("node")
    if known.limit(1).count() == 0:
        return vertex_table.select("node", F.lit(False).alias("reachable"))
    reached = bfs_distances(edge_table, source, include_source=False)
    if not count_cycles:
        reached = reached.where(F.col("node") != source)
    hit = reached.select(F.col("node").alias("_hit"))
    return vertex_table.join(hit, F.col("node") == F.col("_hit"), "left").select(
        "node", F.col("_hit").isNotNull().alias("reachable")
    )


def has_path(
    edge_table: DataFrame,
    vertex_table: DataFrame,
    source: str,
    target: str,
    count_cycles: bool = False,
) -> bool:
    """True if ``target`` is reachable; unknown nodes reach nothing."""
    found = reachable(edge_table, vertex_table, source, count_cycles)
    return found.where((F.col("node") == target) & F.col("reachable")).limit(1).count() > 0
