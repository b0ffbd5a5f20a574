"""Walks, closures, components and load order over an edge table (src, dst and flags) of any size.

src points to dst (dst is the parent). Frontiers are joined level by level; each level is staged, and only counts reach the
driver. Edges may form cycles; a node is expanded once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import drop_reason, is_sensitive
from ..sources.tables import staged, staged_count, staged_with


def explode_references(refs: DataFrame) -> DataFrame:
    """One edge per reference column and target. A master-detail edge is never nillable; an edge to itself is of kind self."""
    edge = refs.select("src", "field", "nillable", "master_detail", (F.size("targets") > 1).alias("polymorphic"), "pos", F.explode("targets").alias("dst"))
    return edge.select(
        "src", "dst", "field", (F.col("nillable") & ~F.col("master_detail")).alias("nillable"), "master_detail", "polymorphic", F.when(F.col("src") == F.col("dst"), "self").otherwise("parent").alias("kind"), "pos"
    )


def child_edges(edges: DataFrame, root: str) -> DataFrame:
    """Tables that point to root, by field; each once."""
    return edges.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("src").alias("child"), "field", "nillable").distinct()


# fixed values: how tables end that a store fills in by itself
READ_ONLY = ["History", "Feed", "Share", "ChangeEvent", "__History"]


def read_only(name: Column) -> Column:
    return reduce(Column.__or__, [name.endswith(end) for end in READ_ONLY])


def child_relationships(edges: DataFrame, root: str, allowed: DataFrame | None = None) -> DataFrame:
    """(child, field, nillable, master_detail) of the reverse edges of a root, each once. Only a cascading child needs its root.

    Read-only children are left out, as are those that are not among allowed (child), if it is given."""
    found = edges.where((F.col("dst") == root) & (F.col("src") != root) & ~read_only(F.col("src")))
    found = found.select(F.col("src").alias("child"), "field", (~F.col("master_detail")).alias("nillable"), "master_detail").distinct()
    return found if allowed is None else found.join(allowed.select("child"), "child", "left_semi")


def child_filter(children: DataFrame) -> DataFrame:
    """Per parent: child relationships kept and dropped as read-only (by their name or a restricted delete)."""
    dropped = read_only(F.col("child")) | F.coalesce("restricted_delete", F.lit(False))
    return children.groupBy("parent").agg(F.count_if(~dropped).alias("kept"), F.count_if(dropped).alias("dropped_read_only"))


def walk(edges: DataFrame, starts: DataFrame, hops: int, stop: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes within `hops` of starts (node), at the smallest depth. Nodes in stop are listed, not expanded."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = staged(starts.select("node").distinct().withColumn("depth", F.lit(0)), "walk")
    frontier = seen
    for depth in range(1, hops + 1):
        from_ = frontier if stop is None else frontier.join(stop.select(F.col(stop.columns[0]).alias("node")), "node", "left_anti")
        new = from_.select("node").join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier, found = staged_count(new.withColumn("depth", F.lit(depth)), "walk")
        if not found:
            break
        seen = seen.union(frontier)
    return seen


def child_lookups(edges: DataFrame, root: str, field: str) -> DataFrame:
    """(node): what the children of a root point to by a field, each once; a child's edge to itself does not count."""
    children = child_edges(edges, root).select(F.col("child").alias("src")).distinct()
    return edges.where((F.col("field") == field) & (F.col("src") != F.col("dst"))).join(children, "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, depth) within hops, whichever way edges point."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return walk(both, starts, hops)


def closure(edges: DataFrame, starts: DataFrame, stop: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """Nodes that starts reach, themselves included."""
    return walk(edges, starts, most, stop).select("node")


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by exchange of both sides. The rounds below join again and again: broadcasts, small each, would all pass through the
    driver, and more of them and larger ones as the graph grows."""
    return left.join(right.hint("merge"), on, how)


def _step(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One round of (node, ahead, behind): the first node that a node is known to reach, and the first that is known to reach it.

    Both move over an edge, or to what the node found so far has found itself, so what is seen of a path grows by half or more in a
    round (names come in random order along a path). All that is asked is asked in one join."""
    none = F.lit(None).cast("string")
    asked = lambda df, at, node, on: df.select(F.col(at).alias("at"), F.col(node).alias("node"), F.lit(on).alias("on"))
    asks = [asked(edges, "dst", "src", True), asked(edges, "src", "dst", False), asked(state.where("ahead <> node"), "ahead", "node", True), asked(state.where("behind <> node"), "behind", "node", False)]
    told = _met(reduce(DataFrame.union, asks), state.select(F.col("node").alias("at"), F.col("ahead").alias("a"), F.col("behind").alias("b")), "at")
    found = told.select("node", F.when(F.col("on"), F.col("a")).alias("ahead"), F.when(~F.col("on"), F.col("b")).alias("behind"), none.alias("ahead0"), none.alias("behind0"))
    own = state.select("node", "ahead", "behind", F.col("ahead").alias("ahead0"), F.col("behind").alias("behind0"))
    new = own.union(found).groupBy("node").agg(*[F.min(c).alias(c) for c in ("ahead", "behind", "ahead0", "behind0")])
    return new.select("node", "ahead", "behind", ((F.col("ahead") < F.col("ahead0")) | (F.col("behind") < F.col("behind0"))).alias("moved"))


def _merged(edges: DataFrame) -> DataFrame | None:
    """(node, top): nodes that edges tie to another one both ways, under the first of the nodes so tied; None if there are none.

    Each names the first of its partners, if that comes before it, and takes over what that one names until none does."""
    pairs = edges.groupBy(F.least("src", "dst").alias("top"), F.greatest("src", "dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    links, moved = staged_count(pairs.groupBy("node").agg(F.min("top").alias("top")), "tied")
    if not moved:
        return None
    while moved:
        up = links.select(F.col("node").alias("of"), F.col("top").alias("then"))
        met = _met(links.select("node", "top"), up, F.col("top") == F.col("of"), "left")
        links, moved = staged_with(met.select("node", F.coalesce("then", "top").alias("top"), F.col("then").isNotNull().alias("moved")), F.count_if("moved"), "tied")
    return links.select("node", "top")


def _under(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """edges between what their ends are merged under, each once."""
    for end in ("src", "dst"):
        edges = _met(edges, tops.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top")), end, "left").withColumn(end, F.coalesce(f"{end}_top", end)).drop(f"{end}_top")
    return edges.where("src <> dst").select("src", "dst").distinct()


def _peeled(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """edges without those from nodes that none points to, and those to nodes that point to none, again while a tenth or more goes."""
    while size:
        inner = _met(edges, edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
        before = size
        edges, size = staged_count(_met(inner, edges.select(F.col("dst").alias("src")), "src", "left_semi").select("src", "dst"), "edges")
        if size > 0.9 * before:
            break
    return edges, size


def _acyclic(edges: DataFrame) -> DataFrame:
    """(node): sources of edges that cannot reach a cycle. Edges to nodes that are done close; those to a node with one open edge
    are drawn on to its end, so chains close in a logarithmic number of rounds. It ends when no node closes."""
    open_edges, before = edges, None
    while True:
        degree = open_edges.groupBy(F.col("src").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next"))
        met = _met(open_edges, degree, F.col("dst") == F.col("of"))  # edges to nodes without open edges close
        drawn = met.select("src", F.when((F.col("n") == 1) & (F.col("src") != F.col("dst")), F.col("next")).otherwise(F.col("dst")).alias("dst")).distinct()
        open_edges = staged(drawn, "open")
        now = open_edges.select("src").distinct().count()
        if now == before or not now:
            return _met(edges.select(F.col("src").alias("node")).distinct(), open_edges.select(F.col("src").alias("node")), "node", "left_anti")
        before = now


NAME_AT = 17  # names of nodes follow 16 digits of their hash


def _shuffled(node: str) -> Column:
    """A name for a node whose order says nothing about its place in the graph."""
    return F.concat(F.lpad(F.hex(F.xxhash64(node)), 16, "0"), F.col(node).cast("string"))


def components(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, or of one with an edge to itself.

    Nodes with edges both ways become one, and edges that no cycle can use are peeled off while many go. In each round, every node
    learns the first node (in an order by hash) that it reaches, and the first that reaches it. Nodes for
    which these are one node are its component. Edges between nodes that differ in either cannot be part of a cycle; the rounds
    go on with the rest, which falls apart into ever smaller pieces; after two rounds, edges of nodes that reach no cycle
    or that no cycle reaches go too. The numbers of rounds grow with the logarithm of the longest path. The component is named by its smallest node; nodes are text."""
    every = edges.select("src", "dst").distinct()
    loops = every.where("src = dst").select(F.col("src").cast("string").alias("node")).withColumn("component", F.col("node"))
    rest, size = staged_count(every.where("src <> dst").select(_shuffled("src").alias("src"), _shuffled("dst").alias("dst")), "edges")
    found: DataFrame | None = None
    merges: list[DataFrame] = []
    for turn in range(most):
        if turn == 2:  # what has not fallen apart by now may be long chains
            for turned in (False, True):
                way = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else rest
                free = staged(_acyclic(way), "free").select(F.col("node").alias("dst" if turned else "src"))
                rest, size = staged_count(_met(rest, free, free.columns[0], "left_anti").select("src", "dst"), "edges")
        tops = _merged(rest) if size else None
        if tops is not None:
            merges.append(tops)
            rest, size = staged_count(_under(rest, tops), "edges")
        rest, size = _peeled(rest, size)
        if not size:
            break
        state = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        state, moved = staged(state.select("node", F.col("node").alias("ahead"), F.col("node").alias("behind")), "state"), 1
        while moved:
            state, moved = staged_with(_step(state, rest), F.count_if("moved"), "state")
            state = state.drop("moved")
        one = state.where("ahead = behind").select("node", F.col("ahead").alias("label"))
        found = one if found is None else found.union(one)
        a, b = state.select(F.col("node").alias("src"), F.col("ahead").alias("a1"), F.col("behind").alias("b1")), state.select(F.col("node").alias("dst"), F.col("ahead").alias("a2"), F.col("behind").alias("b2"))
        rest, size = staged_count(_met(_met(rest, a, "src"), b, "dst").where("a1 = a2 and b1 = b2 and a1 <> b1").select("src", "dst"), "edges")
    for tops in reversed(merges):  # what was merged last is named first
        if found is None:
            found = tops.select("node", F.col("top").alias("label"))
            continue
        told = found.select(F.col("node").alias("top"), "label")
        found = staged(found.union(_met(tops, told, "top", "left").select("node", F.coalesce("label", "top").alias("label"))), "found")
    if found is None:
        return loops
    each = found.union(found.select(F.col("label").alias("node"), "label")).distinct() if merges else found
    named = each.select(F.substring("node", NAME_AT, 1_000_000).alias("node"), "label")
    large = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component")).where("n > 1")
    big = _met(named, large, "label").select("node", "component")
    return big.union(_met(loops, big.select("node"), "node", "left_anti"))


def break_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component: its number of inner edges and the edge to leave out first, nillable and not to itself if possible.

    A component without a nillable edge has no break edge (null)."""
    a, b = labels.select(F.col("node").alias("src"), "component"), labels.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = _met(_met(edges, a, "src"), b, "dst").where("component = other")
    key = F.struct(F.col("src") == F.col("dst"), F.col("pos"), F.col("src"), F.col("field"), F.col("dst"))
    best = F.min_by(F.struct("src", "field", "dst"), F.when(F.col("nillable"), key))
    out = inner.groupBy("component").agg(F.count(F.lit(1)).alias("inner_edges"), best.alias("e"))
    return out.select("component", "inner_edges", F.col("e.src").alias("break_src"), F.col("e.field").alias("break_field"), F.col("e.dst").alias("break_dst"))


def cycle_steps(breaks: DataFrame) -> DataFrame:
    """Per component: two-phase, or skipped where no inner edge is nillable."""
    return breaks.select("component", F.when(F.col("break_src").isNull(), "skipped").otherwise("two-phase").alias("step"), F.when(F.col("break_src").isNull(), "no-nillable-edge").alias("reason"))


def load_waves(edges: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, wave): every node comes in a later wave than what it points to; a component is one step.

    The table of a round has the edges that are still open, each with the number of waves it spans, and a row without `b` per
    step, the least wave that closed edges demand. An edge to a step without open edges closes. An edge to a step with one open
    edge is drawn on to that edge's end: chains and trees, hierarchies of rows say, double their reach in a round; what
    branches and meets again takes a round a level. A cycle that labels do not name is an error."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    named, n = staged_count(_met(nodes, labels, "node", "left").select("node", F.coalesce("component", "node").alias("step")), "steps")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    s, d = named.select(F.col("node").alias("src"), F.col("step").alias("a")), named.select(F.col("node").alias("dst"), F.col("step").alias("b"))
    between = _met(_met(edges.select("src", "dst").distinct(), s, "src"), d, "dst").where("a <> b").select("a", "b", one.alias("w")).distinct()
    floor = named.select(F.col("step").alias("a"), F.lit(None).cast(named.schema["step"].dataType).alias("b"), zero.alias("w")).distinct()
    state, left = staged_with(between.union(floor), F.count("b"), "waves")
    for _ in range(most):
        if not left:
            return _met(named, state, named["step"] == state["a"]).select("node", F.col("w").cast("int").alias("wave"))
        status = state.groupBy(F.col("a").alias("of")).agg(F.max(F.when(F.col("b").isNull(), F.col("w"))).alias("least"), F.count("b").alias("open"), F.min("b").alias("next"), F.max(F.when(F.col("b").isNotNull(), F.col("w"))).alias("span"))
        met = _met(state.where("b is not null"), status, F.col("b") == F.col("of"))
        closed = met.where("open < 2").select("a", F.lit(None).cast(state.schema["b"].dataType).alias("b"), (F.col("least") + F.col("w")).alias("w"))
        drawn = met.where("open > 0").select("a", F.when(F.col("open") == 1, F.col("next")).otherwise(F.col("b")).alias("b"), F.when(F.col("open") == 1, F.col("w") + F.col("span")).otherwise(F.col("w")).alias("w"))
        new = state.where("b is null").union(closed).union(drawn).groupBy("a", "b").agg(F.max("w").alias("w"))
        state, left = staged_with(new, F.when(F.max("w") > n, F.lit(-1).cast("long")).otherwise(F.count("b")), "waves")
        if left < 0:  # a path longer than there are nodes
            raise RuntimeError("load order has a circle; are components missing?")
    raise RuntimeError("load order did not settle")


def follow(links: DataFrame) -> DataFrame:
    """links (node, next, w), a row a node, followed to the end of every path at once: next is null and w the sum on the way.

    A null next ends a path, and so does one that is no node of links. Every round joins each node with what its next has found, so
    paths double in a round. What then still has a next leads into a circle."""
    state, left = staged_with(links.select("node", "next", F.col("w").cast("long").alias("w")), F.count("next"), "links")
    ended: list[DataFrame] = []
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        ended.append(state.where("next is null"))
        ahead = reduce(DataFrame.union, ended, state.where("next is not null")).select(F.col("node").alias("of"), F.col("next").alias("then"), F.col("w").alias("more"))
        met = _met(state.where("next is not null"), ahead, F.col("next") == F.col("of"), "left")
        state, left = staged_with(met.select("node", F.col("then").alias("next"), (F.col("w") + F.coalesce("more", F.lit(0).cast("long"))).alias("w")), F.count("next"), "links")
    return reduce(DataFrame.union, ended, state)


def row_waves(edges: DataFrame) -> DataFrame:
    """load_waves() of a hierarchy of rows: where every node points to at most one other, its wave is the length of its path.

    Edges of another kind, or in a circle, take the way by components and load_waves()."""
    up = edges.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.max("dst").alias("last"), F.lit(1).alias("w"))
    links, several = staged_with(up, F.count_if(F.col("next") != F.col("last")), "links")
    found = None if several else follow(links)
    if found is None or not found.where("next is not null").isEmpty():
        return load_waves(edges, staged(components(edges), "components"))
    ends = edges.select(F.col("dst").alias("node")).union(edges.where("src = dst").select("src")).distinct()
    return found.select("node", F.col("w").cast("int").alias("wave")).union(_met(ends, links.select("node"), "node", "left_anti").select("node", F.lit(0).alias("wave")))


def load_steps(edges: DataFrame) -> DataFrame:
    """(table_name, wave, step, break_edge) of every table: when it is loaded, and how.

    step is `single`, or for tables of a component `two-phase` (break_edge, as src.field, is left empty at first) or `skipped`."""
    labels = staged(components(edges), "components")
    waves = load_waves(edges, labels).select("node", "wave")
    broken = break_edges(edges, labels).select("component", F.concat_ws(".", "break_src", "break_field").alias("said"), F.col("break_src").isNotNull().alias("free"))
    how = _met(labels, broken, "component").select("node", F.when(F.col("free"), "two-phase").otherwise("skipped").alias("step"), F.when(F.col("free"), F.col("said")).alias("break_edge"))
    return _met(waves, how, "node", "left").select(F.col("node").alias("table_name"), "wave", F.coalesce("step", F.lit("single")).alias("step"), "break_edge")


def feedback_edges(edges: DataFrame, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(edges to leave out at first, components that stay): without the former, the latter are all that is cyclic.

    Only nillable edges are left out. In each component, tables that many others point to come first (by edges in less edges
    out); nillable edges against that order go, or, if there are none, the component's break edge. That is repeated on what
    stays cyclic, until the components left have required edges alone and cannot be loaded."""
    every = staged(edges.withColumn("__id", F.monotonically_increasing_id()), "edges")
    gone: DataFrame | None = None
    rest = every
    for _ in range(most):
        labels = staged(components(rest), "components")
        a, b = labels.select(F.col("node").alias("src"), "component"), labels.select(F.col("node").alias("dst"), F.col("component").alias("other"))
        inner = staged(_met(_met(rest, a, "src"), b, "dst").where("component = other").drop("other"), "inner")
        surplus = inner.select(F.col("src").alias("node"), F.lit(-1).alias("s")).union(inner.select("dst", F.lit(1))).groupBy("node").agg(F.struct((-F.sum("s")).alias("s"), F.col("node").alias("name")).alias("place"))
        place = lambda end: surplus.select(F.col("node").alias(end), F.col("place").alias(f"{end}_place"))
        against = F.col("src_place") <= F.col("dst_place")  # an edge to itself too
        free = _met(_met(inner.where("nillable"), place("src"), "src"), place("dst"), "dst").select("component", "__id", "pos", against.alias("against"))
        chosen = free.groupBy("component").agg(F.count_if("against").alias("n"), F.min_by("__id", F.struct("pos", "__id")).alias("first"))
        cut, n = staged_count(_met(free, chosen, "component").where("against or (n = 0 and __id = first)").select("__id"), "cut")
        if not n:
            out = every.where("false") if gone is None else _met(every, gone, "__id", "left_semi")
            return out.drop("__id"), labels
        gone = cut if gone is None else gone.union(cut)
        rest = staged(_met(inner.drop("component"), cut, "__id", "left_anti"), "rest")  # what lies between components stays out of cycles
    raise RuntimeError("feedback edges did not settle")


def scope_paths(edges: DataFrame, root: str, lookups: DataFrame, max_hops: int) -> DataFrame:
    """(node, kind) of the ways that tables belong to root, each once. Transitive parents count only without another way.

    lookups (child, field) are followed one hop from direct children."""
    up = edges.where((F.col("src") == root) & (F.col("dst") != root)).select(F.col("dst").alias("node"), F.lit("direct-parent").alias("kind"))
    down = edges.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("src").alias("node"), F.lit("direct-child").alias("kind"))
    children = down.select(F.col("node").alias("src")).distinct()
    named = lookups.select(F.col("child").alias("src"), "field")
    look = edges.join(children, "src", "left_semi").join(named, ["src", "field"], "left_semi").where((F.col("dst") != root) & (F.col("dst") != F.col("src"))).select(F.col("dst").alias("node"), F.lit("child-lookup").alias("kind"))
    near = staged(up.union(down).union(look).distinct(), "paths")
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    far = walk(edges, start, max_hops).where("depth >= 2").select("node").join(near, "node", "left_anti").select("node", F.lit("transitive").alias("kind"))
    return start.select("node", F.lit("root").alias("kind")).union(near).union(far.where(F.col("node") != root))


def paths_of(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, kind) of the tables that a run asks for (node): their ways to the root, or `unknown` where there is none."""
    return wanted.select("node").distinct().join(paths, "node", "left").select("node", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def lookup_errors(requests: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Requested (child, field) lookups that cannot be followed, and why."""
    children = edges.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("src").alias("child")).distinct().withColumn("is_child", F.lit(True))
    fields = edges.select(F.col("src").alias("child"), "field").distinct().withColumn("is_field", F.lit(True))
    r = requests.join(children, "child", "left").join(fields, ["child", "field"], "left")
    return r.withColumn("error", F.when(F.col("is_child").isNull(), "not-a-child").when(F.col("is_field").isNull(), "not-a-reference")).where("error is not null").select("child", "field", "error")


def classify(edges: DataFrame, root: str, hops: int, stop: DataFrame) -> DataFrame:
    """(node, bucket): must-include (reached by required edges alone), optional-parent or optional-child."""
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    must = staged(closure(edges.where("not nillable"), start, stop).join(stop.select(F.col(stop.columns[0]).alias("node")), "node", "left_anti").where(F.col("node") != root), "must")
    walked = walk(edges, start, hops, stop).where("depth > 0").select("node")
    children = edges.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("src").alias("node")).distinct()
    hidden = must.union(stop.select(F.col(stop.columns[0]).alias("node"))).union(start).distinct()
    parents = walked.join(hidden, "node", "left_anti")
    return must.select("node", F.lit("must-include").alias("bucket")).union(parents.select("node", F.lit("optional-parent").alias("bucket"))).union(
        children.join(hidden, "node", "left_anti").join(parents, "node", "left_anti").select("node", F.lit("optional-child").alias("bucket"))
    )


def required_warnings(edges: DataFrame, buckets: DataFrame, root: str) -> DataFrame:
    """Per optional table and required field of which no target is root or must-include: one row with a target to choose."""
    optional = buckets.where("bucket <> 'must-include'").select(F.col("node").alias("src")).distinct()
    state = buckets.select(F.col("node").alias("dst"), "bucket")
    e = edges.where("not nillable").join(optional, "src", "left_semi").join(state, "dst", "left")
    met = (F.col("dst") == root) | F.coalesce(F.col("bucket") == "must-include", F.lit(False))
    choice = F.min(F.struct(F.col("bucket").isNull().alias("missing"), F.col("dst").alias("dst")))
    out = e.groupBy("src", "field").agg(F.max(met).alias("met"), choice.alias("t"), F.count_distinct("dst").alias("targets")).where("not met")
    return out.select(F.col("src").alias("node"), "field", F.col("t.dst").alias("target"), F.when(F.col("t.missing"), "missing").otherwise("optional").alias("status"), "targets")


def node_summary(columns: DataFrame, depths: DataFrame, counts: DataFrame) -> DataFrame:
    """Per table: number of columns, distance from the root (null if not walked) and rows."""
    own = columns.groupBy(F.col("table_name").alias("node")).agg(F.count(F.lit(1)).alias("fields"), F.count_if("calculated").alias("calculated"))
    return own.join(depths, "node", "left").join(counts, "node", "left").select("node", "fields", "calculated", F.col("depth").cast("bigint").alias("depth"), F.coalesce("n", F.lit(0)).alias("n"))


def node_roles(edges: DataFrame, columns: DataFrame, depths: DataFrame, root: str, standard: list[str]) -> DataFrame:
    """Per table named anywhere: described, role (root, standard-root, parent, child), depth, and its columns by drop reason."""
    own = columns.withColumn("why", drop_reason()).groupBy(F.col("table_name").alias("node")).agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("why") == "formula").alias("formula"), F.count_if(F.col("why") == "audit").alias("audit"),
        F.count_if(F.col("why") == "non-createable").alias("non_createable"), F.count_if(F.col("why").isNull() & is_sensitive()).alias("sensitive"),
    )
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(own.select("node")).distinct()
    children = edges.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("src").alias("node")).distinct().withColumn("is_child", F.lit(True))
    role = F.when(F.col("node") == root, "root").when(F.col("node").isin(standard), "standard-root").when(F.col("depth").isNull() & F.col("is_child"), "child").otherwise("parent")
    all_of = nodes.join(own, "node", "left").join(depths, "node", "left").join(children, "node", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("formula", "audit", "non_createable", "sensitive")]
    return all_of.select("node", F.col("fields").isNotNull().alias("described"), role.alias("role"), F.col("depth").cast("bigint").alias("depth"), F.coalesce("fields", F.lit(0)).alias("fields"), *counts)
