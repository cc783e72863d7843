"""Parent-child links to full hierarchies: path, depth, root and descendants of every node, by heavy-path decomposition.

Steps, each over whole tables and none with more rounds than the logarithm of the longest path:

1. Vertices get compact numbers; each (type, child) keeps one parent, that of the earliest link (equal times:
   the least parent id). Further parents are counted, not followed.
2. Cycle separation by pointer doubling. A node whose pointer never leaves the links is on or below a cycle;
   the image of the doubled pointer, once it no longer shrinks, is exactly the set of nodes on cycles. Their
   own links are cut, so that each becomes the (reported) root of whatever leads into it. Where children
   have several parents, the further links may close cycles too: see multi_parent_cycles.
3. The same doubling sums subtree sizes; each node's heaviest child continues its chain, every other child
   starts one. A path meets at most log2(n) chains.
4. Doubling over heavy links alone gives each node its chain and its place in it. Paths are concatenated from
   chain segments, chain by chain; descendants are intervals of chains.

No star, however large, is ever gathered in one task: children are only aggregated (map side first) per parent.

Defined results: null or unreadable child or parent makes no link (a child with only such targets isn't a node
unless another row links it); repeated links count once; a link to itself is a cycle of one; empty input gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmill.functions.ids import uuid_key, uuid_text
from cairnmill.session import Scratch
from cairnmill.sources.tables import table

#: The relation types that link a child to its parent (fixed values of the data model).
HIERARCHY_TYPES = ("part_of", "implements", "supersedes", "refines")


def double(scratch: Scratch, name: str, links: DataFrame, sizes: bool) -> tuple[DataFrame, DataFrame | None]:
    """Follows links (v, p; p null at roots; each v once) to their ends by pointer doubling.

    Returns (v, top, dist, size) of nodes that reach an end (dist links away; size, if asked for, counts the
    nodes from which v is reached, v included) and (v, on_cycle, size) of those that never do, None if none.
    Each round, a node learns the pointer of the node it points to, and hands its size on to that node.
    """
    state = links.select("v", F.col("p").alias("ptr"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.coalesce("p", "v").alias("top"), F.lit(1).cast("long").alias("size"))
    going_on = F.count_if(F.col("ptr").isNotNull())
    state, active = scratch.keep_counting(state, name, going_on)
    before = None
    while active and active != before:  # none ended in a round: what is left leads into cycles
        going = state.filter("ptr is not null")
        target = state.select(F.col("v").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("top").alias("_top"))
        moved = going.join(target, "ptr").select("v", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_top").alias("top"), "size")
        new = moved.unionByName(state.filter("ptr is null"))
        if sizes:
            gain = going.groupBy(F.col("ptr").alias("v")).agg(F.sum("size").alias("_gain"))
            new = new.join(gain, "v", "left").select("v", "ptr", "dist", "top", (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size"))
        before = active
        state, active = scratch.keep_counting(new, name, going_on)
    ended = state.filter("ptr is null").select("v", "top", "dist", "size")
    if not active:
        return ended, None
    loop = state.filter("ptr is not null").select("v", "ptr", "size")
    rest = scratch.keep(loop, name + "-loop")
    image, before = rest.agg(F.count_distinct("ptr")).first()[0], None
    while image != before:
        rest = scratch.keep(rest.join(rest.select(F.col("v").alias("ptr"), F.col("ptr").alias("_ptr")), "ptr").select("v", F.col("_ptr").alias("ptr"), "size"), name + "-loop")
        before, image = image, rest.agg(F.count_distinct("ptr")).first()[0]
    on = rest.select(F.col("ptr").alias("v")).distinct().withColumn("on_cycle", F.lit(True))
    return ended, rest.select("v", "size").join(on, "v", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))


def multi_parent_cycles(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """v of every node on a cycle of general edges (v, p), where nodes may have several parents.

    Ends are peeled off, then the least and greatest label that reaches a node and that a node reaches are
    spread; nodes whose labels meet are settled, and links between different labels are dropped. Exact; needs
    as many rounds as the longest remaining path, so it is only used where a child has several parents.
    """
    edges = scratch.keep(edges.distinct(), "mp-edges")
    found = None
    count = edges.count()
    while count:
        while True:  # peel nodes without a link in or out
            less = edges.join(edges.select(F.col("p").alias("v")).distinct(), "v", "left_semi")
            less = less.join(edges.select(F.col("v").alias("p")).distinct(), "p", "left_semi").select("v", "p")
            edges = scratch.keep(less, "mp-edges")
            before, count = count, edges.count()
            if count == before:
                break
        if not count:
            break
        label = {}
        for side, (a, b) in {"up": ("v", "p"), "down": ("p", "v")}.items():
            lab = scratch.keep(edges.select(F.explode(F.array("v", "p")).alias("x")).distinct().withColumn("l", F.col("x")), f"mp-{side}")
            while True:
                got = edges.join(lab, edges[b] == lab["x"]).groupBy(F.col(a).alias("x")).agg(F.max("l").alias("g"))
                new = scratch.keep(lab.join(got, "x", "left").select("x", F.greatest("l", F.coalesce("g", "l")).alias("l"), (F.coalesce("g", "l") > F.col("l")).alias("ch")), f"mp-{side}n")
                changed = new.filter("ch").count()
                lab = scratch.keep(new.select("x", "l"), f"mp-{side}")
                if not changed:
                    break
            label[side] = lab
        both = label["up"].withColumnRenamed("l", "u").join(label["down"].withColumnRenamed("l", "d"), "x")
        both = scratch.keep(both, "mp-both")
        # u is the greatest node x reaches (or x), d the greatest that reaches x (or x): if they are one node, x lies on a cycle with it
        scc = both.filter("u = d").select("x", "u")
        inner = edges.join(scc.select(F.col("x").alias("v"), F.col("u").alias("_a")), "v").join(scc.select(F.col("x").alias("p"), F.col("u").alias("_b")), "p").filter("_a = _b")
        on = inner.select("v").distinct()
        found = scratch.keep(on if found is None else found.union(on).distinct(), "mp-found")
        settled = both.filter("u = d").select("x")
        keep = edges.join(settled.select(F.col("x").alias("v")), "v", "left_anti").join(settled.select(F.col("x").alias("p")), "p", "left_anti")
        edges = scratch.keep(keep.select("v", "p"), "mp-edges")
        count = edges.count()
    return found if found is not None else edges.select("v")


class Hierarchy:
    """nodes: (v, type_id, id, p, root, depth, size, on_cycle, chain, pos, parents); see paths() and descendants()."""

    def __init__(self, links: DataFrame):
        """links: (type_id, child, parent, first_seen), child and parent as 16 bytes, in any number of copies."""
        self.scratch = s = Scratch(links.sparkSession)
        picked = F.struct(F.coalesce("first_seen", F.timestamp_seconds(F.lit(253402300799))).alias("at"), "parent")
        one = (
            links.filter("child is not null and parent is not null")
            .groupBy("type_id", "child")
            .agg(F.min(picked)["parent"].alias("parent"), F.min("parent").alias("_lo"), F.max("parent").alias("_hi"))
            .withColumn("several", F.col("_lo") != F.col("_hi"))
            .drop("_lo", "_hi")
        )
        one = s.keep(one, "links")
        several = one.filter("several").limit(1).count() > 0
        ends = links.filter("child is not null and parent is not null") if several else one  # else each child's one parent is all there is
        vertices = ends.select("type_id", F.explode(F.array("child", "parent")).alias("id")).distinct()
        vertices = s.keep(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
        number = vertices.select("type_id", F.col("id").alias("parent"), F.col("v").alias("p"))
        numbered = vertices.join(one.withColumnRenamed("child", "id"), ["type_id", "id"], "left").select("v", "type_id", "parent", "several")
        numbered = s.keep(numbered.join(number, ["type_id", "parent"], "left").select("v", "p", F.coalesce("several", F.lit(False)).alias("several")), "numbered")
        ended, looped = double(s, "forest", numbered.select("v", "p"), True)
        cut = looped.filter("on_cycle").select("v") if looped is not None else None
        if several:
            n = vertices.select("type_id", F.col("id"), "v")
            every = (
                links.filter("child is not null and parent is not null")
                .join(n.select("type_id", F.col("id").alias("child"), "v"), ["type_id", "child"])
                .join(n.select("type_id", F.col("id").alias("parent"), F.col("v").alias("p")), ["type_id", "parent"])
                .select("v", "p")
            )
            more = multi_parent_cycles(s, every)
            cut = s.keep(more if cut is None else more.union(cut).distinct(), "cut")
            links_now = numbered.join(cut, "v", "left_anti").select("v", "p").unionByName(cut.withColumn("p", F.lit(None).cast("long")))
            forest, _ = double(s, "forest-cut", links_now, True)
        elif looped is not None:
            # nodes off the cycles have their sizes already; those on cycles and below get a second, small run with the cycles cut
            loop = s.keep(looped.join(numbered.select("v", "p"), "v").select("v", F.when(~F.col("on_cycle"), F.col("p")).alias("p"), "on_cycle"), "loop")
            below, _ = double(s, "below", loop.select("v", "p"), True)
            forest = ended.unionByName(below)
            cut = loop.filter("on_cycle").select("v")
        else:
            forest = ended
        tree = numbered.join(forest, "v").select("v", "p", "several", F.col("top").alias("root"), F.col("dist").alias("depth"), "size")
        if cut is not None:
            tree = tree.join(cut.withColumn("on_cycle", F.lit(True)), "v", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
            tree = tree.withColumn("p", F.when(~F.col("on_cycle"), F.col("p")))
        else:
            tree = tree.withColumn("on_cycle", F.lit(False))
        tree = s.keep(tree, "tree")
        heavy = tree.filter("p is not null").groupBy("p").agg(F.max_by("v", F.struct("size", -F.col("v"))).alias("v")).select("v", F.lit(True).alias("heavy"))
        down = tree.join(heavy, "v", "left").select("v", F.when(F.col("heavy"), F.col("p")).alias("p"))
        chains, _ = double(s, "chains", down, False)
        chains = chains.select("v", F.col("top").alias("chain"), F.col("dist").alias("pos"))
        self.nodes = s.keep(tree.join(chains, "v").join(vertices, "v"), "nodes")

    def chain_paths(self) -> DataFrame:
        """(chain, prefix): ids from the root down to the node that the chain hangs from, concatenated from segments of the chains above.

        A chain is a path, so no array is longer than the deepest path.
        """
        s = self.scratch
        segment = s.keep(self.nodes.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")), "segments")
        head = self.nodes.filter("pos = 0").select("chain", "p")
        above = self.nodes.select(F.col("v").alias("p"), F.col("chain").alias("up"), F.col("pos").alias("at"))
        hangs = s.keep(head.join(above, "p", "left").select("chain", "up", "at"), "hangs")
        level = s.keep(hangs.filter("up is null").select("chain", F.array().cast("array<binary>").alias("prefix")), "level-0")
        done, n = level, 0
        while True:
            full = level.join(segment, "chain").select(F.col("chain").alias("up"), "prefix", "ids")
            n += 1
            level = s.keep(hangs.join(full, "up").select("chain", F.concat("prefix", F.slice("ids", F.lit(1), (F.col("at") + 1).cast("int"))).alias("prefix")), f"level-{n}")
            if level.isEmpty():
                break
            done = done.unionByName(level)
        return done.join(segment, "chain")

    def paths(self) -> DataFrame:
        """One row for each node with its path from the root to itself, as ids."""
        root = self.nodes.select(F.col("v").alias("root"), F.col("id").alias("root_id"), F.col("on_cycle").alias("leads_into_cycle"))
        return (
            self.nodes.join(root, "root")
            .join(self.chain_paths(), "chain")
            .select(
                "type_id",
                uuid_text(F.col("id")).alias("entity_id"),
                F.when(F.col("on_cycle"), "cycle").when(F.col("leads_into_cycle"), "below_cycle").otherwise("tree").alias("status"),
                "depth",
                uuid_text(F.col("root_id")).alias("root_id"),
                F.transform(F.concat("prefix", F.slice("ids", F.lit(1), (F.col("pos") + 1).cast("int"))), uuid_text).alias("path"),
                (F.col("size") - 1).alias("n_descendants"),
            )
        )

    def descendants(self) -> DataFrame:
        """Chain intervals: one row (type_id, chain_id, chain_pos, descendant_id, depth) for each node and each chain on its path.

        The descendants of a node at (chain_id, chain_pos) are the rows of its chain with a place greater than
        its own, and nodes hanging from its own place (hangs true). A node has at most log2(n) rows; the one with hangs false is its own place.
        """
        s = self.scratch
        n = self.nodes
        head = n.filter("pos = 0").select("chain", F.col("p").alias("_p"))
        above = n.select(F.col("v").alias("_p"), F.col("chain").alias("up"), F.col("pos").alias("at"))
        hangs = s.keep(head.join(above, "_p").select("chain", "up", "at"), "hangs-d")
        level = s.keep(n.select("v", "type_id", "id", "depth", "chain", F.col("pos").alias("at"), F.lit(False).alias("hangs")), "d-0")
        done, k = level, 0
        while True:
            k += 1
            level = s.keep(level.drop("at", "hangs").join(hangs, "chain").select("v", "type_id", "id", "depth", F.col("up").alias("chain"), "at", F.lit(True).alias("hangs")), f"d-{k}")
            if level.isEmpty():
                break
            done = done.unionByName(level)
        first = n.filter("pos = 0").select("chain", uuid_text(F.col("id")).alias("chain_id"))
        return done.join(first, "chain").select("type_id", "chain_id", F.col("at").alias("chain_pos"), uuid_text(F.col("id")).alias("descendant_id"), "depth", "hangs")


def hierarchy_links(spark: SparkSession, folder: str, names: tuple[str, ...] = HIERARCHY_TYPES) -> DataFrame:
    """Links of the named types. The ids of those few types are looked up first, so that the filter reaches the scan."""
    ids = [r[0] for r in table(spark, folder, "relation_types").filter(F.col("name").isin(*names)).select("id").distinct().collect()]
    rel = table(spark, folder, "relations")
    return rel.filter(F.col("type_id").isin(ids) if ids else F.lit(False)).select(
        "type_id",
        uuid_key(F.col("source_entity_id")).alias("child"),
        uuid_key(F.col("target_entity_id")).alias("parent"),
        F.coalesce("recorded_at", "arrived_at").alias("first_seen"),
    )


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that are their own ancestor, by type."""
    nodes = Hierarchy(hierarchy_links(spark, folder)).nodes
    return nodes.filter("on_cycle").select("type_id", uuid_text(F.col("id")).alias("entity_id"))


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return Hierarchy(hierarchy_links(spark, folder)).paths()


def descendants(spark: SparkSession, folder: str) -> DataFrame:
    return Hierarchy(hierarchy_links(spark, folder)).descendants()
