"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Random hyperplanes deal the nodes into leaves of at most LEAF, and all pairs of a
leaf give every node its first list of K neighbours. Each round then joins neighbours of neighbours: the nodes of a home
leaf and all that their lists name meet in one block, compare by one matrix product, and improve the lists of all of
them, until lists hardly change.

A list whose last neighbour still links is saturated: it can't hold all links. Blocks therefore also give a spanning
forest of the links that lists have no room for. Saturated nodes then search again, for links beyond their own
component, until a search finds none. A component with saturated nodes is compared whole, block by block, which counts
every link and emits none. So there is no cap on links, and groups of thousands of near copies cost block pairs, spread
over tasks, not rows.

An audit compares a sample of nodes with every node and counts the links that the search has missed, saturated nodes
included; it adds none. At least ENOUGH must be found. If not, TREES more partitions are searched from where the lists
stand; after ATTEMPTS of them all pairs of a label are compared in blocks, which is exact and quadratic. The audit's figures
are logged.

Vectors that are null, empty, zero or hold null or non-finite components, and those of null label, link with nothing;
vectors of different length are never compared; an empty table gives an empty result; rows that repeat a vec_id are one
more copy of their vector; rows of null vec_id take part and keep it, but never name a component: one of such rows alone has
no name, and one of its rows is kept; ties in lists go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import connected

K, LEAF, TREES, ROUNDS, ATTEMPTS, AUDIT, ENOUGH, BLOCK, WHOLE = 12, 256, 4, 8, 4, 512, 0.995, 256, 2048
LOG = logging.getLogger(__name__)
EDGES = "id long, other long, sim double"


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge components would overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_edges(id_: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(id_, pa.int64()), "other": pa.array(other, pa.int64()), "sim": pa.array(sim, pa.float64())})


def least_members(near: np.ndarray) -> np.ndarray:
    """The least member of the component of each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        new = label.copy()
        for k in range(0, len(near), 512):
            new[k : k + 512] = np.minimum(label[k : k + 512], np.where(near[k : k + 512], label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def best_in(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """For each node of a block, its K nearest there that beat the last of its list; and, where a list can't hold all links
    of the block, a spanning forest of the links, as ties. Nodes of one colour don't see each other."""

    def best_of(group: pa.Table) -> pa.Table:
        ids, x = group["id"].to_numpy(), matrix(group["v"])
        floor = group["floor"].to_numpy() if "floor" in group.column_names else np.full(len(ids), -2.0)
        colour = group["colour"].to_numpy() if "colour" in group.column_names else None
        k, out = min(K, len(ids) - 1), []
        near = np.zeros((len(ids), len(ids)), bool)
        for at in range(0, len(ids), 512):
            if k < 1:
                break
            s = x[at : at + 512] @ x.T
            rows = np.arange(len(s))
            s[rows, rows + at] = -3.0
            if colour is not None:
                s[colour[at : at + 512, None] == colour[None, :]] = -3.0
            near[at : at + 512] = s >= threshold
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(s, best, axis=1)
            good = sim > floor[at : at + 512, None]
            out.append((np.repeat(ids[at : at + 512], good.sum(axis=1)), ids[best[good]], sim[good]))
        lists = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        n = near.sum(axis=1)
        full = (n > K) | ((n > 0) & ((floor >= threshold) | (colour is not None)))
        if full.any():
            near |= near.T  # rounding may differ
            label = least_members(near)
            tied = np.flatnonzero(np.isin(label, label[full]) & (label != np.arange(len(ids))))
        else:
            tied = label = np.empty(0, int)
        table = as_edges(*(np.r_[c, t] for c, t in zip(lists, (ids[tied], ids[label[tied]], np.ones(len(tied))), strict=True)))
        return table.append_column("tie", pa.array(np.repeat([False, True], [len(lists[0]), len(tied)])))

    return best_of


def leaves(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """id, tree, leaf: TREES partitions of the nodes of a label by the signs of random projections, in leaves of about LEAF at most."""
    sizes = cut(nodes.groupBy("g").agg(F.count("*").alias("n")))
    small = sizes.count() <= 100_000
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (LEAF / 2)))).cast("int")
    deep = nodes.join(F.broadcast(sizes) if small else sizes, "g").select("id", "g", "v", F.least(depth, F.lit(24)).alias("depth"))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            code = np.zeros((len(lengths), TREES), "i8")
            for d in np.unique(lengths):
                if d not in planes:
                    planes[d] = np.random.default_rng([int(d), seed] if seed else int(d)).normal(size=(int(d), TREES * 24))
                where = np.flatnonzero(lengths == d)
                bits = (matrix(batch.column(2).take(pa.array(where))) @ planes[d] > 0).reshape(len(where), TREES, 24)
                keep = np.arange(24)[None, :] < batch.column(3).to_numpy()[where][:, None]
                code[where] = ((bits & keep[:, None, :]) << np.arange(24)).sum(axis=2)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(code), pa.list_(pa.int64()))], names=["id", "g", "codes"])

    coded = deep.mapInArrow(signs, "id long, g string, codes array<long>")
    rows = cut(coded.select("id", F.posexplode("codes").alias("tree", "code"), "g").select("id", "tree", F.xxhash64("g", "tree", "code").alias("leaf")))
    # a leaf of near copies can't be split by planes; there, chance does it
    counts = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF))
    split = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.ceil(F.col("n") / LEAF))
    return rows.join(counts, "leaf", "left").select("id", "tree", F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", split)).alias("leaf"))


def merged(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The K best of each node, and what else links: (id, other, sim) of which lists have no room, and ties."""
    once = edges.where("not tie").repartition("id").groupBy("id", "other").agg(F.max("sim").alias("sim"))  # one exchange for both
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    ranked = cut(once.withColumn("rank", F.row_number().over(order)))
    return ranked.where(F.col("rank") <= K).drop("rank"), ranked.where(F.col("rank") > K).drop("rank")


AUDITED = "id long, other long, n long"


def compared(nodes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """The links of the sample's nodes with any node of (id, g, v, whole): a row (id, other) each, but those within one whole component
    are only counted, n. The sample is bounded, so it goes along."""
    asked: dict[str, tuple[list, list, list]] = {}
    for r in sample:
        for column, value in zip(asked.setdefault(r["g"], ([], [], [])), (r["id"], r["v"], r["whole"]), strict=True):
            column.append(value)
    probes = {g: (np.array(ids), matrix(pa.array(v, pa.list_(pa.float64()))), np.array(whole, "f8")) for g, (ids, v, whole) in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = 0, ["id", "other", "n"]
        for batch in batches:
            ids, g = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            whole = batch.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False)  # numbers of components, nan if none
            for name in set(g.tolist()) & set(probes):
                of, x, of_whole = probes[name]
                where = np.flatnonzero(g == name)
                for part in np.split(where, range(256, len(where), 256)):
                    a, b = np.nonzero(matrix(batch.column(2).take(pa.array(part))) @ x.T >= threshold)
                    own = ids[part[a]] != of[b]
                    a, b = a[own], b[own]
                    inside = whole[part[a]] == of_whole[b]
                    n += int(inside.sum())
                    a, b = a[~inside], b[~inside]
                    if len(a):
                        yield pa.record_batch([pa.array(of[b]), pa.array(ids[part[a]]), pa.array(np.ones(len(a), "i8"))], names=names)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n])], names=names)

    return nodes.select("id", "g", "v", "whole").mapInArrow(run, AUDITED)


def audit(nodes: DataFrame, lists: DataFrame, root: DataFrame, threshold: float) -> tuple[int, int]:
    """How many links a sample of nodes has with all nodes, and how many of them the search has missed. The sample grows from AUDIT nodes
    until it has AUDIT links, to 16 times AUDIT nodes or 32 MB at most. Components with saturated nodes are counted whole later, so
    links within them count as found; their numbers are small enough to be exact as doubles."""
    saturated = full_of(lists, threshold).join(root, "node").select("root").distinct()
    numbers = cut(saturated.select("root", F.monotonically_increasing_id().alias("whole")))
    placed = cut(root.join(numbers, "root").select(F.col("node").alias("id"), "whole"))
    known = cut(nodes.select("id", "g", "v").join(placed, "id", "left"))
    n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    size, most = AUDIT, min(n, 16 * AUDIT, max(AUDIT, (32 << 20) // (8 * (width or 1))))
    while True:
        sample = known.orderBy(F.xxhash64("id")).limit(size).collect()
        truth = cut(compared(known, sample, threshold))
        links = truth.agg(F.sum("n")).first()[0] or 0
        if size >= most or links >= AUDIT:
            break
        size *= 4
    pairs = truth.where("id IS NOT NULL").select("id", "other")
    back = lists.select(F.col("other").alias("id"), F.col("id").alias("other"))
    return links, pairs.join(lists.select("id", "other").unionByName(back), ["id", "other"], "left_anti").count()


def descend(nodes: DataFrame, threshold: float, seed: int, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbour lists (id, other, sim) of the nodes (id, g, v and, if need be, colour), improved from `lists`, and ties (a, b).

    Rounds end when one brings less than one link in two hundred, or, as long as there are no links to go by, when lists hardly
    change. With colours, only ties count: the search ends where it finds some, or after two rounds without any."""
    dealt = cut(leaves(nodes, seed))
    coloured = "colour" in nodes.columns
    vectors = nodes.select("id", "v", *(c for c in nodes.columns if c == "colour"))
    best_of, edges = best_in(threshold), EDGES + ", tie boolean"
    ties = []

    def merge(found: DataFrame, lists: DataFrame | None) -> tuple[DataFrame, int]:
        known = found if lists is None else found.unionByName(lists.withColumn("tie", F.lit(False)))
        best, rest = merged(known)
        ties.append(found.where("tie").select(F.col("id").alias("a"), F.col("other").alias("b")))
        ties.append(rest.where(F.col("sim") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b")))
        return best, found.where("tie").count() if coloured else best.where(F.col("sim") >= threshold).count()

    found = cut(dealt.join(vectors, "id").select("tree", "leaf", *vectors.columns).groupBy("tree", "leaf").applyInArrow(best_of, edges))
    lists, links = merge(found, lists)
    home, n_nodes = dealt.where("tree = 0").select("id", F.col("leaf").alias("home")), nodes.count()
    for turn in range(ROUNDS):
        if coloured and (links or turn == 2):
            break
        named = lists.join(home, "id").select("home", F.col("other").alias("id"))
        meet = named.unionByName(home.select("home", "id")).distinct()
        floor = lists.groupBy("id").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(-2.0).alias("floor"))
        block = cut(vectors.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))).join(meet, "id")
        improved, more = merge(cut(block.groupBy("home").applyInArrow(best_of, edges)), lists)
        if more and not coloured:
            done = more <= 1.005 * links
        else:
            done = not coloured and improved.join(lists, ["id", "other"], "left_anti").count() <= 0.01 * n_nodes
        lists, links = improved, more
        if done:
            break
    return lists, cut(reduce(DataFrame.unionByName, ties).distinct())


def full_of(lists: DataFrame, threshold: float) -> DataFrame:
    """The saturated nodes: all of their K neighbours, or more, link."""
    return lists.groupBy(F.col("id").alias("node")).agg(F.count_if(F.col("sim") >= threshold).alias("n")).where(F.col("n") >= K).select("node")


def rooted(lists: DataFrame, ties: DataFrame, threshold: float) -> DataFrame:
    links = lists.where(F.col("sim") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return cut(connected(links.unionByName(ties)))


def bridged(nodes: DataFrame, lists: DataFrame, ties: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """ties and roots once saturated nodes have looked for links beyond their own component, until no search finds any.
    Nodes that are not saturated have found theirs already."""
    full = cut(full_of(lists, threshold))
    while True:
        root = rooted(lists, ties, threshold)
        seeking = nodes.select("id", "g", "v").join(full.join(root, "node").select(F.col("node").alias("id"), F.col("root").alias("colour")), "id")
        many = seeking.groupBy("g").agg(F.count_distinct("colour").alias("n")).where("n > 1").select("g")
        seeking = cut(seeking.join(many, "g"))
        if seeking.isEmpty():
            return ties, root
        _, more = descend(seeking, threshold, seed)
        if more.isEmpty():
            return ties, root
        ties = cut(ties.unionByName(more))


def searched(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Neighbour lists and roots (node, root) that pass the audit; None if no attempt does."""
    lists, ties = None, None
    for attempt in range(ATTEMPTS):
        lists, more = descend(nodes, threshold, 2 * attempt, lists)
        ties, root = bridged(nodes, lists, more if ties is None else ties.unionByName(more), threshold, 2 * attempt + 1)
        links, lost = audit(nodes, lists, root, threshold)
        LOG.info("attempt %d: the audit's %d links but for %d were found", attempt + 1, links, lost)
        if lost <= (1 - ENOUGH) * links:
            return lists, root
    LOG.warning("no attempt passed the audit: all pairs of each label are compared")
    return None


def whole_counts(members: DataFrame, threshold: float) -> DataFrame:
    """Over groups (id, root, v, copies), every pair in block pairs: rows (id, links) with the copies of other members that a node links
    with in a block pair, and rows (id, other) of a spanning forest of its links. Blocks grow with their group from BLOCK to WHOLE, so
    a group of n is sent n / WHOLE times at most; counts of links need all pairs, which is quadratic."""
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(WHOLE), F.count("*") / 16))
    sizes = cut(members.groupBy("root").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))
    placed = cut(members.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    against = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    pairs = placed.select("*", against.alias("o")).select("root", low.alias("i"), high.alias("j"), "b", "id", "v", "copies")

    def run(group: pa.Table) -> pa.Table:
        ids, copies, x = group["id"].to_numpy(), group["copies"].to_numpy(), matrix(group["v"])
        b, i, j = group["b"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        near = np.empty((len(x), len(x)), bool)
        for k in range(0, len(x), 512):
            near[k : k + 512] = x[k : k + 512] @ x.T >= threshold
        near |= near.T
        np.fill_diagonal(near, False)
        label = least_members(near)
        if i != j:  # links within a block are counted where it meets itself
            near &= b[:, None] != b[None, :]
        n, tied = near @ copies, np.flatnonzero(label != np.arange(len(ids)))
        own = np.flatnonzero(n)
        who, other = np.r_[ids[own], ids[tied]], np.r_[np.zeros(len(own), "i8"), ids[label[tied]]]
        links = np.r_[n[own], np.zeros(len(tied), "i8")]
        return pa.table({"id": pa.array(who, pa.int64()), "other": pa.array(other, pa.int64(), mask=np.arange(len(who)) < len(own)), "links": pa.array(links, pa.int64())})

    return cut(pairs.groupBy("root", "i", "j").applyInArrow(run, "id long, other long, links long"))


def usable(v: Column, label: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & v.isNotNull() & fine, F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Components are named by ids that rows have. Rows of a null vec_id link like all others and count as links; a component of such
    rows alone has no name (null), and one of its rows is kept."""
    bounded_batches(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v")).withColumn("good", usable(F.col("v"), F.col("label")))
    # written with a number, so that rows that are equal in all else can be told apart
    rows = cut(rows.select("vec_id", F.when(F.col("good"), F.concat("label", F.lit(":"), F.size("v"))).alias("g"), F.when(F.col("good"), F.col("v")).alias("v"), F.monotonically_increasing_id().alias("row")))
    good = rows.where(F.col("g").isNotNull())
    nodes = cut(good.groupBy("g", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("row").alias("row")).select(F.coalesce("least", F.xxhash64("g", "v")).alias("id"), "least", "row", "g", "v", "copies"))
    got = searched(nodes, threshold)
    if got is None:  # every pair, in blocks
        counted = whole_counts(nodes.select("id", F.xxhash64("g").alias("root"), "v", "copies"), threshold)
        root = cut(connected(counted.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))))
        listed = nodes.select("id", F.lit(0).cast("long").alias("listed"))
    else:
        lists, root = got
        linked = lists.where(F.col("sim") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b"))
        both = cut(linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        enlarged = cut(root.join(full_of(lists, threshold), "node").select("root").distinct())
        grown = cut(root.join(enlarged, "root").select(F.col("node").alias("id"), "root"))
        counted = whole_counts(grown.join(nodes.select("id", "v", "copies"), "id"), threshold)
        listed = both.join(nodes.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("listed"))
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    per_node = nodes.join(counted, "id", "left").join(listed, "id", "left").join(root.select(F.col("node").alias("id"), "root"), "id", "left")
    links = F.coalesce("links", "listed", F.lit(0)) + F.col("copies") - 1
    done = cut(per_node.select("g", "v", "least", "row", links.alias("n_links"), F.coalesce("root", "id").alias("root")))
    # a node without an id stands in the search under a hash, which may be its component's root but never its name
    names = cut(done.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("holder")))
    named = done.join(names, "root").select("g", "v", "n_links", "component_id", F.when(F.col("component_id").isNull(), F.col("holder")).alias("holder"))
    out = good.join(cut(named), ["g", "v"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("row") == F.col("holder"), F.lit(False)).alias("kept"))
    alone = rows.where(F.col("g").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
