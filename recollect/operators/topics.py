"""Topic trees: leader clustering, splitting and merging leaves, hierarchy, names.

The tree is built from all entries by one sequential kernel, for each insertion depends on those before it; what it
returns are two flat tables, nodes and members. Products are taken for many entries at once. Bodies too large for one
kernel are first grouped by a distributed spherical k-means (:func:`coarse_groups`), and the kernel then runs in each group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X

LEAF_MAX, MIDDLE_MIN, SMALL_MIN = 8, 5, 3
SEED, ROUNDS, SAMPLE = 42, 30, 20
MAX_DEPTH, MAX_CHILDREN, MIN_ROOTS = 3, 8, 4
#: Leaves that are multiplied with all at once; products that are held at once; products that may be equal but for rounding.
ROWS, HELD, CLOSE = 512, 1 << 22, 1e-9

NODES = "node_id string, parent_id string, depth int, size int, leaf boolean, avg_sim double, centroid array<double>"
MEMBERS = "node_id string, memory_id string"


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else v


@dataclass
class Leaf:
    members: list[int]
    centroid: np.ndarray
    avg_sim: float = 1.0


@dataclass
class Node:
    children: list[Node] = field(default_factory=list)
    leaf: Leaf | None = None

    def leaves(self) -> list[Leaf]:
        return [self.leaf] if self.leaf else [x for c in self.children for x in c.leaves()]

    def centroid(self) -> np.ndarray:
        own = self.leaves()
        return unit(sum(x.centroid * len(x.members) for x in own))


class Builder:
    """Leaves over unit vectors ``x`` with tag sets, in the given order."""

    def __init__(self, x: np.ndarray, tags: list[set[str]], t: S.Thresholds = S.DEFAULTS):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        self.x = np.where(n > 1e-12, x / np.maximum(n, 1e-12), x)
        self.tags, self.t = tags, t
        self.leaves: list[Leaf] = []
        self.centres = np.empty((0, self.x.shape[1]))  # of the leaves, in the tree's order, and room for more
        self.block = self.x[:0]  # vectors whose products with the centres are held
        self.products, self.at = np.empty((0, 0)), 0  # these products, and the vector that is looked for

    def fit(self, members: list[int]) -> Leaf:
        c = unit(self.x[members].mean(0))
        return Leaf(list(members), c, float((self.x[members] @ c).mean()))

    def put(self, at: int, centroid: np.ndarray) -> None:
        if at == len(self.centres):
            self.centres = np.concatenate([self.centres, np.empty((max(64, at), self.x.shape[1]))])
        self.centres[at] = centroid
        self.products[self.at + 1 :, at] = self.block[self.at + 1 :] @ centroid

    def hold(self, vectors: np.ndarray, n: int) -> int:
        """Take the products of the first of ``vectors`` with the first ``n`` centres at once; how many. Each may add one centre."""
        self.block, self.at = vectors[: min(ROWS, max(1, HELD // max(1, n)))], 0
        self.products = np.empty((len(self.block), n + len(self.block)))
        self.products[:, :n] = self.block @ self.centres[:n].T
        return len(self.block)

    def nearest(self, n: int, among: np.ndarray | None = None) -> tuple[int, float]:
        """Of the first ``n`` centres the one of the largest product with the vector looked for and that product; of equal ones the first."""
        v, sims = self.block[self.at], self.products[self.at, :n]
        if among is not None:
            sims = np.where(among, sims, -np.inf)
        close = np.flatnonzero(sims >= sims.max() - CLOSE)
        if not len(close):
            close = np.array([sims.argmax()])
        exact = [float(self.centres[k] @ v) for k in close]
        best = int(np.argmax(exact))
        return int(close[best]), exact[best]

    def insert_all(self) -> None:
        """All entries in their order."""
        i = 0
        while i < len(self.x):
            for k in range(self.hold(self.x[i:], len(self.leaves))):
                self.at = k
                self.insert(i)
                i += 1

    def insert(self, i: int) -> None:
        """Into the nearest leaf if near enough and not looser than it; else into one of its own."""
        if self.leaves:
            best, s = self.nearest(len(self.leaves))
            leaf = self.leaves[best]
            if s >= self.t.topic_assign and (len(leaf.members) < 3 or s >= 0.8 * leaf.avg_sim):
                n = len(leaf.members)
                leaf.members.append(i)
                leaf.centroid = unit((leaf.centroid * n + self.x[i]) / (n + 1))
                leaf.avg_sim = (leaf.avg_sim * n + s) / (n + 1)
                self.put(best, leaf.centroid)
                return
        self.put(len(self.leaves), self.x[i])
        self.leaves.append(Leaf([i], self.x[i].copy()))

    def kmeans(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Labels by spherical k-means with k-means++ seeds."""
        n = len(rows)
        if n <= k:
            return np.arange(n)
        rng = np.random.default_rng(SEED)
        centres = [rows[rng.integers(n)]]
        while len(centres) < k:
            far = np.clip(1 - np.max(rows @ np.array(centres).T, axis=1), 0, None)
            centres.append(rows[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)])
        c, label = np.array(centres), None
        for _ in range(ROUNDS):
            new = (rows @ c.T).argmax(1)
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([unit(rows[label == j].mean(0)) if (label == j).any() else c[j] for j in range(k)])
        return label

    def inner(self, members: list[int]) -> float:
        """Mean similarity of a bounded sample of pairs."""
        own = members
        if len(own) > SAMPLE:
            own = np.random.default_rng(SEED).choice(own, SAMPLE, replace=False)
        s = self.x[own] @ self.x[own].T
        n = len(own)
        return float((s.sum() - np.trace(s)) / (n * (n - 1))) if n > 1 else 1.0

    def loose(self, members: list[int]) -> bool:
        n, t = len(members), self.t
        if n < SMALL_MIN:
            return False
        least = t.topic_split_large if n > LEAF_MAX else t.topic_split_medium if n >= MIDDLE_MIN else t.topic_split_small
        return self.inner(members) < least

    def split(self) -> None:
        todo, done = [leaf.members for leaf in self.leaves], []
        while todo:
            own = todo.pop()
            if not self.loose(own):
                done.append(self.fit(own))
                continue
            label = self.kmeans(self.x[own], 3 if len(own) > 60 else 2)
            parts = [[m for m, j in zip(own, label) if j == k] for k in np.unique(label)]
            if len(parts) < 2:
                done.append(self.fit(own))
            else:
                todo += parts
        self.leaves = sorted(done, key=lambda leaf: min(leaf.members))

    def leaf_tags(self, leaf: Leaf) -> set[str]:
        return set().union(*(self.tags[m] for m in leaf.members))

    def merge(self) -> None:
        """Small similar leaves become one, each at most once."""
        tags = [self.leaf_tags(x) for x in self.leaves]
        c = np.array([x.centroid for x in self.leaves])
        sizes, pairs = np.array([len(x.members) for x in self.leaves]), []
        for lo in range(0, len(c), ROWS):
            most = self.t.cosine_weight * (c[lo : lo + ROWS] @ c[lo:].T) + self.t.tag_weight
            fits = np.triu((most >= self.t.topic_merge - CLOSE) & (sizes[lo : lo + ROWS, None] + sizes[None, lo:] <= LEAF_MAX), 1)
            for i, j in (np.argwhere(fits) + lo).tolist():
                both = tags[i] | tags[j]
                s = self.t.cosine_weight * float(c[i] @ c[j]) + self.t.tag_weight * (len(tags[i] & tags[j]) / len(both) if both else 0.0)
                if s >= self.t.topic_merge:
                    pairs.append((-s, i, j))
        used, out = set(), []
        for _, i, j in sorted(pairs):
            if i not in used and j not in used:
                used |= {i, j}
                out.append(self.fit(sorted(self.leaves[i].members + self.leaves[j].members)))
        self.leaves = sorted([x for n, x in enumerate(self.leaves) if n not in used] + out, key=lambda leaf: min(leaf.members))

    def absorb(self) -> None:
        """Tiny leaves go into their nearest leaf with room."""
        leaves, n = list(self.leaves), len(self.leaves)
        sizes, alive = np.zeros(2 * n, int), np.arange(2 * n) < n
        sizes[:n] = [len(x.members) for x in leaves]
        self.centres = np.concatenate([[x.centroid for x in leaves], np.empty((n, self.x.shape[1]))]) if n else self.centres
        tiny = [k for k in range(n) if sizes[k] <= self.t.topic_absorb_size]
        tiny.sort(key=lambda k: (sizes[k], min(leaves[k].members)))
        held = 0
        for done, at in enumerate(tiny):
            if done == held:
                held += self.hold(np.array([leaves[k].centroid for k in tiny[held : held + ROWS]]), len(leaves))
                first = done
            self.at, leaf = done - first, leaves[at]
            if not alive[at]:
                continue
            room = (alive & (sizes + len(leaf.members) <= LEAF_MAX))[: len(leaves)]
            room[at] = False
            if not room.any():
                continue
            near, s = self.nearest(len(leaves), room)
            if s >= self.t.topic_absorb:
                new = len(leaves)
                leaves.append(self.fit(sorted(leaves[near].members + leaf.members)))
                alive[[at, near]], alive[new], sizes[new] = False, True, len(leaves[new].members)
                self.put(new, leaves[new].centroid)
        self.leaves = sorted([x for x, on in zip(leaves, alive) if on], key=lambda leaf: min(leaf.members))

    def budget(self) -> None:
        """The most similar leaves become one until no more than the budget are left.

        Each leaf knows its nearest among those after it, so a merge looks anew only for those whose nearest it took.
        """
        leaves, over = list(self.leaves), len(self.leaves) - self.t.topic_leaf_budget
        if over <= 0:
            return
        n = len(leaves)
        c = np.concatenate([[x.centroid for x in leaves], np.zeros((over, self.x.shape[1]))])
        alive = np.arange(n + over) < n
        best, where = np.full(n + over, -2.0), np.full(n + over, -1)
        for lo in range(0, n, ROWS):
            s = np.where(np.arange(n)[None, lo:] > np.arange(lo, min(lo + ROWS, n))[:, None], c[lo : lo + ROWS][: n - lo] @ c[lo:n].T, -2)
            where[lo : lo + len(s)] = s.argmax(1) + lo
            best[lo : lo + len(s)] = s.max(1)
        for new in range(n, n + over):
            i = int(best.argmax())
            j = int(where[i])
            leaves.append(self.fit(sorted(leaves[i].members + leaves[j].members)))
            alive[[i, j]], best[[i, j]] = False, -2
            c[new], alive[new] = leaves[-1].centroid, True
            for k in np.flatnonzero(alive[:new] & ((where[:new] == i) | (where[:new] == j))):
                after = k + 1 + np.flatnonzero(alive[k + 1 : new])
                sims = c[after] @ c[k] if len(after) else np.array([-2.0])
                best[k], where[k] = sims.max(), after[sims.argmax()] if len(after) else -1
            old = np.flatnonzero(alive[:new])
            sims = c[old] @ c[new]
            nearer = sims > best[old]
            best[old[nearer]], where[old[nearer]] = sims[nearer], new
        self.leaves = [x for x, on in zip(leaves, alive) if on]

    def hierarchy(self) -> list[Node]:
        roots = [Node(leaf=x) for x in self.leaves]
        return self.group(roots, 1, MIN_ROOTS, (3, 12))

    def group(self, nodes: list[Node], depth: int, least: int, bounds: tuple[int, int]) -> list[Node]:
        if len(nodes) < least or depth > MAX_DEPTH:
            return nodes
        k = int(np.clip(round(len(nodes) ** 0.5), *bounds))
        if k >= len(nodes):
            return nodes
        label = self.kmeans(np.array([n.centroid() for n in nodes]), k)
        out = []
        for j in np.unique(label):
            own = [n for n, x in zip(nodes, label) if x == j]
            if len(own) == 1:
                out += own
            elif len(own) > MAX_CHILDREN and len(own) < len(nodes):
                out.append(Node(self.group(own, depth + 1, MAX_CHILDREN + 1, (2, 6))))
            else:
                out.append(Node(own))
        return out

    def build(self) -> list[Node]:
        self.insert_all()
        self.split()
        self.merge()
        self.absorb()
        self.budget()
        return self.hierarchy()


def flatten(roots: list[Node], ids: list[str], prefix: str = "kb") -> tuple[list[tuple], list[tuple]]:
    """Rows of NODES and MEMBERS, numbered from 1 in the order of the tree."""
    nodes, members, count = [], [], 0

    def walk(node: Node, parent: str | None, depth: int) -> None:
        nonlocal count
        count += 1
        name = f"{prefix}{count}"
        own = node.leaves()
        nodes.append((name, parent, depth, sum(len(x.members) for x in own), node.leaf is not None, float(node.leaf.avg_sim) if node.leaf else None, node.centroid().tolist()))
        if node.leaf:
            members.extend((name, ids[m]) for m in node.leaf.members)
        for child in node.children:
            walk(child, name, depth + 1)

    for root in roots:
        walk(root, None, 0)
    return nodes, members


def entries(memories: DataFrame) -> DataFrame:
    """(id, embedding, tags, idx) of what a tree is built from: all entries with vectors, Core first."""
    from recollect.operators.scans import topic_entries

    return topic_entries(memories, keep=["id", "embedding", "tags"])


def topic_tree(entries: DataFrame, group: str | None = None, t: S.Thresholds = S.DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``entries`` (idx, id, embedding, tags), a tree for each value of ``group``."""
    from recollect.operators.cluster import cut

    key = F.col(group).cast("string") if group else F.lit("")
    rows = entries.select(key.alias("g"), "idx", "id", "embedding", "tags")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["idx", "id"])
        g = pdf.g.iloc[0]
        b = Builder(np.array(pdf.embedding.tolist(), float), [set(x) for x in pdf.tags], t)
        nodes, members = flatten(b.build(), pdf.id.tolist(), f"{g}/kb" if g else "kb")
        out = [(*n, None) for n in nodes] + [(n, None, None, None, None, None, None, m) for n, m in members]
        return pd.DataFrame(out, columns=["node_id", "parent_id", "depth", "size", "leaf", "avg_sim", "centroid", "memory_id"])

    both = cut(rows.groupBy("g").applyInPandas(build, f"{NODES}, memory_id string"))
    return both.where("memory_id is null").drop("memory_id"), both.where("memory_id is not null").select("node_id", "memory_id")


def coarse_groups(entries: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``entries`` with a column grp from distributed k-means by cosine, for bodies too large for one kernel."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = entries.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="grp").fit(df)
    return model.transform(df).drop("_v")


def leaf_names(members: DataFrame, memories: DataFrame) -> DataFrame:
    """(node_id, name): the leaf's commonest tag in title case, ties by code point; else ``Topic <id>``."""
    from recollect.operators.scans import most_common_tag

    top = most_common_tag(members.join(memories.select(F.col("id").alias("memory_id"), "tags"), "memory_id"), "node_id")
    every = members.select("node_id").distinct().join(top, "node_id", "left")
    return every.select("node_id", F.coalesce(X.title_case(F.col("tag")), F.concat(F.lit("Topic "), F.col("node_id"))).alias("name"))


def inner_names(nodes: DataFrame, names: DataFrame, most_bytes: int = 60) -> DataFrame:
    """(node_id, name) of inner nodes: the names of their largest leaves, joined while they fit."""
    from recollect.functions.noise import strip_trailing_stopwords

    parent = nodes.select(F.col("node_id").alias("n"), F.col("parent_id").alias("p"))
    up = nodes.where("leaf").select("node_id", "size", F.col("parent_id").alias("at"))
    steps = up
    for _ in range(MAX_DEPTH):
        up = up.join(parent, F.col("at") == F.col("n")).select("node_id", "size", F.col("p").alias("at")).where("at is not null")
        steps = steps.unionByName(up)
    rows = steps.where("at is not null").join(names, "node_id")
    w = Window.partitionBy("at")
    first = rows.withColumn("_n", F.row_number().over(w.partitionBy("at", "name").orderBy(F.desc("size"), "node_id"))).where("_n = 1")
    order = w.orderBy(F.desc("size"), "node_id")
    fit = first.withColumn("_s", F.sum(F.octet_length("name") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(order)).where((F.col("_s") <= most_bytes + 2) | (F.col("_r") == 1))
    joined = fit.groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]), ", ").alias("name"))
    return joined.select(F.col("at").alias("node_id"), strip_trailing_stopwords(F.col("name")).alias("name"))


def inherit_names(old_members: DataFrame, old_names: DataFrame, new_members: DataFrame, least: float = S.DEFAULTS.topic_inherit) -> DataFrame:
    """(node_id, name): new leaves take the name of the old leaf they share most members with, one to one.

    Best Jaccard first, then by ids; the number of named leaves is at most the leaf budget.
    """
    n = new_members.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    o = old_members.groupBy(F.col("node_id").alias("old")).agg(F.count(F.lit(1)).alias("m"))
    both = new_members.join(old_members.select(F.col("node_id").alias("old"), "memory_id"), "memory_id").groupBy("node_id", "old").agg(F.count(F.lit(1)).alias("c"))
    j = both.join(n, "node_id").join(o, "old").select("node_id", "old", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("j")).where(F.col("j") >= least)
    taken, used, out = set(), set(), []
    for r in j.orderBy(F.desc("j"), "node_id", "old").collect():
        if r.node_id not in taken and r.old not in used:
            taken.add(r.node_id)
            used.add(r.old)
            out.append((r.node_id, r.old))
    pairs = new_members.sparkSession.createDataFrame(out, "node_id string, old string")
    return pairs.join(old_names.select(F.col("node_id").alias("old"), "name"), "old").select("node_id", "name")


def needs_rebuild(old: DataFrame, new: DataFrame, most: int = 10) -> str:
    """'same', 'insert' or 'rebuild' from (id, content) of the entries before and now."""
    key = lambda df: df.select("id", F.length("content").alias("n"))
    a, b = key(old), key(new)
    gone, come = a.exceptAll(b).count(), b.exceptAll(a).count()
    if not gone and not come:
        return "same"
    return "insert" if not gone and come <= most else "rebuild"


def tree_totals(nodes: DataFrame) -> DataFrame:
    """(node_id, is_leaf, total_members, leaf_count, height) of every node; a leaf has height 0.

    The tree is MAX_DEPTH + 1 levels deep at most, so as many self-joins lead each leaf to all above it.
    """
    parent = nodes.select(F.col("node_id").alias("n"), F.col("parent_id").alias("p"))
    up = nodes.where("leaf").select(F.col("node_id").alias("at"), F.col("size"), F.lit(0).alias("steps"))
    steps = up
    for k in range(1, MAX_DEPTH + 2):
        up = up.join(parent, F.col("at") == F.col("n")).where("p is not null").select(F.col("p").alias("at"), "size", F.lit(k).alias("steps"))
        steps = steps.unionByName(up)
    totals = steps.groupBy("at").agg(F.sum("size").cast("long").alias("total_members"), F.count(F.lit(1)).alias("leaf_count"), F.max("steps").alias("height"))
    return nodes.select("node_id", F.col("leaf").alias("is_leaf")).join(totals, F.col("node_id") == F.col("at")).drop("at")


def naming_work(members: DataFrame, named: DataFrame) -> DataFrame:
    """One row: leaves, unnamed ones, and whether asking for names is put off: at most three unnamed of two members or fewer on average."""
    size = members.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    marked = size.join(named.select("node_id", F.lit(True).alias("known")).distinct(), "node_id", "left")
    new = F.col("known").isNull()
    one = marked.agg(F.count(F.lit(1)).alias("leaves"), F.count_if(new).alias("unnamed"), F.avg(F.when(new, F.col("n"))).alias("mean"))
    return one.select("leaves", "unnamed", ((F.col("unnamed") <= 3) & (F.coalesce("mean", F.lit(0.0)) <= 2)).alias("put_off"))


def insert_into(nodes: DataFrame, members: DataFrame, new: DataFrame, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(node_id, memory_id) after ``new`` (id, embedding) joined the nearest leaf at or over ``topic_assign``; others get a leaf of their own.

    For the few rows an incremental rebuild inserts: they meet the leaves, which the budget bounds.
    """
    leaves = nodes.where("leaf").select("node_id", "centroid")
    rows = new.where(F.col("embedding").isNotNull()).select(F.col("id").alias("memory_id"), "embedding")
    sims = rows.join(F.broadcast(leaves), F.size("embedding") == F.size("centroid")).select("memory_id", "node_id", X.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    best = sims.groupBy("memory_id").agg(F.max(F.struct(F.col("s"), F.col("node_id"))).alias("b"))
    placed = rows.join(best, "memory_id", "left").select(F.when(F.col("b.s") >= t.topic_assign, F.col("b.node_id")).otherwise(F.concat(F.lit("new-"), "memory_id")).alias("node_id"), "memory_id")
    return members.unionByName(placed)


def topic_members(members: DataFrame, memories: DataFrame, node_ids: list[str]) -> DataFrame:
    return members.where(F.col("node_id").isin(*node_ids)).join(memories, F.col("memory_id") == F.col("id")).select("node_id", *[c for c in S.META_COLS])


def bloated(nodes: DataFrame, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """The largest leaves to distil."""
    return nodes.where(F.col("leaf") & (F.col("size") >= t.distill_min)).orderBy(F.desc("size"), "node_id").limit(t.distill_max)


def sizes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    return nodes.where("leaf").join(names, "node_id", "left").select("node_id", "name", "size").orderBy(F.desc("size"), "node_id")
