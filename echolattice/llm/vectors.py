"""Embedding near-duplicates: dual traversal of cover trees, exact threshold pairs.

Unit vectors of a label link at a distance of at most sqrt(2 - 2 * cosine). Equal vectors of a label are one node of a weight.
A label's nodes are the root of one nested tree. Its upper levels are made over the cluster: a cell of more than CELL nodes is
divided among the nearest of a bounded sample of its own vectors, level by level. A smaller cell is divided into blocks, and a
block is a cover tree: nested levels of centres, radii halved from level to level, each node with the covering radius of what
is below it; it is built once and stored with the block.

The traversal runs down both: pairs of cells, then of blocks by joins, then of nodes in a task that has two blocks. A pair
whose centres are further apart than the threshold and both covering radii is dropped; one whose vectors are all within the
threshold, by the same bounds, is taken whole, without looking below; leaves that neither bound decides are compared in double
precision. So neither unlike vectors nor copies of one cost a comparison of all their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, connected_components, min_labels, runs, ship, small

COSINE = 0.98
#: Nodes of a cell that one task divides into blocks, at most; of a block; of a leaf; children of a cell.
CELL, BLOCK, LEAF, FANOUT = 16_384, 1024, 16, 64
#: Bytes of pivots that a pass over the cells to divide sends to the workers.
PIVOT_BYTES = 32 << 20
#: Room for rounding in the bounds; links that they don't decide are decided by the cosine.
SLACK = 1e-7


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class CoverTree:
    """Nodes of a cover tree over the rows of a matrix of unit vectors, in arrays.

    Rows are put in the order of the leaves, so that a node is a run of rows. A node's centre is one of its rows, and also
    the centre of its first child; children's centres are further apart than the radius of their level. A node's children
    are `many` nodes in a row from `first`. Distances are worked out to centres alone.
    """

    NAMES = ("order", "centre", "radius", "begin", "end", "first", "many")

    def __init__(self, *arrays: np.ndarray):
        self.order, self.centre, self.radius, self.begin, self.end, self.first, self.many = arrays

    @classmethod
    def build(cls, x: np.ndarray, reach: float = 0, count: list[int] | None = None) -> CoverTree:
        """A node whose rows are all within reach of each other isn't divided: as a pair with itself it is taken whole. count[0] grows by the distances worked out."""
        nodes: list[list] = []  # centre, radius, begin, end, first, many; places in the leaf order are known from the sizes

        def add(rows: np.ndarray, far: np.ndarray, begin: int) -> tuple:
            nodes.append([int(rows[0]), float(far.max()), begin, begin + len(rows), 0, 0])
            return len(nodes) - 1, rows, far, begin

        order = np.zeros(len(x), np.int64)
        todo = [add(np.arange(len(x)), _far(x, x[:1])[:, 0], 0)] if len(x) else []
        level = {0: 2.0}
        while todo:
            me, rows, far, begin = todo.pop()
            order[begin : begin + len(rows)] = rows
            if len(rows) <= LEAF or nodes[me][1] <= max(1e-6, (reach - SLACK) / 2):
                continue
            radius = level[me]
            while radius >= nodes[me][1]:  # levels at which a node has one child are passed over
                radius /= 2
            nodes[me][4] = len(nodes)
            left, d, at = rows, far, begin
            while len(left):  # a greedy net: what is within the level's radius of a centre goes to it
                close = d <= radius
                todo.append(add(left[close], d[close], at))
                level[len(nodes) - 1] = radius
                at += int(close.sum())
                left = left[~close]
                if len(left):
                    d = _far(x[left], x[left[:1]])[:, 0]
                    if count is not None:
                        count[0] += len(left)
            nodes[me][5] = len(nodes) - nodes[me][4]
        cols = list(zip(*nodes, strict=True)) if nodes else [()] * 6
        return cls(order, *(np.array(c, np.float64 if k == 1 else np.int64) for k, c in enumerate(cols)))

    def packed(self) -> list[bytes]:
        return [getattr(self, n).tobytes() for n in self.NAMES]

    @classmethod
    def unpacked(cls, data: list) -> CoverTree:
        return cls(*(np.frombuffer(b, np.float64 if n == "radius" else np.int64) for n, b in zip(cls.NAMES, data, strict=True)))


def meetings(a: CoverTree, xa: np.ndarray, b: CoverTree, xb: np.ndarray, reach: float):
    """Runs of rows (begin, end in a; begin, end in b, in leaf order; whether all pairs link) of node pairs that the bounds don't keep apart.

    x: unit vectors in leaf order. If b is a, a pair of different runs comes once, and a run with itself for its own pairs.
    """
    if not len(a.centre) or not len(b.centre):
        return
    ca, cb = (xt[np.argsort(t.order, kind="stable")[t.centre]] for t, xt in ((a, xa), (b, xb)))
    root = np.zeros(1, np.int64)
    stack = [(root, root, b is a)]
    while stack:
        p, q, same = stack.pop()
        far = _far(ca[p], cb[q])
        both = a.radius[p][:, None] + b.radius[q][None, :]
        live = far <= reach + both + SLACK
        if same:
            live &= np.arange(len(q))[None, :] >= np.arange(len(p))[:, None]
        whole = live & (far + both <= reach - SLACK)
        flat = live & ~whole & (a.many[p] == 0)[:, None] & (b.many[q] == 0)[None, :]
        for sure, pairs in ((True, whole), (False, flat)):
            for i in np.flatnonzero(pairs.any(axis=1)):
                u, vs = p[i], q[pairs[i]]
                vs = vs[np.argsort(b.begin[vs], kind="stable")]
                own = vs == u if same else np.zeros(len(vs), bool)
                # neighbours in leaf order are one run; the node itself is a run of its own
                cut = np.flatnonzero((b.begin[vs[1:]] != b.end[vs[:-1]]) | own[1:] | own[:-1]) + 1
                for run in np.split(vs, cut):
                    yield int(a.begin[u]), int(a.end[u]), int(b.begin[run[0]]), int(b.end[run[-1]]), sure
        for i, j in np.argwhere(live & ~whole & ~flat):
            u, v = int(p[i]), int(q[j])
            down = [np.arange(t.first[k], t.first[k] + t.many[k]) if t.many[k] else np.array([k]) for t, k in ((a, u), (b, v))]
            stack.append((*down, same and u == v))


def block_links(x: np.ndarray, wx: np.ndarray, a: CoverTree, y: np.ndarray | None, wy: np.ndarray | None, b: CoverTree | None, cosine: float, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked with each row of x, and of y, across the two (or inside x, if y is None), and a forest of the links as row numbers (y's after x's).

    Rows are in the leaf order of the trees a and b. count[0] grows by the pairs that were compared.
    """
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
    one = y is None
    if one:
        y, wy, b = x, wx, a
    shift = 0 if one else len(x)
    sums = np.zeros(len(x) + (0 if one else len(y)), np.int64)
    lx, ly = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    edges, held = [np.zeros((0, 2), np.int64)], 0
    for i, j, k, m, sure in meetings(a, x / lx[:, None], b, y / ly[:, None], reach):
        self_ = one and i == k
        if sure:
            sums[i:j] += wy[k:m].sum()
            if self_:
                sums[i:j] -= wx[i:j]
            else:
                sums[k + shift : m + shift] += wx[i:j].sum()
            u, v = np.arange(i, j), np.arange(k, m) + shift  # all are joined by each side's first
            new = np.concatenate([np.stack([u, np.full(len(u), v[0])], 1), np.stack([np.full(len(v), u[0]), v], 1)])
        else:
            hit = (x[i:j] @ y[k:m].T) / (lx[i:j, None] * ly[None, k:m]) >= cosine
            if count is not None:
                count[0] += hit.size
            u, v = np.nonzero(hit)
            u, v = u + i, v + k
            if self_:
                u, v = u[u < v], v[u < v]
            np.add.at(sums, u, wy[v])
            np.add.at(sums, v + shift, wx[u])
            new = np.stack([u, v + shift], 1)
        edges.append(new)
        held += len(new)
        if held > 200_000:
            edges, held = [_forest(np.concatenate(edges))], 0
    return sums[: len(x)], sums[shift:], _forest(np.concatenate(edges))


def _forest(edges: np.ndarray) -> np.ndarray:
    if not len(edges):
        return edges
    nodes, label = min_labels(edges[:, 0], edges[:, 1])
    keep = nodes != label
    return np.stack([nodes[keep], label[keep]], 1)


def divide(x: np.ndarray, most: int):
    """Rows of unit vectors in runs of at most so many, near ones together: by the nearest of some of the vectors, again and again."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            yield rows
            continue
        pivots = rows[np.linspace(0, len(rows) - 1, min(FANOUT, -(-2 * len(rows) // most))).astype(np.int64)]
        near = (x[rows] @ x[pivots].T).argmax(axis=1)
        parts = [rows[near == k] for k in np.unique(near)]
        # Vectors of one direction aren't told apart by their nearest.
        todo += parts if len(parts) > 1 else [rows[i : i + most] for i in range(0, len(rows), most)]


# ---- the tree over the cluster --------------------------------------------------------------------------------


def _divided(state: DataFrame, cells: DataFrame, first: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """One level down for the cells(cell, n) of more than CELL nodes.

    The rows of state in them, in children of theirs; those children (parent, cell, centre, radius, n, weight, rep); the next
    free number of a cell; and the cells that weren't divided, for all their vectors are nearest to one pivot.
    """
    spark = state.sparkSession
    big = scratch.write(cells.where(F.col("n") > CELL).select("cell", "n", F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / CELL)).cast("int").alias("f")))
    dims = state.agg(F.max("dims")).first()[0]
    passes = -(-big.agg(F.sum("f")).first()[0] * dims * 8 // PIVOT_BYTES)
    states, tree = [], []
    for k in range(passes):
        own = state.join(small(big.where(F.pmod(F.xxhash64("cell"), F.lit(passes)) == k)), "cell")
        drawn = own.withColumn("h", F.xxhash64("node", F.lit(len(states)))).where(F.expr("h <= -9223372036854775807L + cast(18446744073709551614D * least(1D, 4D * f / n) as decimal(20, 0))"))
        drawn = drawn.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "embedding"))), 1, FANOUT).alias("p"), F.first("f").alias("f"))
        pivots = {}  # PIVOT_BYTES at most
        for r in drawn.select("cell", F.expr("transform(slice(p, 1, f), x -> x.embedding)").alias("p")).collect():
            pivots[r["cell"]] = (first, _units(np.array(r["p"], np.float64)))
            first += len(r["p"])
        sent = spark.sparkContext.broadcast(pivots)

        def assign(batches, sent=sent):
            for b in batches:
                cell, size = (b.column(c).to_numpy() for c in ("cell", "dims"))
                child, far = np.zeros(len(cell), np.int64), np.zeros(len(cell))
                flat, ends = b.column("embedding"), np.cumsum(size)
                values = np.asarray(flat.flatten(), np.float64)
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    if c not in sent.value:  # none of its vectors was drawn
                        child[at] = c
                        far[at] = 2.0
                        continue
                    begin, p = sent.value[c]
                    x = _units(np.stack([values[ends[i] - size[i] : ends[i]] for i in at.tolist()]))
                    dot = x @ p.T
                    near = dot.argmax(axis=1)
                    child[at] = begin + near
                    far[at] = np.sqrt(np.maximum(2 - 2 * dot[np.arange(len(at)), near], 0))
                rest = [b.column(c) for c in ("node", "w", "dims", "embedding", "path")]
                yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(child), pa.array(far), *rest], names=["parent", "cell", "far", "node", "w", "dims", "embedding", "path"])

        schema = "parent long, cell long, far double, node long, w long, dims int, embedding array<double>, path array<long>"
        held = scratch.write(own.select("cell", "node", "w", "dims", "embedding", "path").mapInArrow(assign, schema))
        sent.unpersist()
        found = held.groupBy("parent", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.sum("w").alias("weight"), F.min("node").alias("rep"))
        rows = [(begin + i, p.tolist()) for begin, ps in pivots.values() for i, p in enumerate(ps)]
        centres = spark.createDataFrame(rows, "cell long, centre array<double>")
        tree.append(scratch.write(found.join(F.broadcast(centres), "cell", "left")))
        states.append(held)
    out, level = states[0], tree[0]
    for x, y in zip(states[1:], tree[1:], strict=True):
        out, level = out.unionByName(x), level.unionByName(y)
    stuck = level.join(cells.select(F.col("cell").alias("parent"), F.col("n").alias("all")), "parent").where(F.col("n") == F.col("all")).select("cell")
    stuck = scratch.write(stuck)
    return out.drop("far", "parent"), level, first, stuck


def _levels(state: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """state with cells of at most CELL nodes, and the levels (parent, cell, centre, radius, weight, rep) that lead to them."""
    first, levels = 1 << 62, []
    cells = roots
    while cells.where(F.col("n") > CELL).limit(1).count():
        whole = state.join(small(scratch.write(cells.where(F.col("n") <= CELL).select("cell"))), "cell", "left_semi")
        divided, level, first, stuck = _divided(state, cells, first, scratch)
        if not stuck.isEmpty():  # cut by hash: the parts have the cell's centre and radius
            cut = F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("n") / CELL)).cast("long")
            hit = level.join(stuck, "cell", "left_semi").select("cell", "n", F.col("parent"), "centre", "radius")
            parts = divided.join(small(hit.select("cell", "n")), "cell").withColumn("part", F.xxhash64("cell", cut))
            named = scratch.write(parts.groupBy("cell", "part").agg(F.count("*").alias("m"), F.sum("w").alias("weight"), F.min("node").alias("rep")))
            again = named.join(hit, "cell").select("parent", F.col("part").alias("cell"), "centre", "radius", F.col("m").alias("n"), "weight", "rep")
            level = scratch.write(level.join(stuck, "cell", "left_anti").unionByName(again.select(level.columns)))
            moved = parts.withColumn("cell", F.col("part")).select(divided.columns)
            divided = divided.join(stuck, "cell", "left_anti").unionByName(moved)
        kept = cells.where(F.col("n") <= CELL)
        if levels:
            kept = kept.select(F.col("cell").alias("parent"), "cell", "radius", "n", "weight", "rep", "centre")
            level = level.unionByName(kept.select(level.columns))
        else:
            empty = F.lit(None).cast("array<double>")
            level = level.unionByName(kept.select(F.col("cell").alias("parent"), "cell", F.lit(2.0).alias("radius"), "n", "weight", "rep", empty.alias("centre")).select(level.columns))
        levels.append(scratch.write(level))
        cells = levels[-1]
        state = scratch.write(divided.unionByName(whole.select(divided.columns)).withColumn("path", F.concat("path", F.array("cell"))))
    return state, levels


def _met(pairs: DataFrame, level: DataFrame, reach: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of children of the pairs' cells: those that the bounds leave open, and those all of whose vectors link."""
    cols = ["cell", "centre", "radius", "weight", "rep"]
    a, b = (level.select(F.col("parent").alias(f"p{k}"), *(F.col(c).alias(f"{c}_{k}") for c in cols)) for k in "ab")
    both = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(a, "pa").join(b, "pb").where("pa <> pb or cell_a <= cell_b")
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.coalesce(F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))), F.lit(0.0))  # a cell without a centre may be anywhere
    both = both.withColumns({"far": F.when(F.col("cell_a") == F.col("cell_b"), F.lit(0.0)).otherwise(far), "both": F.col("radius_a") + F.col("radius_b")})
    held = both.where(F.col("far") <= F.col("both") + reach + SLACK)
    held = scratch.write(held.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), (F.col("far") + F.col("both") <= reach - SLACK).alias("sure"), "weight_a", "weight_b", "rep_a", "rep_b"))
    return held.where("not sure").select("a", "b"), held.where("sure")


def _shares(sure: DataFrame) -> DataFrame:
    """(cell, more, own, rep): weights that all of a cell's nodes link with by pairs taken whole, and whether its own is among them."""
    turned = sure.select(F.col("b").alias("cell"), F.col("weight_a").alias("weight"), F.col("a").alias("other"), F.col("rep_b").alias("rep")).where("cell <> other")
    both = sure.select(F.col("a").alias("cell"), F.col("weight_b").alias("weight"), F.col("b").alias("other"), F.col("rep_a").alias("rep")).unionByName(turned)
    return both.groupBy("cell").agg(F.sum("weight").alias("more"), F.max((F.col("cell") == F.col("other")).cast("int")).alias("own"), F.first("rep").alias("rep"))


_NAN = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every different vec_id of vectors(vec_id, embedding, label).

    Vectors link if their labels are equal and not null, they have as many components, and their cosine in double precision
    is at least the threshold. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Rows equal in all three columns are one vector; a vec_id with several vectors has the links of all, and one row. A row
    without vec_id links with nothing and is kept out of the links of others. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    usable = f"vec_id is not null and label is not null and embedding is not null and not {_NAN} and exists(embedding, x -> x <> 0)"
    named = {"dims": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("vector"), "embedding")}
    held = scratch.write(rows.where(usable).withColumns(named))
    same = ["label", "dims", "h1", "h2"]
    members = scratch.write(held.select("vec_id", *same).distinct())
    nodes = members.groupBy(*same).agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()))
    keys = nodes.groupBy("label", "dims").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.min("node").alias("rep")).where("n > 1")
    keys = scratch.write(keys.withColumn("cell", F.monotonically_increasing_id()))
    one = held.join(nodes.select(*same, F.col("rep").alias("vec_id"), "w", "node"), [*same, "vec_id"]).join(small(keys.select("label", "dims", "cell")), ["label", "dims"])
    state = one.select("cell", "node", "w", "dims", "embedding", F.array().cast("array<long>").alias("path")).dropDuplicates(["node"])
    state, levels = _levels(scratch.write(state), keys, scratch)

    tree = [f"tree_{n}" for n in CoverTree.NAMES]

    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))

    def build(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33  # numbers of blocks: the table is written once, by the attempts that end
        for t in runs(batches):
            ids, w, size = (t.column(c).to_numpy() for c in ("node", "w", "dims"))
            x = np.asarray(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(ids), int(size[0]))
            for own in divide(_units(x), BLOCK):
                own_tree = CoverTree.build(unit := _units(x[own]), reach)
                own, unit = own[own_tree.order], unit[own_tree.order]
                mean = unit.mean(axis=0)
                c = mean / m if (m := np.linalg.norm(mean)) > 1e-9 else unit[0]
                row = {"parent": [t.column("cell")[0]], "cell": [n], "dims": [int(size[0])], "n": [len(own)], "weight": [int(w[own].sum())], "rep": [int(ids[own].min())], "centre": [c.tolist()], "radius": [float(_far(unit, c[None]).max())]}
                row |= {"ids": [ids[own].tobytes()], "weights": [w[own].astype(np.int64).tobytes()], "vectors": [np.ascontiguousarray(x[own]).tobytes()]}
                yield pa.RecordBatch.from_pydict(row | {k: [v] for k, v in zip(tree, own_tree.packed(), strict=True)}, schema=fields)
                n += 1

    bins = ("ids", "weights", "vectors", *tree)
    fields = pa.schema([*((c, pa.int64()) for c in ("parent", "cell", "dims", "n", "weight", "rep")), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *((c, pa.binary()) for c in bins)])
    schema = "parent long, cell long, dims long, n long, weight long, rep long, centre array<double>, radius double, " + ", ".join(f"{c} binary" for c in bins)
    flat = state.select("cell", "node", "w", "dims", "embedding").repartition("cell").sortWithinPartitions("cell")
    blocks = scratch.write(flat.mapInArrow(build, schema))

    pairs = keys.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    taken = []
    for level in [*levels, blocks]:
        pairs, sure = _met(pairs, level, reach, scratch)
        taken.append(sure)

    load = blocks.select("cell", "dims", *bins)
    left, right = (load.select(*(F.col(c).alias(f"{c}_{k}") for c in ("cell", "dims", *bins))) for k in "ab")
    tasks = pairs.repartition("a", "b").join(left, F.col("a") == F.col("cell_a")).join(right, F.col("b") == F.col("cell_b"))
    needed = ["a", "b", "dims_a", *(f"{c}_{k}" for k in "ab" for c in bins)]

    def rows_of(ids: np.ndarray, sums: np.ndarray, forest: np.ndarray) -> pa.RecordBatch:
        hit, k = np.flatnonzero(sums), len(forest)
        node = np.concatenate([ids[hit], ids[forest[:, 0]]])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([sums[hit], np.zeros(k, np.int64)])), pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(ids[forest[:, 1]])])], names=["node", "n", "other"])

    def traverse(batches):
        for t in batches:
            col = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            for r in range(t.num_rows):
                one, dims = col["a"][r].as_py() == col["b"][r].as_py(), col["dims_a"][r].as_py()
                got = []
                for k in "a" if one else "ab":
                    raw = {c: col[f"{c}_{k}"][r].as_buffer() for c in bins}
                    ids, w = (np.frombuffer(raw[c], np.int64) for c in ("ids", "weights"))
                    got.append((ids, np.frombuffer(raw["vectors"]).reshape(-1, dims), w, CoverTree.unpacked([raw[c] for c in tree])))
                (ids, x, w, a), (other, y, v, b) = got[0], (got[1] if not one else (None,) * 4)
                m, n, forest = block_links(x, w, a, y, v, b, cosine)
                yield rows_of(ids, m, forest) if one else rows_of(np.concatenate([ids, other]), np.concatenate([m, n]), forest)

    def spread(batches):
        """A block's share for each of its nodes."""
        for t in batches:
            for ids, w, more, own, rep in zip(*(t.column(k) for k in range(5)), strict=True):
                ids, w = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(w.as_buffer(), np.int64)
                n = np.full(len(ids), more.as_py()) - own.as_py() * w
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(np.full(len(ids), rep.as_py()))], names=["node", "n", "other"])

    out_schema = "node long, n long, other long"
    found = tasks.select(*needed).mapInArrow(traverse, out_schema)
    found = found.unionByName(blocks.join(_shares(taken[-1]).withColumnRenamed("rep", "rep_"), "cell").select("ids", "weights", "more", "own", F.col("rep_")).mapInArrow(spread, out_schema))
    for k, sure in enumerate(taken[:-1]):
        share = small(scratch.write(_shares(sure)))
        own = state.select("node", "w", F.get("path", F.lit(k)).alias("cell")).join(share.withColumnRenamed("rep", "other"), "cell")
        found = found.unionByName(own.select("node", (F.col("more") - F.col("own") * F.col("w")).alias("n"), "other"))
    found = scratch.write(found)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    # Nodes of a vec_id that has several are one component, and so are cells taken whole.
    several = members.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id")
    shared = members.join(small(scratch.write(several)), "vec_id").join(nodes, same).groupBy("vec_id", "node").agg(F.lit(1).alias("one"))
    heads = shared.join(shared.groupBy("vec_id").agg(F.min("node").alias("head")), "vec_id").select(F.col("node").alias("a"), F.col("head").alias("b"))
    edges = found.where("other is not null and node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(heads)
    for sure in taken:
        edges = edges.unionByName(sure.where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    parts = connected_components(edges, scratch)
    placed = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    about = scratch.write(placed.join(least, "component").join(links, "node", "left").select(*same, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), "component_id"))
    each = members.join(small(about), same).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component_id").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long")).distinct().join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "vectors"))


ORACLE = f"""
WITH RECURSIVE
v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND (a.vec_id <> b.vec_id OR a.e <> b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
reach AS (
  SELECT DISTINCT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, y FROM reach r JOIN links l ON r.other = l.x),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(c.vec_id = c.component_id, true) AS kept
FROM comp c LEFT JOIN n ON c.vec_id IS NOT DISTINCT FROM n.vec_id
"""
