"""Embedding near-dedup by dual traversal of cover trees.

Vectors are scaled to length 1, where cosine >= c means a distance of at most
sqrt(2 - 2c). Equal vectors are one point with a count. A cover tree has nested
levels with halving radii: a level's centres lie further apart than its radius,
cover their points within it, and are centres of all finer levels too. Two trees
are traversed level by level: a pair of nodes whose centres lie further apart
than both covering radii and the distance is cut off; of the rest the children
are paired, in the end the points.

A tree is first fitted on a bounded sample; its finest level of few enough
centres cuts the space into leaves, whose true covering radii are measured over
all points, and the traversal tells which pairs of leaves may hold links. Leaves
are cut into blocks of bounded size, each block gets a tree of all its points,
and tasks traverse the trees of two blocks at a time. The result is exact
whatever the sample; the sample only decides how much is cut off between blocks.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import discard, save
from lectern.llm.graph import components, roots

#: Added to distances, for the rounding of 2 - 2 cos.
SLACK = 1e-6
#: The rounding of a part's product in single precision: cosines of so many parts may be off by this for each, and only decide what is looked at more closely.
ROUGH = 2.0**-23
#: So many rows are multiplied at a time.
TILE = 1024


@dataclass
class Tree:
    """x: points of length 1; centres: each point's centre at each level, as a row of x, row 0 at the first; radii: of the nodes whose centre a point is, by level."""

    x: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level (children in the order of their parents, where each parent's begin, how many points are below each child); the last level's children are the points."""
        out, n = [], len(self.x)
        for k in range(self.centres.shape[1]):
            points = self.centres[:, k + 1] if k + 1 < self.centres.shape[1] else np.arange(n)
            below = np.unique(points)
            parent = self.centres[below, k]
            order = np.argsort(parent, kind="stable")
            out.append((below[order], np.searchsorted(parent[order], np.arange(n + 1)), np.bincount(points, minlength=n)))
        return out


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def _extended(x: np.ndarray, net: list[int], radius: float) -> list[int]:
    """The net with each row of x in turn that lies further than the radius from all of it."""
    net, near = list(net), 1 - radius**2 / 2  # the cosine at that distance
    rest = np.delete(np.arange(len(x)), net)
    for at in range(0, len(rest), TILE):
        rows = rest[at : at + TILE]
        open_ = rows[np.max([(x[rows] @ x[net[k : k + TILE]].T).max(axis=1) for k in range(0, len(net), TILE)], axis=0) < near]
        while len(open_):
            new, open_ = open_[0], open_[1:]
            net.append(int(new))
            open_ = open_[x[open_] @ x[new] < near]
    return net


def _nearest(x: np.ndarray, of: np.ndarray, net: np.ndarray) -> np.ndarray:
    """For each row of `of` the row of the net that is nearest to it."""
    out = np.empty(len(of), np.int64)
    for at in range(0, len(of), TILE):
        out[at : at + TILE] = net[(x[of[at : at + TILE]] @ x[net].T).argmax(axis=1)]
    return out


def tree(x: np.ndarray, low: float) -> Tree:
    """The cover tree of points of length 1: radii 2, 1, 1/2, ... down to below `low`. Covering radii are measured."""
    nets, radius = [[0]], 2.0
    while radius > low and len(nets[-1]) < len(x):
        radius /= 2
        nets.append(_extended(x, nets[-1], radius))
    rows = np.arange(len(x))
    centres = np.zeros((len(x), len(nets)), np.int64)
    parents = rows
    for k in range(len(nets) - 1, -1, -1):
        net = np.array(nets[k])
        up = np.arange(len(x))
        below = np.setdiff1d(rows if k == len(nets) - 1 else np.array(nets[k + 1]), net)
        up[below] = _nearest(x, below, net)
        up[net] = net
        parents = up[parents]
        centres[:, k] = parents
    radii = np.zeros(centres.shape)
    for k in range(len(nets)):
        np.maximum.at(radii[:, k], centres[:, k], _distance((x * x[centres[:, k]]).sum(axis=1)))
    return Tree(x, centres, radii)


def _tiles(radii: np.ndarray, reach: float) -> Iterator[np.ndarray]:
    """Places of nodes of like radii, at most TILE at a time, so that the greatest radius of a tile says enough about all of it."""
    if len(radii) <= 64:
        yield np.arange(len(radii))
        return
    kind = np.ceil(2 * np.log2(np.maximum(radii, reach / 8)))
    for k in np.unique(kind):
        places = np.flatnonzero(kind == k)
        for at in range(0, len(places), TILE):
            yield places[at : at + TILE]


def _halves(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs of parts that together hold each pair of these places once; a part without another is to be paired within."""
    if len(places) <= 64:
        yield places, None
        return
    one, two = places[: len(places) // 2], places[len(places) // 2 :]
    yield one, two
    yield from _halves(one)
    yield from _halves(two)


def _across(x: np.ndarray, y: np.ndarray, r: np.ndarray, s: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tiles that together hold each pair of the nodes x and y once."""
    others = [y[k] for k in _tiles(s[y], reach)] if len(x) and len(y) else []
    return [(x[k], z) for k in _tiles(r[x], reach) for z in others]


def _by(key: np.ndarray, value: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key, of the pairs marked."""
    key, value = key[which], value[which]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    firsts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    for first, end in zip(firsts[:-1], firsts[1:], strict=True):
        yield int(key[first]), value[first:end]


def close(a: Tree, b: Tree | None, cosine: float, levels: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a and b (without b: of a, i < j) of that cosine or more, and how many cosines were taken, by dual traversal.

    A pair of centres is looked at once: its cosine goes down with it to the nodes of
    the same centres a level below, and nodes of one point each are done with that.
    With levels, the pairs of nodes at the level of that number that may hold such
    rows; without b, a node's pair with itself as well.
    """
    same, b = b is None, b or a
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    off = ROUGH * (a.x.shape[1] + 4)
    rough = [t.x.astype(np.float32) for t in ((a,) if same else (a, b))]
    held = [t.levels() for t in ((a,) if same else (a, b))]
    depth = max(a.centres.shape[1], b.centres.shape[1]) if levels is None else levels
    p = q = np.zeros(1, np.int64)
    known = np.zeros(1, np.float32) if same else rough[0][:1] @ rough[1][0]
    none = np.zeros(0, np.int64)
    done, tested = [(none, none)], 0 if same else 1
    for k in range(depth):
        sides = []
        for t, lists in zip((a, b), (held[0], held[-1]), strict=True):  # a shallower tree's points stay as they are
            children, at, points = lists[k] if k < len(lists) else (np.arange(len(t.x)), np.arange(len(t.x) + 1), np.ones(len(t.x)))
            radii = t.radii[:, k + 1] if k + 1 < len(lists) else np.zeros(len(t.x))
            sides.append((children, at, radii, (points == 1) & (levels is None)))
        (down, at, r, lone), (below, start, s, single) = sides
        found = [(none, none, np.zeros(0, np.float32))]

        def judge(i: np.ndarray, j: np.ndarray, dots: np.ndarray, found: list = found, r: np.ndarray = r, s: np.ndarray = s, lone: np.ndarray = lone, single: np.ndarray = single) -> None:
            """Cut pairs of nodes off by their own bound; of single points take the cosine in double precision."""
            points = lone[i] & single[j]
            near = dots >= np.where(points, cosine, 1 - (r[i] + s[j] + reach) ** 2 / 2) - off
            found.append(tuple(x[near & ~points] for x in (i, j, dots)))
            i, j = i[near & points], j[near & points]
            for z in range(0, len(i), 16 * TILE):
                i_, j_ = i[z : z + 16 * TILE], j[z : z + 16 * TILE]
                ok = np.einsum("ij,ij->i", a.x[i_], b.x[j_]) >= cosine
                done.append((i_[ok], j_[ok]))

        itself = (p == q) & same
        judge(p[~itself], q[~itself], known[~itself])
        work = []
        for u in p[itself]:
            mine = down[at[u] : at[u + 1]]
            again = mine[~lone[mine]]
            found.append((again, again, np.ones(len(again), np.float32)))
            if len(mine) > 1:
                tiles = [mine[x] for x in _tiles(r[mine], reach)]
                work += [(x, y) for i, x in enumerate(tiles) for y in tiles[i + 1 :]]
                work += [pair for x in tiles for pair in _halves(x)]
        many, more = np.diff(at) > 1, np.diff(start) > 1  # nodes with children besides their own centre
        for u, vs in _by(p, q, ~itself & many[p]):
            mine = down[at[u] : at[u + 1]]
            full = vs[more[vs]]
            new = np.concatenate([none, *(below[start[v] : start[v + 1]] for v in full)])
            new = new[~np.isin(new, full)]
            work += _across(mine[mine != u], np.concatenate([vs, new]), r, s, reach)
            work += _across(np.array([u]), new, r, s, reach)
        for v, us in _by(q, p, ~itself & ~many[p] & more[q]):
            theirs = below[start[v] : start[v + 1]]
            work += _across(us, theirs[theirs != v], r, s, reach)
        for x, y in work:
            if y is None:
                i, j = (x[z] for z in np.triu_indices(len(x), 1))
                tested += len(i)
                judge(i, j, np.einsum("ij,ij->i", rough[0][i], rough[0][j]))
            else:
                tested += len(x) * len(y)
                wide = r[x].max() + s[y].max() + reach
                dots = rough[0][x] @ rough[-1][y].T
                i, j = np.nonzero(dots >= np.float32(1 - wide**2 / 2 - 2 * off))
                judge(x[i], y[j], dots[i, j])
        p, q, known = (np.concatenate(part) for part in zip(*found, strict=True))
    if levels is not None:
        return p, q, tested
    p, q = (np.concatenate(part) for part in zip(*done, strict=True))
    return (np.minimum(p, q), np.maximum(p, q), tested) if same else (p, q, tested)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, digest, vector): the vector scaled to length 1 as bytes of doubles; null if it is null, zero or holds null or non-finite parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, out = [], []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                x = np.zeros(0) if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(float)
                top = np.abs(x).max(initial=0.0)
                unit = None
                if len(x) and np.isfinite(top) and top > 0:
                    unit = x / top  # so that the squares neither overflow nor vanish
                    unit = (unit / np.sqrt((unit**2).sum()) + 0.0).tobytes()
                digests.append(unit and hashlib.blake2b(unit, digest_size=16).digest())
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], ["id", "digest", "vector"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id bigint, digest binary, vector binary")


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """One row for each vector; a shorter one is filled up with zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), float).reshape(-1, width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, float)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample: int = 4096, max_leaves: int = 512, block: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows linked directly, copies included. Vectors that
    are null, zero or hold null or non-finite parts link with nothing. Vectors of
    different lengths are compared as if the shorter ended in zeros. A row with a
    null id links with nothing, has a null component and is kept. An empty table
    gives an empty one.

    The driver gets a sample of bounded size and one figure for each of at most
    max_leaves leaves. A leaf of many points is cut into blocks by hash, of about
    `block` points or block_bytes; a task holds two blocks and their trees.
    """
    spark = vectors.sparkSession
    rows = save(unit_vectors(vectors, id_col, vector_col), "unit")
    unique = save(rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "unique", 1 << 18)
    first = rows.select(F.col("id").alias("node"), "digest", "vector").join(unique, ["digest", "node"]).dropDuplicates(["digest"]).select("digest", "node", "copies", "vector")
    points = save(first, "points", 1 << 15)
    chosen = [r.vector for r in points.select("digest", "vector").orderBy("digest").limit(sample).collect()]
    width = (points.agg(F.max(F.octet_length("vector"))).first()[0] or 0) // 8
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    low = max(reach / 8, 1e-3)  # finer levels would cut off next to nothing
    block = max(64, min(block, block_bytes // (8 * max(width, 1))))
    fitted = tree(_matrix(chosen, width), low) if chosen else Tree(np.zeros((1, width)), np.zeros((1, 1), np.int64), np.zeros((1, 1)))
    level = max(k for k in range(fitted.centres.shape[1]) if len(np.unique(fitted.centres[:, k])) <= max_leaves)
    leaves = np.unique(fitted.centres[:, level])
    centres = spark.sparkContext.broadcast(fitted.x[leaves])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                dots = _matrix(part.column(3).to_pylist(), width) @ c.T
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(dots.argmax(axis=1).astype(np.int32)), pa.array(_distance(dots.max(axis=1)))], [*part.schema.names, "leaf", "far"])

    held = save(points.mapInArrow(assign, "digest binary, node bigint, copies bigint, vector binary, leaf int, far double"), "leaves")
    sizes = {r.leaf: (r.far, r.n) for r in held.groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    radii = np.zeros(fitted.radii.shape)  # over all points: of a leaf as measured, above from the children's
    radii[leaves, level] = [sizes.get(k, (0.0, 0))[0] for k in range(len(leaves))]
    for k in range(level - 1, -1, -1):
        below = np.unique(fitted.centres[:, k + 1])
        up = fitted.centres[below, k]
        np.maximum.at(radii[:, k], up, _distance((fitted.x[below] * fitted.x[up]).sum(axis=1)) + SLACK + radii[below, k + 1])
    p, q, _ = close(Tree(fitted.x, fitted.centres, radii), None, cosine, level)
    number = {int(c): k for k, c in enumerate(leaves)}
    pairs = sorted({tuple(sorted((number[int(x)], number[int(y)]))) for x, y in zip(p, q, strict=True)})
    blocks = {k: -(-n // block) for k, (_, n) in sizes.items()}
    counts = spark.createDataFrame(list(blocks.items()), "leaf int, blocks int")  # at most max_leaves rows
    cut = held.join(F.broadcast(counts), "leaf").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).select("leaf", "block", "node", "copies", "vector").repartition("leaf", "block").sortWithinPartitions("leaf", "block")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's points with the tree's levels."""
        for key, block in _groups(batches, 2):
            t = tree(_matrix(block.column(4).to_pylist(), width), low)
            for at in range(0, block.num_rows, TILE):
                part = block.slice(at, TILE)
                lists = [pa.array(list(x[at : at + TILE]), pa.list_(kind)) for x, kind in ((t.centres.astype(np.int32), pa.int32()), (t.radii, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(at, at + part.num_rows, dtype=np.int32)), *lists], [*part.schema.names, "pos", "centres", "radii"])

    trees = save(cut.mapInArrow(grown, "leaf int, block int, node bigint, copies bigint, vector binary, pos int, centres array<int>, radii array<double>"), "trees")
    # at most max_leaves ** 2 / 2 pairs; their blocks are made by Spark
    near = spark.createDataFrame([(x, y, blocks[x], blocks[y]) for x, y in pairs if x in blocks and y in blocks], "p int, q int, np int, nq int")
    near = near.select("p", "q", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i"), "nq").select("p", "q", "i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j")).where("p <> q or i <= j")
    sides = near.withColumn("unit", F.struct("p", "i", "q", "j")).select("unit", F.inline(F.array(F.struct(F.col("p").alias("leaf"), F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("q").alias("leaf"), F.col("j").alias("block"), F.lit(1).alias("side"))))).where("side = 0 or unit.p <> unit.q or unit.i <> unit.j")
    dealt = trees.join(sides, ["leaf", "block"]).select(F.concat_ws(":", "unit.p", "unit.i", "unit.q", "unit.j").alias("unit"), "side", "node", "copies", "vector", "centres", "radii", "pos").repartition("unit").sortWithinPartitions("unit", "side", "pos")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in _groups(batches, 1):
            side, node, copies = (unit.column(k).to_numpy() for k in (1, 2, 3))
            split = int((side == 0).sum())
            t = [Tree(_matrix(part.column(4).to_pylist(), width), *(part.column(k).flatten().to_numpy().reshape(part.num_rows, -1) for k in (5, 6))) for part in (unit.slice(0, split), unit.slice(split)) if part.num_rows]
            i, j, _ = close(t[0], t[1] if len(t) > 1 else None, cosine)
            j = j + split if len(t) > 1 else j
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root, linked = node[roots(len(node), i, j)], links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(links[linked].astype(np.int64)), pa.array(root[linked])], ["node", "links", "root"])

    found = save(dealt.mapInArrow(compared, "node bigint, links bigint, root bigint"), "links", 1 << 20)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = save(unique.join(links, "node", "left").join(labels, "node", "left").select("digest", "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "placed", 1 << 18)
    discard(unique, points, held, trees, found)
    out = rows.select("id", "digest").join(placed, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of runs of equal first columns in sorted batches; one run is held at a time."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        starts = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1])]
        for first, end in zip(starts, [*starts[1:], len(values)], strict=True):
            if values[first] != at:
                if held:
                    yield at, pa.concat_batches(held)
                at, held = values[first], []
            held.append(batch.slice(first, end - first))
    if held:
        yield at, pa.concat_batches(held)
