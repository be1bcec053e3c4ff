"""MinHash near-dedup with b-bit signatures.

Texts of equal shingle sets are one node. Each node's set gets 250 minima: fifty
bands of five make the candidates, and two low bits of each minimum are packed
into a 64-byte signature, from which a pair's similarity is estimated by bit
counts, corrected for chance collisions. Pairs whose estimate is near or above
the threshold are confirmed on the full sets.

A pair at the threshold shares no band with probability (1 - .75**5)**50 = 1.3e-6;
more alike pairs, and groups with several links, less. The estimate's standard
error at .75 is .033 and the margin .2, six of them.

Members of a bucket are not all paired. They are first compared with one pivot,
then, where the bucket still spans several components, with pivots that differ
from bucket to bucket, and last, block by block, with every member that is in
another component. There the sets come along, links are confirmed within the
task, and only what joins the members leaves it. The longer the sets, the fewer
members a block has, and sets whose sizes are too far apart to link never meet.
So no link that joins two components is missed, no task emits the pairs of a
group, and a task holds two blocks of bounded size, or two texts' sets.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text
from lectern.llm._shared import discard, save
from lectern.llm.graph import components, roots

BANDS, ROWS, BITS = 50, 5, 2
HASHES, WORDS = BANDS * ROWS, 8
#: Written tables have files of so many rows, by the rows' size.
ROWS_PER_FILE, NODES_PER_FILE, SETS_PER_FILE = 1 << 18, 1 << 15, 1 << 12
_rng = np.random.default_rng(20_240_501)
_A = (_rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
_C = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(packed low bits, band keys) of a non-empty set of 64-bit hashes."""
    h, minima = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        minima = np.minimum(minima, (_A * h[at : at + 4096] + _B).min(axis=1))
    low = _text.mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    packed = np.zeros(WORDS * 64 // BITS, np.uint64)
    packed[:HASHES] = low
    words = (packed.reshape(WORDS, -1) << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    keys = _text.mix((minima.reshape(BANDS, ROWS).astype(np.uint64) * _C).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return words.astype("<u8").tobytes(), keys.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity of signatures (... x WORDS of uint64), corrected for minima that agree in their low bits by chance."""
    differ = x ^ y
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def unpack(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u8").reshape(-1, WORDS)


def features(rows: DataFrame) -> DataFrame:
    """(id, n_shingles, digest, signature, bands) of (id, text); a text without words has 0 shingles and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, packed, bands = [], [], [], []
            for s in _text.shingle_sets(batch.column(1)):
                n.append(len(s))
                p, b = signature(s) if len(s) else (None, None)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                packed.append(p)
                bands.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "signature", "bands"])

    return rows.mapInArrow(run, "id bigint, n_shingles bigint, digest binary, signature binary, bands array<bigint>")


def sets(rows: DataFrame) -> DataFrame:
    """(id, set): the sorted shingle hashes of (id, text), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _text.shingle_sets(batch.column(1))], pa.binary())], ["id", "set"])

    return rows.mapInArrow(run, "id bigint, set binary")


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (node, pivot) whose estimate is at least that."""

    @F.pandas_udf("boolean")
    def passes(x, y):
        return x.__class__(estimate(unpack(x.tolist()), unpack(y.tolist())) >= least)

    mine, theirs = nodes.select("node", F.col("signature").alias("s")), nodes.select(F.col("node").alias("pivot"), F.col("signature").alias("t"))
    return pairs.join(mine, "node").join(theirs, "pivot").where(passes("s", "t")).select("node", "pivot").distinct()


def confirmed(pairs: DataFrame, full: DataFrame, percent: int, group: int = 32) -> DataFrame:
    """Those of the pairs (node, pivot), a written table, that reach the threshold on their full sets.

    A pivot's set goes to each group of about `group` of its members; a task holds
    one pivot's set and reads the members' one by one.
    """
    members = save(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")), "pivots", ROWS_PER_FILE)
    asked = pairs.join(members, "pivot").select(F.col("node").alias("id"), "pivot", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("member"))
    pivots = members.select(F.col("pivot").alias("id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("member"))
    work = asked.unionByName(pivots).join(full, "id").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            ids, pivots, parts, member = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, key in enumerate(zip(pivots, parts, strict=True)):
                if key != at:
                    at, held = key, []
                s = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if not member[i]:
                    held.append(s.copy())
                    continue
                for p in held:
                    both = len(np.intersect1d(s, p, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(p) - both):
                        found.append((ids[i], pivots[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return work.select("id", "pivot", "part", "member", "set").mapInArrow(run, "a bigint, b bigint")


def _shared(sets_: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets at left with those at right, as a matrix; only values on both sides are counted out."""
    sides = []
    for side in (left, right):
        sides.append((np.concatenate([sets_[k] for k in side]), np.repeat(np.arange(len(side)), [len(sets_[k]) for k in side])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        part, halves = common[at : at + 4096], []
        for (values, owner), side in zip(sides, (left, right), strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            m = np.zeros((len(side), len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            halves.append(m)
        out += halves[0] @ halves[1].T
    return out


def _blocks(rows: DataFrame, least: float, percent: int, block: int, short: int) -> DataFrame:
    """(a, b) of (bucket, n, node, component, signature, n_shingles, set): what joins the members of a bucket across components.

    Members are of level 0 with fewer than 2 * short shingles, of level k with
    short * 2**k to twice as many. A level is cut into blocks of block / 2**k
    members. A task compares two blocks of one level or of neighbouring ones, by
    estimate and then on the sets; sets two levels apart differ in size by more
    than any percentage of 50 or more allows.
    """
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("n_shingles") / short))).cast("int")
    leveled = rows.withColumn("level", level)
    sizes = save(leveled.groupBy("bucket", "level").agg(F.count("*").alias("m")), "levels", ROWS_PER_FILE)
    many = sizes.select("bucket", "level", F.ceil(F.col("m") / F.greatest(F.lit(1), F.lit(block) / F.pow(F.lit(2.0), F.col("level")))).cast("int").alias("blocks"))
    above = many.select("bucket", (F.col("level") - 1).alias("level"), F.col("blocks").alias("blocks_above"))
    below = many.select("bucket", (F.col("level") + 1).alias("level"), F.col("blocks").alias("blocks_below"))
    counts = many.join(above, ["bucket", "level"], "left").join(below, ["bucket", "level"], "left").select("bucket", "level", "blocks", F.coalesce("blocks_above", F.lit(0)).alias("blocks_above"), F.coalesce("blocks_below", F.lit(0)).alias("blocks_below"))
    placed = leveled.join(counts, ["bucket", "level"]).withColumn("k", F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int"))

    def units(n: str, other_level: int) -> Column:
        """The units with the n blocks of that level: struct(level and block of the one side, of the other, whether this row is on the other)."""
        k, lv = F.col("k"), F.col("level")
        some = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        if other_level:
            one = lambda j: F.struct(F.least(lv, lv + other_level).alias("p"), (k if other_level > 0 else j).alias("i"), F.greatest(lv, lv + other_level).alias("q"), (j if other_level > 0 else k).alias("j"), F.lit(other_level < 0).alias("second"))
        else:
            one = lambda j: F.struct(lv.alias("p"), F.least(k, j).alias("i"), lv.alias("q"), F.greatest(k, j).alias("j"), (k > j).alias("second"))
        return F.transform(some, one)

    unit = F.concat(units("blocks", 0), units("blocks_above", 1), units("blocks_below", -1))
    dealt = placed.select("bucket", F.inline(unit), "node", "component", "signature", "set").repartition("bucket", "p", "i", "q", "j").sortWithinPartitions("bucket", "p", "i", "q", "j")

    def joins(unit: list[tuple]) -> list[tuple[int, int]]:
        node, part = np.array([u[1] for u in unit]), np.array([u[2] for u in unit])
        if part.min() == part.max():
            return []
        s, second = unpack([u[3] for u in unit]), np.array([u[0] for u in unit])
        sets_ = [np.frombuffer(u[4], np.uint64) for u in unit]
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(unit)),) * 2
        if not len(left):
            return []
        size = np.array([len(x) for x in sets_])
        near = np.concatenate([estimate(s[left[k : k + 64]][:, None], s[right][None]) >= least for k in range(0, len(left), 64)]) & (part[left][:, None] != part[right][None])
        near &= 100 * np.minimum(size[left][:, None], size[right][None]) >= percent * np.maximum(size[left][:, None], size[right][None])
        p, q = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(p):
            return []
        l, r = left[p], right[q]
        both = _shared(sets_, l, r)
        linked = near[np.ix_(p, q)] & (100 * both >= percent * (size[l][:, None] + size[r][None] - both))
        i, k = np.nonzero(linked)
        label = roots(len(unit), l[i], r[k])
        return [(int(node[x]), int(node[label[x]])) for x in np.flatnonzero(label != np.arange(len(unit)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, unit = None, []

        def done() -> pa.RecordBatch:
            found = joins(unit)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                for bucket, p, i, q, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (bucket, p, i, q, j) != at:
                        if len(unit) > 1:
                            yield done()
                        at, unit = (bucket, p, i, q, j), []
                    unit.append(tuple(rest))
        if len(unit) > 1:
            yield done()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, n, node, component, pivot, pivot_component): the members of buckets that are in several components.

    Of buckets of the same members, by count and hash, one is kept.
    """
    rows = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    x = F.xxhash64("node", "bucket")
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min(F.struct(x.alias("x"), "node", "component")).alias("p")).where("low < high")
    one = found.groupBy("n", "members").agg(F.min(F.struct("bucket", "p")).alias("b")).select("b.bucket", "n", F.col("b.p.node").alias("pivot"), F.col("b.p.component").alias("pivot_component"))
    return save(rows.join(save(one, "open", ROWS_PER_FILE), "bucket"), "members", NODES_PER_FILE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, margin: float = 0.2, block: int = 512, star_rounds: int = 1, short: int = 2048) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs; see the module for the method.

    Texts without words (null, empty, blank) have 0 shingles and link with nothing.
    Rows that share an id are each placed by their own text. A row with a null id
    is its own component, null, and is kept. An empty table gives an empty one.
    percent is at least 50. A block has `block` sets of at most 2 * short shingles,
    and fewer longer ones.
    """
    if percent < 50:
        raise ValueError("the percentage must be 50 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = save(features(rows), "features")
    unique = save(found.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node")), "unique", ROWS_PER_FILE)
    nodes = save(found.join(unique.withColumnRenamed("node", "id"), ["digest", "id"]).select(F.col("id").alias("node"), "digest", "n_shingles", "signature", "bands").dropDuplicates(["node", "digest"]), "nodes", NODES_PER_FILE)
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = save(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).where("pivot < high").select("bucket", "pivot"), "shared", ROWS_PER_FILE)
    buckets = save(banded.join(shared, "bucket").distinct(), "buckets", ROWS_PER_FILE)
    full = save(sets(rows.join(buckets.select(F.col("node").alias("id")).distinct(), "id", "left_semi")).where(F.octet_length("set") > 0), "sets", SETS_PER_FILE)
    used, least = [nodes, shared, buckets, full], percent / 100 - margin

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(save(df, name, ROWS_PER_FILE))
        return used[-1]

    def linked(pairs: DataFrame) -> DataFrame:
        return confirmed(kept(pairs, "pairs"), full, percent)

    links = kept(linked(likely(buckets.where("node <> pivot").select("node", "pivot").distinct(), nodes, least)), "links")
    labels = save(components(links), "labels", ROWS_PER_FILE)
    members = buckets.select("bucket", "node")
    for k in range(star_rounds + 1):
        of = _open(members, labels)
        used.append(of)
        if of.isEmpty():
            break
        if k < star_rounds:
            more = linked(likely(of.where(F.col("component") != F.col("pivot_component")).select("node", "pivot").distinct(), nodes, least))
        else:
            sided = of.join(nodes.select("node", "signature", "n_shingles"), "node").join(full.withColumnRenamed("id", "node"), "node").select("bucket", "n", "node", "component", "signature", "n_shingles", "set")
            more = _blocks(sided, least, percent, block, short)
        more = kept(more, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            used.append(labels)
            labels = save(components(links), "labels", ROWS_PER_FILE)
    discard(*used)
    placed = found.select("id", "n_shingles", "digest").join(unique, "digest", "left").join(labels, "node", "left")
    component: Column = F.coalesce("component", "node", "id")
    return placed.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group. Rows without an id stay, as do repeated rows of one that stays."""
    gone = near_duplicates(docs.select(id_col, text_col), id_col, text_col).where("not kept").select(F.col(id_col).alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
