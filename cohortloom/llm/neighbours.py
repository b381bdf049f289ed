"""The most similar vectors of every vector, by collision-counting hashing.

Every unit vector is turned by one random rotation; its coordinates are single projections on orthogonal random
directions, stored in six bits. Each of the first ``COUNTED`` projections is a hash function of its own with a sorted array.
A query opens a window around itself in every sorted array; a vector that lies in at least a threshold of the windows
is a candidate and is verified. Virtual rehashing starts with the windows of a small radius and widens them in steps on
the same arrays, until the query has its k or the radius reaches the similarity asked for.

Counting over one sorted array per projection meets a fixed share of all rows per query, which is quadratic.
Here the arrays are first cut into cells by the order of a few other projections (their signs), several times
over; windows are expanded inside a cell. Cell size stays constant as the table grows, and the number of
cuttings follows from the recall asked for. All coordinates being there, a cell verifies on them and passes on a bounded
number of links per query, which are verified exactly on the vectors. Where more vectors lie closer together than six
bits can tell, the cell is met once more on int16 coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.session import materialise

DIM = 64
#: Projections whose collisions are counted, and the rows a cell should hold.
COUNTED, CELL_ROWS = 32, 128
#: Share of the pairs at the lowest similarity asked for that must share a cell at least once.
RECALL = 0.98
#: Half width of a window in standard deviations of the projected distance at a radius.
HALF_WIDTH = 1.5
#: Coordinates of turned unit vectors have a deviation of about 1 after scaling and are stored in steps of 1/8, six bits each.
STEPS, LIMIT = 8.0, 31
#: Finer coordinates (int16) have so many steps in one of these.
FINER = 256
#: Radii of virtual rehashing: each is half of the next; the last is the distance at the similarity asked for.
RADII = 3
#: A cell with more rows is met in salted parts of at most so many.
PART_ROWS = 2048


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2))


def plan(rows: int, similarity: float) -> tuple[int, int]:
    """(signs per cell key, cuttings) for so many rows: cells of about ``CELL_ROWS`` and the recall asked for."""
    signs = max(1, min(30, round(math.log2(max(2, rows) / CELL_ROWS))))
    together = (1 - math.acos(similarity) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - together))) if together < 1 else 1


def width(radius: float) -> int:
    """Half width of the windows of a radius, in steps."""
    return max(1, round(HALF_WIDTH * radius * STEPS))


@lru_cache
def threshold(radius: float, miss: float = 0.0001) -> int:
    """Collisions that a pair at the radius reaches with probability ``1 - miss``, rounding to steps included."""
    p, total = 1 - _normal_tail((width(radius) + 0.5) / math.sqrt((radius * STEPS) ** 2 + 1 / 6)), 0.0
    for k in range(COUNTED + 1):
        total += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if total > miss:
            return k
    return COUNTED


def _packed(p: np.ndarray) -> np.ndarray:
    """Six bits of each coordinate: four of them in three bytes (n, 3 * dim / 4)."""
    u = (p + (LIMIT + 1)).astype(np.uint8).reshape(len(p), -1, 4)
    return np.stack((u[..., 0] | u[..., 1] << 6, u[..., 1] >> 2 | u[..., 2] << 4, u[..., 2] >> 4 | u[..., 3] << 2), 2).reshape(len(p), -1)


def _unpacked(b: np.ndarray) -> np.ndarray:
    """int8 coordinates of packed rows."""
    x, y, z = np.moveaxis(b.reshape(len(b), -1, 3), 2, 0)
    u = np.stack((x & 63, x >> 6 | (y & 15) << 2, y >> 4 | (z & 3) << 4, z >> 2), 2).reshape(len(b), -1)
    return u.astype(np.int8) - np.int8(LIMIT + 1)


def _hash_rows(matrix: np.ndarray, signs: int, cuttings: int, seed: int, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys (n, cuttings) and int8 or fine int16 coordinates (n, dim) of unit vectors after a random rotation."""
    rng = np.random.default_rng(seed)
    dim = matrix.shape[1]
    cut = rng.standard_normal((dim, cuttings * signs)).astype(np.float32)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    bits = (matrix @ cut > 0).reshape(len(matrix), cuttings, signs)
    keys = (bits * (1 << np.arange(signs, dtype=np.int64))).sum(2)
    turned = matrix @ turn * (STEPS * math.sqrt(dim))
    if fine:
        return keys, np.clip(np.rint(turned * FINER), -LIMIT * FINER, LIMIT * FINER).astype(np.int16)
    return keys, np.clip(np.rint(turned), -LIMIT, LIMIT).astype(np.int8)


_ROW = np.arange(COUNTED, dtype=np.int64)[:, None] * 513


def _coarse(p: np.ndarray) -> np.ndarray:
    """The int8 steps of coordinates of either kind."""
    return p if p.dtype == np.int8 else np.rint(p / FINER).astype(np.int8)


def usable_rows(vectors: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the lists with exactly ``dim`` finite values that are not all zero."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float32())
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null value becomes NaN
    good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
    return rows[good], matrix[good]


def _hasher(modalities: int, signs: int, cuttings: int, seed: int, dim: int, fine: bool = False):
    """Arrow batches (id, owner, vectors ...) to one row per usable vector: its class bits, cells and projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in range(modalities):
                rows, matrix = usable_rows(batch.column(2 + m), dim)
                if not len(rows):
                    continue
                digests = np.array([xxhash.xxh3_128_intdigest(x.tobytes()) for x in matrix + 0.0], dtype=object)
                x = np.array([d & (2**63 - 1) for d in digests], dtype=np.int64)
                y = np.array([d >> 65 for d in digests], dtype=np.int64)
                matrix /= np.abs(matrix).max(1, keepdims=True)  # no overflow in the norm
                keys, projections = _hash_rows((matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32), signs, cuttings, seed, fine)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, cuttings, dtype=np.int32), pa.array(keys.ravel().astype(np.int32)))
                stored = np.ascontiguousarray(projections if fine else _packed(projections)).view(np.uint8)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stored.shape[1]), len(rows), [None, pa.py_buffer(stored.tobytes())]).cast(pa.binary())
                at = pa.array(rows)
                columns = [pa.array(np.full(len(rows), m, np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(x), pa.array(y), lists, packed]
                yield pa.RecordBatch.from_arrays(columns, ["m", "id", "owner", "x", "y", "keys", "p"])

    return run


class Members:
    """The members of a cell part behind their sorted arrays, one per counted projection."""

    def __init__(self, p: np.ndarray, ids: np.ndarray, owners: np.ndarray):
        self.p, self.ids, self.owners = p, ids, owners
        counted = np.ascontiguousarray(_coarse(p[:, :COUNTED]).T)
        n = len(ids)
        # offsets[j * 513 + v]: where the value v - 256 begins in the sorted array j
        places = np.bincount((counted + (_ROW + 257)).ravel(), minlength=COUNTED * 513).reshape(COUNTED, 513)
        self.offsets = places.cumsum(1, dtype=np.int32).ravel()
        # positions are unsigned, so that one comparison tests both ends of a window
        kind = np.uint8 if n < 2**8 else np.uint16 if n < 2**16 else np.uint32
        self.rank = np.empty((COUNTED, n), kind)  # position of each member in each sorted array
        np.put_along_axis(self.rank, np.argsort(counted, 1, kind="stable"), np.arange(n, dtype=kind)[None, :], 1)
        self.norms = np.sqrt((p.astype(np.float64) ** 2).sum(1))

    def windows(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First position and size of the windows of half width ``width`` (below 128) around the queries, per projection."""
        at = np.ascontiguousarray(_coarse(q[:, :COUNTED]).T) + (_ROW + 256)
        begin = self.offsets[at - width]
        return begin.astype(self.rank.dtype), (self.offsets[at + (width + 1)] - begin).astype(self.rank.dtype)

    def collisions(self, begin: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of the pairs that lie in the windows of at least ``least`` projections."""
        shape = begin.shape[1], len(self.ids)
        counts, from_begin, inside = np.zeros(shape, np.uint8), np.empty(shape, self.rank.dtype), np.empty(shape, bool)
        for rank, b, n in zip(self.rank, begin, size, strict=True):
            np.subtract(rank[None, :], b[:, None], out=from_begin)
            np.less(from_begin, n[:, None], out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return np.divmod(np.flatnonzero(counts >= least), shape[1])


def _rank_within(*keys: np.ndarray) -> np.ndarray:
    """Position of each row among the rows equal in all keys, for rows sorted by them."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff([*starts, len(new)]))


def nearest_in_cell(q: np.ndarray, q_ids: np.ndarray, q_owners: np.ndarray, members: Members, k: int, similarity: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, owner of b, similarity)``: the first 2k members of other owners for each query, at most k of one owner.

    Windows widen over ``RADII`` until a query has 2k verified members of other owners within the radius. A radius is passed over
    without counting where the windows hold too little beyond their share of the widest ones, as wider windows lose nothing. An odd owner code marks a class of
    rows of several owners, to which the bound per owner applies; other queries need only the first k and their owner left out.
    A query that leaves out a member as near as its k-th, as far as the rounding can tell, comes out once with itself.
    """
    bound = math.sqrt(2 - 2 * similarity)
    found: list[tuple[np.ndarray, ...]] = []
    # rounding to steps lengthens the vectors, and its error in cosine grows with the distance
    rounded = q.dtype == np.int8
    longer, slack = (1 + 1 / (12 * STEPS**2), 0.02 * bound + 0.001) if rounded else (1.0, 1e-6)
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    real = np.float32 if rounded else np.float64
    widest = width(bound)
    for at in range(0, len(q), block):
        part = q[at : at + block]
        active = np.ones(len(part), bool)
        whole = members.windows(part, widest)
        total = whole[1].sum(0, dtype=np.int64)
        for level in range(RADII):
            radius, last = bound / 2 ** (RADII - 1 - level), level == RADII - 1
            least = threshold(radius)
            if last:
                tried, (begin, size) = active, whole
            else:
                # what the windows hold beyond their share of the widest ones must make up the members sought
                begin, size = members.windows(part, width(radius))
                tried = active & (size.sum(0, dtype=np.int64) - total * ((2 * width(radius) + 1) / (2 * widest + 1)) >= k * least)
            if not tried.any():
                continue
            rows = np.flatnonzero(tried)
            i, m = members.collisions(*((begin, size) if len(rows) == len(part) else (begin[:, rows], size[:, rows])), least)
            i = rows[i] + at
            other = (q_owners[i] != members.owners[m]) & (q_ids[i] != members.ids[m])
            i, m = i[other], m[other]
            if len(i):
                sim = np.einsum("ij,ij->i", q[i].astype(real), members.p[m].astype(real)) / (norms[i] * members.norms[m]) * longer
                near = sim >= (similarity - slack if last else 1 - radius**2 / 2)
                i, m, sim = i[near], m[near], sim[near]
            if not len(i):
                continue
            order = np.lexsort((members.ids[m], -sim, members.owners[m], i))
            i, m, sim = i[order], m[order], sim[order]
            kept = (_rank_within(i, members.owners[m]) < k) | (q_owners[i] & 1 == 0)
            order = np.lexsort((members.ids[m], -sim, i))
            order = order[kept[order]]
            i, m, sim = i[order], m[order], sim[order]
            place = _rank_within(i)
            kth, left_out = place == k - 1, place == 2 * k
            reach = np.full(len(part), np.inf)
            reach[i[kth] - at] = sim[kth] - 0.02 * np.sqrt(np.maximum(0, 2 - 2 * sim[kth])) - 0.0007
            unclear = i[left_out][sim[left_out] >= reach[i[left_out] - at]] if rounded else i[:0]
            kept = place < 2 * k
            i, m, sim = i[kept], m[kept], sim[kept]
            done = tried if last else tried & (np.bincount(i - at, minlength=len(part)) >= 2 * k)
            mine, unclear = done[i - at], q_ids[unclear[done[unclear - at]]]
            found.append((q_ids[i[mine]], members.ids[m[mine]], members.owners[m[mine]], sim[mine]))
            found.append((unclear, unclear, np.zeros(len(unclear), np.int64), np.full(len(unclear), np.nan)))
            active &= ~done
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip([*zip(*found)] or [()] * 4, (np.int64, np.int64, np.int64, np.float64), strict=True))


def _counter(k: int, similarity: float, dim: int, fine: bool):
    """Sorted Arrow batches (cell, part, query, id, o, p) to links of each row; a part may span batches, members come first."""
    schema = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bo", pa.int32()), ("sim", pa.float64())])

    def links(cell: int, ids: np.ndarray, owners: np.ndarray, p: np.ndarray, members: Members) -> Iterator[pa.RecordBatch]:
        a, b, bo, sim = nearest_in_cell(p, ids, owners, members, k, similarity)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), cell), a, b, bo.astype(np.int32), sim.astype(np.float64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, members = None, [], None

        def gather() -> Iterator[pa.RecordBatch]:
            """The members are complete: they get their arrays, and are queries themselves."""
            nonlocal held, members
            if held:
                ids, owners, p = (np.concatenate(x) for x in zip(*held, strict=True))
                members, held = Members(p, ids, owners), []
                yield from links(at[0], ids, owners, p, members)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, parts, query, ids, owners = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            raw = b"".join(batch.column(5).to_pylist())
            p = np.frombuffer(raw, np.int16).reshape(-1, dim) if fine else _unpacked(np.frombuffer(raw, np.uint8).reshape(-1, dim * 3 // 4))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                key = int(cells[lo]), int(parts[lo])
                if key != at:
                    yield from gather()
                    at, members = key, None
                if not query[lo]:
                    held.append((ids[lo:hi], owners[lo:hi], p[lo:hi]))
                    continue
                yield from gather()
                if members is not None:
                    yield from links(key[0], ids[lo:hi], owners[lo:hi], p[lo:hi], members)
        yield from gather()

    return run


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def neighbours(
    bank: DataFrame,
    modalities: Sequence[str],
    k: int = 10,
    similarity: float = 0.95,
    id_column: str = "bank_id",
    owner: str = "subject_id",
    dim: int = DIM,
    seed: int = 11,
) -> DataFrame:
    """``m, id, other, sim``: the k most similar vectors of other owners at or above ``similarity``, of every vector.

    Equal vectors form one class, hashed once: copies never meet each other pair by pair. A class keeps the
    first 2k of its rows by id with at most k of one owner, which holds the k first of other owners for
    any member; classes linked by a verified pair exchange these, and each row ranks its class's list without its
    own owner. Ties in similarity go to the smaller id. Rows with status other than 1, null, short, zero or
    non-finite vectors are no rows here. Pairs below ``similarity`` are not sought; above it a pair is missed
    with a probability of at most about 1 - ``RECALL``.
    """
    signs, cuttings = plan(bank.count(), similarity)
    types = dict(bank.dtypes)
    source = bank.where("status = 1").select(id_column, owner, *modalities)
    shape = f"m int, id {types[id_column]}, owner {types[owner]}, x bigint, y bigint, keys array<int>, p binary"
    hashed = materialise(source.mapInArrow(_hasher(len(modalities), signs, cuttings, seed, dim), shape), "hashed")
    # an unknown owner is an owner of its own
    owned = F.struct(F.col("owner").isNull().alias("alone"), F.coalesce(F.col("owner").cast("string"), F.col("id").cast("string")).alias("o"))
    rows = hashed.select("m", "id", owned.alias("owner"), "x", "y")
    classes = rows.groupBy("m", "x", "y").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n"), (F.min("owner") != F.max("owner")).alias("mixed")).where("n > 1").drop("n")
    copies = materialise(rows.join(classes, ["m", "x", "y"]).select("m", "id", "owner", "c", "mixed"), "copies")
    # rows that are copies of an earlier one meet nobody; an odd owner code marks a class of rows of several owners
    marked = hashed.select("m", "id", "p", "keys", F.hash(owned).alias("o")).join(copies.where("id <> c").select("m", "id"), ["m", "id"], "left_anti")
    mixed = copies.where("mixed AND id = c").select("m", "id", F.lit(True).alias("mixed"))
    code = F.when(F.col("mixed"), F.hash(F.lit("class"), "id").bitwiseOR(F.lit(1))).otherwise(F.col("o").bitwiseAND(F.lit(-2)))
    coded = marked.join(mixed, ["m", "id"], "left").select("m", "id", code.alias("o"), "p", F.posexplode("keys").alias("c", "key"))
    # cell numbers hold modality, cutting and key
    placed = coded.select("m", "id", "o", "p", (F.shiftleft((F.col("m") * cuttings + F.col("c")).cast("long"), signs) + F.col("key")).alias("cell"))
    # large cells, and cells with queries that six bits leave unclear, are met on finer coordinates
    sizes = placed.groupBy("cell").count().where(F.col("count") > PART_ROWS)
    large = materialise(sizes.select("cell", F.ceil(F.col("count") / (PART_ROWS // 2)).cast("int").alias("parts")), "large")
    small = placed.drop("m").join(large, "cell", "left_anti")
    met = materialise(_meet(small.select("cell", F.lit(0).alias("part"), F.lit(False).alias("query"), "id", "o", "p"), k, similarity, dim), "met")
    unclear = materialise(met.where("a = b").select("cell").distinct().select("cell", F.lit(1).alias("parts")).unionByName(large), "unclear")
    again = materialise(placed.drop("p").join(unclear, "cell"), "again")
    fine = source.withColumnRenamed(id_column, "id").join(again.select("id").distinct(), "id", "left_semi").select("id", owner, *modalities)
    finer = fine.mapInArrow(_hasher(len(modalities), signs, cuttings, seed, dim, True), shape).select("m", "id", "p")
    refined = _meet(_parted(again.join(finer, ["m", "id"])), k, similarity, dim, True)
    clear = met.where("a <> b").join(unclear, "cell", "left_anti").unionByName(refined)
    linked = clear.select(F.floor(F.shiftright("cell", signs) / cuttings).cast("int").alias("m"), "a", "b", "bo", "sim")
    # a row's links from all its cells: the first 2k, at most k of one owner, and those that rounding leaves as near as the k-th
    own = linked.repartition("m", "a").groupBy("m", "a", "b").agg(F.max("sim").alias("sim"), F.first("bo").alias("bo"))
    near = [F.desc("sim"), F.asc("b")]
    best = own.withColumn("i", F.row_number().over(Window.partitionBy("m", "a", "bo").orderBy(*near))).where(F.col("i") <= k)
    mine = Window.partitionBy("m", "a").orderBy(*near)
    kth = F.max(F.when(F.col("i") == k, F.col("sim"))).over(Window.partitionBy("m", "a"))
    best = best.withColumn("i", F.row_number().over(mine)).withColumn("kth", kth)
    best = best.where((F.col("i") <= 2 * k) | (F.col("sim") >= F.col("kth") - 0.02 * F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))) - 0.0007))
    candidates = materialise(best.select("m", "a", "b"), "candidates")
    needed = candidates.select("m", F.col("a").alias("id")).unionByName(candidates.select("m", F.col("b").alias("id"))).distinct()
    vectors = source.select(F.col(id_column).alias("id"), F.posexplode(F.array(*modalities)).alias("m", "v"))
    held = materialise(vectors.join(needed, ["m", "id"], "left_semi"), "vectors")
    side = lambda name: held.select("m", F.col("id").alias(name), F.col("v").alias(f"v{name}"))
    verified = candidates.join(side("a"), ["m", "a"]).join(side("b"), ["m", "b"]).select("m", "a", "b", cosine(F.col("va"), F.col("vb")).alias("sim")).where(F.col("sim") >= similarity)
    links = materialise(verified, "links")
    repeated = copies.select("m", "c").distinct()
    copies = copies.drop("mixed")
    all_links = links.unionByName(repeated.select("m", F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("sim")))
    # a class of one row, where it is linked at all
    ends = links.select("m", F.col("a").alias("c")).unionByName(links.select("m", F.col("b").alias("c"))).distinct()
    alone = ends.join(repeated, ["m", "c"], "left_anti").join(rows.select("m", F.col("id").alias("c"), "owner"), ["m", "c"]).select("m", F.col("c").alias("id"), "owner", "c")
    # first rows of each class, at most k of one owner
    by_owner, by_class = Window.partitionBy("m", "c", "owner").orderBy("id"), Window.partitionBy("m", "c").orderBy("id")
    copied = copies.withColumn("i", F.row_number().over(by_owner)).where(F.col("i") <= k).withColumn("i", F.row_number().over(by_class)).where(F.col("i") <= 2 * k)
    lists = copied.drop("i").unionByName(alone)
    members = copies.unionByName(alone)
    # per class: the first 2k rows over all linked classes, at most k of one owner
    order = [F.desc("sim"), F.asc("other")]
    offered = all_links.select("m", F.col("a").alias("c"), F.col("b"), "sim").join(lists.select("m", F.col("c").alias("b"), F.col("id").alias("other"), F.col("owner").alias("other_owner")), ["m", "b"])
    short = (
        offered.withColumn("i", F.row_number().over(Window.partitionBy("m", "c", "other_owner").orderBy(*order)))
        .where(F.col("i") <= k)
        .withColumn("i", F.row_number().over(Window.partitionBy("m", "c").orderBy(*order)))
        .where(F.col("i") <= 2 * k)
    )
    offers = short.groupBy("m", "c").agg(F.sort_array(F.collect_list(F.struct(F.col("i"), "other", "other_owner", "sim"))).alias("offers"))
    # each row takes the first k offers of other owners: no sort of a hot class
    own_first = members.join(offers, ["m", "c"]).select("m", "id", F.slice(F.filter("offers", lambda x: x["other_owner"] != F.col("owner")), 1, k).alias("best"))
    return own_first.select("m", "id", F.explode("best").alias("x")).select("m", "id", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"))


def _parted(rows: DataFrame) -> DataFrame:
    """``cell, part, query, id, o, p`` of ``rows(cell, parts, id, o, p)``: large cells in salted parts.

    Each row is a member of one part and a query of the others, so no pair is lost and no part holds the cell as members.
    """
    split = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    parts = split.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own", "id", "o", "p")
    return parts.select("cell", "part", (F.col("part") != F.col("own")).alias("query"), "id", "o", "p")


def _meet(rows: DataFrame, k: int, similarity: float, dim: int, fine: bool = False) -> DataFrame:
    """``cell, a, b, bo, sim``: the links of each row of ``(cell, part, query, id, o, p)`` to the members of its cell part."""
    placed = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "query")
    return placed.mapInArrow(_counter(k, similarity, dim, fine), "cell bigint, a bigint, b bigint, bo int, sim double")


def similar_pairs(bank: DataFrame, modalities: Sequence[str], k: int = 10, similarity: float = 0.95) -> DataFrame:
    """``modality, bank_id_a, bank_id_b`` (a < b): one record is among the k most similar of the other."""
    found = neighbours(bank, modalities, k, similarity)
    pair = found.select("m", F.least("id", "other").alias("bank_id_a"), F.greatest("id", "other").alias("bank_id_b")).distinct()
    return pair.select(F.element_at(F.array(*map(F.lit, modalities)), F.col("m") + 1).alias("modality"), "bank_id_a", "bank_id_b")
