"""Near-duplicate vectors of one label by a tiled comparison in the order of principal components.

1. Vectors of length one are classes where they are equal, and a class is compared once, whatever its copies.
2. Each length of vectors is turned to its principal components, so that leading coordinates hold most of a product. A
   rotation changes no product, so results do not depend on it.
3. Classes of one label are cut into tiles: by medians of leading coordinates of a sample (which decide only who shares
   a tile), and by hash where a cut holds more than a tile, as with groups of near copies. Two tiles meet only if their
   boxes are near enough for any pair in them to be linked.
4. A task compares two tiles: it adds up products of leading coordinates, bounds the rest of each by the norms of what
   is left, and goes on only with pairs that can still reach the threshold. Those within rounding of it are computed
   again from the vectors as given.
5. It returns link counts of rows and, instead of links, one edge a row to the least row of its component in the two
   tiles, so a group of m near copies costs m rows for each two tiles. Components come from star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .codebooks import flat_lists
from .common import col, grouped, joined, small, staged, table

#: Bytes of a tile's rotated coordinates, leading coordinates by which tiles are cut, and classes (about) whose coordinates say where.
TILE_BYTES, AXES, SAMPLE = 1 << 19, 8, 50_000
#: Lengths of vectors that get a rotation (the commonest ones), and the longest; others keep their coordinates.
ROTATED, LONGEST = 4, 2048
#: Cuts of one label at most; beyond, tiles are told apart by hash.
DEPTH = 10
#: What rounding may do to a product of vectors of length one.
SLACK = 1e-9
#: Rows of a tile that are compared at once, and the part of their pairs up to which the living ones go on singly.
STRIP, SPARSE = 256, 1 / 16


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, label, dim, f1, f2; dim is null where a row links with nothing), and the classes of equal vectors (r, id, copies, label, dim, f1, f2, v). Staged."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    src = src.withColumn("named", F.col("id").isNotNull() & F.col("label").isNotNull())

    def run(batches):
        import xxhash

        for b in batches:
            if not b.num_rows:
                continue
            flat, at, bad = flat_lists(col(b, "v"))
            ok = ~bad & col(b, "named").to_numpy(zero_copy_only=False)
            blobs, dims, f = [None] * b.num_rows, [None] * b.num_rows, np.zeros((b.num_rows, 2), np.int64)
            for i in np.flatnonzero(ok).tolist():
                x = flat[at[i] : at[i + 1]]
                if x.any():
                    blobs[i], dims[i] = x.tobytes(), len(x)
                    f[i] = np.frombuffer(xxhash.xxh3_128_digest(blobs[i]), np.int64)
            yield pa.RecordBatch.from_arrays([col(b, "id"), col(b, "label"), pa.array(dims, pa.int32()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(blobs, pa.binary())], ["id", "label", "dim", "f1", "f2", "v"])

    kind = lambda c: src.schema[c].dataType.simpleString()
    rows = staged(src.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, dim int, f1 long, f2 long, v binary"), "tiles-rows")
    keys = ["label", "dim", "f1", "f2"]
    own = rows.filter("dim is not null").groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.drop("v"), staged(own.withColumn("r", F.monotonically_increasing_id()), "tiles-classes")


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """The vectors scaled to length one; each is divided by its largest component first, so no square overflows or vanishes."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dim(batch: pa.RecordBatch):
    """The rows of a batch by the length of their vectors."""
    dims = col(batch, "dim").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, [col(batch, "v")[int(i)].as_py() for i in at]


def rotations(reps: DataFrame) -> dict[int, np.ndarray]:
    """By length, the principal axes (columns, largest spread first) of all classes, for the commonest lengths: matrices of LONGEST by LONGEST at most."""
    common = [r.dim for r in reps.filter(F.col("dim") <= LONGEST).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(ROTATED).collect()]
    if not common:
        return {}

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, blobs in by_dim(b):
                u = unit(blobs, d)
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array([x.tobytes() for x in m], pa.binary())], ["dim", "i", "row"])

    def merged(batches):
        for (d, i), g in grouped(batches, ["dim", "i"]):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([np.frombuffer(b"".join(g["row"].to_pylist()), np.float64).reshape(-1, d).sum(axis=0).tobytes()], pa.binary())], ["dim", "i", "row"])

    ddl = "dim int, i int, row binary"
    rows = reps.filter(F.col("dim").isin(common)).select("dim", "v").mapInArrow(products, ddl)
    sums = rows.repartition("dim", "i").sortWithinPartitions("dim", "i").mapInArrow(merged, ddl).toArrow().sort_by([("dim", "ascending"), ("i", "ascending")])
    out = {}
    for d in common:
        m = np.frombuffer(b"".join(sums.filter(pa.compute.equal(sums["dim"], d))["row"].to_pylist()), np.float64).reshape(d, d)
        out[d] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return out


def rotated(reps: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """r, copies, label, dim, v, x (rotated vectors of length one as bytes) and c (their leading coordinates). Staged."""
    shared = reps.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            xs, cs = [None] * b.num_rows, [None] * b.num_rows
            for d, at, blobs in by_dim(b):
                u = unit(blobs, d)
                u = u @ shared.value[d] if d in shared.value else u
                lead = np.zeros((len(u), AXES))
                lead[:, : min(d, AXES)] = u[:, :AXES]
                for i, x, c in zip(at.tolist(), u, lead):
                    xs[i], cs[i] = x.tobytes(), c
            yield pa.RecordBatch.from_arrays([*[col(b, n) for n in ("r", "copies", "label", "dim", "v")], pa.array(xs, pa.binary()), pa.array(cs, pa.list_(pa.float64()))], ["r", "copies", "label", "dim", "v", "x", "c"])

    kind = reps.schema["label"].dataType.simpleString()
    return staged(reps.select("r", "copies", "label", "dim", "v").mapInArrow(run, f"r long, copies long, label {kind}, dim int, v binary, x binary, c array<double>"), "tiles-rotated")


def tile_rows(dim: int) -> int:
    return max(16, TILE_BYTES // (8 * dim))


def _cut(c: np.ndarray, weight: float, most: int, depth: int):
    """A tree of (axis, value, below, above) that cuts points at medians of their widest axis, or None for a leaf."""
    if depth == 0 or len(c) < 8 or len(c) * weight <= most:
        return None
    axis = int(np.argmax(np.ptp(c, axis=0)))
    value = float(np.median(c[:, axis]))
    below = c[:, axis] < value
    if not below.any() or np.ptp(c[:, axis]) < 1e-6:
        return None
    return axis, value, _cut(c[below], weight, most, depth - 1), _cut(c[~below], weight, most, depth - 1)


def cuts(points: DataFrame) -> dict:
    """By label and length, a tree that cuts its classes into tiles, from the leading coordinates of about SAMPLE classes of the table."""
    share = max(1, math.ceil(points.count() / SAMPLE))
    some = points.filter(F.pmod(F.xxhash64("r"), F.lit(share)) == 0).select("label", "dim", "c").limit(2 * SAMPLE).toArrow()
    by: dict = {}
    for label, dim, c in zip(some["label"].to_pylist(), some["dim"].to_pylist(), some["c"].to_pylist()):
        by.setdefault((label, dim), []).append(c)
    trees = {k: _cut(np.array(c), share, tile_rows(k[1]), DEPTH) for k, c in by.items()}
    return {k: t for k, t in trees.items() if t}


def leaf_of(c: np.ndarray, tree) -> np.ndarray:
    """Which leaf each point falls in, by its path."""
    out = np.ones(len(c), np.int64)

    def go(at: np.ndarray, node, path: int) -> None:
        if node is None or not len(at):
            out[at] = path
            return
        axis, value, below, above = node
        low = c[at, axis] < value
        go(at[low], below, 2 * path)
        go(at[~low], above, 2 * path + 1)

    go(np.arange(len(c)), tree, 1)
    return out


def tiled(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles (tile, dim, rs, ns, vs, xs: the rows of a tile as bytes), and their boxes (tile, label, dim, lo, hi). Staged."""
    shared = points.sparkSession.sparkContext.broadcast(cuts(points))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            labels, dims = col(b, "label").to_pylist(), col(b, "dim").to_pylist()
            c, leaf = np.array(col(b, "c").to_pylist()), np.ones(b.num_rows, np.int64)
            groups: dict = {}
            for i, k in enumerate(zip(labels, dims)):
                if k in shared.value:
                    groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                leaf[at] = leaf_of(c[at], shared.value[k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    kind = points.schema["label"].dataType.simpleString()
    placed = staged(points.mapInArrow(run, f"r long, copies long, label {kind}, dim int, v binary, x binary, c array<double>, leaf long"), "tiles-placed")
    box = lambda f: F.array(*[f(F.element_at("c", k + 1)) for k in range(AXES)])
    leaves = placed.groupBy("label", "dim", "leaf").agg(F.count("*").alias("n"), box(F.min).alias("lo"), box(F.max).alias("hi"))
    leaves = leaves.withColumn("parts", F.ceil(F.col("n") / F.greatest(F.lit(16), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim"))))).cast("int"))
    boxes = staged(leaves.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("tile", F.monotonically_increasing_id()), "tiles-boxes")
    # leaves of several tiles are the rows over those of a tile at most; their rows are spread before they meet their tile
    large = small(boxes.filter("parts > 1 and sub = 0").select("label", "dim", "leaf", "parts"))
    spread = placed.join(large, ["label", "dim", "leaf"], "left").withColumn("sub", F.pmod(F.xxhash64("r"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    named = spread.join(small(boxes.select("label", "dim", "leaf", "sub", "tile")), ["label", "dim", "leaf", "sub"]).select("tile", "dim", "r", "copies", "v", "x")

    def pack(batches):
        for (tile, dim), g in grouped(batches, ["tile", "dim"]):
            blobs = [g["r"].to_numpy().tobytes(), g["copies"].to_numpy().tobytes(), b"".join(g["v"].to_pylist()), b"".join(g["x"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["tile", "dim", "rs", "ns", "vs", "xs"])

    packed = named.repartition("tile").sortWithinPartitions("tile").mapInArrow(pack, "tile long, dim int, rs binary, ns binary, vs binary, xs binary")
    return staged(packed, "tiles"), boxes


def tile_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """a and b, tiles of one label and length whose boxes are no farther apart than linked vectors can be; a tile meets itself too. Staged.

    Tiles meet over cells of the first coordinate as wide as that distance.
    """
    far = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / far), F.floor(hi / far)))
    first = lambda c: F.element_at(c, 1)
    a = boxes.select("label", "dim", F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), cells(first("lo") - far, first("hi") + far).alias("cell"))
    b = boxes.select("label", "dim", F.col("tile").alias("b"), "lo", "hi", cells(first("lo"), first("hi")).alias("cell"))
    apart = F.aggregate(F.arrays_zip("lo", "hi", "alo", "ahi"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["lo"] - x["ahi"], x["alo"] - x["hi"]), 2))
    met = a.join(b, ["label", "dim", "cell"]).filter((F.col("a") <= F.col("b")) & (apart <= far * far)).select("a", "b").distinct()
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0  # so that no tile always is the second
    return staged(met.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("b")), "tiles-pairs")


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """[:, k]: the norm of what each row has from coordinate k on."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
    return out


def near(x: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y (rotated, of length one; v and w as given) have a cosine of `least` or more."""
    dim, hit = x.shape[1], np.zeros((len(x), len(y)), bool)
    steps = [min(dim, AXES << k) for k in range(max(1, math.ceil(math.log2(max(1, dim / AXES))) + 1))]
    sx, sy = suffix_norms(x), suffix_norms(y)
    for a in range(0, len(x), STRIP):
        s = slice(a, a + STRIP)
        total, lo, i = 0.0, 0, None
        for hi in steps:
            if i is None:  # all pairs of the strip
                total = total + x[s, lo:hi] @ y[:, lo:hi].T
                alive = total + sx[s, hi, None] * sy[None, :, hi] >= least - SLACK
                n = int(np.count_nonzero(alive))
                if n <= SPARSE * alive.size or hi == dim:
                    i, j = np.nonzero(alive)
                    total, i = total[i, j], i + a
            else:  # those that can still reach it
                total = total + np.einsum("ij,ij->i", x[i, lo:hi], y[j, lo:hi])
                alive = total + sx[i, hi] * sy[j, hi] >= least - SLACK
                total, i, j = total[alive], i[alive], j[alive]
            if i is not None and not len(i):
                break
            lo = hi
        hit[i, j] = total >= least
        close = np.flatnonzero(np.abs(total - least) <= SLACK)
        if len(close):
            i, j = i[close], j[close]
            p, q = (m / np.abs(m).max(axis=1, keepdims=True) for m in (v[i], w[j]))
            hit[i, j] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= least
    return hit


def stars(hit: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph of links hit between u (rows) and v (columns): every node but the least of its component, and that least."""
    rows, cols = hit.any(axis=1), hit.any(axis=0)
    nodes, roots = [], []
    while rows.any():
        new = np.flatnonzero(rows)[:1]
        rows[new] = False
        found = [u[new]]
        while len(new):
            across = np.flatnonzero(hit[new].any(axis=0) & cols)
            cols[across] = False
            found.append(v[across])
            new = np.flatnonzero(hit[:, across].any(axis=1) & rows)
            rows[new] = False
            found.append(u[new])
        c = np.unique(np.concatenate(found))
        nodes.append(c[1:])
        roots.append(np.full(len(c) - 1, c[0]))
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (u[:0], u[:0])


def compared(tiles: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """u and n (how many vectors outside its class a row's class is linked to in two tiles; v is null), and edges u and v (n is null). Staged."""
    side = lambda name: tiles.select(F.col("tile").alias(name), "dim", *[F.col(c).alias(name + c) for c in ("rs", "ns", "vs", "xs")])
    both = side("a").join(small(pairs), "a").join(side("b").drop("dim"), "b")

    def read(b, name: str, i: int, dim: int):
        get = lambda c, kind: np.frombuffer(col(b, name + c)[i].as_py(), kind)
        return get("rs", np.int64), get("ns", np.int64), get("vs", np.float64).reshape(-1, dim), get("xs", np.float64).reshape(-1, dim)

    def run(batches):
        for b in batches:
            for i, (p, q, dim) in enumerate(zip(col(b, "a").to_pylist(), col(b, "b").to_pylist(), col(b, "dim").to_pylist())):
                r, n, v, x = read(b, "a", i, dim)
                s, m, w, y = read(b, "b", i, dim) if p != q else (r, n, v, x)
                hit = near(x, y, v, w, least)
                if p == q:
                    np.fill_diagonal(hit, False)
                    hit |= hit.T
                if not hit.any():
                    continue
                us, ns = [r], [hit @ m]
                if p != q:
                    us, ns = [r, s], [hit @ m, hit.T @ n]
                else:
                    np.fill_diagonal(hit, hit.any(axis=1))  # a row and its column are one node
                us, ns = np.concatenate(us), np.concatenate(ns)
                us, ns = us[ns > 0], ns[ns > 0]
                c, root = stars(hit, r, s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([us, c])), pa.array([*[None] * len(us), *root.tolist()], pa.int64()), pa.array([*ns.tolist(), *[None] * len(c)], pa.int64())], ["u", "v", "n"])

    return staged(both.select("a", "b", "dim", *[p + c for p in "ab" for c in ("rs", "ns", "vs", "xs")]).mapInArrow(run, "u long, v long, n long"), "tiles-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """vec_id, n_links (other vectors of its label with a cosine of `least` or more), component_id (the least id reachable) and kept.

    Vectors that are null, zero or empty, that hold null or non-finite components, and those without label or id link
    with nothing; their component is themselves, null without id, which is kept. Vectors of unlike length do not link.
    Repeated rows link with each other, and all rows of a component's least id are kept. `least` is above 0 and at
    most 1. An empty table gives no rows. Other columns are not read.
    """
    rows, reps = classes(vectors, id_col, vector_col, label_col)
    tiles, boxes = tiled(rotated(reps, rotations(reps)))
    found = compared(tiles, tile_pairs(boxes, least), least)
    counts = found.filter("n is not null").groupBy(F.col("u").alias("r")).agg(F.sum("n").alias("links"))
    edges = staged(components(found.filter("v is not null").select("u", "v")), "tiles-stars")
    member = edges.union(edges.select(F.col("v").alias("u"), "v").distinct())
    named = staged(member.join(reps.select(F.col("r").alias("u"), "id"), "u"), "tiles-named")
    least_id = named.groupBy("v").agg(F.min("id").alias("component"), F.count("*").alias("copies"))
    part = joined(named, staged(least_id.withColumnRenamed("v", "root"), "tiles-roots"), lambda a, b: a["v"] == b["root"], "inner").select(F.col("u").alias("r"), "component")
    of = reps.select("r", "id", "copies", *[F.col(c).alias("k" + c) for c in ("label", "dim", "f1", "f2")]).join(counts, "r", "left").join(part, "r", "left").filter("copies > 1 or links is not null")
    of = staged(of.select("copies", "klabel", "kdim", "kf1", "kf2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "tiles-of")
    out = joined(rows, of, lambda a, b: (a["f1"] == b["kf1"]) & (a["f2"] == b["kf2"]) & (a["label"] == b["klabel"]) & (a["dim"] == b["kdim"]))
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def op13(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT l.u AS vec_id, r.m FROM r JOIN l ON l.v = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
