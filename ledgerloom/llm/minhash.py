"""MinHash near-dedup by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every document gets its set of shingle hashes, a fingerprint of that set and a signature of K minima. Documents of
   one fingerprint are one class; only a class's representative goes on, so copies are never paired.
2. Two sets as similar as asked share at least T of K coordinate-value pairs, so they share one of the K - T + 1 first
   pairs of each in any common order (the prefix). The order is by a count sketch of fixed size, rare pairs first.
   Representatives are posted under their prefix; the one of a posting list whose pairs are commonest is its pivot, and
   lists of one pivot merge. In a group of near copies that is the one nearest to what they share, in most lists the same.
3. Collisions are counted in blocks of bounded size, between all members of a pivot that fit in one block, and between
   the pivot and each member where they are more. A block's rows are posted under each of their pairs; a row merges its
   K posting lists in order of length. The K - T + 1 shortest (the prefix) make its partners and their first counts; in
   the others partners are looked up, and those that can't reach T any more are skipped. That count decides: rows with a
   partner of at least T collisions stay.
4. For these, full sets are built from whole texts again, and a search over exact similarities finds the components
   within a block. It gives one link a member, not a link a pair.
5. Members of a large group that these links put in one component need not meet each other. Only those outside the
   component that holds most of them meet all members, again in blocks. A group of m near copies costs m rows; r members
   outside cost r * m / BLOCK.
6. Components of all links come from alternating large-star and small-star steps on tables in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import ascending, col, grouped, mix64, quoted, raw, slices, small, staged, starts_of, table, word_hashes
from .substrings import _pair, fold

#: Coordinates of a signature, and how many standard deviations below its mean the match threshold lies.
K, SIGMAS = 64, 5.5
#: Slots of the count sketch that orders pairs.
SLOTS = 1 << 20
#: Members and bytes of sets in a block.
BLOCK, BLOCK_BYTES = 500, 16 << 20
_R = np.random.default_rng(20240229)
ODD = _R.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
XOR = _R.integers(0, 1 << 63, K, dtype=np.uint64)


def threshold(similarity: float) -> int:
    """Collisions that a pair of that similarity reaches but for a chance of about 1e-7 (binomial: 1.5e-7 at 0.85, 8e-8 at 0.8)."""
    return max(1, math.floor(K * similarity - SIGMAS * math.sqrt(K * similarity * (1 - similarity))))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct hashes of each text's n-word shingles, ascending; a shorter text is one shingle, one without words none."""
    words = [t.lower().split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    at = starts_of(lens)
    h = word_hashes([x for w in words for x in w])
    s = fold(h, n, _pair)
    out = []
    for w, a, e in zip(words, at.tolist(), at[1:].tolist()):
        if e - a >= n:
            out.append(ascending(s[a : e - n + 1]))
        elif e > a:
            out.append(mix64(word_hashes([b"\0".join(w)]) + np.uint64(e - a)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each set, none of which is empty."""
    flat, at = np.concatenate(sets), starts_of(np.array([len(s) for s in sets], np.int64))[:-1]
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        x = (flat ^ XOR[k]) * ODD[k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at) >> np.uint64(16)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, th (hash of the text), n (size of its set), r and f2 (fingerprint of the set) and sig, staged."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import xxhash

        for b in slices(batches, "text"):
            texts = raw(col(b, "text"))
            sets = shingle_sets(texts, n)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            f1, f2, sig = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), [None] * len(sets)
            if len(full):
                some = [sets[i] for i in full]
                flat, at = np.concatenate(some), starts_of(size[full])[:-1]
                f1[full] = mix64(np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), at))
                f2[full] = mix64(np.add.reduceat(mix64(flat ^ np.uint64(0x14057B7EF767814F)), at))
                for i, s in zip(full.tolist(), signatures(some)):
                    sig[i] = s.tobytes()
            th = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([col(b, "id"), _signed(th), pa.array(size), _signed(f1), _signed(f2), pa.array(sig, pa.binary())], ["id", "th", "n", "r", "f2", "sig"])

    return staged(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, th long, n long, r long, f2 long, sig binary"), "minhash-sketches")


def _pair_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of every coordinate and value."""
    return mix64(sig.astype(np.uint64) | (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(40)))


def _matrix(b, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(col(b, name).to_pylist()), np.uint32).reshape(-1, K)


def pair_counts(reps: DataFrame) -> np.ndarray:
    """How many coordinate-value pairs of all representatives fall in each slot: a sketch of fixed size."""

    def run(batches):
        c = np.zeros(SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                c += np.bincount((_pair_keys(_matrix(b)).ravel() % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], ["slot", "c"])

    rows = reps.select("sig").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["c"].to_numpy()
    return out


def postings(reps: DataFrame, t: int) -> DataFrame:
    """key, rank and r: every representative under the pairs of its prefix. The commoner its pairs are, the lower is its rank."""
    counts = reps.sparkSession.sparkContext.broadcast(pair_counts(reps).clip(max=(1 << 32) - 1).astype(np.uint32))

    def run(batches):
        p = K - t + 1
        for b in batches:
            if not b.num_rows:
                continue
            keys = _pair_keys(_matrix(b))
            often = counts.value[(keys % np.uint64(SLOTS)).astype(np.int64)]
            order = np.lexsort((keys, often), axis=1)[:, :p]
            first = np.take_along_axis(keys, order, axis=1).ravel()
            rank = -np.log(often).sum(axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([_signed(first), pa.array(np.repeat(rank, p)), pa.array(np.repeat(col(b, "r").to_numpy(), p))], ["key", "rank", "r"])

    return reps.select("r", "sig").mapInArrow(run, "key long, rank float, r long")


def parts_of(members: DataFrame) -> DataFrame:
    """pivot and parts: how many blocks a pivot's members fill, by their number and by the bytes of their sets. Staged."""
    n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    return staged(members.groupBy("pivot").agg(n.alias("parts")), "minhash-parts")


def first_blocks(members: DataFrame, parts: DataFrame) -> DataFrame:
    """members (pivot, r, n) with block i, j and `asks`: all of a pivot with one block ask; of others the pivot alone, in each block."""
    large = small(parts.filter("parts > 1"))
    out = members.join(large, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")
    pivot = F.col("r") == F.col("pivot")
    out = out.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    return out.select("pivot", "r", "i", F.lit(0).alias("j"), (pivot | (F.col("parts") == 1)).alias("asks"))


def rest_blocks(members: DataFrame, parts: DataFrame, stars: DataFrame) -> DataFrame:
    """Blocks for what large groups leave. Most of a group's members are in one component of the links found so far (stars), so they need not meet; the others meet those, whom they ask, and each other."""
    every = members.join(small(parts.filter("parts > 1")), "pivot").join(stars.select(F.col("u").alias("r"), F.col("v").alias("c")), "r", "left")
    every = staged(every.withColumn("c", F.coalesce("c", "r")), "minhash-every")
    most = every.groupBy("pivot", "c").count().groupBy("pivot").agg(F.max(F.struct("count", "c")).alias("m")).select("pivot", F.col("m.c").alias("most"))
    every = every.join(small(staged(most, "minhash-most")), "pivot")
    rest = staged(every.filter("c <> most"), "minhash-rest")
    few = small(staged(rest.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("rests")), "minhash-rests"))
    own = lambda n: F.pmod(F.xxhash64("r"), F.col(n)).cast("int")
    rest, upto = rest.join(few, "pivot"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ask = rest.select("pivot", "r", own("rests").alias("i"), F.explode(upto("parts")).alias("j"), F.lit(True).alias("asks"))
    told = every.filter("c = most").join(few, "pivot").select("pivot", "r", F.explode(upto("rests")).alias("i"), own("parts").alias("j"), F.lit(False).alias("asks"))
    both = rest.select("pivot", "r", own("rests").alias("own"), F.explode(upto("rests")).alias("other"))
    both = both.select("pivot", "r", F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j"), F.lit(True).alias("asks"))
    return ask.union(told).union(both)


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", F.desc("asks"), "r")


def _block(g: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """A block's rows, those that ask first: r, signatures, and how many ask."""
    return g["r"].to_numpy(), np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint32).reshape(-1, K), int(np.count_nonzero(g["asks"].to_numpy()))


class Postings:
    """Rows of a block under each of their coordinate-value pairs."""

    def __init__(self, s: np.ndarray):
        self.s, n = s, len(s)
        keys = s.astype(np.uint64) | (np.arange(K, dtype=np.uint64) << np.uint64(32))
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.rows = keys.ravel()[order], order // K
        new = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), self.keys[1:] != self.keys[:-1]]))
        at, size = np.empty(n * K, np.int64), np.diff(new, append=n * K)
        at[order] = np.repeat(np.arange(len(new)), size)
        self.list, self.start, self.size = at.reshape(n, K), new, size  # the list of each row's pairs, where lists start, and their lengths

    def partners(self, x: int, t: int, wanted: np.ndarray) -> np.ndarray:
        """Rows among wanted (a mask), x itself aside, that share at least t pairs with row x."""
        lists = self.list[x]
        order = np.argsort(self.size[lists], kind="stable")
        short, rest = lists[order[: K - t + 1]], order[K - t + 1 :]
        start, size = self.start[short], self.size[short]
        at = np.arange(size.sum()) - np.repeat(starts_of(size)[:-1] - start, size)
        count = np.bincount(self.rows[at], minlength=len(self.s))
        y = np.flatnonzero((count > 0) & wanted)
        y = y[y != x]
        count = count[y]
        for a in range(0, len(rest), 16):  # the longer lists: who is in them, a few lists at a time
            if not len(y):
                break
            now = rest[a : a + 16]
            count = count + np.count_nonzero(self.list[y[:, None], now] == lists[now], axis=1)
            able = count + len(rest) - a - len(now) >= t
            y, count = y[able], count[able]
        return y[count >= t]


def live(members: DataFrame, t: int) -> DataFrame:
    """pivot, i, j, r and asks of the rows of blocks (with sig) that meet one that they ask, or that asks them, in at least t coordinates. Staged."""

    def run(batches):
        for (pivot, i, j), g in grouped(batches, ["pivot", "i", "j"]):
            r, s, n = _block(g)
            alive, posted = np.zeros(len(s), bool), Postings(s)
            for x in range(n):
                wanted = np.arange(len(s)) >= (n if n < len(s) else x + 1)  # all ask each other, or some ask the others
                y = posted.partners(x, t, wanted)
                if len(y):
                    alive[x] = alive[y] = True
            k = int(alive.sum())
            if k:
                same = lambda v, kind: pa.array(np.full(k, v), kind)
                yield pa.RecordBatch.from_arrays([same(pivot, pa.int64()), same(i, pa.int32()), same(j, pa.int32()), pa.array(r[alive]), pa.array(np.arange(len(s))[alive] < n)], ["pivot", "i", "j", "r", "asks"])

    return staged(_in_blocks(members).mapInArrow(run, "pivot long, i int, j int, r long, asks boolean"), "minhash-live")


def links(members: DataFrame, t: int, percent: int) -> DataFrame:
    """pivot, u and v, u > v: what ties a block's rows (with sig and shingles) by exact similarities of full sets. Staged.

    Where all ask, each row but the least of a component has one link, to that. Where some ask others, a pivot is linked
    to each that is near, and any other row to the first that is near, as those it asks are one component.
    """

    def run(batches):
        for (pivot, _, _), g in grouped(batches, ["pivot", "i", "j"]):
            r, s, n = _block(g)
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets])
            every, flat = np.unique(np.concatenate(sets), return_inverse=True)
            parts = np.split(flat, np.cumsum(size)[:-1])
            mark, posted = np.zeros(len(every), bool), Postings(s)

            def near(x: int, left: np.ndarray) -> np.ndarray:
                wanted = np.zeros(len(s), bool)
                wanted[left] = True
                y = posted.partners(x, t, wanted)
                if not len(y):
                    return y
                mark[parts[x]] = True
                both = np.array([np.count_nonzero(mark[parts[k]]) for k in y])
                mark[parts[x]] = False
                return y[100 * both >= percent * (size[x] + size[y] - both)]

            us, vs = [], []
            if n < len(r):
                for x in range(n):
                    y = near(x, np.arange(n, len(r)))
                    y = y if r[x] == pivot else y[:1]
                    us.append(np.full(len(y), r[x]))
                    vs.append(r[y])
            else:
                left = np.arange(len(r))
                while len(left):
                    queue, left, found = [left[0]], left[1:], [left[0]]
                    while queue and len(left):
                        new = near(queue.pop(), left)
                        if len(new):
                            left = left[~np.isin(left, new)]
                            queue += new.tolist()
                            found += new.tolist()
                    c = r[np.array(found)]
                    c = c[c != c.min()]
                    us.append(c)
                    vs.append(np.full(len(c), r[np.array(found)].min()))
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), pivot)), pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["pivot", "u", "v"])

    return staged(_in_blocks(members).mapInArrow(run, "pivot long, u long, v long").distinct(), "minhash-links")


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, alive: DataFrame, reps: DataFrame) -> DataFrame:
    """r and shingles of the representatives in alive, from their whole texts. Staged."""
    wanted = staged(alive.select("r").distinct().join(reps.select("r", "id", "th"), "r"), "minhash-wanted")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def build(batches):
        import xxhash

        for b in slices(batches, "text"):
            texts, th = raw(col(b, "text")), col(b, "th").to_pylist()
            own = [i for i, (x, h) in enumerate(zip(texts, th)) if np.uint64(xxhash.xxh64_intdigest(x)).view(np.int64) == h]
            if own:
                sets = shingle_sets([texts[i] for i in own], shingle)
                yield pa.RecordBatch.from_arrays([col(b, "r").take(pa.array(own)), pa.array([s.tobytes() for s in sets], pa.binary())], ["r", "shingles"])

    sets = src.join(small(wanted), "id").mapInArrow(build, "r long, shingles binary")
    return staged(sets.groupBy("r").agg(F.min("shingles").alias("shingles")), "minhash-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id (as doc_id), n_shingles, component_id (the least id reachable over links, its own included) and kept.

    Sets with 100 * intersection >= percent * union are linked. Words are split at ASCII white space, A-Z lower-cased;
    a text of fewer words than a shingle is one shingle. Null texts, texts without words and rows without id are linked
    with nothing; such rows without id have a null component and are kept. Repeated rows fall in one component.
    """
    t = threshold(percent / 100)
    all_ = sketches(docs, id_col, text_col, shingle)
    some = all_.filter("n > 0 and id is not null")
    reps = some.groupBy(F.col("r").alias("f1"), "f2", "n").agg(F.min(F.struct("id", "th", "sig")).alias("m"), F.count("*").alias("copies"))
    reps = staged(reps.select("f1", "f2", "n", "copies", "m.*", F.monotonically_increasing_id().alias("r")), "minhash-classes")
    posted = staged(postings(reps, t), "minhash-postings")
    pivots = staged(posted.groupBy("key").agg(F.min(F.struct("rank", "r")).alias("m"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("m.r").alias("pivot")), "minhash-pivots")
    met = staged(posted.join(pivots, "key").select("pivot", "r").distinct().join(reps.select("r", "n"), "r"), "minhash-members")
    parts = parts_of(met)
    signed = lambda rows: rows.join(reps.select("r", "sig"), "r")
    alive = live(signed(first_blocks(met, parts)), t)
    sets = _sets(docs, id_col, text_col, shingle, alive, reps)
    edges = links(signed(alive).join(sets, "r"), t, percent)
    stars = components(edges)
    if not parts.filter("parts > 1").isEmpty():
        late = live(signed(rest_blocks(met, parts, stars)), t)
        if not late.isEmpty():
            late = links(signed(late).join(_sets(docs, id_col, text_col, shingle, late, reps), "r"), t, percent)
            stars = components(stars.union(late.select("u", "v")))
    named = stars.join(reps.select("r", "id"), stars.u == reps.r).select("u", "v", "id").union(reps.select(F.col("r").alias("u"), F.col("r").alias("v"), "id").join(stars.select("v").distinct(), "v", "left_semi").select("u", "v", "id"))
    named = staged(named, "minhash-named")
    least = named.groupBy("v").agg(F.min("id").alias("component"))
    of = named.join(least, "v").select(F.col("u").alias("r"), "component")
    of = reps.join(of, "r", "left").filter("copies > 1 or component is not null").select(F.col("f1").alias("r"), "f2", "n", F.coalesce("component", "id").alias("component"))
    of = small(staged(of, "minhash-components"))
    own = F.coalesce("component", "id")
    return all_.drop("th", "sig").join(of, ["r", "f2", "n"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document near_duplicates() keeps, one for each id (of several, that of the least text); rows without id stay.

    Only ids move: those to drop, and those that repeat, are joined to the rows, broadcast if they are few.
    """
    found = staged(near_duplicates(docs, id_col, text_col, shingle, percent).select(F.col("doc_id").alias(id_col), "kept"), "minhash-kept")
    drop = small(staged(found.filter("not kept").select(id_col).distinct(), "minhash-drop"))
    left = docs.join(drop, id_col, "left_anti").select(*quoted(docs.columns))
    again = staged(found.filter(F.col("kept") & F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "minhash-again")
    if again.isEmpty():
        return left
    again = small(again)
    row = F.struct(*quoted(docs.columns))
    one = left.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min_by(row, F.struct(F.col(text_col), F.xxhash64(F.to_json(row)))).alias("__row"))
    return left.join(again, id_col, "left_anti").select(*quoted(docs.columns)).unionByName(one.select("__row.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir), shingle=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2))),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 85 * (zx.n + zy.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.x AS doc_id, r.m FROM r JOIN l ON l.y = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
