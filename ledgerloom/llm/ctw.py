"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is its words, A-Z lower-cased, with single spaces and one end byte. Each byte is eight binary decisions; each
decision has a context tree over the bytes before it, to a fixed depth, with a Krichevsky-Trofimov estimate in every
node. A node's weighted probability is half its own estimate and half the product of its children's; the share of the
estimate in that sum is the weight with which prediction stops there, so a prediction mixes the estimates of all depths.

All counts come from byte n-grams of all training texts. Tasks pass distinct ones on as compressed blocks of keys and
counts, dealt by hash, which are summed and dealt again by the last three context bytes. Trees that share their last three context bytes
are independent below depth three, so they are built in batches of whole such groups; depth two is a table of at most
16.7 million nodes, kept in 256 files, and what lies above has at most 65,280 nodes and is built on the driver. N-grams
of the texts to score that training never showed get their values from the same trees: each decision is that of the
deepest node seen. Values lie in sorted blocks of bounded size in the shared folder. A scoring task gathers the distinct
n-grams of some MB of text, asks block after block for them once, and scores the texts from what it got, so no model
size is ever broadcast or held.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascending, col, exists, get, grouped, mix64, put, raw, release, remainder, roomy, scratch, slices, staged, table

#: Bytes of context, at most seven.
DEPTH = 7
#: Entries of a part or block on average, distinct counts that a task holds before it passes them on, and n-grams that are made trees at once.
BLOCK, HELD, BATCH = 2_000_000, 2_000_000, 200_000
#: Text that a scoring task holds while it asks the blocks.
WINDOW = 8 << 20
END = b"\n"
GRAM, TOKEN = 0, 1


#: Lower case for A-Z, a space for white space.
PLAIN = bytes(b + 32 if 65 <= b < 91 else 32 if b in b" \t\n\v\f\r" else b for b in range(256))
_R = np.random.default_rng(20240607)
#: What a byte and its place add to a word's hash.
BYTE, STEP = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts as the model reads them, words with single spaces and an end behind each text; and where each starts."""
    flat = np.frombuffer(END.join([t.translate(PLAIN) for t in texts] + [b""]), np.uint8)
    gap = flat == 32
    before = np.ones(len(flat), bool)
    before[1:] = (gap | (flat == 10))[:-1]
    flat = flat[~(gap & before)]
    behind = np.zeros(len(flat), bool)
    behind[:-1] = (flat == 32)[:-1] & (flat == 10)[1:]
    flat = flat[~behind]
    ends = np.flatnonzero(flat == 10)
    return flat, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends


def grams(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every byte of the texts, that byte (lowest) and the DEPTH bytes before it; ends stand before a text."""
    at = np.arange(len(flat)) + DEPTH * np.repeat(np.arange(1, len(first) + 1), np.diff(first, append=len(flat)))
    pad = np.full(len(flat) + DEPTH * len(first), 10, np.uint64)
    pad[at] = flat
    key = pad.copy()
    for j in range(1, DEPTH + 1):
        key[j:] |= pad[:-j] << np.uint64(8 * j)
    return key[at]


def tokens_of(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word and every end, in order; and where the tokens of each text start."""
    end = flat == 10
    gap = end | (flat == 32)
    start = end.copy()
    start[0] |= not gap[0]
    start[1:] |= gap[:-1] & ~gap[1:]
    at = np.flatnonzero(start)
    place = np.arange(len(flat)) - np.repeat(at, np.diff(at, append=len(flat)))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, STEP))
    part = BYTE[flat] * power[place]
    part[flat == 32] = 0
    return mix64(np.add.reduceat(part, at)), np.searchsorted(at, first)


def runs(a: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.concatenate([np.zeros(min(1, len(a)), np.int64), np.flatnonzero(a[1:] != a[:-1]) + 1])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of what they had."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    if len(parts) > 1:
        order = np.argsort(keys, kind="stable")  # finds the sorted runs
        keys, n = keys[order], n[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and which of them each key is."""
    order = np.argsort(keys)
    at = runs(keys[order])
    which = np.empty(len(keys), np.int32)
    which[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at, append=len(keys)))
    return keys[order[at]], which


class Counts:
    """Distinct keys and their counts, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.parts[1:]) > HELD // 2:
            self.parts = [merged(self.parts)]

    def full(self) -> bool:
        return sum(len(k) for k, _ in self.parts) > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts = merged(self.parts), []
        return out


#: Keys of one part in ascending order, byte by byte of all of them and compressed, with a number for each.
MESSAGE = "kind int, part int, size int, keys binary, n binary"


def narrow(part: np.ndarray) -> np.ndarray:
    """Part numbers in 16 bits where they fit, which sort in linear time."""
    return part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part


def messages(kind: int, keys: np.ndarray, n: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row for each part, from keys in ascending order."""
    zip_ = lambda x: pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)
    order = np.argsort(narrow(part), kind="stable")
    keys, n, part = keys[order], n[order], part[order]
    at = runs(part)
    ends = np.append(at[1:], len(part))
    own = [zip_(keys[a:e]) for a, e in zip(at, ends)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(part[at].astype(np.int32)), pa.array((ends - at).astype(np.int32)), pa.array(own, pa.binary()), pa.array([zip_(n[a:e]) for a, e in zip(at, ends)], pa.binary())], ["kind", "part", "size", "keys", "n"])


def opened(t: pa.Table, number=np.int64) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys and numbers of messages."""
    zip_ = lambda x, size, kind: np.frombuffer(pa.decompress(x, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()
    return [(zip_(k, size, np.uint64), zip_(n, size, number)) for size, k, n in zip(*(t[c].to_pylist() for c in ("size", "keys", "n")))]


def group_of(key: np.ndarray) -> np.ndarray:
    """The last three bytes of context."""
    return (key >> np.uint64(8)) & np.uint64(0xFFFFFF)


def counted(docs: DataFrame, text_col: str, parts: int, folder: str) -> DataFrame:
    """How often each byte n-gram and each token (by hash) occurs in all texts. Staged.

    Messages of n-grams, dealt by their groups; of tokens, which go to files of the folder, distinct and total numbers.
    """

    def run(batches):
        roomy()
        held = {GRAM: Counts(), TOKEN: Counts()}
        for b in slices(batches, "text", 1 << 20, give_back=False):
            text = normal(raw(col(b, "text")))
            held[GRAM].add(grams(*text))
            held[TOKEN].add(tokens_of(*text)[0])
            for kind, c in held.items():
                if c.full():
                    keys, n = c.take()
                    yield messages(kind, keys, n, _block(keys, parts))
        for kind, c in held.items():
            keys, n = c.take()
            yield messages(kind, keys, n, _block(keys, parts))
        release()

    def settle(t: pa.Table) -> pa.Table:
        kind, part = t["kind"][0].as_py(), t["part"][0].as_py()
        keys, n = merged(opened(t))
        if kind == TOKEN:
            put(f"{folder}/{part}", keys.tobytes() + n.astype(np.float64).tobytes())
            return pa.table({"kind": pa.array([TOKEN], pa.int32()), "part": pa.array([part], pa.int32()), "size": pa.array([0], pa.int32()), "keys": [b""], "n": [b""], "distinct": [len(keys)], "total": [int(n.sum())]})
        out = pa.Table.from_batches([messages(GRAM, keys, n, _block(group_of(keys), parts))])
        return out.append_column("distinct", pa.array(out["size"].to_numpy().astype(np.int64))).append_column("total", pa.array(np.zeros(len(out), np.int64)))

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, MESSAGE)
    return staged(rows.groupBy("kind", "part").applyInArrow(settle, MESSAGE + ", distinct long, total long"), "ctw-counts")


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after eight steps up."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        s = s - np.log(x + k)
    return s


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth, sorted by key (context and bits decided so far): zeros, ones, weighted probability, weight of stopping, and the product over the children."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_p: np.ndarray
    stop: np.ndarray
    below: np.ndarray | None = None

    @property
    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def weighted(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> Level:
    """below: logarithm of the product over the children; None for nodes of full depth."""
    own = log_kt(n0, n1)
    if below is None:
        return Level(key, n0, n1, own, np.ones(len(key)))
    return Level(key, n0, n1, np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700))), below)


def in_batches(keys: np.ndarray, n: np.ndarray):
    """Keys and counts in batches of whole groups; in a group, equal contexts stand together in ascending order of bytes."""
    order = np.lexsort((keys, group_of(keys)))
    keys, n = keys[order], n[order]
    at = np.append(runs(group_of(keys)), len(keys))
    a = 0
    while a < len(at) - 1:
        e = max(a + 1, int(np.searchsorted(at, at[a] + BATCH, side="right")) - 1)
        yield keys[at[a] : at[e]], n[at[a] : at[e]]
        a = e


def leaves(gram: np.ndarray, n: np.ndarray) -> Level:
    """Nodes of full depth, from n-grams in which equal contexts stand together, in ascending order of their bytes."""
    byte, ctx, n = gram & np.uint64(255), gram >> np.uint64(8) << np.uint64(8), n.astype(np.float64)
    keys, zeros, ones = [], [], []
    for k in range(8):
        key = ctx | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        one = n * ((byte >> np.uint64(7 - k)) & np.uint64(1))
        keys.append(key[at])
        ones.append(np.add.reduceat(one, at))
        zeros.append(np.add.reduceat(n - one, at))
    u = np.concatenate(keys)
    order = np.argsort(u, kind="stable")
    return weighted(u[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], None)


def parent_keys(key: np.ndarray, depth: int) -> np.ndarray:
    """The keys, one byte of context less, of nodes at this depth."""
    ctx = (key >> np.uint64(8)) & np.uint64((1 << (8 * (depth - 1))) - 1)
    return (ctx << np.uint64(8)) | (key & np.uint64(255))


def above(level: Level, depth: int) -> Level:
    u, which = np.unique(parent_keys(level.key, depth), return_inverse=True)
    return weighted(u, *[np.bincount(which, x, len(u)) for x in (level.n0, level.n1, level.log_p)])


def subtree(gram: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth DEPTH down to 3 for n-grams of whole groups by their last three bytes of context."""
    levels = [leaves(gram, n)]
    for d in range(DEPTH, 3, -1):
        levels.append(above(levels[-1], d))
    return levels


def _block(key: np.ndarray, n: int) -> np.ndarray:
    return (mix64(key ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(max(1, n))).astype(np.int32)


@lru_cache(maxsize=2)
def _load(path: str) -> tuple[np.ndarray, np.ndarray]:
    if not exists(path):
        return np.zeros(0, np.uint64), np.zeros(0)
    data = get(path)
    n = data.size // 16
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float64, n, 8 * n)


@dataclass(frozen=True)
class Model:
    """Messages of n-grams and how many parts they have; the folder of depth two; for depth one the prediction of a one;
    folder and parts of token counts, tokens, distinct tokens and distinct n-grams."""

    counts: DataFrame
    parts: int
    second: str
    top: np.ndarray
    token_folder: str
    tokens: int
    distinct: int
    grams: int


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all whole texts (null: empty) and builds the upper trees."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts, token_folder, folder = int(n_bytes // (4 * BLOCK)) + 8, scratch(spark, "ctw-tokens"), scratch(spark, "ctw-second")
    counts = counted(docs, text_col, parts, token_folder)
    seen = counts.filter(f"kind = {GRAM}").select("kind", "part", "size", "keys", "n")

    def rows_of(levels):
        arrays = [np.concatenate([getattr(x, c) for x in levels] or [np.zeros(0)]) for c in ("key", "n0", "n1", "below")]
        return pa.table([pa.array(arrays[0].astype(np.uint64).view(np.int64)), *map(pa.array, arrays[1:])], ["key", "n0", "n1", "lp"])

    def summary(t: pa.Table) -> pa.Table:
        return rows_of([above(subtree(k, n)[-1], 3) for k, n in in_batches(*merged(opened(t)))])

    def sums(rows):
        return rows.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lp").alias("lp"))

    def level(b) -> Level:
        return weighted(col(b, "key").to_numpy().view(np.uint64), *[col(b, x).to_numpy() for x in ("n0", "n1", "lp")])

    def raised(batches):
        for b in batches:
            if b.num_rows:
                yield from rows_of([above(level(b), 2)]).to_batches()

    kind = "key long, n0 double, n1 double, lp double"
    two = staged(sums(seen.groupBy("part").applyInArrow(summary, kind)), "ctw-second")  # at most 16.7 million rows
    ones = sums(two.mapInArrow(raised, kind)).orderBy("key").toArrow()  # at most 65,280 rows
    l1 = weighted(ones["key"].to_numpy().view(np.uint64), *[ones[x].to_numpy() for x in ("n0", "n1", "lp")])
    l0 = above(l1, 1)
    a0, b0 = np.zeros(256), np.ones(256)
    k0 = l0.key.astype(np.int64)
    a0[k0], b0[k0] = l0.stop * l0.one, 1 - l0.stop
    a1, b1 = np.zeros(1 << 16), np.ones(1 << 16)
    k1 = l1.key.astype(np.int64)
    a1[k1] = a0[k1 & 255] + b0[k1 & 255] * l1.stop * l1.one
    b1[k1] = b0[k1 & 255] * (1 - l1.stop)
    top = np.tile(a0 + b0 / 2, 256)
    top[k1] = a1[k1] + b1[k1] / 2

    def write(batches):
        for (byte,), g in grouped(batches, ["byte"]):
            x = level(g.combine_chunks().to_batches()[0])
            up = parent_keys(x.key, 2).astype(np.int64)
            order = np.argsort(x.key)
            parts = (x.key, a1[up] + b1[up] * x.stop * x.one, b1[up] * (1 - x.stop))
            put(f"{folder}/{byte}", b"".join(v[order].tobytes() for v in parts))
            yield pa.RecordBatch.from_arrays([pa.array([byte], pa.int64())], ["byte"])

    staged(two.withColumn("byte", F.expr("shiftright(key, 8) & 255")).repartition("byte").sortWithinPartitions("byte", "key").mapInArrow(write, "byte long"), "ctw-second-files")
    n = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total")).collect()}
    return Model(seen, parts, folder, top, token_folder, n[TOKEN]["total"] if TOKEN in n else 0, n[TOKEN]["distinct"] if TOKEN in n else 0, n[GRAM]["distinct"] if GRAM in n else 0)


@lru_cache(maxsize=256)
def _second(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of depth two with one last byte: keys, weight that has stopped times its estimate, weight left."""
    if not exists(path):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    data = get(path)
    n = data.size // 24
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float64, n, 8 * n), np.frombuffer(data, np.float64, n, 16 * n)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among sorted ones, and whether it does."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


def _from_second(folder: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two weights of nodes of depth two; nan where there is none."""
    a, b = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
    byte = (keys >> np.uint64(8)) & np.uint64(255)
    for x in np.unique(byte):
        some = np.flatnonzero(byte == x)
        own, oa, ob = _second(f"{folder}/{x}")
        at, hit = _found(own, keys[some])
        a[some[hit]], b[some[hit]] = oa[at[hit]], ob[at[hit]]
    return a, b


def predicted(second: str, top: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each n-gram, from whole groups with those that training never showed (n = 0)."""
    seen = n > 0
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    a = b = keys = None
    for d, x in enumerate(subtree(gram[seen], n[seen])[::-1] if seen.any() else [], 3):
        up = parent_keys(x.key, d)
        if d == 3:
            a, b = _from_second(second, up)
        else:
            at, _ = _found(keys, up)
            a, b = a[at], b[at]
        a, b, keys = a + b * x.stop * x.one, b * (1 - x.stop), x.key
        tables.append((keys, a + b / 2))
    byte, total = gram & np.uint64(255), np.zeros(len(gram))
    for k in range(8):
        prefix = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        one, left = np.full(len(gram), np.nan), np.arange(len(gram))
        for d in range(2 + len(tables), 2, -1):
            at, hit = _found(tables[d - 3][0], _node(gram[left], prefix[left], d))
            one[left[hit]] = tables[d - 3][1][at[hit]]
            left = left[~hit]
        if len(left):
            a2, b2 = _from_second(second, _node(gram[left], prefix[left], 2))
            one[left] = a2 + b2 / 2
            left = left[np.isnan(one[left])]
            one[left] = top[_node(gram[left], prefix[left], 1).astype(np.int64)]
        total += np.log10(np.where((byte >> np.uint64(7 - k)) & np.uint64(1), one, 1 - one))
    return total


def _node(gram: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    """The key of the node of a depth on an n-gram's path after some bits of its last byte."""
    ctx = (gram >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    return (ctx << np.uint64(8)) | prefix


def values(model: Model, docs: DataFrame, text_col: str) -> tuple[str, int]:
    """Folder and number of blocks with the value of every n-gram of training and of docs."""
    parts, second, top = model.parts, model.second, model.top
    blocks, folder = max(1, -(-model.grams // BLOCK)), scratch(docs.sparkSession, "ctw-model")

    def ask(batches):
        roomy()
        g = Counts()
        for b in slices(batches, "text", 1 << 20, give_back=False):
            g.add(grams(*normal(raw(col(b, "text")))))
            if g.full():
                keys, n = g.take()
                yield messages(GRAM, keys, n * 0, _block(group_of(keys), parts))
        keys, n = g.take()
        yield messages(GRAM, keys, n * 0, _block(group_of(keys), parts))
        release()

    def predict(t: pa.Table) -> pa.Table:
        out = []
        for keys, n in in_batches(*merged(opened(t))):
            value = predicted(second, top, keys, n)
            order = np.argsort(keys)
            out.append(messages(GRAM, keys[order], value[order], _block(keys[order], blocks)))
        return pa.Table.from_batches(out)

    def write(t: pa.Table) -> pa.Table:
        part, own = t["part"][0].as_py(), opened(t, np.float64)
        keys, value = (np.concatenate([x[i] for x in own]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        put(f"{folder}/{part}", keys[order].tobytes() + value[order].tobytes())
        return pa.table({"part": pa.array([part], pa.int32())})

    asked = docs.select(F.col(text_col).alias("text")).mapInArrow(ask, MESSAGE)
    told = model.counts.union(asked).groupBy("part").applyInArrow(predict, MESSAGE)
    staged(told.groupBy("part").applyInArrow(write, "part int"), "ctw-blocks")
    return folder, blocks


def _looked_up(folder: str, blocks: int, keys: np.ndarray, missing: float) -> np.ndarray:
    """Values of ascending keys from sorted blocks, each of which is read once."""
    out, own = np.full(len(keys), missing), _block(keys, blocks)
    order = np.argsort(narrow(own), kind="stable")
    for some in np.split(order, runs(own[order])[1:]):
        if len(some):
            t, v = _load(f"{folder}/{own[some[0]]}")
            at, hit = _found(t, keys[some])
            out[some[hit]] = v[at[hit]]
    return out


def windows(batches, text: str, most: int):
    """Lists of slices that hold so many bytes of text together at most, or one slice."""
    held, size = [], 0
    for b in slices(batches, text, min(most, 1 << 20), give_back=False):
        n = sum(map(len, raw(col(b, text))))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield held


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", new: DataFrame | None = None) -> DataFrame:
    """id (as doc_id), n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every whole text.

    `new` are those rows of docs that training did not read, where the caller knows them; all of docs otherwise. Null and
    empty texts are one end. Without training texts every byte has probability 1/256 and every token the base's share of
    nothing known. Repeated rows score alike.
    """
    folder, blocks = values(model, docs if new is None else new, text_col)
    token_folder, parts, tokens, distinct = model.token_folder, model.parts, model.tokens, model.distinct
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        roomy()
        for held in windows(batches, "text", WINDOW):
            read = []
            for b in held:
                flat, first = normal(raw(col(b, "text")))
                token, at = tokens_of(flat, first)
                read.append((col(b, "doc_id"), np.diff(first, append=len(flat)), first, at, *ranked(grams(flat, first)), *ranked(token)))
                del flat, token
            keys, t_keys = (ascending(np.concatenate([r[i] for r in read])) for i in (4, 6))
            known, counts = _looked_up(folder, blocks, keys, np.nan), _looked_up(token_folder, parts, t_keys, 0.0)
            for doc_id, n_bytes, first, at, u, which, h, token in read:
                lens = np.diff(at, append=len(token))
                c = counts[np.searchsorted(t_keys, h)]
                share = np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))
                lp = np.add.reduceat(known[np.searchsorted(keys, u)][which], first)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(lens), pa.array(np.add.reduceat((c > 0).astype(np.int64)[token], at)), pa.array(np.full(len(lens), tokens, np.int64)), pa.array(np.add.reduceat(share[token], at)), pa.array(lp), pa.array(-lp * np.log2(10) / n_bytes)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
            del read, known, keys, held
            release()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    return score(docs, train(docs.filter(~held_out)), new=docs.filter(held_out)).withColumn("held_out", held_out)
