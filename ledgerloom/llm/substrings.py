"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

Texts are packed into chunks of a few MB, written once. At each length a chunk sends every hash that it must ask about
once, grouped by hash bucket as one block of bytes, with a bit that says whether the hash occurs in the chunk twice; a
bucket counts and answers each chunk with one bit a hash. A window of full length is a candidate while all that it was
asked about is repeated; the last length asks about every candidate itself, by 128 bits, so the result is exact but for
their collisions. Before the last length it is enough to ask at anchors, the least hash of any run of sub-windows within
one full window: equal windows have the same least, so where one is asked about its copies are too. A passage that a
third of all documents share costs its chunks one hash each, not one a document; bucket numbers follow the size of the
input. Answers go to one file for each partition of chunks, where the tasks that hold these find them: texts are never
shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import col, exists, get, grouped, mix64, plain_names, put, raw, release, scratch, slices, staged, starts_of, table, without

#: Bytes of text in a chunk, unless one document is longer.
CHUNK_BYTES = 2 << 20
#: Hashes that a bucket holds on average.
BUCKET_HASHES = 2_000_000
ADDED = ("n_words", "n_removed", "kept_text", "removed")


def lengths(window: int, first: int = 9) -> list[int]:
    """The lengths judged: the first, doubled until the window's own, which is the last."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def fold(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of `width` values, by doubling; the last step overlaps. For hashes, and for min and max."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = f(a[: len(a) - step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(x * np.uint64(0x9E3779B97F4A7C15) + y)


def _full(a: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, a.dtype)
    out[: len(a)] = a
    return out


def least_of(v: np.ndarray, span: int, ok: np.ndarray) -> np.ndarray:
    """The least of the `span` values from s on, where ok[s] holds, else 0."""
    return np.where(ok, _full(fold(v, span, np.minimum), len(v)), np.uint64(0))


def anchors(v: np.ndarray, span: int, least: np.ndarray) -> np.ndarray:
    """Where v is the least of a run of `span` values that is asked about."""
    best = fold(np.concatenate([np.zeros(span - 1, np.uint64), least]), span, np.maximum)
    return np.flatnonzero((best == v) & (best > 0))


def word_keys(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def distinct(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the values a, or the pairs of a and b: where the first of each stands, in ascending order, which each is, and how many there are."""
    if b is None:
        _, at, which, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
        return at, which, count
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.bincount(which, minlength=int(new.sum()))


class Chunk:
    """The words of a chunk and what is asked about them, level by level."""

    def __init__(self, texts: list[bytes], window: int, n_buckets: int):
        self.words = [t.split() for t in texts]
        self.lens = np.array([len(w) for w in self.words], np.int64)
        self.starts = starts_of(self.lens)
        self.n, self.window, self.n_buckets = int(self.starts[-1]), window, n_buckets
        flat = [x for w in self.words for x in w]
        keys = word_keys(flat)
        self.h, self.h2 = keys[:, 0].copy(), keys[:, 1].copy()
        room = np.repeat(self.starts[1:], self.lens) - np.arange(self.n)
        self.ok = room >= window

    def ask(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions asked about at this length, their distinct hashes in order of buckets, and which of these each has.

        A hash is a row of one integer, of two at the last length.
        """
        v, v2 = _full(fold(self.h, length, _pair), self.n), None
        if length == self.window:
            pos = np.flatnonzero(self.ok)
            v2 = _full(fold(self.h2, length, _pair), self.n)[pos]
        else:
            self.least = least_of(v, self.window - length + 1, self.ok)
            pos = anchors(v, self.window - length + 1, self.least)
        at, self.which, self.count = distinct(v[pos], v2)
        self.u = u = v[pos][at]
        bucket = (mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(self.n_buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        rows = u[:, None] if v2 is None else np.stack([u, v2[at]], axis=1)
        return pos, rows[self.order], bucket[self.order]

    def told(self, length: int, pos: np.ndarray, answers: list[dict]) -> None:
        """Leaves in ok the windows that are candidates still after the answers for this length."""
        bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers, key=lambda a: a["bucket"])]
        flags = np.zeros(len(self.order), bool)
        flags[self.order] = np.concatenate(bits).astype(bool) if bits else False
        if length == self.window:
            self.ok = np.zeros(self.n, bool)
            self.ok[pos[flags[self.which]]] = True
        elif len(self.u):  # of a window only its own least counts: where it has a copy, that is asked about too
            new = np.concatenate([[True], self.least[1:] != self.least[:-1]])
            runs = self.least[new]
            at = np.minimum(np.searchsorted(self.u, runs), len(self.u) - 1)
            self.ok &= (flags[at] & (self.u[at] == runs))[np.cumsum(new) - 1]

    def covered(self) -> np.ndarray:
        d = np.zeros(self.n + self.window + 1, np.int32)
        s = np.flatnonzero(self.ok)
        d[s] += 1
        d[s + self.window] -= 1
        return np.cumsum(d)[: self.n] > 0


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def pack(docs: DataFrame, text_col: str) -> DataFrame:
    """chunk, n_bytes and blob: whole rows, all their columns, as compressed Arrow batches. Staged, so chunks stay as they are."""

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for b in slices(batches, text_col, CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            n = sum(map(len, raw(col(b, text_col))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "blob"])
            k += 1

    return staged(docs.mapInArrow(run, "chunk long, n_bytes long, blob binary"), "substring-chunks")


def _walk(blob: bytes, text_col: str, levels: list[int], answers: list[list[dict]], n_buckets: int) -> tuple[pa.RecordBatch, Chunk]:
    batch = _unpack(blob)
    chunk = Chunk(raw(col(batch, text_col)), levels[-1], n_buckets)
    for length, a in zip(levels, answers):
        pos, _, _ = chunk.ask(length)
        chunk.told(length, pos, a)
    return batch, chunk


def _answers(asked: DataFrame, width: int, folder: str) -> int:
    """Writes for each chunk and bucket that it asked a bit a hash, which says whether it occurs twice or more: a file for
    each partition of chunks. Returns the bytes of bits."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in t["keys"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(t["twice"].to_pylist(), keys)])
        every = np.concatenate(keys)
        _, which, _ = distinct(every[:, 0], every[:, 1] if width == 2 else None)
        flags = (np.bincount(which, 1 + twice.astype(np.float64)) >= 2)[which]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(flags, ends)]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "n": pa.array([len(k) for k in keys], pa.int32()), "bits": pa.array(bits, pa.binary())})

    def write(batches):
        for (part,), g in grouped(batches, ["part"]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, g.schema) as w:
                w.write_table(g)
            put(f"{folder}/{part}", sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sum(map(len, g["bits"].to_pylist()))], pa.int64())], ["part", "n_bytes"])

    bits = asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, n int, bits binary")
    bits = bits.withColumn("part", F.shiftright("chunk", 32)).repartition("part").sortWithinPartitions("part", "chunk", "bucket")
    return staged(bits.mapInArrow(write, "part long, n_bytes long"), "substring-answers").agg(F.sum("n_bytes")).first()[0] or 0


@lru_cache(maxsize=8)
def _answered(path: str) -> dict[int, list[dict]]:
    """The answers in a file by chunk; none where no chunk of the partition asked."""
    out: dict[int, list[dict]] = {}
    if exists(path):
        for r in pa.ipc.open_stream(get(path)).read_all().select(["chunk", "bucket", "n", "bits"]).to_pylist():
            out.setdefault(r["chunk"], []).append(r)
    return out


def _told(folders: tuple[str, ...], chunk: int) -> list[list[dict]]:
    return [_answered(f"{f}/{chunk >> 32}").get(chunk, []) for f in folders]


def dedup(docs: DataFrame, text_col: str = "text", window: int = 35, first: int = 9) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed (spans of words, end excluded); columns of these names are replaced.

    Removes each word that is covered by a window of so many words whose sequence also starts anywhere else, in the
    same text too. Words are split at ASCII white space and joined by one space in kept_text. Null and short texts lose
    nothing; repeated rows are copies of each other, and lose every word if they hold a window.
    """
    src, named = plain_names(without(docs, *ADDED))
    levels = lengths(window, first)
    chunks = pack(src, text_col)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_buckets = int(max(8, total // 6 // BUCKET_HASHES + 1))
    folders: list[str] = []
    for k, length in enumerate(levels):
        known, width = levels[:k], 2 if length == window else 1

        def asks(batches, folders=tuple(folders), known=tuple(known), length=length):
            for b in batches:
                for c, blob in zip(col(b, "chunk").to_pylist(), col(b, "blob")):
                    release()
                    _, chunk = _walk(blob.as_py(), text_col, [*known, window], _told(folders, c), n_buckets)
                    _, rows, bucket = chunk.ask(length)
                    if not len(rows):
                        continue
                    twice = (chunk.count > 1)[chunk.order]
                    cut = np.flatnonzero(np.diff(bucket)) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cut])], pa.int32()), pa.array([c] * (len(cut) + 1), pa.int64()), pa.array([x.tobytes() for x in np.split(rows, cut)], pa.binary()), pa.array([np.packbits(x).tobytes() for x in np.split(twice, cut)], pa.binary())], ["bucket", "chunk", "keys", "twice"])

        folders.append(scratch(docs.sparkSession, f"substring-answers-{length}"))
        if not _answers(chunks.mapInArrow(asks, "bucket int, chunk long, keys binary, twice binary"), width, folders[-1]):
            break

    span = StructType().add("start", LongType()).add("end", LongType())
    schema = StructType([*src.schema.fields]).add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType()).add("removed", ArrayType(span))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(batches, folders=tuple(folders)):
        for b in batches:
            for c, blob in zip(col(b, "chunk").to_pylist(), col(b, "blob")):
                release()
                batch, chunk = _walk(blob.as_py(), text_col, levels, _told(folders, c), n_buckets)
                gone = chunk.covered() if len(folders) == len(levels) else np.zeros(chunk.n, bool)
                lost, kept, removed = [], [], []
                for w, a, e in zip(chunk.words, chunk.starts.tolist(), chunk.starts[1:].tolist()):
                    g = gone[a:e]
                    if g.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], g, [0]]).astype(np.int8)))
                        removed.append([{"start": s, "end": t} for s, t in edge.reshape(-1, 2).tolist()])
                        w = [x for x, y in zip(w, g.tolist()) if not y]
                    else:
                        removed.append([])
                    lost.append(e - a - len(w))
                    kept.append(b" ".join(w))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk.lens), pa.array(lost, pa.int64()), text, pa.array(removed, spans)], [*batch.schema.names, *ADDED])

    return named(chunks.mapInArrow(result, schema))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
m AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM g SEMI JOIN t USING (g))),
x AS (SELECT r, list(j) AS j FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(j), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN j IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(j, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
