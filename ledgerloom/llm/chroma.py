"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording becomes frames of twelve pitch-class energies. Filters over rectangles of that image, summed through its
integral image, compare neighbouring areas; sixteen answers of two bits pack into one integer a frame. Recordings that
share integers vote for the offset between them; offsets with votes enough are confirmed by the share of differing bits
over the whole overlap, and the one with most votes of those that pass is taken. Recordings of one fingerprint are one
class, and classes are what is aligned. Every frame votes. Classes are dealt into chunks and queries into blocks, and
each block meets each chunk: an inverted list of the chunk's integers gives the offsets at which a query has votes, all
recordings at once, and bit errors are counted there and then, so nothing but alignments leaves a task. A vote is three
of an integer's four bytes that agree, of the bytes as they are or turned by half a byte, so frames vote too whose
integers differ in neighbouring bits; an equal integer is eight votes.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, staged, starts_of, table

#: Seconds of a frame and between frames, whatever the rate, and the range of pitches in Hz.
FRAME, HOP, LOW, HIGH = 0.128, 0.032, 110.0, 2500.0
#: Frames that a filter sees, and the answer's outer thresholds.
WIDTH, EDGE = 8, 0.12
#: Votes and overlapping frames an alignment needs, and the share of bits that may differ.
VOTES, OVERLAP, MOST_ERROR = 2, 8, 0.25
#: By how many bits an integer is turned, and the byte that is left out, for each of its votes.
PARTS = tuple((turn, left) for turn in (0, 4) for left in range(4))
#: Frames of a chunk of recordings or a block of queries, and pairs of runs or of frames that are compared at once.
CHUNK, BLOCK = 1 << 20, 1 << 21
#: Frames of windows that are compared at once: few enough for a processor's cache.
WINDOWS = 1 << 16
#: Hops that a note of a played text lasts.
NOTE = 1


def filters() -> list[tuple[int, int, int, int]]:
    """Kind (0 pitch halves, 1 time halves, 2 quadrants, 3 middle of time, 4 middle of pitch), first pitch, height, width."""
    return [(k % 5, (5 * k) % 6, (4, 6, 3, 5)[k % 4] if k % 5 != 4 else 6, (4, 8, 6)[k % 3]) for k in range(16)]


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) and rate of 16-bit PCM; what isn't WAV is silence of no length."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return raw.reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 8000


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of length one, silent ones zero."""
    frame, hop = max(1, round(rate * FRAME)), max(1, round(rate * HOP))
    n = (len(samples) - frame) // hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(frame, 1 / rate)
    used = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    pitch = np.zeros((len(used), 12), np.float32)
    pitch[np.arange(len(used)), np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    window = np.hanning(frame).astype(np.float32)
    out = np.empty((n, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    for a in range(0, n, 2048):
        x = np.fft.rfft(view[a : a + 2048] * window, axis=1)[:, used[0] : used[-1] + 1] if len(used) else np.zeros((len(view[a : a + 2048]), 0))
        out[a : a + 2048] = (x.real**2 + x.imag**2) @ pitch
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for every place at which the filters fit."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[t + x1, y1] - total[t + x0, y1] - total[t + x1, y0] + total[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole, mx, my = area(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:
            a = area(0, w, y, my)
        elif kind == 1:
            a = area(0, mx, y, y + h)
        elif kind == 2:
            a = area(0, mx, y, my) + area(mx, w, my, y + h)
        elif kind == 3:
            a = area(w // 4, w - w // 4, y, y + h)
        else:
            a = area(0, w, y + h // 3, y + h - h // 3)
        answer = np.log((1 + a) / (1 + whole - a))
        level = (answer > -EDGE).astype(np.uint32) + (answer > 0) + (answer > EDGE)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbours differ in one bit
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlapping frames at an offset, and the share of bits that differ there."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if end <= start:
        return 0, 1.0
    x = a[start:end] ^ b[start + offset : end + offset]
    return end - start, float(np.bitwise_count(x).sum() / (32 * (end - start)))


def melody(text: bytes, note: int = NOTE) -> tuple[np.ndarray, int]:
    """A text played at 4 kHz, one note of two tones and `note` hops a word: recordings for tables that hold none."""
    rate = 4000
    t = np.arange(note * round(rate * HOP)) / rate
    tones = np.sin(2 * np.pi * 220 * 2 ** (np.arange(36) / 12)[:, None] * t).astype(np.float32) * 0.4
    h = np.fromiter(map(zlib.crc32, text.split()), np.int64)
    return (tones[h % 36] + tones[h // 36 % 36]).ravel() if len(h) else np.zeros(0, np.float32), rate


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """id, n (integers), fp (little-endian) and r (hash of fp), staged. Null, damaged and too short recordings have n = 0."""
    src = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))

    def run(batches):
        import xxhash

        for b in batches:
            fps = [fingerprint(chroma(*decode(x or b""))) for x in col(b, "media").to_pylist()]
            data = [x.tobytes() for x in fps]
            r = np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data)).view(np.int64)
            yield pa.RecordBatch.from_arrays([col(b, "id"), pa.array([len(x) for x in fps], pa.int32()), pa.array(data, pa.binary()), pa.array(r)], ["id", "n", "fp", "r"])

    return staged(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n int, fp binary, r long"), "chroma-fingerprints")


def voting(fp: np.ndarray) -> list[np.ndarray]:
    """For each of PARTS, three bytes of the integers and the part's number."""
    out = []
    for k, (turn, left) in enumerate(PARTS):
        x = fp >> np.uint32(turn) | fp << np.uint32(32 - turn) if turn else fp
        low = x & np.uint32((1 << 8 * left) - 1)
        high = x >> np.uint32(8 * left + 8) << np.uint32(8 * left) if left < 3 else np.uint32(0)
        out.append(low | high | np.uint32(k << 24))
    return out


def _runs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of one vote start, their lengths, and the vote."""
    starts, lengths, values = [], [], []
    for v in voting(fp):
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]]))
        starts.append(at)
        lengths.append(np.diff(at, append=len(v)).astype(np.int32))
        values.append(v[at])
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(values)


class Chunk:
    """Recordings in one row, with room for a query of `most` frames before each, and their runs of one value in the values' order."""

    def __init__(self, fps: list[np.ndarray], most: int):
        lens = np.array([len(x) for x in fps], np.int64)
        self.row = np.concatenate([np.zeros(most, np.uint32), *fps, np.zeros(most + 1, np.uint32)])
        self.lens, self.first = lens, most + starts_of(lens)[:-1]
        self.at = self.first + most * np.arange(len(fps))
        runs = [_runs(x) for x in fps]
        start, self.length = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        own = np.repeat(np.arange(len(fps)), [len(r[0]) for r in runs])
        value = np.concatenate([r[2] for r in runs])
        order = np.argsort(value, kind="stable")
        value, self.place, self.length = value[order], (start + self.at[own])[order], self.length[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), bool), value[1:] != value[:-1]]))
        self.value, self.span = value[new], np.append(new, len(value))

    def found(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of each vote begin, and how many there are."""
        k = np.searchsorted(self.value, value)
        here = k < len(self.value)
        here[here] = self.value[k[here]] == value[here]
        k = np.where(here, k, 0)
        return self.span[k], np.where(here, self.span[np.minimum(k + 1, len(self.value))] - self.span[k], 0)


def votes(a: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where a query's first frame may stand in a chunk's row with VOTES votes or more, and how many there are.

    Two runs of one vote add a trapezoid of votes over the places, of which the four bends are summed, so long runs cost no
    more than short ones; runs of one frame on either side add one vote at one place.
    """
    start, length, value = _runs(a)
    low, n = chunk.found(value)
    single, places, bends = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = starts_of(n)
    for x in range(0, int(first[-1]), BLOCK):
        size = np.minimum(first[1:], x + BLOCK) - np.maximum(first[:-1], x)
        i = np.repeat(np.arange(len(n)), np.maximum(0, size))
        j = np.arange(x, min(x + BLOCK, int(first[-1]))) + (low - first[:-1])[i]
        rise, stay = length[i], chunk.length[j]
        at = chunk.place[j] - start[i] - rise + 1
        one = (rise == 1) & (stay == 1)
        single.append(at[one])
        at, rise, stay = at[~one], rise[~one], stay[~one]
        one = np.ones(len(at), np.int64)
        places = np.concatenate([places, at, at + rise, at + stay, at + rise + stay])
        bends = np.concatenate([bends, one, -one, -one, one])
        places, bends = _summed(places, bends)
    counted = np.sort(np.concatenate(single)) if single else places
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(counted)), bool), counted[1:] != counted[:-1]]))
    found, count = counted[new], np.diff(new, append=len(counted))
    if len(places):
        slope, width = bends.cumsum(), np.diff(places, append=places[-1:])
        end = (slope * width).cumsum()
        before = end - slope * width
        some = np.flatnonzero((np.maximum(before + slope, end) >= (1 if len(found) else VOTES)) & (width > 0))
        step = np.arange(width[some].sum()) - np.repeat(starts_of(width[some])[:-1], width[some])
        some = np.repeat(some, width[some])
        found, count = _summed(np.concatenate([found, places[some] + step]), np.concatenate([count, before[some] + slope[some] * (step + 1)]))
    return found[count >= VOTES], count[count >= VOTES]


def _summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, and the sum of the values at each, where it isn't zero."""
    if not len(places):
        return places, values
    order = np.argsort(places, kind="stable")
    places, values = places[order], values[order]
    new = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
    places, values = places[new], np.add.reduceat(values, new)
    return places[values != 0], values[values != 0]


def _differing(a: np.ndarray, row: np.ndarray, at: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many bits differ in each overlap: n frames from `start` on of a query that lies at `at` in a row.

    Where most of the query overlaps, whole windows of its width are compared, and what lies outside the overlap is left out.
    """
    out, first, width, x = np.zeros(len(at), np.int64), starts_of(n), len(a) + len(a) % 2, 0
    if width * len(at) <= 4 * int(first[-1]):
        narrow = np.int16 if width < 1 << 15 else np.int64
        wide, t = np.zeros(width, np.uint32), np.arange(width, dtype=narrow)
        wide[: len(a)] = a
        windows, start, end = np.lib.stride_tricks.sliding_window_view(row, width), start.astype(narrow)[:, None], (start + n).astype(narrow)[:, None]
        step = max(1, WINDOWS // width)
        for x in range(0, len(at), step):
            d = np.ascontiguousarray(windows[at[x : x + step]] ^ wide)
            d *= (t >= start[x : x + step]) & (t < end[x : x + step])
            out[x : x + step] = np.bitwise_count(d.view(np.uint64)).sum(1, dtype=np.int64)
        return out
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(first, first[x] + BLOCK, side="right")) - 1)
        i = np.arange(first[y] - first[x]) + np.repeat(start[x:y] - first[x:y] + first[x], n[x:y])
        j = i + np.repeat(at[x:y], n[x:y])
        out[x:y] = np.add.reduceat(np.bitwise_count(a[i] ^ row[j]).astype(np.int64), first[x:y] - first[x])
        x = y
    return out


def search(a: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Recording, offset, votes, overlap and share of differing bits of a query's best alignment with each recording that has one.

    Best is that of most votes, and then the least offset, of those with OVERLAP frames and at most MOST_ERROR of bits differing.
    """
    place, count = votes(a, chunk)
    r = np.searchsorted(chunk.at - len(a) + 1, place, side="right") - 1
    offset = place - chunk.at[r]
    start, end = np.maximum(0, -offset), np.minimum(len(a), chunk.lens[r] - offset)
    long = np.flatnonzero(end - start >= OVERLAP)
    r, offset, count, start, n = r[long], offset[long], count[long], start[long], (end - start)[long]
    differ = _differing(a, chunk.row, chunk.first[r] + offset, start, n)
    error = differ / np.maximum(1, 32 * n)
    good = np.flatnonzero(error <= MOST_ERROR)
    good = good[np.lexsort((offset[good], -count[good], r[good]))]
    good = good[np.concatenate([np.ones(min(1, len(good)), bool), r[good[1:]] != r[good[:-1]]])]
    return r[good], offset[good], count[good], n[good], error[good]


def _alignments(asked: pa.Table, there: pa.Table):
    """For each query of a block: its class, and the classes, offsets, votes, overlaps and shares of differing bits of its alignments with a chunk of recordings."""
    queries = [np.frombuffer(x, np.uint32) for x in asked["fp"].to_pylist()]
    if queries and len(there):
        chunk = Chunk([np.frombuffer(x, np.uint32) for x in there["fp"].to_pylist()], max(map(len, queries)))
        ids = there["r"].to_numpy()
        for q, a in zip(asked["r"].to_pylist(), queries):
            r, *found = search(a, chunk)
            other = ids[r] != q
            yield q, ids[r][other], *[x[other] for x in found]


def _table(out: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 7
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
    return pa.table([pa.array(x).cast(k) for x, k in zip(columns, kinds)], ["q", "r", "offset", "votes", "overlap", "bit_error_rate", "n_links"])


def _meet(asked: pa.Table, there: pa.Table) -> pa.Table:
    """The alignments of a block of queries with a chunk of recordings, each one link."""
    return _table([(np.full(len(r), q), r, *found, np.ones(len(r))) for q, r, *found in _alignments(asked, there)])


def _count(asked: pa.Table, there: pa.Table) -> pa.Table:
    """For each query of a block, the best of its alignments with a chunk of recordings, and how many there are."""
    out = []
    for q, r, offset, votes, overlap, error in _alignments(asked, there):
        k = np.lexsort((r, error, -votes))[:1]
        out.append((np.full(len(k), q), r[k], offset[k], votes[k], overlap[k], error[k], np.full(len(k), len(r))))
    return _table(out)


def _classes(prints: DataFrame, is_query) -> DataFrame:
    """A row a class: r, copies, asks (whether a query is in it), its least id and its fingerprint."""
    some = prints.filter("n > 0 and id is not null")
    return staged(some.groupBy("r").agg(F.min(F.struct("id", "fp")).alias("m"), F.count("*").alias("copies"), F.max(is_query.cast("int")).alias("asks")).select("r", "copies", "asks", "m.*"), "chroma-classes")


def _met(reps: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """What meet() gives for each block of queries and each chunk of recordings, staged."""
    frames, of_queries = (x or 0 for x in reps.agg(F.sum(F.length("fp").cast("long")), F.sum(F.when(F.col("asks") == 1, F.length("fp").cast("long")))).first())
    chunks, blocks = 1 + frames // (4 * CHUNK), 1 + of_queries // (4 * CHUNK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("r"), F.lit(n)).cast("int")
    asked = reps.filter("asks = 1").select("r", "fp", dealt(blocks).alias("block"), every(chunks).alias("chunk"))
    there = reps.select("r", "fp", every(blocks).alias("block"), dealt(chunks).alias("chunk"))
    met = asked.groupBy("block", "chunk").cogroup(there.groupBy("block", "chunk")).applyInArrow(meet, "q long, r long, offset int, votes long, overlap int, bit_error_rate double, n_links long")
    return staged(met, "chroma-pairs")


def _named(found: DataFrame, prints: DataFrame, reps: DataFrame) -> DataFrame:
    """Alignments of classes by their least ids as rows of kind `match`, and every recording and its class as rows of kind `member`."""
    pairs = found.join(reps.select(F.col("r").alias("q"), F.col("id").alias("query_id")), "q").join(reps.select("r", F.col("id").alias("match_id")), "r")
    pairs = pairs.select(F.lit("match").alias("kind"), "query_id", "match_id", "offset", "votes", "overlap", "bit_error_rate", "n_links")
    members = prints.select("id", "r", "n").join(reps.select("r", F.col("id").alias("match_id")), "r", "left")
    members = members.select(F.lit("member").alias("kind"), F.col("id").alias("query_id"), F.when(F.col("n") > 0, F.col("match_id")).alias("match_id"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("votes"), F.col("n").alias("overlap"), F.lit(0.0).alias("bit_error_rate"), F.lit(0).cast("long").alias("n_links"))
    return pairs.unionByName(members)


def align(prints: DataFrame, is_query) -> DataFrame:
    """kind, query_id, match_id, offset, votes, overlap and bit_error_rate.

    Rows of kind `match`: a class with a query in it and another class, at the best (most votes, then the least) of all
    offsets with VOTES votes, OVERLAP frames and at most MOST_ERROR of bits differing. Rows of kind `member`: every
    recording and its class (null without a fingerprint), with its frames as overlap. A class is named by its least id.
    Repeated rows are members once each.
    """
    reps = _classes(prints, is_query)
    return _named(_met(reps, _meet), prints, reps).drop("n_links")


def links(prints: DataFrame, is_query) -> DataFrame:
    """align() with one row of kind `match` a class with a query in it, and n_links: with how many other classes it has an
    alignment. The row shows the one of most votes, then the least share of differing bits.

    Every alignment is found and counted, but none is a row of its own: pairs grow with queries times recordings.
    """
    reps = _classes(prints, is_query)
    best = ["r", "offset", "votes", "overlap", "bit_error_rate"]
    found = _met(reps, _count).groupBy("q").agg(F.min_by(F.struct(*best), F.struct(-F.col("votes"), F.col("bit_error_rate"), F.col("r"))).alias("b"), F.sum("n_links").alias("n_links"))
    return _named(found.select("q", *[f"b.{c}" for c in best], "n_links"), prints, reps)


def clip(text):
    """The last two thirds of a text's words, every tenth of them reversed: a part of a recording with noise."""
    return F.concat_ws(" ", F.transform(F.slice(F.split(text, r"[\x20\x09-\x0D]+"), F.floor(F.size(F.split(text, r"[\x20\x09-\x0D]+")) / 3).cast("int") + 1, 1 << 30), lambda w, i: F.when(i % 10 == 9, F.reverse(w)).otherwise(w)))


def op1(spark, sf_dir: str) -> DataFrame:
    """No table holds audio: every turn of `conversations` is played as a melody (clip 0), and those of conversations
    divisible by 50, which are the queries, once more in part and with noise (clip 1), to be found in their whole. A row
    for each query's class (its best alignment, and how many others it aligns with), and one for each recording's class."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    part = turns.filter("conv_id % 50 = 0 and text is not null").select("conv_id", "turn", F.lit(1).alias("clip"), clip(F.col("text")).alias("text"))
    every = turns.select("conv_id", "turn", F.lit(0).alias("clip"), "text").union(part)
    out = links(fingerprints(every.select(F.struct("conv_id", "turn", "clip").alias("id"), "text"), "id", "text", melody), F.col("id.conv_id") % 50 == 0)
    ids = [F.col(f"{side}_id.{c}").alias(f"{side}_{c}") for side in ("query", "match") for c in ("conv_id", "turn", "clip")]
    return out.select("kind", *ids, "offset", "votes", "overlap", "bit_error_rate", "n_links")
