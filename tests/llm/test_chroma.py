"""Links between recordings, against a direct count of equal frames at every offset of every pair."""

import numpy as np

from pyspark.sql import functions as F

from ledgerloom.llm import chroma


def links(spark, fps: list[np.ndarray], queries: int) -> dict:
    rows = [(i, len(x), x.tobytes(), i) for i, x in enumerate(fps)]
    got = chroma.align(spark.createDataFrame(rows, "id long, n int, fp binary, r long"), F.col("id") < queries).filter("kind = 'match'").collect()
    return {(r.query_id, r.match_id): (r.offset, r.votes, r.overlap, round(r.bit_error_rate, 9)) for r in got}


def votes_at(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """By offset, the triples of bytes that agree, of the integers as they are and turned by four bits: four equal bytes are four, three are one."""

    def agree(x: np.ndarray, y: np.ndarray) -> int:
        d = x ^ y
        total = 0
        for z in (d, d >> np.uint32(4) | d << np.uint32(28)):
            equal = sum(((z >> np.uint32(8 * k)) & np.uint32(255) == 0).astype(int) for k in range(4))
            total += 4 * int((equal == 4).sum()) + int((equal == 3).sum())
        return total

    part = lambda o: slice(max(0, -o), min(len(a), len(b) - o))
    return {o: agree(a[part(o)], b[part(o).start + o : part(o).stop + o]) for o in range(1 - len(a), len(b))}


def noisy(rng, x: np.ndarray, p: float) -> np.ndarray:
    return x ^ ((rng.random((len(x), 32)) < p) * (np.uint32(1) << np.arange(32, dtype=np.uint32))).sum(1).astype(np.uint32)


def test_every_frame_votes(spark):
    """Overlaps of 8 to 11 frames without error, and copies of 200 frames with a tenth of bits changed."""
    rng = np.random.default_rng(11)
    new = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    asks, others = [], []
    for k in range(24):
        asks.append(new(40))
        others.append(np.concatenate([asks[-1][40 - (8 + k % 4) :], new(30)]))
    for _ in range(12):
        asks.append(new(200))
        others.append(noisy(rng, asks[-1], 0.1))
    fps = asks + others
    want = {}
    for q in range(len(asks)):
        for r in range(len(fps)):
            v = votes_at(fps[q], fps[r])
            o = min(v, key=lambda o: (-v[o], o))
            n, error = chroma.bit_errors(fps[q], fps[r], o)
            if q != r and v[o] >= chroma.VOTES and n >= chroma.OVERLAP and error <= chroma.MOST_ERROR:
                want[q, r] = (o, v[o], n, round(error, 9))
    assert len(want) >= 35 and links(spark, fps, len(asks)) == want


def test_votes_of_runs(monkeypatch):
    """Votes and alignments in rows of several recordings, with long runs and small blocks."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(chroma, "BLOCK", 7)
    monkeypatch.setattr(chroma, "OVERLAP", 2)
    monkeypatch.setattr(chroma, "MOST_ERROR", 0.02)
    new = lambda: np.repeat(rng.integers(0, 3, n := rng.integers(1, 12)), rng.integers(1, 5, n)).astype(np.uint32)
    for _ in range(60):
        a, fps = new(), [new() for _ in range(rng.integers(1, 5))]
        chunk = chroma.Chunk(fps, len(a) + 3)
        place, count = chroma.votes(a, chunk)
        got = dict(zip(place.tolist(), count.tolist()))
        every = [votes_at(a, b) for b in fps]
        assert got == {int(chunk.at[k]) + o: v for k, at in enumerate(every) for o, v in at.items() if v >= chroma.VOTES}
        want = {}
        for k, (b, at) in enumerate(zip(fps, every)):
            good = [(-v, o, *chroma.bit_errors(a, b, o)) for o, v in at.items() if v >= chroma.VOTES]
            good = [g for g in good if g[2] >= 2 and g[3] <= 0.02]
            if good:
                v, o, n, e = min(good)
                want[k] = (o, -v, n, e)
        assert {r: x for r, *x in zip(*map(np.ndarray.tolist, chroma.search(a, chunk)))} == {k: list(v) for k, v in want.items()}


def test_refrain_at_a_second_offset(spark):
    """A motif stands in the middle, with more votes but strange frames around it, and at the end, where the recordings overlap."""
    rng = np.random.default_rng(13)
    new = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    motif, tied = new(10), new(12)
    a, b = np.concatenate([new(60), motif, new(60), motif]), np.concatenate([motif, new(60)])
    longer = motif.copy()
    longer[3] ^= np.uint32(1)
    c, d = np.concatenate([new(60), tied, new(60), tied]), np.concatenate([tied, new(60)])
    e, f = np.concatenate([new(60), motif[::-1], new(60), longer[::-1]]), np.concatenate([motif[::-1], new(60)])
    got = links(spark, [a, c, e, b, d, f], 3)
    assert got == {(0, 3): (-130, 80, 10, 0.0), (1, 4): (-132, 96, 12, 0.0), (2, 5): (-130, 74, 10, round(1 / 320, 9))}


def test_recall_under_noise():
    """Of the pairs that hold at the true offset, 0.9 or more get the votes, with a tenth to three tenths of the words replaced."""
    rng = np.random.default_rng(14)
    vocabulary = [b"w%d" % i for i in range(2000)]
    fp = lambda words, note: chroma.fingerprint(chroma.chroma(*chroma.melody(b" ".join(words), note)))
    for note, p in ((n, p) for n in (1, 2, 4) for p in (0.1, 0.2, 0.3)):
        true = found = 0
        for _ in range(60 // note + 30):
            words = [vocabulary[i] for i in rng.integers(0, 2000, rng.integers(16, 120))]
            cut = int(rng.integers(0, len(words) // 4 + 1))
            other = [vocabulary[rng.integers(2000)] if rng.random() < p else w for w in words[cut:]]
            a, b = fp(words, note), fp(other, note)
            n, error = chroma.bit_errors(a, b, -cut * note)
            if n >= chroma.OVERLAP and error <= chroma.MOST_ERROR:
                true += 1
                found += -cut * note in chroma.search(a, chroma.Chunk([b], len(a)))[1]
        print(note, p, true, found)
        assert true >= 25 and found >= 0.9 * true, (note, p, true, found)


def test_query(spark):
    """Clips are found in their wholes: the true offset of each that is long enough holds by brute force, and the query has it."""
    sf = "/root/testdata/sf0.01"
    rows = chroma.op1(spark, sf).collect()
    own = {(r.query_conv_id, r.query_turn): r for r in rows if r.kind == "match" and (r.query_clip, r.match_clip) == (1, 0) and (r.query_conv_id, r.query_turn) == (r.match_conv_id, r.match_turn)}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id % 50 = 0 and text is not null").collect()
    fp = lambda words: chroma.fingerprint(chroma.chroma(*chroma.melody(" ".join(words).encode())))
    wanted = 0
    for t in turns:
        words = t.text.split()
        cut = len(words) // 3
        a, b = fp([w[::-1] if i % 10 == 9 else w for i, w in enumerate(words[cut:])]), fp(words)
        n, error = chroma.bit_errors(a, b, cut * chroma.NOTE)
        if n >= chroma.OVERLAP and error <= chroma.MOST_ERROR and votes_at(a, b)[cut * chroma.NOTE] >= chroma.VOTES:
            wanted += 1
            assert own[t.conv_id, t.turn].offset == cut * chroma.NOTE
    assert wanted >= 5


def test_links_are_counted_whole(spark):
    """A row a query's class, which counts every alignment that align() has, also where a query meets several chunks."""
    docs = spark.range(120).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), ((i + F.col("id") * F.lit(7)) % 41).cast("string")))).alias("text"))
    prints = chroma.fingerprints(docs, "id", "text", chroma.melody)
    pairs = [r for r in chroma.align(prints, F.col("id") % 5 == 0).collect() if r.kind == "match"]
    rows = chroma.links(prints, F.col("id") % 5 == 0).collect()
    got = {r.query_id: r for r in rows if r.kind == "match"}
    want = {}
    for r in pairs:
        want.setdefault(r.query_id, []).append(r)
    assert len(pairs) > 2 * len(want) and {q: r.n_links for q, r in got.items()} == {q: len(x) for q, x in want.items()}
    for q, r in got.items():
        assert (-r.votes, r.bit_error_rate) == min((-x.votes, x.bit_error_rate) for x in want[q])
        assert (r.match_id, r.offset, r.votes, r.overlap) in [(x.match_id, x.offset, x.votes, x.overlap) for x in want[q]]
    assert sum(r.kind == "member" for r in rows) == 120
