"""Vector codes, filter interactions and near vectors against plain Python, and their stated cases."""

import math
from itertools import permutations

import numpy as np
import pytest

from ledgerloom.llm import codebooks, interactions, tiles

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<double>, label string, id string, r int, v string, n int, code string, copies int, c int, dim int"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "v", 2, "c", 3, 4, 5) for r in rows], DDL).repartition(3)


def plain_codes(rows):
    """The contract in Python integers, for vectors of one length that four divides."""
    kept = sorted((i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    w = len(kept[0][1]) // 4
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in kept[:256]] for p in range(4)]
    best = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(4):
        new = [[list(c) for c in b] for b in books]
        for p in range(4):
            member = {}
            for _, x, _ in kept:
                member.setdefault(best(x, p)[1], []).append(cut(x, p))
            for e, xs in member.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    found = {}
    for i, x, label in kept:
        b = [best(x, p) for p in range(4)]
        found[i] = ("".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), label)
    by = {}
    for _, error, label in found.values():
        by[label] = by.get(label, 0) + error
    return {i: (c, e, by[label]) for i, (c, e, label) in found.items()}, np.array(books)


def test_codes_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.01, 1, 40])).tolist(), [None, "a", "b"][i % 3]) for i in rng.permutation(400)]
    rows += [(1000, rows[0][1], "a"), (1001, [0.0] * 8, "a"), (1002, [-0.0] * 8, None), (1003, [NAN, *[1.0] * 7], "a"), (1004, [None, *[1.0] * 7], "b"), (1005, None, "a"), (1006, [1.0] * 7 + [-INF], "a")]
    want, books = plain_codes(rows)
    codes, got_books = codebooks.compress(frame(spark, rows))
    assert (got_books == books).all() and codebooks.digest(got_books) == codebooks.digest(books)
    assert {r.id: (r.code, r.error, r.label_error) for r in codebooks.label_errors(codes).collect()} == want


def test_codes_of_few_short_long_and_no_vectors(spark):
    codes, books = codebooks.compress(frame(spark, [(2, [1.0], "a"), (1, [0.5, -0.5, 2.0, 0.0, 1.0], "a"), (1, [0.5, -0.5, 2.0, 0.0, 1.0], None), (None, [], None)]))
    assert books.shape == (4, 4, 2) and books[0, 0].tolist() == [512, -512] and codes.agg({"error": "sum"}).first()[0] == 0
    assert sorted((r.id is None, r.code) for r in codes.collect()) == [(False, "00000000"), (False, "00000000"), (False, "02020200"), (True, "03020200")]
    codes, books = codebooks.compress(frame(spark, [(1, [1e300, 0.0, 0.0, 0.0], "a"), (2, [-1e300, 0.0, 0.0, 0.0], "a")]))
    assert books[0].tolist() == [[codebooks.most_component(1)], [-codebooks.most_component(1)]]
    for none in ([], [(1, None, "a"), (2, [NAN], "b")]):
        codes, books = codebooks.compress(frame(spark, none))
        assert codebooks.label_errors(codes).count() == 0 and books.size == 0 and codebooks.digest(books)


def test_distances_stay_exact_at_the_largest_components():
    for width in (1, 3, 16, 200):
        m = codebooks.most_component(width)
        x, book = np.full((2, width), -m, np.int64), np.stack([np.full(width, m), np.full(width, m - 1)])
        entry, d = codebooks.nearest(x, book.astype(np.int64))
        assert entry.tolist() == [1, 1] and d.tolist() == [width * (2 * m - 1) ** 2] * 2 and d[0] > 0


def plain_links(rows, least=0.98):
    """n_links, component and kept of each row by all pairs."""
    ok = [v is not None and label is not None and i is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, v, label in rows]
    unit = [np.array(v) / np.abs(v).max() if k else None for k, (_, v, _) in zip(ok, rows)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and (rows[a][1] == rows[b][1] or unit[a] @ unit[b] / (math.sqrt(unit[a] @ unit[a]) * math.sqrt(unit[b] @ unit[b])) >= least):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    low = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return sorted(((i, c, low.get(find(x)), i is None or low[find(x)] == i) for x, ((i, _, _), c) in enumerate(zip(rows, n))), key=repr)


def vectors(rng, n=600, dim=24):
    """Groups of near copies of every size, chains of them, equal vectors, and vectors alone."""
    rows, i = [], 0
    for size in (150, 40, 9, 3, 2, 2):
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((i, (centre + rng.normal(size=dim) * 0.13).tolist(), "a"))
            i += 1
    x = rng.normal(size=dim)
    for _ in range(40):  # each near the one before it
        x = x + rng.normal(size=dim) * 0.15
        rows.append((i, (x * rng.choice([1e-200, 1, 1e200])).tolist(), "a"))
        i += 1
    rows += [(i + k, rows[k % 50][1], "a" if k % 2 else "b") for k in range(120)]
    rows += [(5000 + k, rng.normal(size=dim).tolist(), rng.choice(["a", "b", "c"]).item()) for k in range(n - len(rows))]
    return rows


def test_near_vectors_are_the_plain_links(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 24 * 40)  # many small tiles: cut by coordinates, and by hash
    rows = vectors(np.random.default_rng(11))
    rows += [(7000, None, "a"), (7001, [0.0] * 24, "a"), (7002, [NAN] + [1.0] * 23, "a"), (7003, rows[0][1], None), (None, rows[0][1], "a"), (7004, [None] + [1.0] * 23, "a"), (7005, rows[0][1][:20], "a"), (7006, [], "a"), (3, rows[3][1], "a"), (3, rows[3][1], "a")]
    got = sorted((tuple(r) for r in tiles.near_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == plain_links(rows)
    assert tiles.near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in tiles.near_vectors(frame(spark, [(1, None, "a")])).collect()] == [(1, 0, 1, True)]


def test_near_vectors_of_one_dimension_and_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.98, math.sqrt(1 - 0.98**2)], "a"), (3, [0.97, math.sqrt(1 - 0.97**2)], "a"), (4, [2.0], "a"), (5, [9.0], "a"), (6, [-1.0], "a"), (7, [0.6, 0.8], "a"), (8, [3.0, 4.0], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in tiles.near_vectors(frame(spark, rows)).collect()}
    assert got == {i: (n, c) for i, n, c, _ in plain_links(rows)} and got[4] == got[5] == (1, 4) and got[6] == (0, 6)


@pytest.mark.parametrize("dim", [1, 7, 8, 9, 40, 130])
def test_stopping_early_loses_no_pair(dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(300, dim)) * np.linspace(3, 0.1, dim)
    v[100:200] = v[:100] + rng.normal(size=(100, dim)) * np.linspace(0.5, 0.01, dim)
    x = tiles.unit([r.tobytes() for r in v], dim)
    for least in (0.5, 0.9, 0.98, 1.0):
        want = x @ x.T
        hit = tiles.near(x, x, v, v, least)
        sure = np.abs(want - least) > 1e-9
        assert (hit == (want >= least))[sure].all()


def test_cutting_meets_every_pair_of_boxes(spark):
    rng = np.random.default_rng(2)
    lo = rng.uniform(-1, 0.9, size=(60, tiles.AXES))
    boxes = [(i, "a" if i % 4 else "b", 8, lo[i].tolist(), (lo[i] + rng.uniform(0, 0.5, tiles.AXES)).tolist()) for i in range(60)]
    got = {tuple(sorted((r.a, r.b))) for r in tiles.tile_pairs(spark.createDataFrame(boxes, "tile long, label string, dim int, lo array<double>, hi array<double>"), 0.6).collect()}
    far = lambda p, q: sum(max(0, a - d, c - b) ** 2 for a, b, c, d in zip(p[3], p[4], q[3], q[4]))
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[0] <= q[0] and p[1] == q[1] and far(p, q) <= 2 - 2 * 0.6}
    assert want <= got and all(far(boxes[a], boxes[b]) < 2 - 2 * 0.6 + 1e-4 for a, b in got)


TEXTS = ["", None, "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(70)), "a # b", "é" * 30 + "X", " ".join(f"w{i}" for i in range(60)) + " $", "\t\n", "ABC é漢 " * 20]


def plain_audit(docs, labels):
    """The contract, document by document and order by order."""
    import re

    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in first and (i is None or i > first[t])
        rows.append((i, part or "", {x for x, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if f}))
    out, shares = {}, {}
    for order in permutations("ABCDE"):
        for s, x in enumerate(order):
            before = set(order[:s])
            for p in {r[1] for r in rows}:
                own = [(i, f) for i, q, f in rows if q == p]
                removed = [i for i, f in own if x in f and not f & before]
                out[p, "".join(order), s + 1] = [sum(not f & (before | {x}) for _, f in own), len(removed), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed)]
                shares[p, x] = shares.get((p, x), 0) + len(removed)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_the_plain_one(spark):
    docs = [(i, TEXTS[i % len(TEXTS)] if i % 7 else TEXTS[i % 3], [None, "", "s", "tt"][i % 4 if i % 5 else 2]) for i in range(120)]
    docs += [(5, docs[5][1], "s"), (5, docs[5][1], "other"), (None, "word " * 60, "s"), (None, "alone #", "s"), (3, "another text of the same id", "s")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 110, 2)] + [(2, 1, None), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x", 2, True) for d in docs], "doc_id long, text string, source string, mask int, part string, id int, good boolean").repartition(5)
    labelled = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, id int")
    got = interactions.audit(frame, labelled).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in interactions.COUNTS) for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert interactions.audit(frame.limit(0), labelled).count() == 0 and interactions.audit(frame, labelled.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    t = " ".join(f"w{i % 1000}" for i in range(5000)).encode() + b" " + b"x" * 300
    monkeypatch.setattr(interactions, "WORD_BYTES", 100)
    assert interactions.word_counts(t) == (len(t.split()), len(set(t.split())))
