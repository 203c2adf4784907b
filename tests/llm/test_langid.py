"""Documents of more than four languages."""

import numpy as np

from ledgerloom.llm import langid


def test_six_languages(spark):
    rng = np.random.default_rng(4)
    words = {c: ["".join(rng.choice(list(letters), 6)) for _ in range(40)] for c, letters in zip("abcdef", ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"))}
    m = langid.train(spark.createDataFrame([(" ".join(w), c) for c, w in words.items()], "text string, lang string"))
    text = " ".join(x for w in words.values() for x in w)
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), m).first()
    assert {x.lang for x in row.languages} == set("abcdef") and abs(row.score - 1 / 6) < 0.02
    five = langid.infer(m, [" ".join(x for c in "abcde" for x in words[c]).encode(), " ".join(words["b"]).encode()])
    assert [set(np.flatnonzero(p)) for p in five] == [{0, 1, 2, 3, 4}, {1}]


def direct(model, text: bytes) -> np.ndarray:
    """The mixture of a text word by word: expectation-maximisation over all languages, then over sets of the most likely, all sets tried."""
    tables = [langid._log_p(p) for p in model.paths]
    n_langs, words = len(tables), []
    joined = b" " + b" ".join(text.lower().split()) + b" "
    for word in range(len(joined.split())):
        logs = []
        for t in tables:
            total, k = 0.0, -1
            for i in range(1, len(joined) - 1):
                if joined[i - 1] == 32:
                    k += 1
                if joined[i] != 32 and k == word:
                    key = np.array([joined[i - 1] | joined[i] << 8 | joined[i + 1] << 16], np.uint64)
                    total += float(t[int(langid.mix64(key)[0]) & (langid.SLOTS - 1)])
            logs.append(total)
        words.append([np.exp(max(x - max(logs), -60)) for x in logs])

    def em(pi, steps):
        for _ in range(steps):
            new = [0.0] * n_langs
            for w in words:
                total = sum(p * x for p, x in zip(pi, w))
                new = [a + p * x / total for a, p, x in zip(new, pi, w)]
            pi = [x / len(words) for x in new]
        return pi

    every = em([1 / n_langs] * n_langs, langid.STEPS)
    order = sorted(range(n_langs), key=lambda k: (-every[k], k))
    best = None
    for k in range(1, n_langs + 1):
        pi = [every[i] + 1e-6 if i in order[:k] else 0.0 for i in range(n_langs)]
        pi = [x / sum(pi) for x in pi]
        if k > 1:
            pi = em(pi, langid.SET_STEPS)
        value = sum(np.log(sum(p * x for p, x in zip(pi, w))) for w in words) - 0.5 * k * np.log(len(words) + 1)
        if best is None or value > best[0]:
            best = value, pi
    return np.array(best[1])


def test_against_word_by_word(spark, monkeypatch):
    """Also with so few cells that a text is read in blocks, and with more languages than a process keeps open."""
    rng = np.random.default_rng(9)
    sets = ("abcd", "cdef", "efgh", "ghij")
    word = lambda s: "".join(rng.choice(list(s), rng.integers(2, 7)))
    m = langid.train(spark.createDataFrame([(" ".join(word(s) for _ in range(60)), s) for s in sets], "text string, lang string"))
    texts = [" ".join(word(sets[k]) for k in rng.choice(4, 12, p=p)) for p in ((1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.4, 0.3, 0.3, 0), (0.25,) * 4, (0, 0, 0, 1))]
    raw = [t.encode() for t in texts] + [b"", b"x"]
    want = np.array([direct(m, t) if t else np.zeros(4) for t in raw])
    assert np.allclose(langid.infer(m, raw), want, atol=1e-6)
    monkeypatch.setattr(langid, "CELLS", 20)
    assert np.allclose(langid.infer(m, raw), want, atol=1e-6)


def test_many_languages(spark):
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{k}" for k in range(20)), f"l{i:04}") for i in range(1100)]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert len(m.langs) == 1100 and langid.infer(m, [rows[7][0].encode()])[0].argmax() == 7
