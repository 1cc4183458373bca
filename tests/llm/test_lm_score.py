import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import elias_fano, lm_score  # noqa: E402


def by_hand(rows, mu=lm_score.MU):
    """Sums by doc_id of all its rows' tokens."""
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    one, two, n_docs = Counter(), Counter(), 0
    for i, t in tokens:
        if not held(i):
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t))
            n_docs += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = sum(
            math.log10((two[p, w] + mu * (one[w] + 1) / (n + v + 1)) / ((n_docs if p == "<s>" else one[p]) + mu))
            for p, w in zip(["<s>", *t[:-1]], t)
        )
        have = out.get(i, (held(i), 0, 0, n, 0.0, 0.0, 0))
        out[i] = (held(i), have[1] + len(t), have[2] + sum(one[w] > 0 for w in t), n, have[4] + base, have[5] + score, have[6] + 1)
    return out


def agree(got, want, n_rows_of):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6
        assert abs(r.score - w[5]) < 1e-3 * w[1] + 1e-6


def test_sequences():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 77, 5000):
        for top in (1, 300, 2**63):
            v = np.sort(r.integers(0, top, n, dtype=np.uint64))
            e = elias_fano.EliasFano.of(v)
            if n:
                assert (e.get(np.arange(n)) == v).all()
            q = np.concatenate((v, r.integers(0, top, 40, dtype=np.uint64)))
            assert (e.successor(q, np.zeros(len(q)), np.full(len(q), n)) == np.searchsorted(v, q)).all()


def test_trie_survives_a_memory_map(tmp_path):
    r = np.random.default_rng(2)
    pairs = np.unique(r.integers(0, 60, (500, 2), dtype=np.uint64) * np.uint64(2**57 + 1), axis=0)
    words = np.unique(pairs[:, 0])
    value = r.normal(size=len(pairs))
    trie = elias_fano.Trie.build(pairs[:, 0], pairs[:, 1], value, words, np.arange(len(words)) + 1)
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    opened = elias_fano.Trie.from_buffer(np.memmap(tmp_path / "trie", np.uint8, "r"))
    asked = np.concatenate((pairs, pairs[::-1, ::-1], np.array([[5, 7]], np.uint64)))
    known = {(a, b): x for (a, b), x in zip(pairs.tolist(), value)}
    count = dict(zip(words.tolist(), range(1, len(words) + 1)))
    counts, seen, got = opened.lookup(asked[:, 0], asked[:, 1])
    for (w, c), n, s, x in zip(asked.tolist(), counts, seen, got):
        assert n == count.get(w, 0) and s == ((w, c) in known)
        assert not s or abs(x - known[w, c]) < 1e-3


def test_scores_by_hand(spark):
    import random

    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=r.randint(0, 60)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    agree(lm_score.scores(docs).collect(), by_hand(rows), 1)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows.rows()]
    agree(lm_score.scores(odd_rows.documents(spark)).collect(), by_hand(rows), 1)
    assert lm_score.scores(odd_rows.nothing(spark)).count() == 0
    held = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    row = lm_score.scores(held).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)
