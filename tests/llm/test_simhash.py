import random

import numpy as np
import pytest
import xxhash
from odd_rows import documents, nothing

from contactweave.llm.common import WORD, lower_ascii
from contactweave.llm.simhash import finer, fingerprint, links, near_duplicates


def plain_fingerprint(text):
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    """Least number of the rows that links reach, by comparing all rows."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def joined(n, pairs):
    """Least number that the pairs reach from each of n."""
    pairs, label = np.array(pairs), np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        if np.array_equal(before, label):
            return label.tolist()


def signed(x):
    return int(np.array([x], np.uint64).view(np.int64)[0])


def near(base, rng, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("text", ["", " \t", "one", "one two three", "a b c d", "A b a b a b a b", "É é\x00 x\x0by\x1cz w\xa0v", "go " * 900])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_way_to_differ_meets_in_a_finer_list():
    rng = random.Random(5)
    masks = [0]
    for _ in range(3):
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            for _ in range(200):
                x = sum(1 << b for b in rng.sample(free, 4))
                assert any(not x & child for child in finer(mask))
        masks = sorted({c for m in masks for c in finer(m)})
    assert len(finer(0)) == 7 and {m.bit_count() for m in masks} == {32} and len(masks) <= 70


@pytest.mark.parametrize("longest", [(1024, 1024, 1024), (8, 8, 8), (0, 0, 0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed, longest):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for centre in rng.sample(sorted(fps), 12):  # chains and clouds, linked and just not linked
        for _ in range(40):
            fps.add(near(centre, rng, 6))
        for _ in range(10):
            centre = near(centre, rng, 5)
            fps.add(centre)
    fps = sorted(fps)
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = links(table, longest=longest).collect()
    number = {signed(x): i for i, x in enumerate(fps)}
    assert joined(len(fps), [(number[r.a], number[r.b]) for r in found]) == plain_components(fps)


def test_documents_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 200]))) for _ in range(25)]
    for t in list(texts):
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [None, "", "\n", texts[0].upper()]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted((rows[i][0], f"{fps[i]:016x}", rows[k][0]) for i, k in enumerate(plain_components(fps)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark):
    docs = documents(spark)
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    at = {r.doc_id: r for r in got}
    assert at[2].component_id == 1 and at[1].component_id == 1
    assert at[3].component_id == at[4].component_id == at[5].component_id == 3
    assert at[None].component_id is None
    assert [r.component_id for r in got if r.doc_id == 8] == [8, 8]
    assert near_duplicates(nothing(spark)).count() == 0


def test_row_without_id_links_others(spark):
    base = plain_fingerprint("some text of a few words")
    assert base
    rows = [(None, "some text of a few words"), (5, "some text of a few words"), (4, "Some TEXT of a few words")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == [(4, 4), (5, 4), (None, 4)]


@pytest.mark.parametrize("longest", [(64, 64, 64), (5_000, 5_000, 5_000)])
def test_a_third_of_all_rows_in_one_list(spark, longest):
    """Few links are made of a crowded list, and none is lost."""
    rng = random.Random(9)
    head = 0xABCDEF << 40
    crowd = {near(head, rng, 6) for _ in range(1_000)} | {head | rng.getrandbits(40) for _ in range(1_000)}
    fps = sorted(crowd | {rng.getrandbits(64) for _ in range(4_000)})
    found = {(r.a, r.b) for r in links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), longest=longest).collect()}
    number = {signed(x): i for i, x in enumerate(fps)}
    array = np.array(fps, np.uint64)
    linked = [(i, i + 1 + j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 4)]
    assert len(linked) > 10_000
    assert joined(len(fps), [(number[a], number[b]) for a, b in found]) == joined(len(fps), linked)
    if longest[0] > len(fps) // 2:
        assert len(found) < 7 * len(fps)
