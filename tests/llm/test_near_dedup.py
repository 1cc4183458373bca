import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import near_dedup  # noqa: E402


def classes(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def family(r, n, words=120, edits=6):
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = r.choice(vocabulary)
        out.append(" ".join(own))
    return out


def test_equals_brute_force(spark):
    r = random.Random(2)
    texts = [t for n in (40, 12, 5, 2, 1, 1) for t in family(r, n)] + family(r, 20, edits=14) + ["a b", "A b", "a", "", "a b c", "a b c d"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs, size, percent).collect()}
        assert got == classes(rows, size, percent)


def test_a_small_set_in_a_component_hides_no_link(spark):
    # cut copies of 85 to 100 shingles, linked one by one, and a document that only the larger ones link to
    sets = {k: list(range(k)) for k in range(85, 101)} | {200: list(range(116)), 300: list(range(60))}
    rows = [(0, 7, k, 85 if k < 200 else k, len(s), min(len(s), 100)) for k, s in sets.items()]
    members = spark.createDataFrame(rows, "band int, hash long, node long, component long, n long, most long")
    held = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    got = near_dedup._cross_links(members, held, 85).collect()
    assert {x.a for x in got} == {200} and {x.b for x in got} <= {99, 100} and got


def test_cut_and_extended_copies_equal_brute_force(spark):
    r = random.Random(11)
    texts = []
    for f in range(8):
        base = [f"f{f}w{k}" for k in range(r.randint(90, 140))]
        for k in range(30):
            cut = base[: len(base) - r.randint(0, 30)]
            more = [f"x{f}_{k}_{j}" for j in range(r.choice((0, 0, 4, 9, 12, 16, 18, 22)))]
            texts.append(" ".join((base if r.random() < 0.4 else cut) + more))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == classes(rows, 3, 85)


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 3)], "a long, b long")
    got = {x.node: x.component for x in near_dedup.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_bands_miss_almost_nothing():
    for threshold in (0.8, 0.85, 0.95):
        rows, bands = near_dedup.bands_for(threshold)
        assert rows * bands <= near_dedup.VALUES and (1 - threshold**rows) ** bands <= near_dedup.MISS


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs).collect()), key=str)
    assert len(got) == 12
    by = {d: (c, k) for d, c, k in got}
    assert by[1] == (1, True) and by[2] == (1, False) and by[3] == (3, True) and by[4] == (4, True) and by[None] == (None, True)
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in left.collect()) == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9, 10)] + [(True, 0)]
    assert near_dedup.near_duplicates(odd_rows.nothing(spark)).count() == 0
