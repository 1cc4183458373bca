import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from contactweave.llm.prefix_trie import SpillingQueue, end_digests, named_prefixes, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest_order(role, text):
    d = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return int(d[:15], 16), int(d[16:31], 16)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest_order(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(head, [])[:h] + turns[c][h:]
    return out


def plain_trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(plain_rebuilt(rows).items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        saved[k] = own + sum(saved[c] for c in children[k])
        leaves[k] = sum(leaves[c] for c in children[k]) if children[k] else 1
    return sorted(
        (
            (
                m[0],
                len(k),
                members[k[:-1]][0] if k else None,
                len(m),
                len(children[k]),
                leaves[k],
                saved[k],
                hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest(),
            )
            for k, m in members.items()
        ),
        key=str,
    )


def conversations(seed, n=60, most=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(350), rng.randrange(-250, 0), rng.randrange(4) * 100])
        start = rng.choice([0, 3, None])
        for t in range(rng.randrange(1, most)):
            turn = None if start is None else start + t
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "é😀", "", None])))
    rows += [rows[0], rows[0], (None, 0, "user", "x"), (None, None, None, None)]
    long_one = rng.randrange(350)
    rows += [(long_one, 100 + i, "user", rng.choice(["p", "q"])) for i in range(120)]
    return rows


def got(spark, rows, parts=6, **settings):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, trie(table, **settings).collect()), key=str)


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"band_bits": 1, "slice_levels": 7, "queue": 2}), (3, {"band_bits": 2, "slice_levels": 3, "queue": 0})])
def test_against_plain_trie(spark, seed, settings):
    rows = conversations(seed)
    assert got(spark, rows, **settings) == plain_trie(rows)


def test_equal_long_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(3)]
    rows += [(c, 0, "user", "alone") for c in range(205, 230)]  # no conversation 200: those with h > 0 lose their turn
    assert any(not t for t in plain_rebuilt(rows).values())
    assert got(spark, rows) == plain_trie(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    rows = conversations(4, 10)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in ("depth", "k1", "n", "group", "at", "first", "band", "own", "chars")])
    assert sorted(map(tuple, trie(table).collect()), key=str) == plain_trie(rows)


def test_prefix_names_do_not_depend_on_partitions(spark):
    rows = [(1, t, "user", str(t * t % 7)) for t in range(500)] + [(2, t, "user", str(t * t % 7)) for t in range(500)]
    names = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = named_prefixes(rebuilt(spark.createDataFrame(rows, SCHEMA)))
            names.append(sorted(map(tuple, found.select("conv_id", "depth", "k1", "k2", "to1", "to2").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert names[0] == names[1]
    by = {(c, d): (k1, k2) for c, d, k1, k2, _, _ in names[0]}
    assert all(by[c, d - 1] == (t1, t2) for c, d, _, _, t1, t2 in names[0] if d)


def test_ends_in_pieces(spark):
    rows = spark.createDataFrame([(c, 2, 7, 8, True) for c in range(-40, 1000)], "conv_id long, depth long, k1 long, k2 long, ended boolean")
    want = hashlib.sha256(",".join(map(str, range(-40, 1000))).encode()).hexdigest()
    assert [tuple(r) for r in end_digests(rows.repartition(5), most=9).collect()] == [(2, 7, 8, want)]


@pytest.mark.parametrize("limit", [0, 1, 5, 1000])
def test_spilling_queue(limit):
    rng = random.Random(limit)
    queue, sums, level = SpillingQueue(limit), defaultdict(lambda: [0, 0, 0]), 0
    for level in range(30):
        for _ in range(20):
            key = (level + rng.randrange(1, 4), rng.randrange(3), rng.randrange(2))
            add = [rng.randrange(9) for _ in range(3)]
            queue.push((*key, *add))
            sums[key] = [x + y for x, y in zip(sums[key], add)]
        for key in sorted(k for k in sums if k[0] == level):
            assert queue.take(key) == tuple(sums.pop(key))
        assert queue.take((level, 9, 9)) == (0, 0, 0)
    assert (queue.spilled > 0) == (limit < 1000)
