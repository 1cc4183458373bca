"""Contigs, bins, pixels, zoom, rectangles and balancing on small matrices."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactweave.errors import ContactWeaveError, MatrixIndexError, NotBalancedError, ResolutionError
from contactweave.operators import balance as bal, contacts as ct, genome as gn, region as rg
from contactweave.operators.genome import Genome
from contactweave.operators.matrix import Matrix
from contactweave.plans import lookups, ordering, storage, tiles as tl
from contactweave.schemas import PAIRS
from contactweave.sources.matrix_store import dump_weights

PAIR_ROWS = [
    ("r1", "A", 5, "A", 15),
    ("r2", "B", 24, "A", 0),
    ("r3", "B", 99, "C", 1),
    ("r4", "A", 20, "C", 3),
    ("r5", "X", 1, "A", 1),
    ("r6", "A", 15, "A", 5),
]


def pairs_of(spark, rows):
    return spark.createDataFrame([(*r, "+", "+") for r in rows], PAIRS)


def lengths_of(spark, rows):
    return spark.createDataFrame([(n, l, i) for i, (n, l) in enumerate(rows)], "tig_name string, length bigint, ord bigint")


@pytest.fixture(scope="module")
def genome(spark):
    return Genome.from_lengths(lengths_of(spark, [("B", 25), ("A", 20), ("C", 20)]))


def triples(df):
    return sorted(tuple(r) for r in df.collect())


def pixels_of(spark, rows):
    return spark.createDataFrame(rows, "bin1_id bigint, bin2_id bigint, count bigint")


def test_contigs_and_bins(genome):
    assert triples(genome.contigs) == [(0, "A", 20), (1, "C", 20), (2, "B", 25)]
    assert [r.chrom_offset for r in genome.tig_index(10).orderBy("tig_id").collect()] == [0, 2, 4, 7]
    assert triples(genome.bins(10).where("tig_id = 2").select("start", "end")) == [(0, 10), (10, 20), (20, 25)]
    assert genome.n_bins(10) == 7
    assert triples(gn.contig_bin_range(genome.bins(10))) == [(0, 0, 1), (1, 2, 3), (2, 4, 6)]


def test_repeated_name_means_its_last_id(spark):
    genome = Genome.from_lengths(lengths_of(spark, [("A", 30), ("A", 40), ("B", 10)]))
    assert not genome.unique_names
    got = ct.contact_pixels(pairs_of(spark, [("r", "A", 0, "B", 0)]), genome, 10)
    assert triples(got) == [(0, 4, 1)]


def test_empty_contig_holds_no_contact(spark):
    genome = Genome.from_lengths(lengths_of(spark, [("Z", 0), ("A", 20)]))
    assert triples(genome.bins(10).select("bin_id", "tig_id")) == [(0, 1), (1, 1)]
    pairs = pairs_of(spark, [("r", "Z", 0, "A", 5), ("s", "A", 0, "A", 5)])
    assert triples(ct.contact_pixels(pairs, genome, 10)) == [(0, 0, 1)]


def test_negative_positions(spark, genome):
    placeholder = pairs_of(spark, [("", "", -1, "", -1), ("r", "A", 1, "A", 2)])
    assert triples(ct.contact_pixels(placeholder, genome, 10)) == [(0, 0, 1)]
    with pytest.raises(Exception, match="must not be negative"):
        ct.contact_pixels(pairs_of(spark, [("r", "A", -1, "A", 2)]), genome, 10).collect()


def test_long_contig_bins_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(gn, "_BIN_CHUNK", 4)
    genome = Genome.from_lengths(lengths_of(spark, [("A", 1003), ("B", 7)]))
    got = triples(genome.bins(10).select("bin_id", "tig_id", "start", "end"))
    assert got == [(0, 0, 0, 7)] + [(1 + k, 1, 10 * k, min(10 * k + 10, 1003)) for k in range(101)]


@pytest.mark.parametrize("large", [False, True])
def test_pixels(spark, genome, large):
    if large:
        spark.conf.set("spark.contactweave.broadcastBytes", "1")
    try:
        pairs = pairs_of(spark, PAIR_ROWS)
        clamped = ct.contact_pixels(pairs, genome, 10)
        strict = ct.contact_pixels(pairs, genome, 10, "strict")
        assert triples(clamped) == [(0, 1, 2), (0, 6, 1), (1, 2, 1), (2, 6, 1)]
        assert triples(strict) == [(0, 1, 2), (0, 6, 1), (2, 2, 1), (2, 6, 1)]
        index = lambda p: [r.bin1_offset for r in gn.bin_index(p, genome.bins(10), 7).orderBy("bin_id").collect()]
        assert index(strict) == [0, 2, 2, 4, 4, 4, 4, 4]
        assert index(clamped) == [0, 2, 3, 4, 4, 4, 4, 4]
        assert [r.read_name for r in ct.unplaced_pairs(pairs, genome).collect()] == ["r5"]
        assert triples(ct.zoom_pixels(strict, genome, 10, 20)) == [(0, 0, 2), (0, 3, 1), (1, 1, 1), (1, 3, 1)]
        assert triples(ct.zoom_pixels(clamped, genome, 10, 20)) == [(0, 0, 2), (0, 1, 1), (0, 3, 1), (1, 3, 1)]
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")


def test_zoom_refuses_bad_steps_and_pixels_outside(spark, genome):
    pixels = pixels_of(spark, [(0, 7, 1)])
    with pytest.raises(ResolutionError):
        ct.zoom_pixels(pixels, genome, 10, 15)
    with pytest.raises(Exception, match="outside the matrix"):
        ct.zoom_pixels(pixels, genome, 10, 20).collect()


def test_rectangle_examples(spark, genome):
    strict = pixels_of(spark, [(0, 1, 2), (0, 6, 1), (2, 2, 1), (2, 6, 1)])
    assert triples(rg.rectangle(strict, 7, 0, 3, 0, 3)) == [(0, 1, 2), (1, 0, 2), (2, 2, 1)]
    assert triples(rg.rectangle(strict, 7, 2, 3, 0, 7)) == [(2, 2, 1), (2, 6, 1)]
    assert triples(rg.rectangle(strict, 7, 6, 7, 0, 7)) == [(6, 0, 1), (6, 2, 1)]
    weights = bal.length_weights(genome.bins(10), 10)
    assert [round(r.value, 9) for r in rg.balanced_rectangle(strict, weights, 7, 2, 3, 0, 7).collect()] == [0.01, 0.01]
    for bad in ((0, 0, 0, 3), (0, 8, 0, 3), (-1, 2, 0, 3), (0, 3, 3, 2)):
        with pytest.raises(MatrixIndexError):
            rg.rectangle(strict, 7, *bad)


def random_matrix(n, fill, seed, top=50):
    rng = random.Random(seed)
    return [(i, j, rng.randint(1, top)) for i in range(n) for j in range(i, n) if rng.random() < fill]


def dense(rows, n):
    out = np.zeros((n, n))
    for i, j, c in rows:
        out[i, j] = out[j, i] = c
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored matrix of 30 bins whose bins 3 and 20 are masked by NaN weights."""
    genome = Genome.from_lengths(lengths_of(spark, [("A", 100), ("B", 80), ("C", 120)]))
    matrix = Matrix.create(spark, str(tmp_path_factory.mktemp("m") / "x"), genome)
    rows = random_matrix(30, 0.4, 11)
    matrix.add_level(10, pixels_of(spark, rows))
    w = [math.nan if b in (3, 20) else 1 + b / 10 for b in range(30)]
    matrix.store.write_table(10, "weights", spark.createDataFrame(list(enumerate(w)), "bin_id bigint, weight double"))
    return matrix, rows, np.array(w)


@pytest.mark.parametrize("box", [(0, 30, 0, 30), (5, 9, 20, 30), (20, 30, 5, 9), (0, 30, 4, 8), (2, 15, 10, 25), (7, 8, 7, 8)])
def test_rectangles_match_a_dense_slice(stored, box):
    matrix, rows, w = stored
    i0, i1, j0, j1 = box
    full = dense(rows, 30)
    raw = rg.to_dense(matrix.rectangle(10, *box), *box, value="count")
    assert (raw == full[i0:i1, j0:j1]).all()
    want = np.nan_to_num(full * w[:, None] * w[None, :])[i0:i1, j0:j1]
    np.testing.assert_allclose(matrix.balanced_array(10, *box), want)


def test_rows(stored):
    matrix, rows, w = stored
    value = dense(rows, 30) * w[:, None] * w[None, :]
    got = matrix.balanced_row(10, 4).collect()
    assert [r.bin_id for r in got] == [j for j in range(30) if value[4, j] > 0]
    full = [r.value for r in matrix.dense_row(10, 4).orderBy("bin_id").collect()]
    np.testing.assert_allclose(full, np.nan_to_num(value[4]))
    assert matrix.balanced_row(10, 3).count() == 0
    with pytest.raises(MatrixIndexError):
        matrix.balanced_row(10, 30)


def test_slices_and_accessors(stored, spark, monkeypatch):
    matrix, rows, w = stored
    assert matrix.n_pixels(10) == len(rows) and matrix.n_bins(10) == 30
    assert matrix.resolutions() == [10] and matrix.n_contigs == 3
    assert matrix.tig_id("C") == 2 and matrix.tig_name(0) == "B" and matrix.tig_id("no") is None
    for start, end in ((0, 5), (17, 90), (len(rows) - 3, len(rows))):
        got = matrix.pixel_slice(10, start, end).orderBy("pos").collect()
        assert [(r.bin1_id, r.bin2_id, r["count"]) for r in got] == sorted(rows)[start:end]
        assert [r.pos for r in got] == list(range(start, end))
    assert [(r.bin1_id, r.bin2_id, r["count"]) for r in matrix.iter_pixels(10)] == sorted(rows)
    assert matrix.balanced_pixel_slice(10, 0, 5).count() == 5
    with pytest.raises(MatrixIndexError):
        matrix.pixel_slice(10, 0, len(rows) + 1)
    again = Matrix.open(spark, matrix.store.root)
    assert again.resolutions() == [10] and triples(again.contigs()) == triples(matrix.contigs())
    with_values = again.bins(10, with_values=True)
    assert with_values.columns[-2:] == ["weight", "max_val"]
    with pytest.raises(ResolutionError):
        again.add_level(10, pixels_of(spark, rows))
    with pytest.raises(ResolutionError):
        again.pixels(20)


def test_build_zoom_balance(spark, tmp_path):
    rng = random.Random(2)
    tigs = [("A", 400), ("B", 390), ("C", 611)]
    rows = []
    for i in range(3000):
        (a, la), (b, lb) = rng.choice(tigs), rng.choice(tigs)
        rows.append((f"r{i}", a, rng.randint(0, la), b, rng.randint(0, lb)))
    pairs = pairs_of(spark, rows)
    matrix = Matrix.build(spark, str(tmp_path / "m"), pairs, lengths_of(spark, tigs), [10, 20, 60, 30], "LEN")
    assert matrix.resolutions() == [10, 20, 30, 60]
    for res in (10, 20, 30, 60):
        direct = ct.contact_pixels(pairs, matrix.genome, res)
        assert triples(matrix.pixels(res)) == triples(direct)
        assert matrix.pixels(res).agg(F.sum("count")).first()[0] == 3000
        assert {r.weight for r in matrix.weights(res).collect()} == {1 / res}
    single = Matrix.build(spark, str(tmp_path / "s"), pairs, lengths_of(spark, tigs), [50])
    assert single.resolutions() == [50]
    with pytest.raises(NotBalancedError):
        single.balanced_row(50, 0)
    for bad in ([10, 15], [20, 10], [10, 10], []):
        with pytest.raises(ResolutionError):
            Matrix.build(spark, str(tmp_path / "bad"), pairs, lengths_of(spark, tigs), bad)


def test_a_rebuilt_matrix_forgets_old_weights(spark, genome, tmp_path):
    root, pixels = str(tmp_path / "m"), pixels_of(spark, [(0, 6, 1)])
    first = Matrix.create(spark, root, genome)
    first.add_level(10, pixels)
    first.balance([10], "LEN")
    again = Matrix.create(spark, root, genome)
    with pytest.raises(ResolutionError):
        again.pixels(10)
    again.add_level(10, pixels)
    with pytest.raises(NotBalancedError):
        Matrix.open(spark, root).weights(10)


def test_stored_pixels_prune_by_row_range(stored, spark):
    matrix, _, _ = stored
    plan = lambda *box: matrix.rectangle(10, *box)._jdf.queryExecution().executedPlan().toString()
    assert plan(2, 5, 10, 12).count("GreaterThanOrEqual(bin1_id") == 1  # nothing is stored below the diagonal
    assert plan(2, 12, 5, 20).count("GreaterThanOrEqual(bin1_id") == 2


@pytest.fixture(scope="module")
def tiled(spark, tmp_path_factory):
    """A stored matrix of 70 bins in tiles of 9."""
    genome = Genome.from_lengths(lengths_of(spark, [("A", 300), ("B", 400)]))
    matrix = Matrix.create(spark, str(tmp_path_factory.mktemp("t") / "x"), genome)
    rows = random_matrix(70, 0.3, 5)
    spark.conf.set("spark.contactweave.tilePixels", "30")
    try:
        matrix.add_level(10, pixels_of(spark, rows))
        matrix.balance([10], "LEN")
    finally:
        spark.conf.unset("spark.contactweave.tilePixels")
    return matrix, rows


def tiles_read(df):
    """Number of tiles that each scan of pixels opened, once ``df`` has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size())]
    return [s.metrics().apply("numPartitions").value() for s in scans if s.metrics().contains("numPartitions")]


def test_tiles_interleave_rows_and_columns(spark):
    for side in (1, 3, 7):
        table = spark.range(40).selectExpr("id as a", "id * 7 % 40 as b")
        for r in table.select("a", "b", tl.tile_column("a", "b", side).alias("t")).collect():
            assert r.t == tl.tile_number(r.a // side, r.b // side)
    assert len({tl.tile_number(r, c) for r in range(129) for c in range(129)}) == 129 * 129
    assert tl.tile_bins(0, 0, 10) == 1 and tl.tile_bins(1000, 5, 10) == 1000
    assert tl.tile_bins(10**7, 10**12, 16_000_000) == -(-(10**7) // 128)
    assert tl.tiles_over(10, 5, 5, 0, 9) == [] and tl.tiles_over(10, 15, 25, 0, 9) == []


def test_a_row_reads_one_row_and_one_column_of_tiles(tiled):
    matrix, rows = tiled
    side = matrix.tile_bins(10)
    assert 70 // side >= 7
    assert tiles_read(matrix.tiled_pixels(10))[0] > 25
    full = dense(rows, 70)
    for row in (0, 35, 69):
        own, last = row // side, 69 // side
        cells = matrix.rectangle(10, row, row + 1, 0, 70)
        right, above = (tiles_read(cells) + [0])[:2]
        assert right <= last - own + 1 and above <= own + 1
        assert [r.bin_id for r in matrix.balanced_row(10, row).collect()] == np.flatnonzero(full[row]).tolist()
    box = (10, 20, 30, 45)
    assert (rg.to_dense(matrix.rectangle(10, *box), *box, value="count") == full[10:20, 30:45]).all()
    assert sum(tiles_read(matrix.rectangle(10, *box))) <= 9
    assert [(r.bin1_id, r.bin2_id, r["count"]) for r in matrix.iter_pixels(10)] == sorted(rows)
    got = matrix.pixel_slice(10, 50, 300)
    assert [(r.bin1_id, r.bin2_id, r["count"]) for r in got.orderBy("pos").collect()] == sorted(rows)[50:300]


def test_touching_reads_the_tiles_of_its_bins(tiled):
    matrix, rows = tiled
    got = rg.touching(matrix.tiled_pixels(10), [3, 50], 70, matrix.tile_bins(10))
    assert triples(got.select("bin1_id", "bin2_id", "count")) == sorted(r for r in rows if {3, 50} & set(r[:2]))
    assert tiles_read(got)[0] <= 2 * (69 // matrix.tile_bins(10) + 1)


@pytest.mark.parametrize("large", [False, True])
def test_pyramid_sums_all_levels_in_one_scan(spark, large):
    rng = random.Random(8)
    tigs = [("A", 95), ("B", 230), ("C", 120), ("D", 5)]
    rows = [(f"r{i}", *(x for t in (rng.choice(tigs), rng.choice(tigs)) for x in (t[0], rng.randint(0, t[1])))) for i in range(800)]
    genome = Genome.from_lengths(lengths_of(spark, tigs))
    pairs = pairs_of(spark, rows)
    if large:
        spark.conf.set("spark.contactweave.broadcastBytes", "1")
    try:
        levels = ct.pyramid(ct.located_pixels(pairs, genome, 10), genome, 10, [20, 50, 60])
        plan = levels._jdf.queryExecution().optimizedPlan().toString()
        assert "bin_id" not in plan and plan.count("Generate explode") == 1
        for res in (20, 50, 60):
            got = levels.where(F.col("res") == res)
            assert triples(got.select("bin1_id", "bin2_id", "count")) == triples(ct.contact_pixels(pairs, genome, res))
            bins = {r.bin_id: r.tig_id for r in genome.bins(res).collect()}
            assert all(bins[r.bin1_id] == r.tig1_id and bins[r.bin2_id] == r.tig2_id for r in got.collect())
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")


def folders(root):
    return set(os.listdir(f"{root}/data"))


def test_a_failed_build_leaves_the_matrix_as_it_was(spark, tmp_path):
    root, lengths = str(tmp_path / "m"), lengths_of(spark, [("A", 100), ("B", 80)])
    good = pairs_of(spark, [("r", "A", 1, "B", 2), ("s", "A", 50, "A", 99)])
    Matrix.build(spark, root, good, lengths, [10, 20], "LEN")
    before = triples(Matrix.open(spark, root).pixels(20))
    for bad, message in ((pairs_of(spark, [("r", "A", 1, "B", 2), ("t", "A", -5, "B", 1)]), "negative"),):
        with pytest.raises(Exception, match=message):
            Matrix.build(spark, root, bad, lengths, [10, 40], "LEN")
    again = Matrix.open(spark, root)
    assert again.resolutions() == [10, 20] and triples(again.pixels(20)) == before
    assert again.weights(10).count() == 18


def test_versions_are_switched_last_and_cleared(spark, tmp_path):
    root, lengths = str(tmp_path / "m"), lengths_of(spark, [("A", 100)])
    pairs = [pairs_of(spark, [("r", "A", k, "A", 99)]) for k in (1, 30, 60)]
    first = Matrix.build(spark, root, pairs[0], lengths, [10])
    reader = Matrix.open(spark, root).pixels(10)
    Matrix.build(spark, root, pairs[1], lengths, [10])
    assert triples(reader) == [(0, 9, 1)]  # the version before still answers
    assert triples(Matrix.open(spark, root).pixels(10)) == [(3, 9, 1)]
    kept = folders(root)
    Matrix.build(spark, root, pairs[2], lengths, [10])
    assert not set(first.store.folders.values()) & folders(root) and len(folders(root)) == len(kept)
    assert triples(Matrix.open(spark, root).pixels(10)) == [(6, 9, 1)]
    with pytest.raises(ContactWeaveError, match="already holds"):
        Matrix.create(spark, root, first.genome, overwrite=False)
    with pytest.raises(ContactWeaveError, match="no matrix"):
        Matrix.open(spark, str(tmp_path / "none"))


def numpy_weights(rows, tig_of, n, iters=400):
    far = [(i, j, c) for i, j, c in rows if j - i >= 3]
    full = dense(far, n)
    marg, nnz = full.sum(1), (full > 0).sum(1)
    bias = np.where(nnz < 5, 0.0, 1.0)
    scaled = np.zeros(n)
    for t in set(tig_of):
        at = np.array(tig_of) == t
        positive = marg[at][marg[at] > 0]
        if len(positive):
            scaled[at] = marg[at] / np.median(positive)
    logs = np.log(scaled[scaled > 0])
    cutoff = np.exp(np.median(logs) - 5 * np.median(np.abs(logs - np.median(logs))))
    bias[scaled < cutoff] = 0
    for _ in range(iters):
        m = (full * bias[:, None] * bias[None, :]).sum(1)
        mean, var = m[m != 0].mean(), m[m != 0].var()
        bias = bias / np.where(m == 0, 1, m / mean)
        if var < 1e-5:
            break
    m = (full * bias[:, None] * bias[None, :]).sum(1)
    return np.where(bias == 0, np.nan, bias / np.sqrt(m[m != 0].mean()))


@pytest.mark.parametrize("large", [False, True])
def test_iterative_weights_match_numpy(spark, large, monkeypatch):
    genome = Genome.from_lengths(lengths_of(spark, [("A", 100), ("B", 80), ("C", 120)]))
    rows = [r for r in random_matrix(30, 0.5, 4) if 9 not in r[:2]] + [(9, 20, 3)]
    rows = [(i, j, 1 if 5 in (i, j) else c * 40) for i, j, c in rows]
    tig_of = [r.tig_id for r in genome.bins(10).orderBy("bin_id").collect()]
    want = numpy_weights(rows, tig_of, 30)
    assert np.isnan(want[9]) and not np.isnan(want).all()
    if large:
        monkeypatch.setattr(ordering, "SMALL", -1)
        spark.conf.set("spark.contactweave.broadcastBytes", "1")
    monkeypatch.setattr(bal, "BLOCK_BINS", 4)
    try:
        got = bal.iterative_weights(pixels_of(spark, rows), genome, 10)
        np.testing.assert_allclose([r.weight for r in got.orderBy("bin_id").collect()], want, rtol=1e-9)
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")


def nodes_above_scan(plan, column):
    """Lines of a plan from the nearest join down to the scan of a table with ``column``."""
    lines = [(re.search(r"[A-Za-z*]", line).start(), line) for line in plan.splitlines() if re.search(r"[A-Za-z]", line)]
    at = next(k for k, (_, line) in enumerate(lines) if "FileScan parquet" in line and column in line)
    path, indent = [lines[at][1]], lines[at][0]
    for depth, line in reversed(lines[:at]):
        if depth < indent:
            path, indent = [line, *path], depth
            if "Join" in line:
                break
    return path


@pytest.mark.parametrize("large", [False, True])
def test_a_round_moves_biases_and_no_contacts(spark, large):
    rows = random_matrix(64, 0.5, 6)
    if large:
        spark.conf.set("spark.contactweave.broadcastBytes", "1")
    try:
        blocks = bal.BlockedContacts(pixels_of(spark, rows), 64)
        try:
            bias = spark.range(64).selectExpr("id as bin_id", "1.0D + id as bias")
            sums = blocks.sums(bias)
            full = dense(rows, 64)
            for r in rows:
                if r[0] == r[1]:
                    full[r[0], r[0]] = 2 * r[2]  # a diagonal contact is seen from both of its ends
            b = 1.0 + np.arange(64)
            want = (full * b[:, None] * b[None, :]).sum(1)
            got = {r["_bin"]: r["_sum"] for r in sums.collect()}
            np.testing.assert_allclose([got[k] for k in range(64)], want)
            text = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            above = nodes_above_scan(text, "count#")
            assert "Join" in above[0] and not any("Exchange" in n for n in above[1:])
        finally:
            blocks.drop()
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")


def test_sums_of_a_round_are_made_where_the_contacts_are(spark):
    blocks = bal.BlockedContacts(pixels_of(spark, random_matrix(64, 0.5, 6)), 64)
    try:
        sums = blocks.sums(spark.range(64).selectExpr("id as bin_id", "1.0D + id as bias"))
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\((bin_id|_bin)#", plan)
    finally:
        blocks.drop()


def test_weights_by_block_leave_pixels_where_they_are(spark, monkeypatch):
    rows = [*random_matrix(64, 0.5, 8), (3, 64, 1), (3, 900, 1)]  # two bins have no weight
    pixels = storage.materialize(pixels_of(spark, rows), "pixels")
    weights = spark.range(64).selectExpr("id as bin_id", "if(id = 5, double('nan'), 1.0D / (1 + id)) as weight")
    monkeypatch.setattr(lookups, "FEW_KEYS", -1)
    spark.conf.set("spark.contactweave.broadcastBytes", str(8 * 64))  # too little for rows of weights
    try:
        value = ct.balanced_pixels(pixels, weights, 64)
        text = value._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert not any("Exchange" in n for n in nodes_above_scan(text, "count#")[1:])
        got = {(r.bin1_id, r.bin2_id): r.value for r in value.collect()}
        cells = {(r.i, r.j): r.value for r in rg.balanced_rectangle(pixels.where("bin2_id < 64"), weights, 64, 3, 40, 10, 64).collect()}
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")
    at = lambda k: np.nan if k == 5 else 1.0 / (1 + k)
    want = {(i, j): c * at(i) * at(j) for i, j, c in rows if j < 64}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()))
    both = {**want, **{(j, i): v for (i, j), v in want.items()}}
    inside = {k: v for k, v in both.items() if 3 <= k[0] < 40 and 10 <= k[1] < 64}
    assert cells.keys() == inside.keys()
    np.testing.assert_allclose([cells[k] for k in inside], list(inside.values()))


def test_nothing_left_to_balance(spark, genome, tmp_path):
    pixels = pixels_of(spark, [(0, 6, 1)])
    assert bal.iterative_weights(pixels, genome, 10) is None
    assert bal.balance_weights(pixels, genome, 10, "other") is None
    matrix = Matrix.create(spark, str(tmp_path / "m"), genome)
    matrix.add_level(10, pixels_of(spark, []))
    assert matrix.balance([10], "ICGW") == []
    assert matrix.balance([10], "LEN") == [10]
    dump_weights(matrix.weights(10), str(tmp_path / "dump"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()] == ["0.1"] * 7


def test_dense_rectangle_moves_only_stored_cells(spark):
    """Over several strips, with copies, cells outside, on strip ends and without a finite value."""
    strip, nan = rg._STRIP, float("nan")
    rows = [(3, 5, 1.5), (3, 5, 1.5), (3, 6, nan), (4, strip + 4, 2.0), (4, strip + 5, 3.0), (5, 2 * strip, float("inf"))]
    rows += [(2, 7, 9.0), (6, 7, 9.0), (3, 4, 9.0), (4, 2 * strip + 7, 9.0), (5, None, 1.0), (None, 7, 1.0), (5, 2 * strip + 6, 4.0), (5, 8, None)]
    cells = spark.createDataFrame(rows, "i long, j long, value double")
    dense = rg.dense_rectangle(cells, 3, 6, 5, 2 * strip + 7)
    assert dense.schema.simpleString() == "struct<i:bigint,j:bigint,value:double>"
    held = {(3, 5): 1.5, (4, strip + 4): 2.0, (4, strip + 5): 3.0, (5, 2 * strip + 6): 4.0}
    want = sorted([(i, j, held.get((i, j), 0.0)) for i in range(3, 6) for j in range(5, 2 * strip + 7)] + [(3, 5, 1.5)])
    assert sorted(map(tuple, dense.collect())) == want
    assert "Join" not in dense._jdf.queryExecution().executedPlan().toString()


def test_pyramid_sums_levels_behind_one_shuffle_of_pixels(spark, monkeypatch):
    """Levels are made from dealt pixels, so a task's sums follow its share of the pixels."""
    monkeypatch.setattr(ct, "_TASK_PIXELS", 100)
    lengths = spark.createDataFrame([("a", 950, 0), ("b", 10, 1), ("c", 1_203, 2), ("d", 0, 3)], "tig_name string, length long, ord long")
    genome = Genome.from_lengths(lengths)
    rng = random.Random(5)
    n = genome.n_bins(10)
    cells = {tuple(sorted((rng.randrange(n), rng.randrange(n)))): rng.randrange(1, 9) for _ in range(3_000)}
    pixels = ct.locate(spark.createDataFrame([(*k, v) for k, v in cells.items()], "bin1_id long, bin2_id long, count long"), genome, 10)
    dealt = ct.pyramid(pixels, genome, 10, [20, 30, 60], len(cells))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    shuffles = [at for at in re.finditer("Exchange hashpartitioning", plan)]
    assert len(shuffles) == 1 and plan.index("Generate") < shuffles[0].start()
    plain = ct.pyramid(pixels, genome, 10, [20, 30, 60])
    assert dealt.columns == plain.columns
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_marginals_broadcast_no_bins(spark):
    """Bins are made from a row for each contig, which looks small to the planner however many bins that gives."""
    genome = Genome.from_lengths(lengths_of(spark, [("A", 200_000), ("B", 300_000), ("C", 0)]))
    rows = [(0, 5, 2), (0, 7, 1), (4, 5, 9), (6, 40_000, 3), (7, 60_000, 1), (2, 90, 0)]  # near, outside and empty pixels as well
    margs = bal.marginals(pixels_of(spark, rows), genome.bins(10))
    assert margs.columns == ["bin_id", "tig_id", "nnz", "total"]
    held = margs.where("total > 0")
    assert triples(held.select("bin_id", "nnz", "total")) == [(0, 2, 3), (5, 1, 2), (6, 1, 3), (7, 2, 2), (40_000, 1, 3)]
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    assert margs.count() == genome.n_bins(10) == 50_000
    assert triples(margs.groupBy("tig_id").count()) == [(1, 20_000), (2, 30_000)]


def test_dense_rectangle_makes_short_runs_behind_a_shuffle_of_blocks(spark, tmp_path):
    """Neither a row nor a strip has a marker of its own in the shuffle, and what is written repeats few columns."""
    n_rows, n_columns = 500, 3 * rg._STRIP + 100
    held = {(7, 11): 2.0, (7, 11 + rg._RUN): 3.0, (8, 10 + rg._RUN): 4.0, (499, n_columns + 9): 5.0}
    cells = spark.createDataFrame([(*k, v) for k, v in held.items()], "i long, j long, value double")
    dense = rg.dense_rectangle(cells, 0, n_rows, 10, 10 + n_columns)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Window") < plan.index("Generate explode(sequence(i#") < plan.index("Exchange")
    dense.write.parquet(str(tmp_path / "dense"))
    size = sum(f.stat().st_size for f in (tmp_path / "dense").glob("*.parquet"))
    assert size < 0.5 * n_rows * n_columns  # bytes; far more where a row is written from end to end
    stored = spark.read.parquet(str(tmp_path / "dense"))
    assert stored.distinct().count() == stored.count() == n_rows * n_columns
    assert {(r.i, r.j): r.value for r in stored.where("value != 0").collect()} == held
    assert tuple(stored.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()) == (0, n_rows - 1, 10, 9 + n_columns)
