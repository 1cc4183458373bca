"""Trans maxima and best neighbours against a plain row-by-row search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from contactweave.operators import scaffold as sc
from contactweave.operators.genome import Genome
from contactweave.operators.matrix import Matrix
from contactweave.plans import lookups


def lengths_of(spark, rows):
    return spark.createDataFrame([(n, l, i) for i, (n, l) in enumerate(rows)], "tig_name string, length bigint, ord bigint")


def make(spark, root, tigs, pixels, weights, res=100_000):
    matrix = Matrix.create(spark, root, Genome.from_lengths(lengths_of(spark, tigs)))
    matrix.add_level(res, spark.createDataFrame(pixels, "bin1_id bigint, bin2_id bigint, count bigint"))
    w = spark.createDataFrame(list(enumerate(weights)), "bin_id bigint, weight double")
    matrix.store.write_table(res, "weights", w)
    matrix.update_trans_max()
    return matrix


def found(matrix, res=100_000):
    named = sc.named_neighbors(matrix.best_neighbors(res), matrix.genome).collect()
    return {(r.tig_name, r.end): (r.neighbor, r.score) for r in named}


def test_example(spark, tmp_path):
    tigs = [("P", 100_000), ("Q", 100_000), ("R", 100_000)]
    matrix = make(spark, str(tmp_path / "a"), tigs, [(0, 1, 10), (0, 2, 2), (1, 2, 4)], [1.0] * 3)
    stored = {r.bin_id: r.max_val for r in matrix.best_trans_weights(100_000).collect()}
    assert stored == {0: 10, 1: 10, 2: 4}
    assert found(matrix) == {(a, e): (b, 2.5) for a, b in (("P", "Q"), ("Q", "P")) for e in ("start", "end")}
    names = matrix.neighbor_names("P", is_start=True).collect()
    assert [(r.tig_name, r.end, r.neighbor) for r in names] == [("P", "start", "Q")]
    lone = make(spark, str(tmp_path / "b"), tigs[:2], [(0, 1, 10)], [1.0] * 2)
    assert found(lone) == {}


def search(tig_of, length, pixels, weights, cutoff=100_000):
    """Neighbour of every contig end, one row at a time."""
    n = len(tig_of)
    rows = [{} for _ in range(n)]
    best = [0.0] * n
    for i, j, c in pixels:
        v = c * weights[i] * weights[j]
        if not math.isfinite(v):
            continue
        rows[i][j] = rows[j][i] = v
        if tig_of[i] != tig_of[j] and min(length[tig_of[i]], length[tig_of[j]]) >= cutoff:
            best[i], best[j] = max(best[i], v), max(best[j], v)

    def strongest(r, without):
        held = [v for c, v in rows[r].items() if length[tig_of[c]] >= cutoff and tig_of[c] not in without]
        return max(held) if held else None

    out = {}
    for tig in range(len(length)):
        own = [b for b in range(n) if tig_of[b] == tig]
        for end, r in (("start", own[0]), ("end", own[-1])):
            top = None
            for c in sorted(rows[r]):
                w = rows[r][c]
                if tig_of[c] == tig or length[tig_of[c]] < cutoff:
                    continue
                most = max(best[r], best[c])
                if most == 0:
                    continue
                if most - w < 1e-7:
                    a, b = (strongest(x, {tig, tig_of[c]}) for x in (r, c))
                    if a is None or b is None:
                        continue
                    score = w / max(a, b)
                else:
                    score = w / most
                if score - 1 >= 1e-7 and (top is None or score > top[1]):
                    top = (tig_of[c], score)
            if top:
                out[tig, end] = top
    return best, out


@pytest.mark.parametrize("seed", range(4))
def test_random_matrices_match_the_search(spark, tmp_path, seed):
    rng = random.Random(seed)
    tigs = sorted(((f"t{i}", rng.choice([30_000, 90_000, 100_000, 250_000, 310_000])) for i in range(9)), key=lambda t: t[1])
    tig_of = [i for i, (_, l) in enumerate(tigs) for _ in range(-(-l // 100_000))]
    n = len(tig_of)
    pixels = [(i, j, rng.randint(1, 6 if seed % 2 else 60)) for i in range(n) for j in range(i, n) if rng.random() < 0.5]
    weights = [math.nan if rng.random() < 0.1 else (1.0 if seed < 2 else rng.random()) for _ in range(n)]
    matrix = make(spark, str(tmp_path / "m"), tigs, pixels, weights)
    best, want = search(tig_of, [l for _, l in tigs], pixels, weights)
    stored = {r.bin_id: r.max_val for r in matrix.best_trans_weights(100_000).collect()}
    assert [stored[b] for b in range(n)] == pytest.approx(best)
    got = {(r.tig_id, r.end): (r.neighbor_id, r.score) for r in matrix.best_neighbors(100_000).collect()}
    assert got.keys() == want.keys()
    for key, (tig, score) in want.items():
        assert got[key] == (tig, pytest.approx(score))


def test_longest_contig(spark):
    genome = Genome.from_lengths(lengths_of(spark, [("b", 9), ("a", 9), ("c", 3)]))
    assert tuple(sc.longest_contig(genome).first()) == ("a", 9)


def test_cells_of_many_bins_are_passed_on_before_they_pile_up():
    """What a task holds of cells of ever new bins stays within a few batches, whatever their number."""

    class Cells:
        def mapInArrow(self, run, _):
            return run

    taken = 0

    def batches():
        nonlocal taken
        for at in range(0, 1_200_000, 10_000):
            i = pa.array(range(at, at + 10_000), pa.int64())
            no, w = pa.array([False] * 10_000), pa.array([1.0] * 10_000)
            taken += 10_000
            yield pa.RecordBatch.from_arrays([i, i, i, i, w, no, no, no], "i j tig_i tig_j w is_first is_last mutual".split())

    given = most = 0
    for batch in sc._mutual_and_best(Cells())(batches()):
        most = max(most, taken - given)
        given += batch.num_rows
    assert given == 1_200_000 and most <= 300_000


NAMES = "i j tig_i tig_j w is_first is_last mutual".split()


def both_ways(pixels):
    """Cells of (bin, bin, strength) with three bins a contig, all of them candidates."""
    cells = [(i, j, i // 3, j // 3, w, True, True, True) for a, b, w in pixels for i, j in ((a, b), (b, a))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], NAMES)


def kept_of(batches):
    rows = [tuple(r.values()) for b in sc._thinned(batches) for r in b.to_pylist()]
    return {r[:2] for r in rows if r[7]}, [r for r in rows if not r[7]]


def test_outdone_candidates_do_not_leave_their_task():
    mutual, best = kept_of([both_ways([(0, 3, 1.0), (0, 6, 1.0), (0, 9, 1.0), (12, 15, 2.0), (12, 0, 1.0)])])
    assert mutual == {(12, 15), (15, 12)}
    assert {(r[0], r[3], r[4]) for r in best if r[0] == 0} == {(0, 1, 1.0), (0, 2, 1.0)}


@pytest.mark.parametrize("seed", range(3))
def test_thinning_keeps_all_that_scores(monkeypatch, seed):
    """Whatever a task holds at a time, no winning candidate and no bin's two best partners get lost."""
    rng = random.Random(seed)
    pixels = [(a, b, float(rng.randint(1, 4))) for a in range(60) for b in range(a + 1, 60) if a // 3 != b // 3 and rng.random() < 0.1]
    rng.shuffle(pixels)
    monkeypatch.setattr(sc, "_HELD", 30)
    mutual, best = kept_of([both_ways(pixels[k : k + 7]) for k in range(0, len(pixels), 7)])
    partners = {}
    for a, b, w in pixels:
        for i, j in ((a, b), (b, a)):
            held = partners.setdefault(i, {})
            held[j // 3] = max(held.get(j // 3, 0.0), w)
    for a, b, w in pixels:
        rest = [v for i in (a, b) for t, v in partners[i].items() if t not in (a // 3, b // 3)]
        if w > max(rest, default=0.0):
            assert {(a, b), (b, a)} <= mutual
    assert len(mutual) < 1.5 * len(pixels)  # of two cells a pixel
    at, tig, w = (np.array([r[c] for r in best]) for c in (0, 3, 4))
    first, second = sc.two_best(at, tig, w)
    for i, held in partners.items():
        ranked = sorted((-v, t) for t, v in held.items())[:2]
        assert [(-w[k], tig[k]) for k in (*first, *second) if at[k] == i] == ranked


@pytest.mark.parametrize("lacking", [False, True])
def test_facts_are_looked_up_as_arrays_where_rows_do_not_fit(spark, tmp_path, monkeypatch, lacking):
    rng = random.Random(5)
    tigs = [(f"t{i}", 90_000 if i < 3 else 250_000) for i in range(10)]
    n = 3 + 7 * 3
    pixels = [(i, j, rng.randint(1, 9)) for i in range(n) for j in range(i, n) if rng.random() < 0.4]
    matrix = make(spark, str(tmp_path / "m"), tigs, pixels, [1.0 + b / 100 for b in range(n)])
    weights = matrix.weights(100_000).where("bin_id != 7") if lacking else matrix.weights(100_000)
    facts = sc.bin_facts(matrix.bins(100_000), matrix.genome, weights)
    plain, tiled = matrix.pixels(100_000), matrix.tiled_pixels(100_000)

    def found(pixels):
        best = sc.materialize(sc.trans_max(pixels, facts, n), "best")
        ends = sc.best_neighbors(pixels, facts, best, n)
        return sorted(map(str, best.collect())), sorted(map(str, ends.collect()))

    whole = found(plain)
    assert len(whole[0]) == n - lacking and whole[1]
    monkeypatch.setattr(sc, "FEW_KEYS", 0)
    assert found(tiled) == whole
    if not lacking:
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", n * 16)  # rows take 56 bytes and more
        monkeypatch.setattr(lookups, "_shuffled", None)
        assert sorted(map(str, sc.trans_max(tiled, facts, n).collect())) == whole[0]
        assert sorted(map(str, sc.trans_max(plain, facts, n).collect())) == whole[0]
