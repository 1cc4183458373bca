import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import documents, nothing

from contactweave.llm.fill_middle import MIDDLE, PLAIN, PREFIX, PSM, SPM, SUFFIX, Framed, arrange, digest, form_of, restore, store, texts, transform


def joined(t, form, a, b):
    p, m, s = t[:a], t[a:b], t[b:]
    return {PLAIN: t, PSM: f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}", SPM: f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"}[form]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSMaé😀", max_size=60), st.integers(1, 7), st.sampled_from([PSM, SPM, PLAIN]), st.integers(0, 10**6), st.integers(0, 10**6))
def test_arrange_and_restore(t, frame, form, x, y):
    if any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
        form = PLAIN
    a, b = sorted((x % (len(t) + 1), y % (len(t) + 1)))
    made = arrange(Framed.of(t, frame), form, a, b)
    assert made.text() == joined(t, form, a, b)
    assert made.units[-1] == len(made.text())
    assert restore(made, form).text() == t


def test_only_cut_frames_are_opened(monkeypatch):
    import contactweave.llm.fill_middle as module

    source = Framed.of("abcdefghij" * 100, 50)
    opened = []
    real = module.zstandard.decompress
    monkeypatch.setattr(module.zstandard, "decompress", lambda f: opened.append(f) or real(f))
    made = arrange(source, PSM, 203, 748)
    assert len(opened) == 4  # each of two cut frames for both sides of its cut
    assert sum(f in source.frames for f in made.frames) == 18


def test_cut_on_a_frame_edge_opens_nothing(monkeypatch):
    import contactweave.llm.fill_middle as module

    source = Framed.of("abcdefghij" * 100, 50)
    monkeypatch.setattr(module.zstandard, "decompress", lambda f: pytest.fail("opened"))
    arrange(source, SPM, 100, 100)
    arrange(source, PSM, 0, 1000)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("frame", [7, 1 << 15])
def test_rows_against_plain_slicing(spark, frame):
    docs = documents(spark)
    formed = transform(store(docs, frame))
    got = sorted(map(tuple, digest(formed).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        form, a, b = form_of(r.doc_id, len(t), any(m in t for m in (PREFIX, SUFFIX, MIDDLE)), 1, 10, 20)
        cut = (None, None) if form == PLAIN else (a, b - a)
        want.append((r.doc_id, len(t), form, *cut, sha(joined(t, form, a, b)), sha(t)))
    assert got == sorted(want, key=str)
    outputs = {(r.doc_id, sha(r.output)) for r in texts(formed).collect()}
    assert outputs == {(r[0], r[5]) for r in want}


def test_marked_and_empty_texts_stay_plain(spark):
    rows = [(i, f"a{m}b", ) for i, m in enumerate((PREFIX, SUFFIX, MIDDLE, "<p>", "< P>"))] + [(10, ""), (11, None)]
    got = {r.doc_id: r.form for r in transform(store(spark.createDataFrame(rows, "doc_id long, text string")), plain_percent=0).collect()}
    assert [got[i] for i in (0, 1, 2, 10, 11)] == [PLAIN] * 5
    assert PLAIN not in (got[3], got[4])


def test_empty_table(spark):
    assert digest(transform(store(nothing(spark)))).count() == 0
