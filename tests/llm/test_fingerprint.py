import hashlib
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import fingerprint  # noqa: E402


def corpus(n=120):
    r = random.Random(4)
    vocabulary = [f"term{k}" for k in range(1500)]
    return [(k, " ".join(r.choices(vocabulary, [1 / (j + 5) for j in range(1500)], k=r.choice([3, 40, 200])))) for k in range(0, 3 * n, 3)]


def test_next_document_and_digest(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for blocks in (1, 7, 40):
        got = {r.doc_id: r for r in fingerprint.fingerprints(docs, fingerprint.band_mask(docs), blocks).collect()}
        assert len(got) == len(rows)
        for k, (doc, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            q = len(text) // 4
            assert got[doc].n_chars == len(text)
            assert got[doc].edited_sha256 == hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()
            assert got[doc].near_next == fingerprint.likeness(got[doc].fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint)


def test_band_counts_whole_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    mask = np.unpackbits(np.frombuffer(fingerprint.band_mask(docs), np.uint8))
    df = {}
    for _, t in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    import xxhash

    entries = {}
    for w, n in df.items():
        entries.setdefault(xxhash.xxh3_64_intdigest(w) >> (64 - fingerprint.LEXICON_BITS), []).append(n)
    low, high = len(rows) ** 0.05, len(rows) ** 0.75
    for e, n in entries.items():
        if len(n) == 1:
            assert mask[e] == (low <= n[0] <= high), (n, low, high)


def test_edits_stay_near_and_others_far(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string")
    got = fingerprint.fingerprints(docs, fingerprint.band_mask(docs)).toPandas()
    long = got[got.n_chars > 200]
    assert long.near_edited.mean() > 4 * long.near_next.mean()
    assert (long.near_edited > long.near_next).mean() > 0.8


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    got = fingerprint.fingerprints(docs, fingerprint.band_mask(docs)).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[3].n_chars == 0 and by[3].near_edited == 1.0 and by[3].near_next == 1.0  # 3 and 4 are both empty
    assert by[7].n_chars == len(odd_rows.LONG)
    assert by[None].edited_sha256 == hashlib.sha256(("a row without an id"[:-4] + "The ").encode()).hexdigest()
    assert fingerprint.fingerprints(odd_rows.nothing(spark), bytes(1 << 19)).count() == 0
    one = docs.filter("doc_id = 1")
    assert fingerprint.fingerprints(one, fingerprint.band_mask(one)).first().near_next == 1.0
