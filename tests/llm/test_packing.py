import random
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import packing  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Fewest sequences by trying all placements; for a few pieces."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] >= lengths[k] and bins[b] not in tried:
                tried.add(bins[b])
                place(k + 1, bins[:b] + [bins[b] - lengths[k]] + bins[b + 1 :])
        place(k + 1, bins + [capacity - lengths[k]])

    place(0, [])
    return best


def test_completion_is_minimal_on_small_cases():
    for seed in range(60):
        r = random.Random(seed)
        lengths = sorted((r.randint(1, 100) for _ in range(r.randint(1, 9))), reverse=True)
        runs = packing.complete_bins(Counter(lengths), 100)
        used = Counter()
        for run in runs:
            assert sum(x * n for x, n in run.filling) <= 100
            for x, n in run.filling:
                used[x] += n * run.times
        assert used == Counter(lengths)
        assert sum(run.times for run in runs) == fewest(lengths, 100), lengths


def test_completion_never_loses_to_best_fit():
    for seed in range(20):
        r = random.Random(seed)
        counts = Counter(r.randint(1, 2048) for _ in range(r.randint(1, 800)))
        runs = packing.complete_bins(counts, 2048)
        assert sum(x.times for x in runs) <= sum(x.times for x in packing.best_fit(dict(counts), 2048))
    assert packing.complete_bins({}, 2048) == []


def test_one_way_down_ends_whatever_the_number_of_lengths():
    # a table with most of the lengths, where best fit misses the bound
    r = random.Random(1)
    counts = Counter(min(2048, 1 + int(r.lognormvariate(6, 0.8))) for _ in range(60_000))
    bound = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert len(counts) > 1500 and sum(x.times for x in packing.best_fit(dict(counts), 2048)) > bound
    runs = packing.complete_bins(counts, 2048)
    used = Counter()
    for run in runs:
        assert sum(x * n for x, n in run.filling) <= 2048
        for x, n in run.filling:
            used[x] += n * run.times
    assert used == counts and sum(x.times for x in runs) == bound


def test_no_filling_is_left_out():
    # the only exact way leaves out the third largest piece
    left = packing._Left(dict.fromkeys((115, 107, 103, 101, 100, 90), 1), 2048)
    assert next(packing._fillings(left, 513, 0, packing._Work(1000))) == (115, 107, 101, 100, 90)


def test_word_ids_equal_the_tokenizer():
    texts = ["Ünß µª² ÀÉ×÷ 12½ don't I'LL \xad soft\xadhy x<|endoftext|>y <|en \x00\x01", "a\x1cb\xa0c é́", "", "日本 😀x", "ΑΣ ΣΑΣ it's"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text, got in zip(texts, packing.WordIds(TOKENIZER).encode(pa.array(texts))):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_of_words_are_merged_once():
    class Counting:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, part):
            self.calls += 1
            return self.model.tokenize(part)

    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = ["q" + "".join(letters[n // 26**k % 26] for k in range(4)) for n in range(80_000)]
    words = packing.WordIds(TOKENIZER)
    words._model = Counting(words._model)
    plain, shown = (b"".join(words.encode(pa.array([" ".join(w)]))) for w in (stems, [x.upper() + "!" for x in stems]))
    assert words._model.calls == len(stems) + 1
    assert len(shown) == len(plain) + 4 * len(stems)


def check(packed, docs, capacity):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[doc, k, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    at = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(n <= capacity for n in at.values())
    return len(at)


def test_all_documents_are_packed(spark):
    docs = odd_rows.documents(spark)
    packed = packing.pack_documents(docs, TOKENIZER, 64).collect()
    check(packed, [(r[0], r[1]) for r in odd_rows.rows()], 64)
    packed = packing.pack_documents(docs, TOKENIZER).collect()
    n = check(packed, [(r[0], r[1]) for r in odd_rows.rows()], 2048)
    assert n == -(-sum(r.length for r in packed) // 2048)


def test_empty_table(spark):
    assert packing.pack_documents(odd_rows.nothing(spark), TOKENIZER).count() == 0
