import hashlib
import os
import random
import struct
import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import piece_codec  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equal_to_the_library():
    r = random.Random(3)
    odd = ["", " ", "  a   b ", "▁▁x ▁", "\x00a\x01", "日本語" * 60, "😀 🏳️‍🌈", "ab" * 3000, "<s> </s> <unk> <0x0A>", "\n\n\t x", " lead", "trail "]
    odd += ["".join(r.choice(" ab▁\nçü日😀e,.th") for _ in range(r.randint(0, 90))) for _ in range(600)]
    coder, theirs = piece_codec.PieceModel(MODEL), library()
    for text in odd:
        ids = coder.encode(text)
        assert ids == theirs.encode(text, add_bos=True, add_eos=True), text
        assert coder.decode(ids) == theirs.decode(ids), text
    for _ in range(1000):
        ids = [r.choice([r.randint(0, 31_999), r.randint(0, 260)]) for _ in range(r.randint(0, 12))]
        assert coder.decode(ids) == theirs.decode(ids), ids


def test_spans_cover_the_text():
    coder = piece_codec.PieceModel(MODEL)
    for text in ("ça  va 日本😀 ok", "a\nb", " x"):
        data, at = text.encode(), 0
        for i, _, start, end in coder.spans(text):
            assert start <= at <= end or start == at
            at = max(at, end)
        assert at == len(data)
        assert [s[0] for s in coder.spans(text)] == coder.encode(text)[1:-1]


def char_map(rules):
    """A compiled map of single-byte-chain rules, laid out by trying bases; small maps only."""
    trie = {}
    pool, places = b"", {}
    for source, target in rules.items():
        places[source] = len(pool)
        pool += target.encode() + b"\0"
        node = trie
        for b in source.encode():
            node = node.setdefault(b, {})
        node[None] = source
    units = [0] * 4096
    used = {0}
    free = iter(range(1, 4096 // 256))

    def fill(at, node):
        base = next(free) * 256  # a block for each node keeps children apart
        units[at] |= (at ^ base) << 10
        for key, child in node.items():
            if key is None:
                units[at] |= 1 << 8
                units[base] = places[child] | 1 << 31
                used.add(base)
            else:
                units[base ^ key] = key
                fill(base ^ key, child)

    fill(0, trie)
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + pool


def test_longest_prefix_of_a_character_map():
    found = piece_codec.CharMap(char_map({"ab": "X", "a": "yy", "é": "e"}))
    data = "abaéz".encode()
    assert found.longest(data, 0) == (2, b"X")
    assert found.longest(data, 2) == (1, b"yy")
    assert found.longest(data, 3) == (2, b"e")
    assert found.longest(data, 5) is None
    coder = piece_codec.PieceModel(MODEL)
    coder.map = found
    assert coder.normalize("abaéz") == ("▁Xyyez", [0, 0, 2, 2, 3, 5, 6])
    coder.squeeze = True
    assert coder.normalize("  ab  z ") == ("▁X▁z", [2, 2, 4, 6, 7])


def test_spans_against_the_library():
    """Byte spans of every piece of whole texts; a byte of a character has the character's span."""
    theirs, coder = library(), piece_codec.PieceModel(MODEL)
    texts = [r[1] or "" for r in odd_rows.rows()] + ["Ein Haus, größer als 12 €.", "two  spaces", " lead", "▁mark a", "日本語 テキスト 😀 x", "tail "]
    path = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(path):
        texts += [t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist()]
    compared = 0
    for text, (ids, spans) in zip(texts, coder.aligned(pa.array(texts, pa.string()))):
        assert ids[1:-1].tolist() == [i for i, *_ in coder.spans(text)]
        assert spans.tolist() == [[a, b] for *_, a, b in coder.spans(text)]
        pieces = theirs.encode(text, return_type="proto").pieces  # places in bytes
        assert len(pieces) == len(spans)
        for p, (a, b) in zip(pieces, spans.tolist()):
            if p.id not in coder.bytes_of:
                assert (p.begin, p.end) == (a, b)
                compared += 1
    assert compared > 100


def test_every_row(spark):
    docs = odd_rows.documents(spark)
    got = piece_codec.round_trips(docs, MODEL).collect()
    theirs, want = library(), []
    for row in odd_rows.rows():
        ids = theirs.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append((row[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(want, key=order)
    coder = piece_codec.PieceModel(MODEL)
    for r in got:
        if r.doc_id == 6:
            flat = [x for *_, a, b in coder.spans(odd_rows.rows()[5][1]) for x in (a, b)]
            assert r.spans_sha256 == hashlib.sha256(struct.pack(f"<{len(flat)}q", *flat)).hexdigest()
    assert piece_codec.piece_spans(docs.filter("doc_id = 6"), MODEL).first().pieces[0].start == 0
    assert piece_codec.round_trips(odd_rows.nothing(spark), MODEL).count() == 0
