"""Operators on tokens: pieces of marked words, alignment of two tokenizers."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import plain
from truthloom.llm import align, chunktable, pieces, registry
from truthloom.llm.pieces import PieceTokenizer, encode_pieces, piece_digest

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [*"abc  \n\t,.'0123▁é中👍\xa0　 \x85\x00\r", "the", "ing", " wor", "<s>", "</s>", "<0x41>", "<unk>", "   ", "́", "�", "'s", "<|endoftext|>"]


def odd_texts(count, seed=1):
    draw = random.Random(seed)
    made = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(count)]
    return [*made, "", " ", "  ", "▁", " ▁", "x" * 9000, "中" * 3000, " " * 5000, "0123456789abcdef" * 600]


def library(text):
    inner = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [1, *inner.encode(text or ""), 2]
    return ids, inner.decode(ids)


@pytest.mark.parametrize("long, remembered", [(4096, 200_000), (2, 50)])
def test_ids_and_texts_are_the_library_s(monkeypatch, long, remembered):
    monkeypatch.setattr(pieces, "LONG", long)
    monkeypatch.setattr(chunktable, "REMEMBERED", remembered)
    monkeypatch.setattr(chunktable, "STRETCH", 3000)
    own = PieceTokenizer(PIECES)
    texts = odd_texts(3000)
    for _ in range(2):  # the second time from the table
        found = own.ids(pa.array([*texts, None]))
        for text, ids in zip([*texts, None], found):
            assert ids.tolist() == own.inner.encode(text or "")
            assert own.text(np.array([1, *ids.tolist(), 2])) == own.inner.decode([1, *ids.tolist(), 2])
    for ids in ([], [1, 2], [0], [300, 0, 5], [200, 201, 13], [28705], [28705, 28705]):  # ids of no text too
        assert own.text(np.array(ids, np.int64)) == own.inner.decode(ids)


def test_pieces_of_edge_rows(spark):
    texts = plain.edge_texts() + odd_texts(60)
    docs = plain.frame(spark, texts)
    found = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digest(docs, PIECES).collect()]
    want = []
    for doc, text in [(r.doc_id, r.text) for r in docs.collect()]:
        ids, shown = library(text)
        want.append((doc, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(shown.encode()).hexdigest()))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert piece_digest(docs.limit(0), PIECES).collect() == []
    bare = encode_pieces(docs.where("doc_id = 0"), PIECES, begin=False, end=False).collect()
    assert [(r.n_tokens, r.decoded) for r in bare] == [(0, "")]


def test_pieces_of_the_whole_table(spark):
    inner = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op13_pieces(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = [1, *inner.encode(row.text or ""), 2]
        assert found[row.doc_id] == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                     sha256(inner.decode(ids).encode()).hexdigest())


# --- alignment ---

BYTES = public_tokenizers.path("byte_bpe_50k.json")
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def encoders():
    inner = Tokenizer.from_file(BYTES)
    inner.encode_special_tokens = True
    letters = align.byte_letters()
    names = {i: bytes(letters[c] for c in name) for name, i in inner.get_vocab(with_added_tokens=False).items()}
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        name = own.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if own.is_byte(i) else name.replace("▁", " ").encode()

    return (lambda t: [(i, names[i]) for i in inner.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, piece(i)) for i in own.encode(t)])


def aligned(docs):
    return sorted(((r.doc_id, tuple(r[c] for c in FIGURES)) for r in align.alignment_digest(docs, BYTES, PIECES).collect()), key=str)


def expected(docs):
    rows = docs.select("doc_id", "text").collect()
    return sorted(zip([r.doc_id for r in rows], plain.alignment([r.text for r in rows], *encoders())), key=str)


@pytest.mark.parametrize("piece, fan_in, slice_bytes", [(8 << 20, 64, 4 << 20), (300, 2, 2000)], ids=["one", "many"])
def test_alignment_of_edge_rows(spark, monkeypatch, piece, fan_in, slice_bytes):
    """Radixes in one piece, and in many that are merged two at a time."""
    for name, value in (("PIECE_BYTES", piece), ("FAN_IN", fan_in), ("SLICE_BYTES", slice_bytes)):
        monkeypatch.setattr(align, name, value)
    texts = [t for t in plain.edge_texts() if t is None or len(t) < 20_000] + odd_texts(150)[:-1] + plain.random_texts(40) + ["the same text, again"] * 30
    docs = plain.frame(spark, texts)
    assert aligned(docs) == expected(docs)
    assert aligned(docs.limit(0)) == []
    with_groups = align.align_tokens(docs.where("doc_id = 3"), BYTES, PIECES, with_groups=True).collect()
    assert {sha256(r.groups.encode()).hexdigest() for r in with_groups} == {r.groups_sha256 for r in with_groups}


def test_parts_are_encoded_alike_alone_and_together():
    both, (encode_a, encode_b) = align.Aligner(BYTES, PIECES), encoders()
    texts = [t for t in odd_texts(4000, seed=8)[:-3] if t and "▁" not in t]
    data, offsets = align.text_bytes(align.spaced(pa.array(texts)))
    starts = align.borders(data, offsets)
    ends = np.append(starts, len(data))[1:]
    first = np.searchsorted(starts, offsets)
    parts = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    ids_a = [e.ids for e in both.a.encode_batch([p.decode() for p in parts], add_special_tokens=False)]
    ids_b = both.b.segment(parts)
    for i, text in enumerate(texts):
        own = range(first[i], first[i + 1])
        assert [t for p in own for t in ids_a[p]] == [t for t, _ in encode_a(text)]
        assert [t for p in own for t in ids_b[p]] == [t for t, _ in encode_b(text)]


def test_heap_merge_adds_equal_pairs_in_order():
    draw = np.random.default_rng(4)
    heads, want = [], {}
    for _ in range(9):
        pairs = np.unique(draw.integers(0, 40, 60) << 16 | draw.integers(0, 5, 60)).astype("<u4")
        counts = draw.integers(1, 9, len(pairs))
        heads.append((pairs, counts))
        for p, c in zip(pairs.tolist(), counts.tolist()):
            want[p] = want.get(p, 0) + c
    found = list(align.merge_heads(heads))
    assert all(len(set((p >> 16).tolist())) == 1 for p, _ in found)  # one A id at a time
    assert [(p, c) for own, n in found for p, c in zip(own.tolist(), n.tolist())] == sorted(want.items())
    columns = align.unblock(align.block(*heads[0]), "<u4", "<i8")
    assert all((a == b).all() for a, b in zip(columns, heads[0]))


def test_alignment_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = sorted(((r.doc_id, tuple(r[c] for c in FIGURES)) for r in registry.op11_alignment(spark, SMALL).collect()), key=str)
    assert found == expected(docs)
