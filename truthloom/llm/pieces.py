"""SentencePiece encoding and decoding through a table of distinct marked words (operator 13).

Where no piece of the vocabulary holds a whitespace marker after another character, no merge can
cross the border between a character and the marker that follows it.  So a text is its marked words,
each a run of markers and the characters up to the next one: each distinct marked word is segmented
once in a task, and the ids are joined back by position.  A marked word of more than LONG bytes, such as
a text without spaces, is cut once more between characters that no piece holds next to each other.

Null texts count as empty: only the begin and end ids.  U+2581 in a text is a marker like any other,
as in the library, and decodes to a space.  Ties and repeated rows are encoded each; extra columns are ignored; an empty
table gives an empty result.  A text's bytes and ids are held as a whole, everything else for a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.chunktable import ChunkTable, Flat, stretches
from truthloom.llm.words import chunks, ranges, text_bytes

MARK = "▁"
#: Bytes of a marked word above which it is cut at every border that no piece crosses.
LONG = 4096
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def marked_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the marked words: each text's first byte, and every space after another byte."""
    border = data == 32
    border[1:] &= data[:-1] != 32
    border[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(border)


def with_prefix(texts: pa.Array) -> pa.Array:
    """Texts as the model sees them, spaces for markers: one before each text that is not empty."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
    return pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string()))


class PieceTokenizer:
    """Ids of texts through ids of their distinct marked words, and texts of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.inner = SentencePieceProcessor(model_file=path)
        names = [self.inner.id_to_piece(i) for i in range(self.inner.get_piece_size())]
        plain = [n for i, n in enumerate(names) if not (self.inner.is_control(i) or self.inner.is_byte(i) or self.inner.is_unknown(i))]
        if any(MARK in name.lstrip(MARK) or "\n" in name or " " in name for name in plain):
            raise ValueError("pieces of this model cross whitespace markers; it is not supported")
        if len(self.inner.encode("\n")) != 2 or self.inner.decode(self.inner.encode(" \n ")) != " \n ":
            raise ValueError("this model changes white space before it encodes; it is not supported")
        self.bos, self.eos, self.unknown = self.inner.bos_id(), self.inner.eos_id(), self.inner.unk_id()
        self.surface = Flat(np.uint8)
        shown = [self._bytes(i, name) for i, name in enumerate(names)]
        self.surface.add(np.frombuffer(b"".join(shown), np.uint8), np.array([len(b) for b in shown]))
        # joined[x, y]: some piece holds byte y after byte x; bytes inside one character stay together
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for name in plain:
            held = np.frombuffer(name.replace(MARK, " ").encode(), np.uint8)
            self.joined[held[:-1], held[1:]] = True
        self.ids_of = Flat(np.uint32)
        self.table = ChunkTable(self._learn, self.ids_of.clear)

    def _bytes(self, i: int, name: str) -> bytes:
        if self.inner.is_control(i) or self.inner.is_unknown(i):
            return b""
        return bytes([int(name[3:5], 16)]) if self.inner.is_byte(i) else name.replace(MARK, " ").encode()

    def segment(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of parts as they stand: a line break before each keeps the model's own prefix apart."""
        cut = [self._cut(part) if len(part) > LONG else [part] for part in parts]
        flat = self.inner.encode(["\n" + piece.decode() for pieces in cut for piece in pieces], num_threads=1)
        found, at = [], 0
        for pieces in cut:
            found.append([i for ids in flat[at : at + len(pieces)] for i in ids[2:]])
            at += len(pieces)
        return found

    def _cut(self, part: bytes) -> list[bytes]:
        held = np.frombuffer(part, np.uint8)
        at = [0, *(np.flatnonzero(~self.joined[held[:-1], held[1:]]) + 1).tolist(), len(part)]
        return [part[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, parts: list[bytes]) -> None:
        found = self.segment(parts)
        self.ids_of.add(np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found]))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text, without begin and end."""
        data, offsets = text_bytes(with_prefix(texts))
        starts = marked_words(data, offsets)
        ends = np.append(starts, len(data))[1:]
        first = np.searchsorted(starts, offsets)
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in stretches(ends):
            rows = self.table.lookup(data, starts[lo:hi], ends[lo:hi])
            flat.append(self.ids_of.take(rows))
            sizes.append(self.ids_of.sizes(rows))
        stops = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[first]
        whole = np.concatenate(flat)
        return [whole[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def text(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it; ids that no text has go to the library itself."""
        if (ids == self.unknown).any():
            return self.inner.decode(ids.tolist())
        sizes = self.surface.sizes(ids)
        shown = [self.surface.take(ids[lo:hi]).tobytes() for lo, hi in stretches(np.cumsum(sizes))]
        try:
            return b"".join(shown).removeprefix(b" ").decode()
        except UnicodeDecodeError:
            return self.inner.decode(ids.tolist())


@lru_cache(maxsize=1)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def encode_pieces(docs: DataFrame, model: str, begin: bool = True, end: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the ids as little-endian 32-bit integers, their number, and the text decoded from them."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(model)
        around = [words.bos] if begin else [], [words.eos] if end else []
        for batch in batches:
            for part in chunks(batch):
                own = [np.concatenate([around[0], ids, around[1]]).astype("<u4") for ids in words.ids(part.column("text"))]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(ids) for ids in own], pa.int64()),
                    pa.array([ids.tobytes() for ids in own], pa.binary()), pa.array([words.text(ids) for ids in own], pa.string()),
                ], ["doc_id", "n_tokens", "ids", "decoded"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, ENCODED)


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encode_pieces(docs, model).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )
