"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file (token bytes and rank) is turned straight into a
sentencepiece BPE model: every token's bytes are written as printable characters,
one per byte, and scored by its negative rank, with identity normalisation.
Texts are cut into pre-tokens, each pre-token's bytes are mapped the same way and
encoded by that model; ids are the vocabulary's ranks.  Nothing is trained.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; whole texts are encoded, however long; equal
rows give equal rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the vocabulary's makers cut text before merging (published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for the piece no text can reach: every byte is in the vocabulary.
_UNKNOWN = "\U000f0000"
#: Distinct pre-tokens a worker remembers before it starts afresh.
CACHE = 500_000


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in printable}
    spare = 0x100
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return chars


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file of base64 lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _block(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece i + 1 is the token of rank i."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every single byte")
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    model = [piece(_UNKNOWN, 0.0, 2)]
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        model.append(piece("".join(chars[b] for b in token), -float(rank), 1))
    no = (1 << 64) - 1  # -1, as the format writes it
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, 0) + _number(41, no) + _number(42, no) + _number(43, no)
    trainer += _block(45, _UNKNOWN.encode())
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(model) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    """Encodes texts with a serialised model; remembers pre-tokens it has seen."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.table = {b: c for b, c in self.chars.items()}
        self.bytes = {c: b for b, c in self.chars.items()}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        if new:
            mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
            for w, ids in zip(new, self.sp.encode(mapped, out_type=int, num_threads=1)):
                known[w] = [i - 1 for i in ids]
        return [[i for w in words for i in known[w]] for words in cut]

    def decode(self, ids: list[int]) -> str:
        text = "".join(self.sp.id_to_piece(i + 1) for i in ids)
        return bytes(self.bytes[c] for c in text).decode()


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): every row's token ids; the model is built once and sent to the executors."""
    model = df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(vocabulary)))  # fixed: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(model.value)
            ids = encoder.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("id"), text).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(key), "ids")
