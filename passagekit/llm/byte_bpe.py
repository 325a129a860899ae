"""Byte-level BPE through sentencepiece: a BPE model serialised straight from a rank file.

Each byte is mapped to one printable character, each rank to a piece scored by its negative rank; normalisation is the
identity, and white space is not escaped.  Pre-tokens are encoded one by one; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import clean, documents, map_batches, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE = 400_000  # pre-tokens kept by a worker
_SENT: dict[str, str] = {}  # what ship() has sent, by name


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece number is the rank; one more piece stands for the unknown."""
    chars = byte_characters()
    pieces = sorted((rank, "".join(chars[b] for b in piece)) for piece, rank in ranks.items())
    if [rank for rank, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0 .. n-1")
    unknown = len(pieces)
    body = [_field(1, _field(1, text.encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, text in pieces]
    body.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown)  # model_type BPE, vocab_size, unk_id
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos, pad
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))  # no dummy prefix, trimming, escapes
    return b"".join(body) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(ranks))
        chars = byte_characters()
        self.table = {b: c for b, c in enumerate(chars)}
        # decoding: piece -> bytes, by the inverse of the character map
        inverse = {c: b for b, c in enumerate(chars)}
        raw = [bytes(inverse[c] for c in self.model.IdToPiece(i)) for i in range(len(ranks))]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.cache: dict[str, list[int]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        todo = []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[word] = [rank]
            else:
                todo.append((word, raw.decode("latin-1").translate(self.table)))
        for (word, _), ids in zip(todo, self.model.Encode([x for _, x in todo], num_threads=1), strict=True):
            self.cache[word] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.find(text) for text in texts]
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.cache)
        if len(self.cache) + len(new) > CACHE:
            new = set().union(*split)
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        return [np.array([i for ids in map(get, words) for i in ids], np.uint32) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        total = np.cumsum(n)
        return self.flat[np.arange(total[-1] if len(n) else 0) + np.repeat(self.at[ids] - (total - n), n)].tobytes()


@lru_cache(maxsize=2)
def _loaded(name: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(SparkFiles.get(name)), pattern)


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file (a fixed few MB) to all executors; its name for SparkFiles.get().

    A name that was sent already from another place is refused: executors would read the other file.
    """
    name = path.rsplit("/", 1)[-1]
    sent = [str(x) for x in spark.sparkContext.listFiles if str(x).endswith("/" + name)]
    if not sent:
        _SENT[name] = path
        spark.sparkContext.addFile(path)
    elif _SENT.get(name, path) != path:
        raise ValueError(f"a file {name} was sent from {_SENT[name]} before")
    return name


def encode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> token count, and digests of the ids and of the decoded bytes.

    Null and empty texts have no tokens and the digests of nothing.  Texts of any length are encoded whole; repeated
    rows give repeated results, null ids stay null; an empty table gives an empty result.
    """
    name = ship(df.sparkSession, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name, pattern)
        for part in slices(batch, limit=4 << 20):
            ids = bpe.encode(part.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(df, run, SCHEMA)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir).select(*clean()), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
