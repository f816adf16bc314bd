"""Problem 8: the corpus as ids of a public byte-level vocabulary, and back.

Method: a SentencePiece BPE model is serialised directly from the vocabulary (rank file): every piece is
the token's bytes written in the usual printable byte alphabet, its score is the negative rank, the normaliser
is the identity. Text is split by the vocabulary's pattern into pre-tokens; a text's distinct
pre-tokens are encoded and put together; decoding maps pieces back to bytes. Piece number and rank are the same, the unknown
piece takes the first free id after them and never occurs, as all 256 bytes are pieces.

Each Python worker builds the model once and keeps the ids of frequent pre-tokens in a bounded memory; batches
stream through Arrow, and no row waits for another.

Defined results: null and empty texts give an empty list of ids; strings that look like special tokens are ordinary
text; blank texts are tokenised like any other; very long texts are encoded whole; lone surrogates cannot occur in stored strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before merges, as published with the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMORY = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The rank file's place among the installed public vocabularies."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must be 0, 1, 2 ..."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without holes")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes, an integer, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A SentencePiece model (BPE, identity normaliser) with the tokens as pieces in rank order."""
    alphabet = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteEncoder:
    """Texts to ids and back, for one worker."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.unknown = len(tokens)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.split = regex.compile(PATTERN).findall
        alphabet = byte_alphabet()
        self.letters = {b: alphabet[b] for b in range(256)}
        self.back = {ord(c): b for b, c in enumerate(alphabet)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, parts: Iterable[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > _MEMORY:
            self.known.clear()
            new = list(dict.fromkeys(parts))
        ids = self.model.encode([p.encode().decode("latin-1").translate(self.letters) for p in new], num_threads=1)
        self.known.update(zip(new, ids))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.split(text)
        self._learn(dict.fromkeys(parts))
        known, out = self.known, []
        for p in parts:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.back[ord(c)] for c in letters).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def encode_column(text: Column, path: str | None = None) -> Column:
    """array<int> of ids."""
    path = path or vocabulary_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([coder.encode(t) for t in texts.to_pylist()], type=pa.list_(pa.int32()))

    return ids(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of ids; null for null."""
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([None if x is None else coder.decode(x) for x in lists.to_pylist()], type=pa.string())

    return texts(ids)


def count_column(text: Column, path: str | None = None) -> Column:
    """The number of ids of each text: only the number leaves the worker."""
    path = path or vocabulary_path()

    @F.arrow_udf("int")
    def sizes(texts: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([len(coder.encode(t)) for t in texts.to_pylist()], type=pa.int32())

    return sizes(text)


def encode_documents(df: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """id_column and ids of every row; other columns are not read."""
    return df.select(F.col(id_column), encode_column(F.col(text_column), path).alias("ids"))


def iterate(texts: Iterator[str], path: str | None = None) -> Iterator[list[int]]:
    """Outside Spark."""
    coder = encoder(path or vocabulary_path())
    yield from map(coder.encode, texts)
