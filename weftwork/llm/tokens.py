"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it again.

The ``tokenizers`` library runs over Arrow batches inside the executors. The tokenizer's file (1.5 MB, a fixed size)
is read on the driver and broadcast, so the executors need no copy of their own.

Defined results: a null text and an empty text give an empty list of ids; strings that look like special tokens are
ordinary text; every other column of the input is ignored, so a clashing name can't matter; repeated rows stay
repeated; texts are encoded whole, whatever their length; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = os.environ.get("WEFTWORK_TOKENIZERS", "/opt/tokenizers")
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Texts are handed to the library in slices of at most this many rows and about this many characters.
SLICE_ROWS, SLICE_CHARS = 512, 2_000_000

_LOADED: dict[str, "ByteBpe"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE vocabularies write for each byte, reversed.

    Printable Latin-1 bytes stand for themselves; the others get the code points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE tokenizer with its byte table."""

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        parsed = json.loads(definition)
        special = {x["id"]: x["content"].encode() for x in parsed.get("added_tokens", [])}
        alphabet = byte_alphabet()
        vocabulary = parsed["model"]["vocab"]
        self.pieces: list[bytes | None] = [None] * (max([*vocabulary.values(), *special]) + 1)
        for written, k in vocabulary.items():
            self.pieces[k] = special.get(k) or bytes(alphabet[c] for c in written)
        for k, content in special.items():
            self.pieces[k] = content
        self.widths = np.array([len(p or b"") for p in self.pieces], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of each token; tokens that share a split character both hold it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        ends = np.cumsum(self.widths[np.asarray(ids, dtype=np.int64)]) if ids else np.zeros(0, dtype=np.int64)
        starts = ends - (self.widths[np.asarray(ids, dtype=np.int64)] if ids else 0)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(raw):
            return starts, ends
        return character[starts], character[ends - 1] + 1

    def to_bytes(self, ids: list[int]) -> bytes:
        bad = "\N{REPLACEMENT CHARACTER}".encode()
        return b"".join((self.pieces[k] if 0 <= k < len(self.pieces) else None) or bad for k in ids)

    def decode(self, ids: list[int]) -> str:
        return self.to_bytes(ids).decode("utf-8", errors="replace")

    def decode_pieces(self, ids: list[int]) -> list[str]:
        """The text that each token completes: a character split over several tokens comes with the last of them."""
        reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
        out = [reader.decode(self.to_bytes([k])) for k in ids]
        if out:
            out[-1] += reader.decode(b"", True)
        return out


def load(definition: bytes) -> ByteBpe:
    """The tokenizer of a definition, made once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task: the cores belong to Spark
    key = hashlib.sha256(definition).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(definition)
    return _LOADED[key]


def read_definition(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or DEFAULT_FOLDER, name), "rb") as f:
        return f.read()


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts, bounded in rows and characters, with the place of the first."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if k + 1 - begin >= SLICE_ROWS or held >= SLICE_CHARS:
            yield begin, [t or "" for t in texts[begin : k + 1]]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, [t or "" for t in texts[begin:]]


def int_lists(rows: list, kind: pa.DataType = pa.int32()) -> pa.Array:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if ends[-1] else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def encode(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None, spans: bool = False) -> DataFrame:
    """(key, ids), one row for each row of ``df``; with ``spans`` also starts and ends, in characters.

    A narrow transformation: one scan of two columns, no shuffle.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    definition = df.sparkSession.sparkContext.broadcast(read_definition(tokenizer, folder))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        bpe = load(definition.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, part in slices(texts):
                ids = bpe.encode(part)
                columns = [keys.slice(begin, len(part)), int_lists(ids)]
                if spans:
                    found = [bpe.spans(t, i) for t, i in zip(part, ids)]
                    columns += [int_lists([s for s, _ in found]), int_lists([e for _, e in found])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "ids", *(["starts", "ends"] if spans else [])]
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if spans else ""))


def count(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts have none."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    definition = df.sparkSession.sparkContext.broadcast(read_definition(tokenizer, folder))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        bpe = load(definition.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, part in slices(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(part)), pa.array([len(i) for i in bpe.encode(part)], pa.int64())], [key, "n_tokens"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, text) of each row. Null ids give a null text; an id outside the vocabulary gives U+FFFD."""
    source = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    definition = df.sparkSession.sparkContext.broadcast(read_definition(tokenizer, folder))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        bpe = load(definition.value)
        for batch in batches:
            texts = [None if i is None else bpe.decode([-1 if k is None else k for k in i]) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return source.mapInArrow(run, f"`{key}` {kind}, text string")
