"""Problem 6: encoding with a public byte-level BPE vocabulary.

Forced-boundary splitting. Merges only ever produce vocabulary tokens, so a pair of neighbouring bytes
that stands inside no token is a certain cut: no merge crosses it. The text is cut at such pairs, the
fragments are encoded one by one (a fragment seen before costs one look-up) and the ids concatenated.

The vocabulary's own pre-splitting must give the same pieces for a fragment as for the whole text. That
holds for a cut whose left character is a printable ASCII character (so no look-ahead over blanks is
cut short), whose right side begins a character, and isn't an apostrophe (which could open a
contraction). Text without such a cut, for instance a long run of Chinese, is one fragment.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fragments that a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 400_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONGEST_REMEMBERED = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps a public vocabulary: LECTERN_TOKENIZERS, else the installed package."""
    if folder := os.environ.get("LECTERN_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class FragmentEncoder:
    """Encodes byte strings by forced-boundary splitting over a rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.whole = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = self._cut_table(ranks)
        self.known: dict[bytes, tuple[int, ...]] = {}

    @staticmethod
    def _cut_table(ranks: dict[bytes, int]) -> np.ndarray:
        """Of each pair of bytes, at index 256 * left + right, whether the text is cut between them."""
        inside = np.zeros(65536, dtype=bool)
        for token in ranks:
            codes = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[codes[:-1] * 256 + codes[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        allowed = (left > 0x20) & (left < 0x7F) & ((right < 0x80) | (right >= 0xC0)) & (right != ord("'"))
        return ~inside & allowed

    def _encode_new(self, fragment: bytes) -> tuple[int, ...]:
        ids = tuple(self.whole.encode_ordinary(fragment.decode("utf-8")))
        if len(fragment) <= _LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[fragment] = ids
        return ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, array]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        known, new = self.known.get, self._encode_new
        flat, offsets = array("i"), np.zeros(len(texts) + 1, dtype=np.int32)
        for i, text in enumerate(texts):
            if text:
                raw = text.encode("utf-8", "replace")
                codes = np.frombuffer(raw, dtype=np.uint8).astype(np.uint16)
                at = (np.flatnonzero(self.cut[(codes[:-1] << 8) | codes[1:]]) + 1).tolist()
                pieces = (raw[a:b] for a, b in zip(chain((0,), at), chain(at, (len(raw),))))
                flat.extend(chain.from_iterable(known(piece) or new(piece) for piece in pieces))
            offsets[i + 1] = len(flat)
        return offsets, flat


_encoders: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    """The worker's encoder for ``path``, made once."""
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path)
    return _encoders[path]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row (id_col, ids_col array<int>) for every row of ``documents``.

    An empty and a null text give an empty list, a repeated row its own row again, a null id stays null.
    Strings of special tokens are ordinary text. Other columns aren't read. Unpaired surrogates, which
    Spark strings cannot hold, would be encoded as "?".
    """
    path = path or vocabulary_path()
    source = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            offsets, flat = own.encode_batch(batch.column(1).to_pylist())
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return source.mapInArrow(run, f"key {key_type}, ids array<int>").select(F.col("key").alias(id_col), F.col("ids").alias(ids_col))


def count_tokens(rows: DataFrame, text_col: str = "text", count_col: str = "tokens", path: str | None = None) -> DataFrame:
    """``rows`` without ``text_col`` and with the number of its tokens; null and empty texts count 0."""
    path = path or vocabulary_path()
    kept = [c for c in rows.columns if c not in (text_col, count_col)]
    source = rows.select(*kept, text_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + f", `{count_col}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            offsets, _ = own.encode_batch(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.diff(offsets).astype(np.int32))], names=[*kept, count_col])

    return source.mapInArrow(run, schema)
