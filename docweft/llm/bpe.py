"""Problem 7: exact byte-pair encoding by longest matches, pair compatibility and backtracking.

A text is cut by the tokenizer's public pattern. Inside of a part, an Aho-Corasick automaton over the vocabulary
gives the longest token that starts at each byte. The encoder walks from left to right, taking the longest token
whose pair with the token before it is compatible (the merges of the two tokens' joined bytes give just these two
tokens); if none fits, it steps back and takes the next shorter token there. A byte position that failed once is
never visited again, so the work is linear in the part's length. Decoding gathers bytes through an offset table.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public pattern of the vocabulary (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts and token pairs kept in memory by one Python worker; results don't depend on it.
CACHE_PARTS, CACHE_PAIRS = 100_000, 400_000


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary: of folder ``DOCWEFT_TOKENIZERS``, else of the installed package or its folder."""
    folder = os.environ.get("DOCWEFT_TOKENIZERS")
    if not folder and (spec := importlib.util.find_spec("public_tokenizers")):
        folder = os.path.dirname(spec.origin)
    return os.path.join(folder or "/opt/tokenizers", name)


class BytePairCodec:
    """Encoder and decoder of one vocabulary of ranked byte strings."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(PATTERN).findall
        self.token = {rank: token for token, rank in self.rank.items()}
        self.length = {rank: len(token) for rank, token in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        # the longest proper prefix of each token that is itself a token
        self.shorter = {}
        for token, rank in self.rank.items():
            cut = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), 0)
            self.shorter[rank] = self.rank[token[:cut]] if cut else -1
        size = max(self.token) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            lengths[rank] = len(token)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.token.get(rank, b"") for rank in range(size)), np.uint8)
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank until no pair is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def part(self, data: bytes) -> list[int]:
        """Ids of one part of the pattern."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [-1] * size
        best = [0] * size
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > best[start]:
                best[start], longest[start] = length, rank
        failed = bytearray(size + 1)
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while candidate >= 0:
                end = at + self.length[candidate]
                if not failed[end] and (last < 0 or self.fits(last, candidate)):
                    break
                candidate = self.shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < size else -1
            else:  # nothing fits here: the token before was too long
                failed[at] = 1
                out.pop()
                at -= self.length[last]
                candidate = self.shorter[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.part(piece.encode("utf-8", "surrogatepass"))
                if len(known) >= CACHE_PARTS:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = got
            ids.extend(got)
        return ids

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.blob[np.arange(int(size.sum())) + shift].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    return BytePairCodec(path)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``df``, in no order; a narrow plan without any exchange.

    Null and empty texts give the empty list, repeated rows give repeated results, an empty table an empty one;
    other columns, also one named ``ids``, are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # bounds the memory that one result batch needs
                rows = batch.slice(k, 512)
                offsets, values = np.zeros(rows.num_rows + 1, np.int32), []
                for i, value in enumerate(rows.column(1)):
                    values.append(np.array(encode(value.as_py()), np.int32))
                    offsets[i + 1] = offsets[i] + len(values[-1])
                flat = np.concatenate(values) if values else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens BIGINT) of every row; null and empty texts have 0 tokens."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            counts = pa.array([len(encode(value.as_py())) for value in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=[key, *keep, "n_tokens"])

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (key, *keep)] + [T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(text).alias("text"), key, *keep).mapInArrow(run, schema)
