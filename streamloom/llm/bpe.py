"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are split by the pattern: at a space after a letter or digit, where no
match can go on (only the start of a match may be a space, and no lookahead of the pattern reaches back).
A single match of very many bytes, on which the library's merge loop is quadratic, is merged here with a
heap instead, in the same order: least rank first, leftmost on ties.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, table

#: Characters after which the next safe boundary is taken.
PIECE = 50_000
#: Bytes of one match from which the heap is used.
LONG = 4_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match, in time n log n."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder for a rank file. The library splits and merges; see the module for long texts."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.run = regex.compile(rf"[\p{{L}}]{{{LONG // 4},}}|[\p{{N}}]{{{LONG // 4},}}|\s{{{LONG // 4},}}|[^\s\p{{L}}\p{{N}}]{{{LONG // 4},}}")

    def _piece(self, text: str) -> list[int]:
        if len(text) < LONG // 4 or not self.run.search(text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pattern.findall(text):
            b = m.encode()
            ids += merge_long(b, self.ranks) if len(b) >= LONG else self.encoding.encode_ordinary(m)
        return ids

    def encode(self, text: str) -> list[int]:
        n = len(text)
        if n <= PIECE:
            return self._piece(text)
        ids: list[int] = []
        start = 0
        while start < n:
            stop = start + PIECE
            while 0 < (stop := text.find(" ", stop)) and not text[stop - 1].isalnum():
                stop += 1
            stop = stop if stop > 0 else n
            ids += self._piece(text[start:stop])
            start = stop
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _coder(path: str, pattern: str, full: bool):
    def code(batches):
        codec = Codec(path, pattern)
        names = {i: str(i) for i in codec.bytes}
        for batch in pieces(batches):
            n, digest, back, every = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids))
                if full:
                    every.append(np.array(ids, np.int32))
                digest.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names_ = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns.append(pa.array(every, pa.list_(pa.int32())))
                names_.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names_)

    return code


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of docs.

    ids are those of the whole text without special tokens; decoded_sha256 is of the bytes that they
    decode to. A null text is empty: no ids. The rank file must be at ``path`` on every executor.
    Repeated rows are encoded each; other columns aren't read.
    """
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return arrow_map(docs, _coder(path, pattern, ids), schema)


def decode(ids: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """ids with the column ``decoded`` (binary) in place of the ids; null ids give null bytes."""
    rest = [c for c in ids.columns if c != ids_col]

    def back(batches):
        table_ = {i: b for b, i in read_ranks(path).items()}
        for batch in pieces(batches):
            raw = [None if x is None else b"".join(map(table_.__getitem__, x)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(raw, pa.binary())], [*rest, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema if f.name != ids_col)
    return arrow_map(ids, back, f"{schema}, decoded binary" if rest else "decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
