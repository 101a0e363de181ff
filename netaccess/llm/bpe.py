"""Byte-level BPE by tree reduction: halves are encoded on their own and joined at their boundary.

Byte strings under concatenation form a monoid; so do their encodings under ``TreeBPE.join``. A sequence
of tokens is the encoding of its bytes exactly if each adjacent pair of its tokens is the encoding of the
pair's bytes, so a join re-encodes a window around the boundary and widens it only until the pairs at
the window's two edges hold. Everything outside the window then provably stays.

Null texts are taken as empty: 0 tokens, hashes of the empty string. Empty tables give empty results,
repeated rows give repeated results, and columns other than the named two are ignored. A piece of n bytes
without a break takes time in the order of n log^2 n, whatever it holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from netaccess.llm.common import map_arrow

LEAF_BYTES = 12
#: windows beyond this many bytes are merged by a heap
SCAN_BYTES = 64
LEAF_IDS = 256
CACHE_WORDS = 400_000
ROWS_AT_ONCE = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pair_holds: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Repeatedly merge the adjacent pair of lowest rank, the leftmost of equal ones."""
        if len(piece) > SCAN_BYTES:
            return self.merged(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merged(self, piece: bytes) -> list[int]:
        """The same by a heap of ranked pairs over linked parts; a pair that is gone is skipped when it comes up."""
        n, rank = len(piece), self.ranks.get
        end_of, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = end_of[i]  # 0: the part at i has gone into an earlier one
            if not middle or middle >= n or end_of[middle] != end:
                continue
            end_of[i], end_of[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(piece[i : end_of[end]])) is not None:
                    heappush(heap, (r, i, end_of[end]))
            if i and (r := rank(piece[before[i] : end])) is not None:
                heappush(heap, (r, before[i], end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end_of[i]]])
            i = end_of[i]
        return ids

    def holds(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as just a, b."""
        known = self.pair_holds.get((a, b))
        if known is None:
            if len(self.pair_holds) > CACHE_WORDS:
                self.pair_holds.clear()
            known = self.pair_holds[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.leaf(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            left_done = i >= len(left) or self.holds(left[-i - 1], window[0])
            right_done = j >= len(right) or self.holds(window[-1], right[j])
            if left_done and right_done:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i = i if left_done else min(len(left), 2 * i)
            j = j if right_done else min(len(right), 2 * j)

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.piece(piece[:half]), self.piece(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of runs of ids, joined with their neighbours level by level up the tree."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[k : k + LEAF_IDS])) for k in range(0, len(ids), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class PackedPieces(dict):
    """Piece of text -> its ids as packed little-endian 32-bit integers; emptied when full."""

    def __init__(self, bpe: TreeBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        packed = np.array(self.bpe.piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """One tokenizer for each worker process, read where it is installed."""
    import regex

    return regex.compile(pattern).findall, PackedPieces(TreeBPE(read_ranks(path)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of (doc_id, text); ``with_ids`` adds the packed ids."""
    fields = [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if with_ids:
        fields.append(StructField("ids", BinaryType()))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        split, packed = encoder(ranks_path, pattern)
        bpe = packed.bpe
        for batch in batches:
            ids_of, texts = batch["doc_id"].to_pylist(), batch["text"]
            # a piece of a batch at a time, so that the ids of a whole batch are never held at once
            for k in range(0, len(ids_of), ROWS_AT_ONCE):
                out: dict[str, list] = {f.name: [] for f in fields}
                for doc_id, text in zip(ids_of[k : k + ROWS_AT_ONCE], texts[k : k + ROWS_AT_ONCE]):
                    ids = b"".join(map(packed.__getitem__, split(text.as_py() or "")))
                    out["doc_id"].append(doc_id)
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
                    if with_ids:
                        out["ids"].append(ids)
                yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, StructType(fields))
