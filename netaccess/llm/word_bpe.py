"""BPE with word ends by tree concatenation.

A word's symbols are cut into halves, each half is encoded on its own, and the encodings are joined by encoding growing
windows around the joint anew until the window begins with the very token with which the left side had it and ends with
the one of the right side. As no merge then crosses either edge of the window, and a sequence of tokens is the encoding of
its symbols exactly if each adjacent pair of its tokens is the encoding of the pair's symbols, all outside stays.

Words of over ``LONG_SYMBOLS`` symbols, which no pattern splits, become rows of their own: Spark encodes their leaves in
parallel and joins neighbours level by level; each task holds two of them. Whatever the text, the time is near linear.

Null texts are taken as empty: 0 tokens, hashes of the empty string. Empty tables give empty results, repeated rows (of
equal ids too) give repeated results, there is nothing to tie, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from netaccess.llm.common import map_arrow
from netaccess.runtime import materialize

#: Symbols that one leaf of the tree holds inside a task, and those of a leaf that is a row.
LEAF_SYMBOLS, LONG_SYMBOLS = 48, 4_096
#: Symbols up to which the least merge is looked for by eye; beyond it waits in a heap.
SCAN_SYMBOLS = 24
CACHE_WORDS = 400_000
#: White space of the pattern's engine; in ``SETTLED`` code points every Unicode version classes and folds alike.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SETTLED = r"\x00-\u04ff\u1e00-\u1eff\u2000-\u205e\u20a0-\u20ac\u3000-\u3029\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e"
RESULT = [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


class MergeTable:
    """Merges of pairs of ids by rank, and the symbols that an id stands for."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.name = {i: t for t, i in vocab.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.spelled: dict[int, list[int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        # the printable stand-ins of the bytes, by the rule that every byte-level vocabulary follows
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.first = [vocab[stand_in[b]] for b in range(256)]
        self.last = [vocab[stand_in[b] + suffix] for b in range(256)]
        self.vocab, self.suffix = vocab, suffix

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        return [*map(self.first.__getitem__, data[:-1]), self.last[data[-1]]]

    def spell(self, token: int) -> list[int]:
        found = self.spelled.get(token)
        if found is None:
            name = self.name[token]
            ended = name.endswith(self.suffix) and name != self.suffix
            letters = list(name.removesuffix(self.suffix)) if ended else list(name)
            if ended:
                letters[-1] += self.suffix
            found = self.spelled[token] = [self.vocab[c] for c in letters]
        return found

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if len(ids) > SCAN_SYMBOLS:
            return self.merge_long(ids)
        ids = list(ids)
        while len(ids) > 1:
            best = at = None
            for i in range(len(ids) - 1):
                found = ranks.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of ranked pairs over a linked list."""
        ids, n, ranks = list(ids), len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, i, made, a, b = heapq.heappop(waiting)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((made, ids[k])):
                    heapq.heappush(waiting, (found[0], i, found[1], made, ids[k]))
            after[j] = -1
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], made))):
                heapq.heappush(waiting, (found[0], h, found[1], ids[h], made))
        return [x for x in ids if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides together from the encodings of each."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = self.merge([s for t in (*left[-i:], *right[:j]) for s in self.spell(t)])
            left_agrees = i >= len(left) or window[0] == left[-i]
            right_agrees = j >= len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i = i if left_agrees else min(len(left), 2 * i)
            j = j if right_agrees else min(len(right), 2 * j)

    def encode(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF_SYMBOLS:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.encode(symbols[:half]), self.encode(symbols[half:]))


class Words(dict):
    """Word -> (its ids as text, its tokens' names), each joined by blanks; emptied when full."""

    def __init__(self, table: MergeTable):
        self.table = table

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.table.encode(self.table.symbols(word))
        found = " ".join(map(str, ids)), self.table.text(ids)
        if len(word) <= 64:
            self[word] = found
        return found


class Tokenizer:
    """Added tokens, normalisation and words as the vocabulary file asks for them, and the merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        model = held["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.table.name |= {i: t for t, i in self.added.items()}
        self.table.text = lambda ids: " ".join(map(self.table.name.__getitem__, ids))
        split = next(p["pattern"]["Regex"] for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split.replace(r"[^\s", f"[^{BLANK}")).findall
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        self.split_rare = split_by_library(held["normalizer"], split)
        self.marks = re.compile("|".join(map(re.escape, self.added))).split if self.added else lambda text: [text]
        self.marked = re.compile("|".join(map(re.escape, self.added))).findall if self.added else lambda text: []
        self.words = Words(self.table)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, word or added token) in text order."""
        marks = self.marked(text)
        for k, part in enumerate(self.marks(text) if marks else [text]):
            if k:
                yield True, marks[k - 1]
            for word in self.split(part):
                yield False, word

    def split(self, part: str) -> list[str]:
        """Normalised words. Characters that newer versions of Unicode class anew are left to the library's own tables."""
        if not part.isascii() and self.unsettled(part):
            return self.split_rare(part)
        # one letter at a time: the casing of a sigma does not look at its neighbours here
        return self.find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())


def split_by_library(normalizer: dict, pattern: str):
    import tokenizers

    whole = tokenizers.Tokenizer(tokenizers.models.BPE())
    whole = tokenizers.Tokenizer.from_str(json.dumps(json.loads(whole.to_str()) | {"normalizer": normalizer}))
    cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
    return lambda part: [word for word, _ in cut.pre_tokenize_str(whole.normalizer.normalize_str(part))]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process, read where it is installed."""
    return Tokenizer(path)


def hexed(data: str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest()


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, long_symbols: int = LONG_SYMBOLS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of (doc_id, text); ``with_ids`` adds the packed ids.

    ``ids_sha256``: of the decimal ids joined by one blank; ``decoded_sha256``: of the decoded text. Words of over
    ``long_symbols`` symbols are encoded by Spark in leaves of as many.
    """
    fields = RESULT + [StructField("ids", BinaryType())] * with_ids
    # a row is a finished document, or (with a key) a leaf of a document that holds a long word
    held = [*fields, StructField("key", LongType()), StructField("part", IntegerType()), StructField("node", IntegerType()), StructField("nodes", IntegerType()), StructField("done", IntegerType()), StructField("leaf", BinaryType())]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tok, at = tokenizer(path), TaskContext.get().partitionId() << 40
        words, table = tok.words, tok.table
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in held}
            blank = dict.fromkeys(out)

            def put(**row) -> None:
                for name, value in (blank | row).items():  # noqa: B023
                    out[name].append(value)  # noqa: B023

            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text, marked = value.as_py() or "", False
                if any(t in text for t in tok.added):
                    pieces = list(tok.pieces(text))
                    marked = any(m for m, _ in pieces)
                    found = [(str(tok.added[w]), w) if m else words[w] if len(w) * 4 <= long_symbols or len(w.encode()) <= long_symbols else None for m, w in pieces]
                    names = [w for _, w in pieces]
                else:
                    names = tok.split(text)
                    longest = max(map(len, names), default=0)
                    found = [words[w] for w in names] if longest * 4 <= long_symbols else [words[w] if len(w.encode()) <= long_symbols else None for w in names]
                if None not in found:
                    ids = " ".join(i for i, _ in found)
                    row = {"doc_id": doc_id, "n_tokens": ids.count(" ") + 1 if ids else 0, "ids_sha256": hexed(ids), "decoded_sha256": hexed(" ".join(d for _, d in found))}
                    put(**row, **({"ids": packed([int(i) for i in ids.split()])} if with_ids else {}))
                    continue
                at += 1
                part, run_ids = 0, []
                for name, known in zip(names, found):
                    if known is not None:
                        run_ids += map(int, known[0].split())
                        continue
                    if run_ids:
                        put(doc_id=doc_id, key=at, part=part, node=0, nodes=1, done=1, leaf=packed(run_ids))
                        part, run_ids = part + 1, []
                    symbols = table.symbols(name)
                    cuts = range(0, len(symbols), long_symbols)
                    for node, k in enumerate(cuts):
                        put(doc_id=doc_id, key=at, part=part, node=node, nodes=len(cuts), done=0, leaf=packed(symbols[k : k + long_symbols]))
                    part += 1
                if run_ids:
                    put(doc_id=doc_id, key=at, part=part, node=0, nodes=1, done=1, leaf=packed(run_ids))
            yield out

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(map_arrow(narrow, run, StructType(held)), "word-bpe")
    whole = rows.filter("key IS NULL").select(*(f.name for f in fields))
    leaves = rows.filter("key IS NOT NULL").select("key", "doc_id", "part", "node", "nodes", "done", "leaf")
    deepest = leaves.agg(F.max("nodes").alias("n")).first()["n"]
    if deepest is None:
        return whole
    return whole.unionByName(put_together(joined_tree(leaves, path, deepest), path, fields, with_ids))


def joined_tree(leaves: DataFrame, path: str, deepest: int) -> DataFrame:
    """(key, doc_id, part, ids): leaves encoded each on its own, then neighbours joined level by level."""
    kept = [StructField("key", LongType()), StructField("doc_id", LongType()), StructField("part", IntegerType()), StructField("node", IntegerType()), StructField("ids", BinaryType())]

    def encoded(batches: Iterator[dict]) -> Iterator[dict]:
        table = tokenizer(path).table
        for b in batches:
            ids = [leaf if done else packed(table.encode(unpacked(leaf))) for done, leaf in zip(b["done"].to_pylist(), b["leaf"].to_pylist())]
            yield {"key": b["key"], "doc_id": b["doc_id"], "part": b["part"], "node": b["node"], "ids": ids}

    def joined(batches: Iterator[dict]) -> Iterator[dict]:
        table = tokenizer(path).table
        for b in batches:
            sides = [[unpacked(s["ids"]) for s in pair] for pair in b["sides"].to_pylist()]
            yield {"key": b["key"], "doc_id": b["doc_id"], "part": b["part"], "node": b["node"], "ids": [packed(table.join(*s) if len(s) == 2 else s[0]) for s in sides]}

    level = materialize(map_arrow(leaves.repartition("key", "part", "node"), encoded, StructType(kept)), "word-bpe-leaves")
    while deepest > 1:
        pairs = level.groupBy("key", "doc_id", "part", F.floor(F.col("node") / 2).cast("int").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "ids"))).alias("sides"))
        level = materialize(map_arrow(pairs, joined, StructType(kept)), "word-bpe-level")
        deepest = (deepest + 1) // 2
    return level


def put_together(parts: DataFrame, path: str, fields: list[StructField], with_ids: bool) -> DataFrame:
    """The digests of documents from the ids of their parts, each document as long as its text."""
    whole = parts.groupBy("key", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"]).alias("parts"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table = tokenizer(path).table
        for b in batches:
            ids = [unpacked(b"".join(p)) for p in b["parts"].to_pylist()]
            out = {"doc_id": b["doc_id"], "n_tokens": [len(i) for i in ids], "ids_sha256": [hexed(" ".join(map(str, i))) for i in ids], "decoded_sha256": [hexed(table.text(i)) for i in ids]}
            yield out | ({"ids": [packed(i) for i in ids]} if with_ids else {})

    return map_arrow(whole, run, StructType(fields))
