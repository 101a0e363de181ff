"""Long pieces without a break: equal to the library, in little time, and decoding up the tree."""

import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from netaccess.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("unit,times", [("=", 10_000), ("a", 20_000), ("ab", 20_000), ("汉字", 10_000), ("\0", 30_000), ("🙂", 5_000), ("-=", 10_000)])
def test_runs_equal_the_library(library, unit, times):
    text, tree = unit * times, bpe.TreeBPE(RANKS)
    began = time.time()
    ids = [i for piece in bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[0](text) for i in tree.piece(piece.encode())]
    assert time.time() - began < 5
    assert ids == library.encode_ordinary(text) and tree.decode(ids) == text.encode()


def test_heap_merges_as_the_scan_does():
    r, tree = random.Random(3), bpe.TreeBPE(RANKS)
    for _ in range(2_000):
        piece = bytes(r.choice(b"aaab=e thn\xe6\xb1") for _ in range(r.randint(1, bpe.SCAN_BYTES)))
        assert tree.merged(piece) == tree.leaf(piece)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1_000])
def test_decoding_up_the_tree(n):
    r, tree = random.Random(n), bpe.TreeBPE(RANKS)
    ids = [r.randrange(len(RANKS)) for _ in range(n)]
    assert tree.decode(ids) == b"".join(tree.bytes_of[i] for i in ids)
