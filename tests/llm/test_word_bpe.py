"""BPE with word ends against the installed library, on odd characters, added tokens, long words and awkward rows."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from netaccess.llm.word_bpe import encode_documents, tokenizer, unpacked

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Library.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def own(text):
    t = tokenizer(PATH)
    return [i for m, w in t.pieces(text) for i in ([t.added[w]] if m else t.table.encode(t.table.symbols(w)))]


def test_every_character_as_the_library(library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} A{chr(c)}́ '{chr(c)}s" for c in (*range(1, 0x3400), *range(0x4DF0, 0x5000), *range(0x9F00, 0xAC10), *range(0xF900, 0x11000), *range(0x1F000, 0x1FB00))]
    assert [own(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_mixtures_and_added_tokens(library):
    r = random.Random(3)
    parts = ["the", "THE", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'s", "'S", " ", "\n", "\x1c", "=", "ß", "İ", "Σ", "é", "漢", "😀", "1", "23"]
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own(text) == ids
        assert tokenizer(PATH).table.text(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("run", ["=" * 9_000, "a" * 12_001, "ab" * 6_000, "aab" * 4_001, "漢字" * 3_000, "z" * 49])
def test_runs(library, run):
    assert own(run) == library.encode(run, add_special_tokens=False).ids


def test_joins_of_any_two_parts_equal_the_whole():
    r, table = random.Random(5), tokenizer(PATH).table
    for _ in range(3_000):
        word = "".join(r.choice("aehinrst-=") for _ in range(r.randint(2, 90)))
        symbols = table.symbols(word)
        cut = r.randrange(1, len(symbols))
        assert table.join(table.merge(symbols[:cut]), table.merge(symbols[cut:])) == table.merge_long(symbols) == table.merge(symbols)


def test_documents_with_words_in_rows_of_their_own(spark, docs, texts, library):
    long = [(500, "x" * 5_000 + " and " + "yz" * 3_000 + "<|endoftext|> the end"), (501, "-" * 4_097), (502, "漢" * 4_000), (500, "x" * 5_000), (None, "hello <|startoftext|>"), (503, "x" * 9_000 + "!")]
    rows = texts + long
    df = docs.select("doc_id", "text", "token").union(spark.createDataFrame([(i, t, "") for i, t in long], "doc_id long, text string, token string"))
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((str(i), len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)), ids))
    for limit in (1_000, 4_096):
        got = encode_documents(df, PATH, with_ids=True, long_symbols=limit).collect()
        assert sorted((str(r[0]), r[1], r[2], r[3], unpacked(r[4])) for r in got) == sorted(wanted)


def test_empty_table(spark, no_docs):
    assert encode_documents(no_docs, PATH).collect() == []
