import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.llm import bpe

PARTS = ["a", "the ", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "'ll", "'", "!!", "<|endoftext|>", "<|", "x" * 50, " " * 90, "<|endoftext|>" * 2, "ß", "\x00"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_tree_equals_the_library(library):
    vocabulary, draw = bpe.Vocabulary.byte_bpe_50k(), random.Random(5)
    for _ in range(150):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(400)))
        pieces = [bpe.Piece.of(vocabulary, leaf) for leaf in bpe.leaves(text, draw.choice([7, 50, 200]))]
        whole = bpe.concatenated(vocabulary, [bpe.Piece.unpacked(vocabulary, *p.packed(vocabulary)) for p in pieces])
        assert whole.text == text
        assert whole.ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert list(whole.starts) == bpe.word_starts(vocabulary, text)


def test_words_that_never_end(library):
    vocabulary = bpe.Vocabulary.byte_bpe_50k()
    for text in ("ab" * 3000, " " * 5000, "é" * 999, "7" * 2000 + "a" * 2000, "<|endoftext|>" * 200):
        whole = bpe.concatenated(vocabulary, [bpe.Piece.of(vocabulary, leaf) for leaf in bpe.leaves(text, 100)])
        assert whole.ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(documents, prose, edges, library):
    rows = [(i, prose(i, 30 * i)) for i in range(8)] + [(50, prose(9, 4000)), (50, prose(9, 4000)), (51, "x" * 9000), (52, "<|endoftext|> in text")] + edges
    got = bpe.encoded(documents(rows), leaf_chars=500).collect()
    want = sorted(((doc_id, library.encode(text or "", add_special_tokens=False).ids, library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False))
                   for doc_id, text in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == want
    digests = bpe.digests(bpe.encoded(documents(rows), leaf_chars=500)).collect()
    assert sorted(r.n_tokens for r in digests) == sorted(len(w[1]) for w in want)


def test_empty_table(documents):
    assert bpe.encoded(documents([(1, "a")]).limit(0)).collect() == []


def test_tokens_of_two_parts_are_joined(library):
    """Words cut anywhere, of few letters and with characters of several bytes, are what the library makes of them whole."""
    vocabulary, draw = bpe.Vocabulary.byte_bpe_50k(), random.Random(2)
    coder = bpe._encoding(vocabulary)
    for _ in range(5000):
        word = "".join(draw.choices(draw.choice(["ab", "etaoin", "a", "éß日x", "inghert"]), k=draw.randrange(2, 100)))
        cut = draw.randrange(1, len(word))
        parts = (np.asarray(coder._encode_single_piece(p.encode()), np.int32) for p in (word[:cut], word[cut:]))
        assert bpe.joined_ids(vocabulary, *parts)[0].tolist() == coder._encode_single_piece(word.encode())


def test_two_megabytes_without_a_break(library, monkeypatch):
    vocabulary, draw, windows, join = bpe.Vocabulary.byte_bpe_50k(), random.Random(6), [], bpe.joined_ids

    def watched(*args):
        found = join(*args)
        windows.append(found[1])
        return found

    monkeypatch.setattr(bpe, "joined_ids", watched)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    whole = bpe.concatenated(vocabulary, [bpe.Piece.of(vocabulary, leaf) for leaf in bpe.leaves(text, bpe.LEAF_CHARS)])
    assert whole.ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(windows) == 63 and max(windows) <= 64
