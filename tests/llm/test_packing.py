import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.llm import packing

PARTS = ["İ", "Σας ΟΔΟΣ", "é", "é", " ", "\n", "\x1c", "\x85", "\xa0", "ǅ", "don't", "WE'LL", "<|endoftext|>", "<|", "½", "²", "ª", "日本", "　", "x" * 30,
         "!!", "_", "ß", "ſ", "\x00", "5", "ŉ", "ΑΣ", "\t", "word", "The ", "̈́"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_library(library, monkeypatch):
    encoder, draw = packing.Encoder(packing.Vocabulary.word_bpe_49k()), random.Random(3)
    plain = packing.Encoder(packing.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    for chunk in (1 << 17, 20):
        monkeypatch.setattr(packing, "_CHUNK", chunk)
        for _ in range(1000):
            text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(40)))
            want = library(text)
            assert encoder.ids(text).tolist() == want and plain.ids(text).tolist() == want
    monkeypatch.setattr(packing, "WORDS_KEPT", 0)
    fresh = packing.Encoder(packing.Vocabulary.word_bpe_49k())
    assert fresh.ids("some words, some WORDS " * 9).tolist() == library("some words, some WORDS " * 9) and not fresh.words


def held_to_contract(pieces, rows, library, most):
    """Every id in one piece, sequences without gaps, none longer than ``most``, padding only where a length isn't a power of two."""
    want, got, sequences = Counter(), defaultdict(list), defaultdict(list)
    for doc_id, text in rows:
        want[(doc_id, tuple(library(text)))] += 1
    by_doc = defaultdict(list)
    for r in pieces:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    padding = 0
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        total = sum(n for _, n in held)
        assert total <= most
        padding += 0 if total & (total - 1) == 0 else most - total
    for (doc_id, total), held in by_doc.items():
        copies = [(d, ids) for (d, ids), n in want.items() for _ in range(n) if d == doc_id and len(ids) == total]
        # Pieces of rows that share an id and a length are told apart by their ids.
        assert sorted(start for start, _ in held)[0] == 0
        if len(copies) == 1:
            assert [i for _, ids in sorted(held) for i in ids] == list(copies[0][1])
        else:
            assert sum(len(ids) for _, ids in held) == sum(len(ids) for _, ids in copies)
        got[doc_id] += copies
    assert Counter((d, ids) for copies in got.values() for d, ids in copies) == want
    return padding, sequences


@pytest.mark.parametrize("most, tiers, shard", [(2048, 4, 1 << 21), (64, 3, 500), (64, 1, 300)])
def test_documents(documents, prose, edges, library, most, tiers, shard):
    rows = [(i, prose(i, 11 * i)) for i in range(40)] + [(90, prose(9, 30_000)), (91, prose(9, 4000)), (91, prose(9, 4000)), (92, "z" * 9000)] + edges
    packing_ = packing.packed(documents(rows), most=most, tiers=tiers, shard_tokens=shard, step_tokens=4 * most)
    padding, sequences = held_to_contract(packing_.collect(), rows, library, most)
    assert padding == 0
    digest = packing.pieces(packing_).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_id"} == set(digest[0].asDict())
    by_key = {(r.sequence_id, r.offset): zlib.crc32(r.ids) for r in packing_.collect()}
    assert all(by_key[(r.sequence_id, r.offset)] == r.ids_crc32 for r in digest)
    whole = packing.sequences(packing_, most=most).collect()
    assert len(whole) == len(sequences) and {len(r.ids) // 4 for r in whole} <= {1 << k for k in range(12)}


def test_tiers_and_gaps():
    draw = random.Random(8)
    sizes = [draw.choice([1, 2, 60, 200, 257, 513, 900, 1025, 2047, 2048, 5000]) for _ in range(3000)]
    windows = packing.packed_windows(sizes)
    totals = Counter(sum(n for *_, n in w) for w in windows)
    assert sum(k * v for k, v in totals.items()) == sum(sizes)
    assert all(k & (k - 1) == 0 for k in totals) and all(totals[k] <= 1 for k in totals if k < 256)
    # Long items stand alone with gaps filled by shorter ones, so few documents are cut.
    cut = Counter(doc for w in windows for doc, *_ in w)
    assert sum(1 for doc, n in cut.items() if n > 1 and sizes[doc] <= 2048) < 0.35 * len(sizes)


def test_steps_are_balanced():
    sizes = [2048] * 100 + [1024] * 77 + [512] * 9 + [256] * 41 + [64, 8]
    groups = packing.step_groups(sizes, 16 * 2048)
    held = Counter()
    for size, group in zip(sizes, groups):
        held[group] += size
    assert max(held.values()) - min(held.values()) <= 256
    for tier in (2048, 1024):
        per = Counter(g for s, g in zip(sizes, groups) if s == tier)
        assert max(per.values()) - min(per.values()) <= 2


def test_padding_where_a_length_is_no_power(spark):
    ids = array("I", [5, 6, 7]).tobytes()
    one = spark.createDataFrame([(1, 0, 3, 3, 0, 0, 3, 0, bytearray(ids))], "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long, ids binary")
    (row,) = packing.sequences(one, pad_id=9, most=8).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [5, 6, 7, 9, 9, 9, 9, 9]


def test_empty_table(documents):
    assert packing.packed(documents([(1, "a")]).limit(0)).collect() == []
