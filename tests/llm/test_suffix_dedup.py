import random
from collections import defaultdict

import pytest

from tempora.llm import suffix_dedup


def brute(rows, length):
    docs = sorted({(doc_id is None, doc_id or 0, text or "") for doc_id, text in rows})
    seen, out = {}, {}
    # Documents that share an id come by a hash of their text: tests give those no common strings.
    for doc in docs:
        raw = doc[2].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i:i + length], (doc, i)) != (doc, i):
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g))
    return sorted(((doc_id, *out[(doc_id is None, doc_id or 0, text or "")]) for doc_id, text in rows), key=str)


def check(frame, rows, length, **options):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicated(frame, length, **options).collect()]
    assert sorted(got, key=str) == brute(rows, length)


@pytest.fixture()
def rows(prose, edges):
    long = prose(1, 300)
    found = [(i, prose(i, 30)) for i in range(6)]
    found += [(10 + i, prose(50 + i, 10) + long[i * 20:i * 20 + 90 + 13 * i] + prose(70 + i, 10)) for i in range(12)]  # passages at many offsets
    found += [(30, long), (31, long), (32, "a" * 400), (33, "a" * 250), (34, "ab" * 150), (35, long + long), (36, "é" * 120), (37, "xé" * 90), (38, "\x00" * 150)]
    return found + edges


def test_equals_brute_force(documents, rows):
    check(documents(rows), rows, 100)
    check(documents(rows).repartition(7), rows, 40)


def test_hot_anchors_are_dealt_by_single_windows(documents, rows):
    check(documents(rows), rows, 60, hot=1)


def test_long_texts_come_in_pieces(documents, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 333)
    check(documents(rows), rows, 100)
    monkeypatch.setattr(suffix_dedup, "_TASK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "_KNOWN", 3)
    monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST", 0)
    check(documents(rows), rows, 100)


def test_earliest_is_by_number_not_by_partition(documents):
    text = "".join(random.Random(2).choices("abcdefgh ", k=300))
    rows = [(9, text), (3, text), (20, "z" + text), (11, text[50:])]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(documents(rows).repartition(4)).collect()}
    assert got == {3: 0, 9: 300, 20: 300, 11: 250}


def test_a_repeated_row_is_one_document(documents):
    text = "".join(random.Random(3).choices("abcdefgh ", k=300))
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.deduplicated(documents([(1, text), (1, text), (2, text)])).collect())
    assert got == [(1, 0), (1, 0), (2, 300)]


@pytest.mark.parametrize("alphabet,length", [("ab", 100), ("abcdef", 100), ("ab", 40)])
def test_interval_expansion_finds_all_equal_windows(alphabet, length):
    draw = random.Random(length)
    for _ in range(8):
        base = "".join(draw.choice(alphabet) for _ in range(400))
        texts = []
        for _ in range(12):
            at = draw.randrange(250)
            text = base[at:at + draw.randrange(50, 300)]
            if draw.random() < 0.6:
                i = draw.randrange(len(text))
                text = text[:i] + draw.choice(alphabet + "\x00é") + text[i + 1:]
            texts.append(("a" * draw.randrange(100, 250) if draw.random() < 0.2 else text).encode())
        places = defaultdict(list)
        for i, text in enumerate(texts):
            for s in range(len(text) - length + 1):
                places[text[s:s + length]].append((i, s))
        found = defaultdict(list)
        for i, s, group in zip(*(x.tolist() for x in suffix_dedup.equal_windows(texts, length))):
            found[group].append((i, s))
        assert sorted(map(sorted, found.values())) == sorted(sorted(p) for p in places.values() if len(p) > 1)


def test_segments_hold_every_window_once():
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"abc d") for _ in range(n)) for n in (0, 99, 100, 101, 500, 3000)] + [b"a" * 300]
    windows = defaultdict(int)
    for _, docs, starts, _, counts, _ in suffix_dedup.segments(texts, 100):
        for doc, start, count in zip(docs.tolist(), starts.tolist(), counts.tolist()):
            for s in range(start, start + count):
                windows[doc, s] += 1
    assert dict(windows) == {(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 99)}


def test_empty_table(documents):
    assert suffix_dedup.deduplicated(documents([(1, "a")]).limit(0)).collect() == []
