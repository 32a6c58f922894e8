import random
import re
from itertools import combinations

import numpy as np
import pytest

from tempora.llm import ngram_join
from tempora.llm.components import components


def sets_of(rows, k):
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.setdefault(doc_id, []).append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    return out


def brute(rows, k, percent):
    sets = {d: s for d, s in sets_of(rows, k).items() if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, len(sets_of([(d, t)], k)[d][0]), None if d is None else find(d)) for d, t in rows), key=str)


def got(frame, k, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(frame, k, percent).collect()), key=str)


def edited(text, seed, edits):
    words, draw = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture()
def rows(prose, edges):
    found = [(i, prose(i, 10 + 7 * i)) for i in range(15)]
    found += [(30 + 3 * i + j, edited(t, j, j)) for i, (_, t) in enumerate(found[3:]) for j in range(3)]     # copies, near and less near
    found += [(200 + i, prose(99, 60) + " " + prose(300 + i, 60)) for i in range(12)]                         # a common passage
    found += [(300 + i, edited(prose(77, 150), i, 2 + i % 5)) for i in range(40)]                             # a hot group of near copies
    return found + [(400, "ONE two"), (401, "one TWO"), (402, "É x y"), (403, "é x y")] + edges


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_equals_brute_force(documents, rows, k, percent):
    assert got(documents(rows), k, percent) == brute(rows, k, percent)


def test_hot_groups_are_dealt_and_frequent_shingles_come_last(documents, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 500)
    assert got(documents(rows), 3, 90) == brute(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "PAIRS_A_MEMBER", 0)
    assert got(documents(rows), 3, 90) == brute(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "OPEN_PAIRS_A_MEMBER", 0)
    assert got(documents(rows), 3, 90) == brute(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "SLOTS", 1 << 6)
    assert got(documents(rows).repartition(9), 3, 90) == brute(rows, 3, 90)


def test_without_broadcasts(documents, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    assert got(documents(rows), 5, 80) == brute(rows, 5, 80)


def test_every_order_shares_a_prefix():
    draw = random.Random(1)
    by = ngram_join.Orders(80, (np.arange(64) < 20).astype(np.uint8) * 7)
    for _ in range(200):
        a = {draw.randrange(200) for _ in range(60)}
        b = set(a) - set(draw.sample(sorted(a), 4)) | {draw.randrange(200) for _ in range(4)}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if 100 * len(a & b) >= 80 * len(a | b):
            assert all(set(by.prefix(x, o)) & set(by.prefix(y, o)) for o in range(ngram_join.ORDERS))


def test_filters_of_all_orders_never_lose_a_link():
    draw = random.Random(2)
    for percent in (50, 80, 90, 100):
        by = ngram_join.Orders(percent, (np.arange(64) % 3).astype(np.uint8))
        for _ in range(300):
            a = {draw.randrange(300) for _ in range(draw.randrange(1, 80))}
            b = set(a)
            for _ in range(draw.randrange(12)):
                b.discard(draw.choice(sorted(b | {0})))
                b.add(draw.randrange(300))
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            if 100 * len(a & b) >= percent * len(a | b):
                assert by.passes(len(x), len(y), *by.views([[by.prefix(s, o) for o in range(ngram_join.ORDERS)] for s in (x, y)]))


def test_shingles_of_long_and_odd_words():
    texts = [None, "", " \n", "a", "a b", "a b c", "A\x0bB\tC", "x" * 500 + " y z", "x" * 499 + "q y z", "x" * 8 + " y z", "x" * 9 + " y z", "é\xa0b c d", "a b c a b c"]
    sets = ngram_join.shingle_sets(texts, 3)
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 3]
    assert sets[5].tolist() == sets[6].tolist() and len({s[0] for s in sets[3:12]}) == 8
    assert all(s.tolist() == ngram_join.shingle_sets([t], 3)[0].tolist() for s, t in zip(sets, texts))


def test_repeated_ids_are_one_document(documents):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"), (11, "q q q")]
    assert {r.doc_id: r.component_id for r in ngram_join.similar(documents(rows), 3, 90).collect()} == {1: 1, 5: 1, 9: 1, 11: 11}


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table_and_stage(documents, edges):
    assert ngram_join.similar(documents([(1, "a")]).limit(0), 3, 90).collect() == []
    frame = documents([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")] + [(None, "a b c d e f")])
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
