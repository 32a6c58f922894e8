import hashlib
from collections import defaultdict

from tempora.llm import exact_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups["".join(c for c in text or "" if c not in WHITE)].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for body, members in groups.items():
        best = min(members)
        for m in members:
            ids = [rows[x[3]][0] for x in (m, best)]
            out.append((ids[0], ids[1], len(members), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(documents, rows, **options):
    got = exact_dedup.duplicate_groups(documents(rows), **options).collect()
    want, groups = brute([(r[0], r[1]) for r in rows])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_equals_brute_force_over_several_levels_of_names(documents, prose, edges):
    texts = [prose(i, 5 + 40 * i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20 + i, t.replace(" ", "  \n")) for i, t in enumerate(texts)]                       # white space only
    rows += [(40 + i, t[:-2] + "#") for i, t in enumerate(texts)] + [(60 + i, "#" + t) for i, t in enumerate(texts)]
    rows += [(80, texts[3] * 2), (81, texts[3]), (82, "ab" * 16), (83, "ab" * 8), (84, "a" * 33)]
    check(documents, rows + edges, block_bytes=8)
    check(documents, rows + edges)


def test_ties_longest_original_then_least_id(documents):
    rows = [(7, "a b"), (3, "ab"), (5, "a b"), (9, "a  b"), (8, "a  b")]
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.duplicate_groups(documents(rows)).collect()}
    assert got == {7: (8, False, 5), 3: (8, False, 5), 5: (8, False, 5), 9: (8, False, 5), 8: (8, True, 5)}


def test_a_group_over_many_partitions(documents):
    frame = documents([(i, "same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(50)]).repartition(40)
    got = exact_dedup.duplicate_groups(frame).collect()
    assert len(got) == 550 and sum(r.kept for r in got) == 51
    assert {r.keep_id for r in got if r.group_size == 500} == {0}


def test_empty_table_and_stage(documents, edges):
    assert exact_dedup.duplicate_groups(documents([(1, "a")]).limit(0)).collect() == []
    frame = documents([(1, "x y"), (2, "xy"), (3, "z")])
    kept = exact_dedup.without_copies(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_blocks_that_many_texts_share(documents, monkeypatch):
    """A common first block, and a common pair of blocks, are named once; the groups are the same as without that way."""
    head = "".join(chr(97 + i % 26) for i in range(128))
    rows = [(i, head + f"{i % 40:064d}" * 2) for i in range(160)] + [(500 + i, "only" * 16) for i in range(30)]
    wanted = sorted(tuple(r) for r in exact_dedup.duplicate_groups(documents(rows), 64).collect())
    for few in (8192, 0):
        monkeypatch.setattr(exact_dedup, "FREQUENT", 20)
        monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", few)
        table = documents(rows).repartition(16)
        assert sorted(tuple(r) for r in exact_dedup.duplicate_groups(table, 64).collect()) == wanted
