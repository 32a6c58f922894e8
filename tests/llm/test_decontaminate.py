import hashlib
import re
from collections import Counter

import pytest

from tempora.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    out = []
    for doc_id, text in docs:
        ws, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            width = min(n, len(iw))
            windows = {tuple(iw[i:i + width]) for i in range(len(iw) - width + 1)} if iw else set()
            for i in range(len(ws) - width + 1 if iw else 0):
                if tuple(ws[i:i + width]) in windows:
                    hit |= set(range(i, i + width))
                    ids.add(item_id)
        digest = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


@pytest.fixture()
def tables(spark, documents, prose, edges):
    items = [(i, prose(i, 12 + 4 * i)) for i in range(8)] + [(20, "one"), (21, "two words"), (22, "the the the the the the the the the the the the the the the the"), (23, ""), (24, None), (None, prose(3, 20)),
                                                             (25, prose(2, 20)), (25, prose(2, 20)), (25, "rare thing here")]
    texts = [it[1] or "" for it in items]
    docs = [(i, prose(200 + i, 80) + texts[i % 8].upper() + prose(300 + i, 20 * i)) for i in range(16)]
    docs += [(30, texts[5]), (31, " ".join(texts[5].split()[:9])), (32, " ".join(texts[6].split()[:13])), (33, "the " * 30), (34, texts[7].replace(" ", "--")), (35, "ONE"), (36, "two! words? one"),
             (37, prose(400, 3000) + texts[4] + prose(401, 50)), (38, "rare thing here, rare thing here"), (38, "other row of the same id one"), (39, texts[1] + " " + texts[1])] + edges
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, term long, at long")
    return docs, items, documents(docs), table


def rows_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()), key=str)


def test_equals_brute_force(tables):
    docs, items, frame, table = tables
    assert rows_of(decontaminate.contamination(frame, table)) == brute(docs, items)


def test_documents_that_begin_inside_an_item(spark, documents, prose):
    item = words(prose(7, 60))[:40]
    docs = [(1, " ".join(item[20:])), (2, " ".join(item[27:])), (3, " ".join(item[10:30]) + " " + prose(500, 60)), (4, " ".join(item[28:])), (5, " ".join(item[20:33]) + " x " + " ".join(item[3:18]))]
    table = spark.createDataFrame([(1, " ".join(item)), (2, prose(8, 30))], "item_id long, text string")
    got = rows_of(decontaminate.contamination(documents(docs), table))
    assert got == brute(docs, [(1, " ".join(item)), (2, prose(8, 30))])
    assert [n_hit for _, _, n_hit, *_ in got] == [20, 13, 20, 0, 28]


def test_by_shuffles_alone(tables, monkeypatch):
    docs, items, frame, table = tables
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert rows_of(decontaminate.contamination(frame.repartition(9), table, window_words=5)) == brute(docs, items, 5)


def test_empty_tables(tables):
    docs, _, frame, table = tables
    assert decontaminate.contamination(frame.limit(0), table).collect() == []
    assert rows_of(decontaminate.contamination(frame, table.limit(0))) == brute(docs, [])


def test_proximity(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents([(1, "gamma x x alpha x beta delta"), (2, "alpha " + "x " * 40 + "beta gamma delta"), (3, "alpha beta"), (4, "delta x gamma x alpha beta")])
    near = decontaminate.near_matches(decontaminate.indexed(docs, items), span=6)
    assert {r.doc_id for r in near.collect()} == {1, 4}
    assert {r.doc_id: r.n_near for r in decontaminate.contamination(docs, items, span=6).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_proximity_of_all_documents(tables):
    docs, items, frame, table = tables
    taken = [(d, words(t)) for d, t in docs]
    asked = {(i, tuple(words(t))) for i, t in items}
    often = Counter(w for _, ws in taken for w in ws)
    expected = []
    for doc_id, ws in taken:
        near = set()
        for item_id, iw in asked:
            rare = sorted({w for w in iw if often[w]}, key=lambda w: (often[w], w))[:3]
            if len(rare) == 3 and any(w == rare[0] and all(r in ws[max(0, p - 8):p + 9] for r in rare[1:]) for p, w in enumerate(ws)):
                near.add(item_id)
        expected.append((doc_id, len(near)))
    found = [(r.doc_id, r.n_near) for r in decontaminate.contamination(frame, table, span=8).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert any(n for _, n in expected)


def test_no_python_in_the_plans(tables, capsys):
    _, _, frame, table = tables
    decontaminate.contamination(frame, table).explain()
    decontaminate.postings(frame, decontaminate.item_words(table).selectExpr("word", "1L AS term"), 1).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_stage(tables):
    docs, items, frame, table = tables
    bad = {d for d, *_, contaminated in brute(docs, items) if contaminated}
    kept = decontaminate.without_contaminated(frame, table)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
