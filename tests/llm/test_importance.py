import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tempora.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest_run):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, longest_run + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, percent, least, seed, longest_run, buckets):
    """(doc_id, n_features, weight, score, rank) of every row, feature by feature."""
    s, t = [0] * buckets, [0] * buckets
    found = []
    for doc_id, text in docs:
        of, words = features(text, longest_run)
        where = [zlib.crc32(f.encode()) % buckets for f in of]
        found.append((doc_id, where, words))
        for b in where:
            s[b] += 1
    for text in target:
        for f in features(text, longest_run)[0]:
            t[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + float(buckets)) / ((s[b] + 1.0) * (sum(t) + float(buckets))))) for b in range(buckets)]
    rows = []
    for doc_id, where, words in found:
        weight = sum(gain[b] for b in where) // len(where) if where else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(where), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, row in enumerate(able[:len(able) * percent // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest_run, buckets, percent, least", [(1, 10_000, 10, 20), (1, 70, 40, 1), (3, 500, 50, 5)])
def test_equals_brute_force(spark, documents, prose, edges, longest_run, buckets, percent, least):
    rows = [(i, prose(i, 7 * i + 1)) for i in range(60)] + [(70, "The the THE " * 3000), (71, "x" * 50_000), (72, "é-é_É " * 30)] + edges
    target = [prose(900 + i, 40) for i in range(5)] + [None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resampled(documents(rows), table, percent, least, 7, longest_run, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, percent, least, 7, longest_run, buckets)


def test_pieces_of_a_long_text(monkeypatch, prose):
    text = prose(3, 4000)
    whole = importance.feature_counts(text, 3, 997)
    monkeypatch.setattr(importance, "CHUNK", 50)
    pieces = importance.feature_counts(text, 3, 997)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))
    assert whole[1].sum() == len(features(text, 3)[0]) and whole[2] == features(text, 3)[1]


def test_planes_add_up():
    draw = np.random.default_rng(5)
    for most in (1, 3, 1000, 2 ** 31):
        counts, gain = draw.integers(0, most + 1, (20, 131)), draw.integers(-14_000, 14_001, 131)
        digits = importance._digits(counts.max())
        amounts = [importance.planes(np.maximum(a, 0)[None], importance._digits(np.maximum(a, 0).max()))[0] for a in (gain, -gain)]
        assert importance.sliced_sums(importance.planes(counts, digits), *amounts).tolist() == (counts @ gain).tolist()


def test_target_words_are_preferred(spark, documents):
    draw = random.Random(4)
    near, far = "alpha beta gamma delta".split(), "omega sigma kappa lambda".split()
    rows = [(i, " ".join(draw.choices(near if i % 2 else far, k=30))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(near * 50),)], "text string")
    drawn = [r.doc_id for r in importance.resampled(documents(rows), target, percent=25).collect() if r["rank"]]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 75


def test_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "text string")
    assert importance.resampled(documents([(1, "a")]).limit(0), nothing).collect() == []
    rows = [(i, f"word{i} " * 30) for i in range(20)]
    got = importance.resampled(documents(rows), nothing, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
