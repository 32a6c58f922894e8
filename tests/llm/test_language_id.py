import random
import zlib
from collections import Counter

import pytest

from tempora.llm import language_id

SYLLABLES = {"aa": "ka lo mi nu te ra".split(), "bb": "sch ung ein keit ver bü".split(), "cc": "ción ña oso rr qué ía".split()}


def text_of(lang, seed, words=30):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(words)) + ". 42!"


def brute_profiles(rows, size):
    """The method by hand: counts in Counters, ranks in dicts."""
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    return {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:size])} for lang, c in counts.items()}


def number(gram):
    total = 0
    for c in gram:
        total = total << 21 | ord(c)
    return total


def grams(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        found.update(word)
        found.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return found


def brute(text, profiles, size):
    own = [g for g, _ in sorted(grams(text or "").items(), key=lambda x: (-x[1], number(x[0])))[:size]]
    if not own or not profiles:
        return "und", 0.0
    away = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (size * len(own))


@pytest.fixture()
def rows(edges):
    found = [(i, text_of(lang, i), lang) for i in range(60) for lang in [("aa", "bb", "cc")[i % 3]]]
    return found + [(*e, None) for e in edges] + [(200, "ka lo", None), (201, None, "aa"), (202, "!?. 123", "aa"), (203, "Ünïcode ß ﬁ İ", "bb"), (203, "Ünïcode ß ﬁ İ", "bb")]


def test_equals_the_method_by_hand(documents, rows):
    frame = documents(rows)
    learn = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    profiles = brute_profiles(learn, language_id.PROFILE)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identified(frame).collect()), key=str)
    want = sorted(((doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0, lang, round(score, 9))
                   for doc_id, text, _ in rows for lang, score in [brute(text, profiles, language_id.PROFILE)]), key=str)
    assert got == want


def test_held_out_accuracy(documents, rows):
    truth = {r[0]: r[2] for r in rows[:60]}
    got = [r for r in language_id.identified(documents(rows)).collect() if r.doc_id in truth and r.held_out]
    assert got and all(r.lang_pred == truth[r.doc_id] for r in got)


def test_small_profiles_ties_and_many_partitions(documents, rows):
    frame = documents(rows).repartition(30)
    profiles = language_id.trained(frame, size=5)
    want = brute_profiles(rows, 5)
    assert {lang: {int(g): int(r) for g, r in zip(profiles.grams, profiles.ranks[:, i]) if r >= 0} for i, lang in enumerate(profiles.languages)} \
        == {lang: {number(g): r for g, r in p.items()} for lang, p in want.items()}


def test_nothing_to_learn_and_empty_table(documents):
    frame = documents([(1, "some text", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in language_id.identified(frame).collect()} == {("und", 0.0)}
    assert language_id.identified(frame.limit(0)).collect() == []


def test_rejected_documents_go_with_all_columns_kept(documents, rows):
    frame = documents(rows)
    kept = language_id.recognised(frame, language_id.trained(frame))
    assert kept.columns == frame.columns
    assert sorted((r.text for r in kept.collect())) == sorted(t for _, t, _ in rows if t and any(c.isalpha() for c in t))


def test_without_profiles_documents_with_a_letter_stay(documents, rows):
    frame = documents([(doc_id, text, None) for doc_id, text, _ in rows])
    profiles = language_id.trained(frame)
    assert profiles.languages == []
    kept = language_id.recognised(frame, profiles)
    assert sorted((r.text for r in kept.collect())) == sorted(t for _, t, _ in rows if t and any(c.isalpha() for c in t))
