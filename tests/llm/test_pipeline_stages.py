import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_decontaminate import brute as contamination  # noqa: E402
from test_ngram_join import brute as similar, edited  # noqa: E402


def expected(docs, items):
    """The stages by hand, on (doc_id, text) without repeated or null ids."""
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    best = {}
    for doc_id, text in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[body] = min(best.get(body, (0, 0)), (-len(text), doc_id)) if body in best else (-len(text), doc_id)
    docs = [d for d in docs if (-len(d[1]), d[0]) in best.values()]
    stays = {d for d, _, component in similar(docs, 5, 80) if d == component}
    docs = [d for d in docs if d[0] in stays]
    bad = {d for d, *_, contaminated in contamination(docs, items) if contaminated}
    return [d for d in docs if d[0] not in bad]


def test_stages_follow_each_other_and_their_decisions_hold(spark, documents, prose, scratch):
    items = [(i, prose(900 + i, 30)) for i in range(4)]
    docs = [(i, prose(i, 40 + i)) for i in range(30)]
    docs += [(40 + i, t.replace(" ", "\n ")) for i, t in docs[:8]] + [(50 + i, edited(t, i, 1)) for i, t in docs[8:20]]
    docs += [(80 + i, prose(600 + i, 20) + items[i][1]) for i in range(4)] + [(90, None), (91, ""), (92, "12 34!"), (93, "\n")]
    documents([(*d, "ab") for d in docs]).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    frame = spark.read.parquet(f"{scratch}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, scratch)
        assert out.columns == frame.columns, name
        out.write.parquet(f"{scratch}/{name}")
        frame = spark.read.parquet(f"{scratch}/{name}")
    want = expected(docs, items)
    assert 0 < len(want) < 36
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == sorted(want)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, scratch).collect()) == sorted(d for d, _ in want)


def test_stage_order_and_empty_table(spark, documents, scratch):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "bpe"]
    documents([(1, "a")]).limit(0).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    assert corpus_pipeline.run(spark, scratch).collect() == []


@pytest.mark.parametrize("name", sorted(corpus_pipeline.STAGES and {"pipeline", *(f"op{n}_" for n in (1, 2, 4, 5, 6, 7, 8, 9, 10))}))
def test_registered(name):
    import __spark_entry__

    assert any(q.startswith(name) for q in __spark_entry__.queries())
