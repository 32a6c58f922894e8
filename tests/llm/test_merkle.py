import hashlib
import zlib

from pyspark.sql import functions as F

from tempora.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def altered(row):
    doc_id, text = row[0], row[4]
    return (*row[:4], text.replace("\n", "") if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text)


def levels(hashes, arity):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(tree, i, arity):
    for level in tree[:-1]:
        start = i - i % arity
        yield level[start:i], level[i + 1:start + arity]
        i //= arity


def brute(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, by hand."""
    of = {}
    for row in rows:
        of.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(altered(row)), row[0]))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([m[2] for m in sorted(of[s])], arity) for s in names}
    top, out = levels([trees[s][-1][0] for s in names], arity), []
    for k, source in enumerate(names):
        for i, (*_, own, now, doc_id) in enumerate(sorted(of[source])):
            path = [*way(trees[source], i, arity), *way(top, k, arity)]
            folded = now
            for left, right in path:
                folded = h(*left, folded, *right)
            root = top[-1][0]
            out.append((doc_id, own, trees[source][-1][0], root, h(*(x for left, right in path for x in left + right)), folded, folded == root))
    return sorted(out, key=str)


def checked(spark, rows, **kwargs):
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    table = table.selectExpr("*", "'x' AS leaf", "1 AS number", "2 AS place", "'y' AS hash", "3 AS tree", "4 AS row", "'z' AS presented", "5 AS id")
    manifest = merkle.built(table, merkle.tampered(F.col("doc_id"), F.col("text")), **kwargs)
    got = merkle.proofs(manifest)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return manifest, sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(spread):
    """``spread``: rows a source; texts with and without line feeds, nulls, empty and long ones."""
    texts = ["a\nb", "plain", None, "", "é\n\n" * 3, "x" * 300_000 + "\n"]
    out, number = [], 0
    for source, n in spread.items():
        for _ in range(n):
            out.append((number, source, "en" if number % 3 else None, number % 5 or None, texts[number % len(texts) if number < 30 else number % 5]))
            number += 7
    return out


def test_sources_of_all_heights(spark):
    rows = rows_of({"hot": 95, None: 4, "": 1, "Z": 3, "a": 9, "é": 10, "b": 2})
    for stride in (1, 2):
        assert checked(spark, rows, stride=stride)[1] == brute(rows)
    assert checked(spark, rows, arity=2, stride=3)[1] == brute(rows, arity=2)


def test_one_block_and_one_source(spark):
    rows = rows_of({"only": 40})
    manifest, got = checked(spark, rows)
    assert got == brute(rows)
    assert manifest.sources.count() == 1 and manifest.root == got[0][2] == got[0][3]


def test_repeated_rows_and_ids(spark):
    rows = [(1, "s", None, 1, "a\n"), (1, "s", None, 1, "a\n"), (1, "s", None, 1, "b"), (None, "s", None, None, None), (None, "s", "x", 0, "\n"), (2, None, None, 1, "c")]
    assert checked(spark, rows)[1] == brute(rows)


def test_one_row_and_none(spark):
    row = [(5, "s", "en", 3, "a\nb")]
    (found,) = checked(spark, row)[1]
    assert [found] == brute(row) and found[1] == found[3] and found[4] == hashlib.sha256(b"").hexdigest()
    manifest, got = checked(spark, [])
    assert got == [] and manifest.root is None


def test_untouched_table_is_verified(spark):
    rows = rows_of({"a": 30, "b": 5})
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert {r.verified for r in merkle.proofs(merkle.built(table)).collect()} == {True}
