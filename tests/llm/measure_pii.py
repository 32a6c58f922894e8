"""Recall and false alarms of the field on hidden documents: ``python tests/llm/measure_pii.py SF_DIR`` prints one line a case.

The field is trained on documents whose crc32(doc_id) mod 5 is not 0.  In the others the patterns' telephone numbers are the known ones:

* ``marks``: each number loses its ``+``, so that no pattern knows it; recall is the share of the numbers that a span of the field meets;
* ``repeats``: each number stands again without its ``+`` behind the text; recall is the share of these;
* ``bare``: it stands again as bare digits, in one token (the skip links tie tokens, so a number of several tokens has no link to it);
* ``as_is``: spans that the field adds to unchanged texts (false alarms, but for data that the patterns miss).
"""

import re
import sys
import zlib

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tempora.llm import pii  # noqa: E402


def hidden(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def cases(doc_id: int, text: str) -> list[tuple[str, int, str, list[tuple[int, int]]]]:
    """(case, doc_id, text, places to find)."""
    phones = [(s, e) for k, s, e in pii.base_spans(text) if k == 3]
    out = [("as_is", doc_id, text, [])]
    if phones:
        stripped, places, at = "", [], 0
        for s, e in phones:
            stripped += text[at:s]
            places.append((len(stripped), len(stripped) + e - s - 1))
            stripped, at = stripped + text[s + 1:e], e
        out.append(("marks", doc_id, stripped + text[at:], places))
        for case, again in (("repeats", lambda n: n[1:]), ("bare", lambda n: re.sub("[^0-9]", "", n))):
            longer, places = text + "\nand once more", []
            for s, e in phones:
                number = again(text[s:e])
                places.append((len(longer) + 1, len(longer) + 1 + len(number)))
                longer += " " + number
            out.append((case, doc_id, longer + " as said", places))
    return out


def measured(docs) -> dict[str, tuple[int, int, int, int]]:
    """case: documents, places, places found, other added spans."""
    from pyspark.sql import functions as F
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    field = pii.trained(docs.where(left != 0))
    rows = docs.where((left == 0) & F.col("text").isNotNull()).select("doc_id", "text").collect()
    made = [c for r in rows for c in cases(r.doc_id, r.text)]
    frame = docs.sparkSession.createDataFrame([(i, c[2]) for i, c in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.found(frame, field).collect()}
    out = {}
    for i, (case, _, text, places) in enumerate(made):
        base = set(filter(None, pii.written(pii.base_spans(text)).split(",")))
        added = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s and s not in base]
        met = [p for p in places if any(s < p[1] and e > p[0] for s, e in added)]
        others = [a for a in added if not any(a[0] < e and a[1] > s for s, e in places)]
        n = out.get(case, (0, 0, 0, 0))
        out[case] = (n[0] + 1, n[1] + len(places), n[2] + len(met), n[3] + len(others))
    return out


if __name__ == "__main__":
    from tempora.session import local_session

    spark = local_session(8, 8)
    for case, (docs, places, met, others) in measured(spark.read.parquet(f"{sys.argv[1]}/documents.parquet")).items():
        print(f"{case}: {docs} documents, {met} of {places} known numbers found, {others} other spans added", flush=True)
