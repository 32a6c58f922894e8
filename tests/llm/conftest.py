import random

import pytest

VOCABULARY = "the of and tion anth ere ould ing her wha séa ñan über straße 日本 don't x1 42 mail".split()


@pytest.fixture()
def prose():
    """prose(seed, words): invented words, upper and lower case, with line breaks."""

    def make(seed: int, words: int) -> str:
        draw = random.Random(seed)
        out = []
        for _ in range(words):
            word = "".join(draw.choice(VOCABULARY) for _ in range(draw.choice((1, 1, 2, 3))))
            out.append(word.title() if draw.random() < 0.1 else word)
            out.append("\n" if draw.random() < 0.05 else "\t " if draw.random() < 0.02 else " ")
        return "".join(out)

    return make


@pytest.fixture()
def documents(spark):
    """documents(rows of (doc_id, text[, lang])): a table with further columns whose names clash with those of operators."""

    def make(rows):
        rows = [(*row, "xx")[:3] for row in rows]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return frame.selectExpr("doc_id", "text", "lang", "'s' AS source", "1L AS n", "2L AS rep", "3L AS bucket", "4L AS name", "5L AS entry",
                                "6L AS key", "7L AS item", "8L AS stays", "9L AS n_shingles", "10L AS component_id", "11L AS doc_hash", "12L AS row")

    return make


#: Null, empty, blank, one word, a repeated row, a repeated id with another text, a null id.
EDGES = [(100, None), (101, ""), (102, " \n\t "), (103, "word"), (104, "two words"), (104, "two words"), (105, "one text"), (105, "another text here"),
         (None, "a row without an id"), (None, None)]


@pytest.fixture()
def edges():
    return list(EDGES)
