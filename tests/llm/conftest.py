import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def odd_texts() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, repeated rows, words at the edges."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma,", "Delta", "épsilon", "zeta.", "eta###", "the", "of", "ñandú", "x1"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = text(300), text(60)
    near = base.replace(" the", " thx", 2)
    rows = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, "one two"), (8, "One  TWO\n"),
            (9, "a b c d e"), (10, "a b c d e f"), (11, text(90) + " " + passage + " " + text(80)), (12, passage + "\n" + text(100)),
            (13, ("ab " * 400)), (14, "é" * 500), (15, "日本語 " * 100), (16, text(20_000)), (17, "w1 w2 w3 w4 w5 w6 w7"),
            (18, "w1 w2 w3 w4 w5 w6 w8"), (None, text(70)), (None, passage), (21, "▁x  y \n z "), (22, "same line\nsame line\nother"),
            (23, "\x0b\x0c\x1c\x85 odd spaces"), (24, "You are not an idiot, he said. You idiot moron scum!")]
    rows += [(30 + i, near.replace("beta", f"b{i}", i % 3)) for i in range(40)]
    rows.append(rows[0])  # a repeated row
    rows.append((17, "another text of the same id " + text(60)))
    return [(i, t, None if i == 6 else "en", "src0" if i != 7 else None, None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_texts(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with extra columns named like the operators' own."""
    names = ["h", "c", "n", "w", "t", "g", "s", "length", "start", "ids", "cell", "salt", "place", "run", "root", "kept", "spans", "score",
             "token", "_id", "_ver", "_text", "_h", "_text_h", "_rank", "size", "key", "sketch"]
    out = odd_docs
    for n in names:
        out = out.selectExpr("*", f"'extra' as `{n}`")
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
