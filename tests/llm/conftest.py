import random

import pytest

#: Nulls, empty, wordless, short, very long, ties, repeated rows; extra columns that clash with the operators' own.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, score double, n string"


@pytest.fixture(scope="session")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(70), prose(200)
    edit = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    texts = [None, "", "  \n\t ", "one", "One", "a b c", "### 12 ...", base, base, edit(base, 3), edit(base, 190), prose(120) + " " + passage, passage + "\n" + prose(90)]
    texts += [f"{prose(60)}\n{passage} {prose(60)}", prose(30000), (prose(6) + "\n") * 40, "Licensed under CC BY-NC 4.0. All rights reserved.\n" + prose(60), "MIT License"]
    texts += [prose(rng.randint(1, 150)) for _ in range(25)]
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", "s3", None]), len(t or ""), 5, True, 0.5, "x") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[20]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
