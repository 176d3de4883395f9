import random

import pytest

WORDS = "red green blue stone river cloud paper light seven Été straße 漢字 über the of and".split()


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(4)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(40))
    text = lambda n: "".join(word() + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))
    rows = [(i, text(rng.choice([1, 3, 8, 30, 120, 400]))) for i in range(40)]
    base = text(150)
    passage = text(70)
    for i in range(40, 60):
        words = base.split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(i, base) for i in range(60, 66)]
    rows += [(i, text(20) + passage + text(20)) for i in range(66, 72)]
    rows += [(72, passage + "x " + passage), (73, "ab" * 300), (74, "z" * 1000)]
    rows += [(75, None), (76, ""), (77, " \n\t"), (78, "one"), (79, "one"), (80, "ONE two"), (81, text(5000))]
    rows += [(82, text(60)), (82, text(60)), (5, rows[5][1])]  # a repeated id, a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with columns in use inside."""
    rows = [(i, t, f"s{(i or 0) % 3}", "en", i or 0, t, 1) for i, t in corpus]
    schema = "doc_id long, text string, source string, lang string, n_chars long, key string, size int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return docs.limit(0)
