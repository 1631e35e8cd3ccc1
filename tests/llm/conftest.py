import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) rows: copies, near copies, repeats, junk, nulls, empty, very long and tied texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    base = texts[0] + "\n" + prose(90)
    for k in range(25):
        words = base.split(" ")
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[3]] * 6 + [None, "", "   \n", "one two", "one two", "A b C d", "a B c D", "a b c d e", "x " * 400, prose(6000), "!!! ???"]
    shared = prose(70)
    texts += [prose(20) + " " + shared + " " + prose(20) for _ in range(8)]
    return [(k, t, ("en", "de", None)[k % 3], None if k == 5 else f"src{0 if k % 3 else k % 5}") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
