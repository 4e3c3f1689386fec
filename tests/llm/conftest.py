import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def corpus():
    """Texts with every hard case: null, empty, long, ties, repeats, other scripts."""
    rng = random.Random(4)
    some = ["the", "of", "and", "Straße", "naïve", "one", "two", "alpha", "beta", "Gamma", "delta.", "10", "x,", "你好", "ΣΑΣ"]
    texts = [None, "", " \n\t ", "a", "A", "a b c", "A b C", "x" * 5000, "the end " * 3000]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts += texts[9:20] + [t.upper() for t in texts[12:18] if t.isascii()]
    texts += ["mail ann@example.org or +1 (303) 555-0199 now", "card 4111 1111 1111 1111 at 10.0.0.255 not 1.2.3.256"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "own text"), (7, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use themselves."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("l").alias("lang"), F.lit(1).alias("row"), F.lit(2).alias("fp"),
                     F.lit("k").alias("kept"), F.lit(3).alias("__row"), F.lit(4).alias("shard"), F.lit("d").alias("digest")).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
