import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, n long, size long, key string, fp long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "été", "x1", "you", "idiot", "!!", "#tag"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))), rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s3", None]), 5, 1, 2, 3, "k", 4) for i in range(60)]
    rows += [(60, None, None, None, None, None, None, None, None, None), (61, "", "en", "s1", 0, 1, 2, 3, "k", 4), (62, " \n\t ", "en", "s1", 4, 1, 2, 3, "k", 4)]
    rows += [(63, "long word " * 20_000, "en", "s2", 200_000, 1, 2, 3, "k", 4), rows[5], rows[5], (None, "no id here", "en", None, 10, 1, 2, 3, "k", 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS) if hasattr(T, "_parse_datatype_string") else DOCS)
