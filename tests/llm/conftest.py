import os

import pytest
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="session")
def library(vocabulary):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null and repeated ids, repeated rows, long words, columns of clashing names."""
    words = " ".join(f"w{n} harbour{n % 7}" for n in range(300))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, words), (5, words), (6, words + " tail"), (None, words), (None, None),
        (7, "x" * 30_000), (8, "Été 한글 \U0001f389 naïve"), (9, "a b c d\na b c d\n" * 40), (9, "different text of the same id"),
    ]
    return spark.createDataFrame([(i, t, "x", 0, 1, None) for i, t in rows], "doc_id long, text string, rid string, n int, node int, digest string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
