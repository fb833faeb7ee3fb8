import pytest

from feedloom.llm.shipping import ship

WORDS = "the red fox of a quiet hill ran by and on to an old mill near that long low wall".split()


def prose(n: int, salt: int = 0) -> str:
    """Words without repeated windows."""
    return " ".join(f"{WORDS[(i * 7 + salt) % len(WORDS)]}{(i * i + salt) % 97}" for i in range(n))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and blank texts, repeated rows, ties, copies, a very long text."""
    passage = prose(60, 5)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "Two  words"),
        (6, "Two words"),
        (7, "two words"),
        (8, prose(80, 1)),
        (9, prose(80, 1)),
        (9, prose(80, 1)),
        (10, passage + " " + prose(20, 2)),
        (11, prose(30, 3) + " " + passage),
        (12, passage + " tail"),
        (None, prose(80, 1)),
        (None, None),
        (None, "only here é 日本 " + passage),
        (13, "É accents à la crème, 日本語 👍 naïve"),
        (14, " leading and trailing "),
        (15, prose(3000, 9)),
        (16, "a " * 5000),
        (17, prose(55, 4) + "\n" + prose(55, 4)),
        (-3, prose(80, 1)),
    ]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The awkward rows with further columns whose names operators use inside."""
    rows = [(i, t, None, "x", 0, k, "b", 1.0) for k, (i, t) in enumerate(awkward)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, bucket string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
