import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: Nulls in every column, empty and very long texts, ties, repeated rows; extra columns named as the operators' own.
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, 1, "x", 3),
    (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, 1, "x", 3),
    (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 5, 1, "x", 3),
    (3, "", None, None, None, None, None, None),
    (4, None, None, None, None, None, None, None),
    (None, "One two three four five six seven eight nine ten eleven twelve.", None, "b", 1, 1, "y", 4),
    (None, None, None, None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG), 2, "z", 5),
    (8, " \t\n\r\x0b ", "en", "a", 6, 2, "z", 5),
    (9, "password = 'hunter2hunter2'\nthe same line of text stands here\nthe same line of text stands here\n▁ \U0001f600 　 end", "en", "a", 9, 2, "z", 5),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, token int")


@pytest.fixture(scope="session")
def odd_pages(odd_docs):
    html = F.concat(F.lit("<html><body><nav>menu</nav><article><p>"), "text", F.lit("</article>"))
    return odd_docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") < 8, "http://a.example/x").alias("url"), html.alias("html"), F.lit(1).alias("host"), F.lit("p").alias("path"))


@pytest.fixture(scope="session")
def odd_chats(spark):
    rows = [
        (1, 0, "user", "a", "e"), (1, 1, "assistant", "b", "e"),
        (2, 0, "user", "a", "e"), (2, 1, "assistant", "b", "e"), (2, 2, "user", "c", "e"), (2, 2, "user", "c", "f"),
        (3, 0, "user", "a", "e"), (3, 1, "assistant", "b", "e"), (3, 2, "user", "c", "e"),
        (4, 0, "user", "z", "e"), (4, None, None, None, None), (None, 0, "user", "q", "e"), (5, 0, None, None, None),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
