import pytest

from plotweave.llm.queries import prepared

#: What documents may look like: nulls in any column, empty and blank texts, repeats, signs outside the basic plane.
ODD = [
    (1, "one two three four five six seven eight nine ten\nalpha beta", "en", "a", 10),
    (1, "one two three four five six seven eight nine ten\nalpha beta", "en", "a", 10),
    (2, None, None, None, None),
    (None, "text without an id but with some words to count here", "en", None, 5),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (5, "x", "de", "b", 1),
    (6, "𝒳 mail me: a.b@c.d.e, 𝒳𝒳 +1 (375) 555-4393 and 10.0.0.1, 4111 1111 1111 1111\n" * 3, "en", "b", 1),
    (7, "wide " * 30000, "en", "a", 1),
]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Odd rows, with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return llm.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("extra") for c in (
        "_text", "_lines", "score", "size", "kept", "hits", "spans", "node", "component", "a", "b", "id", "n", "_id", "text_hash", "target")})


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(llm, sf):
    return llm.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
