import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, blank and very long texts, ties, repeated rows, a null id, null groups.
ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4), (4, "one two three four five six seven eight nine ten eleven", "en", "a", 50),
    (4, "one two three four five six seven eight nine ten eleven", "en", "a", 50), (5, "one two three four five six seven eight nine ten eleven", "en", "a", 50), (None, "no id at all here", "en", "a", 17),
    (6, "word " * 30000, "en", "a", 150000), (7, "Ünïcode straße 　 wide \x1c odd é́", "de", "b", 20), (8, "a", "de", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    clash = ("fp", "shard", "slot", "length", "word", "score", "label", "host", "home", "root", "count", "row", "features", "u", "v", "_bucket", "bucket", "weight")
    return spark.createDataFrame(ODD, DOCS).select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
