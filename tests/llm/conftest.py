import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("_id", T.LongType())]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(WORDS[(k * k + k // 7) % len(WORDS)] + str(k % 97) for k in range(30_000))
    base = " ".join(WORDS[(3 * k) % 19] + str(k) for k in range(60))
    texts = ["", None, " \t\n ", "one", "ONE", "a b c", base, base, base.replace("40", "x"), base.upper(), long, long + " end", "line\nshared line\n\nlast", "other\nshared line", "shared line"]
    rows = [(k, t, "en", f"s{k % 4}", len(t or ""), "x", k) for k, t in enumerate(texts)]
    rows += [(20, base, None, None, None, None, None), (20, base, None, None, None, None, None), (None, base, "de", "s1", 1, "y", 2), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
