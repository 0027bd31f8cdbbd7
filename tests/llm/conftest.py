import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("digest", T.StringType()), T.StructField("size", T.LongType()), T.StructField("row", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("id", T.LongType())])


def rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(f"{words[i % 12]}{i % 97}x{i * i % 1013}" for i in range(6000))
    base = [f"w{i * 7 % 401}v{i}" for i in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    far = [f"q{i}" for i in range(30)] + base[30:]
    shared = " ".join(f"passage{i}" for i in range(12))
    texts = ["", None, "   \n\t", "one", "one two", "One TWO", " ".join(base), " ".join(base), " ".join(near), " ".join(far), long, long + " tail",
             shared + " begins here with words of its own", shared + " stands in quite another text", "1234 5678 !!", "Ünïcödé Straße 漢字 🎉",
             "the cat don't sit; it's <|endoftext|> here 3.14!", "x" * 5000]
    out = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "", "é"][k % 5], len(t or ""), "d", 3, "r", 0.5, 9) for k, t in enumerate(texts)]
    out += [(6, " ".join(base), "en", "b", 1, "d", 3, "r", 0.5, 9)] * 2  # repeated rows of one id and text
    out += [(4, "another text of an id that is there", "en", "a", 1, "d", 3, "r", 0.5, 9), (None, "one", "en", "a", 1, "d", 3, "r", 0.5, 9), (-5, "one", None, None, 1, None, None, None, None, None)]
    out += [(100 + k, "copy of a hot text, many times over and over again", "en", "hot", 1, "d", 3, "r", 0.5, 9) for k in range(80)]
    return out


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame(raw, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
