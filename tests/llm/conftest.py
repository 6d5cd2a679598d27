import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def long_text():
    """About a megabyte without repetition, with some of what each operator looks for."""
    return " ".join(f"word{i}" for i in range(100_000)) + " password: hunter2hunter2\n"


@pytest.fixture(scope="session")
def odd(spark, long_text):
    """Null, empty, blank, very long and repeated texts, a null id, and extra columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, long_text), (5, "one two three"), (5, "one two three"), (6, "One TWO three"), (None, "one two three"),
        (7, "token = abcdef123 " * 30 + "é𝄞 secret:'zzzzzzzz'"), (8, "token = abcdef123 " * 30 + "é𝄞 secret:'zzzzzzzz'"), (-3, "AKIA" + "A1" * 10 + " deadbeef" * 4 + " " + "0af3" * 8),
    ]
    names = "doc_id bigint, text string, id string, rules int, spans string, kept int, n_words string, __row int, check string, sample int, low int, component_id string, n_chars bigint, lang string, source string"
    fill = ("x", 1, "s", 2, "n", 3, "c", 4, 5, "k", 6, "en", "web")
    return spark.createDataFrame([(*r, *fill) for r in rows], names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, want):
        assert tuples(df) == sorted(want, key=repr)

    return check
