import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, label string, fingerprint string, digest long"


def words(n, salt=""):
    return " ".join(f"w{salt}{k}" for k in range(n))


LONG = words(30_000, "x")
PASSAGE = words(40, "p")
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "word"),
    (7, "Two words"),
    (8, LONG),
    (9, f"before one {PASSAGE} after one"),
    (10, f"before two\n{PASSAGE}\nafter two"),
    (11, PASSAGE.upper()),
    (12, "a b a b a b a b a b a b a b a b a b a b a b a b a b a b"),
    (13, "é É ß ñ 漢字 😀 ÀB cD\x0bz\x0cy\x1cq\xa0r " + words(12, "u")),
    (14, "<|endoftext|> <|startoftext|> <s> \\0 \x00 $ % & | # * < >"),
    (15, "same line\nsame line\n\n\nsame line\nother"),
    (16, words(60, "r") + " " + words(60, "r")),
    (17, "w" * 5000),
    (None, "a row without an id but with a text of more than ten words in it"),
    (None, None),
    (18, "an id that comes twice " + words(25, "t")),
    (18, "an id that comes twice " + words(25, "t")),
    (18, "an id that comes three times with another text " + words(25, "t")),
]


def rows():
    return [(i, text, None if k % 3 else "en", None if k % 2 else "src0", None, k, 0.5, "x", "f", None) for k, (i, text) in enumerate(ROWS)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, and columns whose names the
    operators use themselves; over several partitions."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
