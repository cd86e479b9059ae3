import pytest

EXTRA = "row long, key string, band int, n int, part string, shard int, slot int, score double, ids string, text_hash int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(start, count):
    return " ".join(f"w{i}" for i in range(start, start + count))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    base = words(0, 120)
    near = base.replace("w60 ", "other ", 1)
    long = words(5000, 30_000)
    rows = [
        (1, base, "en", "a", 1), (2, base, None, "b", None), (3, near, "en", None, 3), (4, None, "de", "a", 0),
        (5, "", "fr", "b", 0), (6, " \t\n ", "es", None, 4), (7, long, "en", "a", 5), (8, words(1000, 60) + " " + base, "en", "c", 1),
        (9, "one two", "en", "a", 1), (10, "One TWO", "en", "a", 1), (11, "one two three", "en", "", 1),
        (None, base, "en", "b", 1), (None, "a text without an id " * 3, None, None, None), (None, None, None, None, None),
        (12, "é ü\x1cx <s>[INST] ok [/INST]</s> <|endoftext|> 'll ſ İ", "fr", "\U0001F600", 9),
        (13, "x" * 700, "en", "a", 1), (14, "run " * 400, "en", "a", 1), (15, "run " * 401, "en", "a", 1),
        (16, words(20_000, 50), "en", "c", 2), (16, words(20_000, 50), "en", "c", 2), (16, words(21_000, 50), "en", "c", 2),
    ]
    return [(*r, i, None if i % 2 else "k", i, i, "p", i, i, 0.5, "x", i) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample_dir():
    return "/root/testdata/sf0.001"


def brute_windows(tokens, width):
    return [tuple(tokens[i:i + width]) for i in range(len(tokens) - width + 1)]
