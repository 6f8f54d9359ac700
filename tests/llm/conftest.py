import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " ", "one two three four five six seven", "one  two\tthree four five\nsix seven", LONG, LONG + " end", "日本語のテキスト 😀 emoji test", "\x00 nul \x1c sep", "a@b.co +1 (234) 567-8901 10.0.0.1 4111 1111 1111 1111"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, float(i), i, "x", i, "y", [1], i, f"k{i}", f"r{i}", f"t{i}", 7 * i) for i, t in enumerate(TEXTS * 2)]
    rows += [rows[3], rows[3], (None, "one two three four five six seven", *[None] * 14), (None,) * 16]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, norm string, blob long, mix_pos string, ids array<int>, __t long, __key string, `range` string, __text string, `rank` long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
