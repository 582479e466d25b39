import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, shard string, __row string, line string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EN = "the quick brown fox jumps over the lazy dog while another animal watches from the hill near the old mill"
FR = "le renard brun saute par dessus le chien paresseux pendant que nous regardons la colline près du vieux moulin"


def prose(seed: int, words: str, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words.split()) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in every column, empty, short and very long texts, copies, repeated rows and ids."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "fr", None, 4), (4, "one", None, "b", 3), (None, EN, "en", "b", 9), (None, None, None, None, None),
        (7, EN, "en", "c", 9), (7, EN, "en", "c", 9), (8, EN.upper(), "en", "d", 9), (9, EN + " tail", "en", "a", 9), (9, FR, "fr", "b", 9), (10, LONG, "en", "c", 9), (11, LONG + " end", None, None, None),
        (12, "ÀÉÎ " * 20 + "ß 中文 🙂", "fr", "a", 1), (13, "a b c d e", "en", "a", 9), (14, "12345 !!! ###", "en", "a", 3),
    ]
    rows += [(100 + i, prose(i, EN, 60), "en", f"s{i % 7}", 1) for i in range(30)]
    rows += [(200 + i, prose(i, FR, 60), "fr", f"s{i % 7}", 1) for i in range(30)]
    return [(*r, "own", "own", "own", "own") for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    """The rows as a Parquet table, with further columns whose names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, DOCS).repartition(3, "source").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
