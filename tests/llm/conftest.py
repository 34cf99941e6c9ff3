import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, _id long, h long, k1 long, kept boolean, shard int"
LONG = ("Lorem ipsum dolor sit amet " * 20_000) + "token = 'abcdef012345' " + "x" * 200_000


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "clash", 7, 7, 7, False, 3)


EDGE = [
    _row(1, ""),
    _row(2, None),
    _row(None, "a text without an id " * 20),
    _row(3, LONG),
    _row(4, "repeated row with some words " * 10),
    _row(4, "repeated row with some words " * 10),
    _row(4, "the same id with another text " * 12),
    _row(5, "one"),
    _row(6, " \t\n\r\x0b\x0c "),
    _row(7, "dup line\ndup line\n\n\nother # $ line"),
    _row(8, "Äpfel und Öl süß sind gut " * 30, "de", None),
    _row(9, "Äpfel und Öl süß sind gut " * 30, None, "b"),
    _row(10, "emoji 😀 and CJK 梦 and nul \x00 end " * 30, "", ""),
    _row(11, "12345 678 --- !!!"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def duck(tmp_path):
    """Rows of DuckDB SQL over Spark tables, columns by name."""
    import duckdb

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            path = str(tmp_path / name)
            df.write.mode("overwrite").parquet(path)
            con.execute(f"create view {name} as select * from '{path}/*.parquet'")
        got = con.execute(sql)
        cols = [c[0] for c in got.description]
        order = sorted(range(len(cols)), key=cols.__getitem__)
        return sorted((repr([r[i] for i in order]) for r in got.fetchall()))

    return run


@pytest.fixture
def rows():
    return lambda df: sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
