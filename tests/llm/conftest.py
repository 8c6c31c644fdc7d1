import pytest

from plain_texts import near, prose

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int, fingerprint string,"
    " score double, n_lines int, _key string, _print bigint, component_id int, sequence_id string, votes string, spans int"
)


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): nulls, empties, long texts, ties, copies, repeated rows."""
    shared = "This line stands in many documents."
    base = [prose(n, 120) for n in range(8)]
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, prose(4, 60_000), "b"), (5, "x" * 300_000, "b"),
        (None, base[0], None), (None, None, None), (6, base[1], "a"), (6, base[1], "a"), (7, base[1], "c"),
        (8, "ÄÖ ß é\n\n" + base[2], "é"), (9, "one", "a"), (10, "two words", "a"), (11, "one", "a"),
    ]
    rows += [(20 + n, f"{base[n % 8]}\n{shared.upper() if n % 2 else '  ' + shared}\n{base[(n + 1) % 8]}", "ab"[n % 2]) for n in range(12)]
    rows += [(50 + n, near(base[3], 7 * n), "d") for n in range(10)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    rows = [(i, t, "en", s, len(t or ""), "own", 1, "own", 0.5, 3, "k", 9, 1, "s", "v", 7) for i, t, s in edge_rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
