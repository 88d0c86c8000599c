import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a caller may have beside those that an operator reads, with names that operators use inside.
CLASH = ["id", "rid", "key", "n", "sha", "name", "label", "_text", "_gone", "bucket", "item", "kind", "start"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank, short and very long texts, copies, ties, repeated rows."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base.upper()), (3, base), (3, base), (4, " ".join(near)), (5, None), (6, ""), (7, " \t\n "),
        (8, "one"), (9, "One"), (10, "two words"), (11, long), (12, long + " end"), (13, prose(3, 90)), (None, base),
        (None, None), (14, "é ü ß 日本 " * 30), (15, "x " * 500), (16, prose(4, 40) + " " + base), (0, base),
    ]
    return [(i, t, None if i == 13 else "en", None if i == 1 else "s", None) for i, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    for n, c in enumerate(CLASH):
        df = df.selectExpr("*", f"cast({n} as int) as {c}")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
