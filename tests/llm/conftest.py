import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def sentence(seed: int, n: int) -> str:
    """Words that differ for every seed."""
    return " ".join(f"{WORDS[(seed * 7 + k * 5) % 18]}{(seed * 31 + k * k) % 97}" for k in range(n))


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, "
    "cls long, n long, component long, start long, item long"
)


def frame(spark, rows):
    """Documents with columns whose names operators use inside."""
    full = [(i, t, "en", "s", None, False, 9.0, 7, 7, 7, 7, 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "one"),
    (4, "one"),
    (5, "One  two\nthree"),
    (None, "One two three"),
    (None, None),
    (6, sentence(1, 60)),
    (7, sentence(1, 60)),
    (8, sentence(2, 40) + " " + sentence(1, 60) + "\n" + sentence(3, 40)),
    (9, "x" * 100_000),
    (10, sentence(4, 30_000)),
    (11, "12345 !!! ???"),
    (12, "naïve café ÜBER straße Ωmega \U0001f600   \x1c end"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
