import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rk string, n int, `rank` int, u string"


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), "k", "r", 1, 2, "u")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=120, line=12):
    import random

    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    return "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows, clashing names."""
    rows = [document(k, prose(k)) for k in range(40)]
    rows += [document(100 + k, prose(1)) for k in range(5)]  # copies
    rows += [document(110, prose(2).replace("alpha", "Alpha", 1).upper().lower()), document(111, prose(3) + " one more word")]
    rows += [document(200, None), document(201, ""), document(202, " \n\t\n"), document(203, "one two"), document(204, "x" * 5000)]
    rows += [document(205, " ".join(f"w{k}" for k in range(60_000))), document(None, prose(7)), document(None, None), (300, None, None, None, None, None, None, None, None, None)]
    rows += [document(12, prose(12)), document(13, prose(500))]  # a repeated row, and an id used twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, None), (200, 0, 1), (5, 1, 1), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
