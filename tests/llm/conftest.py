import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, words string, key string"


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "of", "the", "and", "Stone", "river", "été", "straße", "x1"]
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared lines, nulls, blanks, one very long text, ties and repeated rows."""
    rng = random.Random(7)
    base = prose(rng, 120)
    shared = "This very line stands in many documents, word for word."
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(24)]
    texts += [base, base, base.replace("alpha", "alpha", 1) + " tail", base.upper()]
    words = base.split()
    for k in range(6):
        own = list(words)
        own[10 + 7 * k] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [f"{prose(rng, 30)}\n  {shared}\t\n{prose(rng, 5)}" for _ in range(5)] + [shared, f"{shared}\n{shared.upper()}"]
    texts += ["", " \n\t ", "one", "one two", None, None, prose(rng, 30_000), "a\n\nb\n", "||| ### $$$", "é" * 19, "é" * 20, "é" * 20, "é" * 20]
    out = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or ""), 1, 2, "w", "k") for k, t in enumerate(texts)]
    return [*out, out[3], out[3]]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="session")
def with_nulls(spark, rows):
    more = [(None, "a document without a name, of more than twenty characters", "en", "s0", 1, 1, 2, "w", "k"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([*rows, *more], KIND).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
