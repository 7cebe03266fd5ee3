import random

import pytest

WORDS = "the of and ma ri to ke lon tas vel pir sho nun dex qua".split()
DOC_SCHEMA = "doc_id long, text string, score double, text_id long, set_id string, h int, key string, n_chars long"


@pytest.fixture(scope="session")
def lspark(spark):
    from folio.llm.queries import prepared

    return prepared(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, repeated rows, ties, near copies, long texts."""
    rng = random.Random(5)
    base = prose(rng, 400)
    near = base.split()
    near[7] = near[200] = "changed"
    long = prose(rng, 30_000)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "a b c d e"),
        (10, "A B C D E"), (None, base), (None, None), (12, long), (13, "x " + long[5_000:90_000]), (14, "é" * 400), (14, "é" * 400),
        (15, "漢字 " * 300), (16, "token = abcdefgh12 AKIA" + "B" * 12 + "\npassword:'short' " + "0f" * 20), (17, "ab" * 2000),
        (18, "<|endoftext|> and  two  spaces \n end "), (19, prose(rng, 80)), (20, prose(rng, 80) + "\n" + prose(rng, 80)),
    ]
    for i in range(40):
        w = base.split()
        for _ in range(rng.randint(0, 60)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(w)))
    for i in range(60):  # small sets: few and many shared words
        rows.append((200 + i, " ".join(rng.choice("a b c".split()) if rng.random() < 0.1 else f"w{j}" for j in range(rng.randint(1, 45)))))
    return rows


@pytest.fixture(scope="session")
def edge_docs(lspark):
    """The rows above, with extra columns whose names the operators use inside."""
    rows = [(i, t, 0.5, 7, "s", 1, "k", len(t or "")) for i, t in edge_rows()]
    return lspark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(lspark):
    return lspark.createDataFrame([], DOC_SCHEMA)
