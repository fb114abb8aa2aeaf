import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, size int, pii_spans string, mix_copy int"
WORDS = "the of alpha beta gamma delta épsilon zeta eta theta iota kappa Lambda mu nu".split()


def texts(seed: int = 1) -> list[str | None]:
    """Prose, copies, near copies, shared passages, periodic and very long texts, none and empty ones."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(n))
    base, passage = prose(120).split(), prose(60)
    out: list[str | None] = [prose(rng.randrange(1, 150)) for _ in range(25)]
    out += [out[3]] * 3 + [out[4].upper()]
    for _ in range(14):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(9))
        out.append(" ".join(copy))
    out += [f"{prose(20)} {passage} {prose(20)}" for _ in range(8)]
    out += [None, "", " \n\t ", "one", "one two three", "ONE two three", "a" * 700, "abc " * 300, prose(4000), None, "naïve\u00a0text <|endoftext|> x"]
    return out


def rows(seed: int = 1) -> list[tuple]:
    out = []
    for i, t in enumerate(texts(seed)):
        source = [None, "src1", "src10", "src2"][i % 4] if i % 3 else "src0"
        out.append((i * 7 % 1000, t, None if i % 5 == 0 else "en", source, None if t is None else len(t), "k", i, i % 3, "p", 1))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
