from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 7) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, repeated lines and junk."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiéñß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = " ".join(line(12) for _ in range(6))
    texts = ["\n".join(line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    texts += [texts[0], texts[0], texts[3]]
    for i in (5, 6, 7, 7, 7):  # near copies: one word of many differs
        parts = texts[i].split(" ")
        parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    texts += [f"{line(5)} {passage} {line(7)}" for _ in range(4)]
    texts += ["Same line here, ten chars.\n" + line(20), "  SAME line here, ten chars.\t\n" + line(9), "Same line here, ten chars."]
    texts += [" ".join(f"{rng.choice(words)}###" for _ in range(40)) for _ in range(4)]
    texts += ["Orre " * 200, "aaaa" * 300, "ab" * 400]
    texts += ["Mail a.b@c.org or x@y.z_d@e.f.gh, call +1 (523) 555-1055, card 4242 4242 4242 4242 and 10.0.0.255, 300.1.1.1, 1.2.3.4.5.6.7.8"]
    texts += [f'token = "{rng.getrandbits(160):040x}" {line(6)}' for _ in range(6)]
    return [(i, t, "xx", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]


#: Nulls, empty and odd texts, ties and repeated rows.
EDGE = [
    (None, None, None, None, None), (None, "a null id with some words in it", "x", None, 1), (1, "", "x", "s", 0), (2, None, "x", "s", None),
    (3, " \n\t\n", "x", "s", 4), (4, "one", "x", "s", 3), (5, "seven words are in this very text", "x", "s", 9), (5, "seven words are in this very text", "x", "s", 9),
    (6, "seven words are in this very text", "x", "s", 9), (6, "the same id with another text", "x", "s", 9), (7, "long " * 20_000 + "\n" + "z" * 50_000, "x", "s", 9),
    (8, "▁ \x00 𝔘 日本 \r\n é " * 20, "x", "s", 9),
]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark, rows):
    marks = [(i, 0 if "###" in t or "Orre" in t else 1, int(i % 9 == 0)) for i, t, *_ in rows if i % 5]
    return spark.createDataFrame([*marks, (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with extra columns that are named like those that operators make."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(EDGE, SCHEMA)
    return frame.withColumns({c: F.lit(1) for c in ("id", "row", "n_tokens", "rate", "digests", "cls", "key", "units", "at", "kept_sha256", "n", "posterior")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
