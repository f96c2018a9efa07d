import random

import pytest
from llm_data import frame, prose


@pytest.fixture(scope="session")
def rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows, near copies, a hot source."""
    rng = random.Random(5)
    out = [(k, prose(rng, rng.randint(3, 160)), "hot" if k % 3 else f"s{k % 5}") for k in range(120)]
    out += [(200, None, "hot"), (201, "", "s1"), (202, " \n\t ", None), (None, "a text without an id", "s2"), (None, None, None), (203, prose(rng, 20_000), "s3")]
    out += [(k, out[7][1], "hot") for k in range(300, 330)]  # exact copies
    out += [(400, out[9][1], "hot"), (400, out[9][1], "hot")]  # a repeated row
    long = prose(rng, 400)
    out += [(500, long, "s4"), (501, long.replace("river", "rivers", 1), "s4"), (502, long.upper(), "s4")]
    out += [(600, "Ünï çödé ñ 漢字 \x1c text 😀 " + prose(rng, 60), "s0"), (601, "line one of the text\nline two of the text\n\nline one of the text\n", "s0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
