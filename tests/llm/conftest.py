import random

import pytest

CLASHING = ("batch string, node string, key string, n string, score string, kept string, digest string,"
            " words string, block string, comp string, bucket string, length string, hash string")


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeioubdfglmnrst") for _ in range(draw.randint(2, 7)))
                    for _ in range(n))


def odd_rows() -> list[tuple]:
    """(id, text): nulls, blanks, short, repeated, near and very long texts, and odd characters."""
    passage = prose(1, 60)
    base = prose(2, 200)
    near = base.split()
    near[100] = "changed"
    longest = prose(3, 4000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "two words"),
        (7, base), (8, " ".join(near)), (9, base), (10, base.upper()), (11, base.replace(" ", "  ")),
        (12, prose(4, 40) + " " + passage + " " + prose(5, 30)), (13, passage + "\n" + prose(6, 80)),
        (14, passage), (15, passage + " " + passage), (16, longest), (17, longest + " end"),
        (18, "x" * 30_000), (19, "a b é́ 中文 <|endoftext|> it's"),
        (20, "same line\n" * 40), (21, "same line\n" * 40), (22, "# $ % & | < > * " * 12),
        (23, "Copyright (c) 2020 A Name\nReleased under the MIT License.\n"), (24, "tie"), (24, "tie"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with an id that is missing, and columns whose names operators use."""
    rows = [(i, t, *["x"] * 13) for i, t in [*odd_rows(), (None, "no id"), (None, None)]]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASHING}").repartition(3).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
