import random

import pytest

CLASHES = (
    "id doc body line line_no own n key keys path pos fp first last root level score label order ids part size start "
    "digest holder run new shard cell bytes bucket tie words data gone others fingerprint component_id"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of ``(doc_id, text)`` rows, with further columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *[f"cast(null as string) as `{name}`" for name in CLASHES])

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "idiot"]) for _ in range(40_000))
    prose = "one two three four five six seven eight nine ten\neleven twelve thirteen fourteen fifteen sixteen"
    return [
        (None, None),
        (None, prose),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, long),
        (5, prose),
        (5, prose),
        (6, prose),
        (7, "word"),
        (8, "   one   two\r\n\r\nthree\n"),
        (9, prose.replace("six", "SIX")),
        (-10, "𝄞 日本語 ß \x00 end"),
    ]
