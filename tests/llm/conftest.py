import random

import pytest

WORDS = [a + b for a in ("lo", "mar", "ti", "sen", "qu", "bre") for b in ("na", "st", "ol", "ér", "x")]


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same for the same seed."""

    def make(n, seed=0, capital=False):
        r = random.Random(seed)
        out = [r.choice(WORDS) for _ in range(n)]
        return " ".join([out[0].capitalize(), *out[1:]] if capital else out)

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """Odd rows: nulls, empty and long texts, ties, repeated rows, other scripts, clashing columns."""
    base, long = prose(80, 1), prose(6000, 2)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [
        (1, base, "en"), (2, base, "en"), (3, near, None), (4, None, "en"), (5, "", "en"),
        (6, " \t\n ", None), (7, "one two", "fr"), (8, "one two", "fr"), (9, long, "de"),
        (10, prose(30, 3) + " " + long, "de"), (None, base, "en"), (None, prose(25, 4), None),
        (11, "Ünïcödé … — 漢字かな交じり文 ١٢٣ İstanbul <|endoftext|> it's 42% fine", "es"),
        (12, "x" * 3000, None), (13, ("ab " * 400).strip(), None), (2, base, "en"),
        (2, prose(40, 5), "en"), (14, words[0], None), (15, "\0\x1c zero \x85 \xa0 control", "en"),
    ]
    return spark.createDataFrame(
        [(*r, "s", 7, 9.0, 5) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("doc_id = -1")
