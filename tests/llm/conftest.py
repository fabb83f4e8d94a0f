from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, words string, size int, id string"


def _sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "Öl", "été", "x1"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, ties and letters beyond the basic plane."""
    rng = random.Random(4)
    base = [_sentence(rng, rng.choice([3, 40, 90, 200])) for _ in range(40)]
    shared = _sentence(rng, 90)
    texts = [
        None, "", " \n\t ", "one", "one two", "!!!", "ÀÉ É", *base, *[b.upper() for b in base[:6]], *base[:6], base[7] + " extra", base[8][:-1], f"{base[9]}\n{shared}", f"{shared}\n{base[10]}",
        "De " * 400, "ab" * 900, "x" * 1500, _sentence(rng, 6000), "a b c a b c a b c d", "line\nline\n \n \nline two\nline", "Under the MIT license, under the  mit-LICENSE; cc-by-nc cc by nc Apache License, Version 2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a very good copy of this software and associated documentation", "🙂 𝒳 bold 🙂 𝒳 bold 🙂 𝒳 bold",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (3, "one"), (None, "one"), (None, "one"), (None, None), (None, base[3]), (5, base[5]), (10**17 + 1, base[5])]
    langs, sources = ["en", "fr", None, "de"], ["s1", "s2", None, "s10", "ü"]
    return [(i, t, langs[k % 4], sources[k % 5] if k % 3 else "hot", None if k % 2 else k, k, "k", None, k, "clash") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
