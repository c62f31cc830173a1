from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeinrstloé") for _ in range(rnd.randint(2, 9)))
    long = " ".join(word() for _ in range(60_000))
    plain = [" ".join(word() for _ in range(80)) + ".\nMail a.b@ex.org or +1 (555) 555-0199\n" for _ in range(6)]
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, None), (4, long, "en", "s"), (None, plain[0], "en", "s"), (None, None, None, None),
        (5, plain[1], "en", "s"), (5, plain[1], "en", "s"), (6, plain[1], "fr", "s"), (7, plain[2].upper(), "en", "t"), (8, "x" * 300_000, "en", "s"),
        (9, "<|endoftext|> don't <|startoftext|>  two  blanks\r\n\ttab 日本語 İ ﬁ", "en", "s"), (10, "12345 !!", "en", "s"), (11, plain[3], None, "s"), (12, plain[4], "en", None),
    ]
    clash = ("fp", "check_fp", "row", "kept", "score", "spans", "n_words", "key", "x0", "length", "bucket", "base", "rank", "shard", "virtual_slot", "found", "lang_pred", "draw", "tie", "__text", "__id", "__of", "__simhash_text", "__spans", "__doc", "__row", "hash", "node", "label")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame([(*r, len(r[1] or ""), *[0] * len(clash)) for r in rows], schema).cache()


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.filter("false")
