import random

import pytest

#: Further columns whose names operators use themselves.
CLASHING = ["size", "score", "kept", "n", "words", "part", "text_hash", "component_id", "keep_id", "rank", "label", "spans", "norm", "copies", "row", "gone_id", "gone_sha", "gone_hash", "repeated", "sha", "mix_id", "mix_hash", "mix_key", "mix_times", "times", "rows", "draw", "node", "key", "bucket", "doc", "hits", "run", "digest", "x", "quality", "task", "ids", "found", "flat"]


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "Omega,", "über", "no."]) + str(r.randint(0, 400)) * (r.random() < 0.7) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    r = random.Random(3)
    base = [prose(r, r.randint(60, 160)) for _ in range(12)]
    rows = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[0], "en", "src0"), (21, base[0].replace(" ", "\n", 1), "de", None), (22, base[1] + " end", None, "src1")]
    rows += [(30, None, "en", "src0"), (31, "", "en", None), (32, " \t\n", None, None), (33, "one", "en", "src1"), (34, "two words", "en", "src1")]
    rows += [(40, "x" * 300_000, "en", "src2"), (41, prose(r, 30_000), "en", "src2"), (42, "same same " * 400, "fr", "src2"), (43, "a@" * 2000, "en", "src2")]
    rows += [(5, base[5], "en", "src2"), (5, base[5], "en", "src2"), (6, "other text of a known number", "en", "src0"), (None, base[2], "en", "src0"), (None, None, None, None), (None, base[2], "en", "src0")]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*row, *["?"] * len(CLASHING)) for row in messy_rows()], f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text or "" for r in small.collect()}
