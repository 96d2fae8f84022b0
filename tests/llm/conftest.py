import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` tuples, over several partitions."""

    def make(rows, parts=3):
        full = [(*r, "en", "src1")[:4] if len(r) == 2 else r for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty, repeated, tied and long texts, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} filler{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "src0"),
        (3, " \t\n ", "en", "src0"),
        (4, "one", "de", "src2"),
        (5, "same text in two rows and more", "en", "src3"),
        (5, "same text in two rows and more", "en", "src3"),
        (6, "same text in two rows and more", None, "src3"),
        (7, long_text, "en", "odd-source"),
        (8, long_text, "en", None),
        (None, "a row without an id", "fr", "src0"),
        (None, None, None, None),
    ]
    clash = ["_key", "_text", "text_hash", "n", "lo", "gram", "_id", "_one", "_rank", "shard", "slot", "domain", "epoch", "toxic_score"]
    return documents(rows).withColumns({c: F.lit("clash") for c in clash})
