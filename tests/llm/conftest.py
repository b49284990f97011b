import pytest

#: A documents table with every awkward case: nulls in each column, empty and long texts, repeated rows, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, size long, line_no int"


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, 1.0, 7, 3, 2)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    long_text = " ".join(f"word{n % 977} runs on" for n in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while indeed"
    return make_docs(
        [
            (1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (None, "no id here, but some words all the same"),
            (6, "word", None, None), (7, long_text), (8, "ß é 漢字 🙂 mixed"), (9, base.replace("quick", "quiet"), "de", None), (10, "x\n\nx\nx"),
        ]
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
