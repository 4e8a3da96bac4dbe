import re

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """A small documents table; rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=()):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *("en", "s")[len(r) - 2:], None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, schema)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def word_list():
    return lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
