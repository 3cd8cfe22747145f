import sys
import types

import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text, source) rows; columns as in the real one."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make


#: Rows that every operator on texts must bear: null id, null and empty text, a repeated row, ties, a long text.
ODD = [
    (1, "one two three four five six seven", "a"),
    (1, "one two three four five six seven", "a"),
    (2, "one two three four five six seven", "b"),
    (3, None, None),
    (4, "", "a"),
    (None, "text without an id", "b"),
    (5, " \t\n ", None),
    (6, "long " * 30000 + "end", "a"),
    (7, "x y 日本 é\x1c z\x0b", "b"),
]

module = types.ModuleType("llm_cases")
module.ODD = ODD
sys.modules["llm_cases"] = module
