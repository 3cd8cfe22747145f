"""Every operator works on a user's own table, with the package only on the driver's path."""

import pytest
from test_shipping import ran

CASES = {
    "simhash": "from cohortlens.llm import simhash; n = simhash.keep_one(docs).count()",
    "licences": "from cohortlens.llm import license_scan; n = license_scan.scan(docs).count()",
    "personal": "from cohortlens.llm import pii; n = pii.redact(docs).count()",
    "pages": "from cohortlens.llm import html_text; n = html_text.extract(docs, ['doc_id'], 'text').count()",
    "middle": "from cohortlens.llm import fill_in_middle as f; n = f.restore(f.fill_in_middle(docs)).count()",
    "pieces": "from cohortlens.llm import piece_spans; n = piece_spans.encode_documents(docs).count()",
    "words": "from cohortlens.llm import bpe; n = bpe.encode_documents(docs).count()",
    "centroids": "from cohortlens.llm import centroids; n = centroids.cluster(vecs, components=3).count()",
    "near": "from cohortlens.llm import near_dup_vectors; n = near_dup_vectors.near_duplicates(vecs).count()",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_operator_without_a_path(tmp_path, name):
    made = """
s = session()
docs = s.createDataFrame([(1, "some text of words", "a"), (2, "other text of words\\nand a line", "b")], "doc_id long, text string, source string")
vecs = s.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0, 0.25])], "vec_id long, embedding array<double>")
"""
    assert ran(f"{made}{CASES[name]}\nprint(n)", tmp_path) == ["2"]
