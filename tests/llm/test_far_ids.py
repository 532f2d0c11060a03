"""Fingerprints of documents whose ids lie as far apart as they can."""

import hashlib

import pytest

from tickloom.llm import fingerprints


@pytest.mark.parametrize("block_rows", [500, 2])
@pytest.mark.parametrize("ids", [[-(2**63), 0], [-(2**63), 2**63 - 1, 5], [-(2**63) + k * 922337203685477 * 3 for k in range(60)], [*range(40), 2**63 - 1, 2**62, -(2**63)]])
def test_next_document_by_descending_id(spark, monkeypatch, ids, block_rows):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block_rows)
    docs = spark.createDataFrame([(i, f"text of {i} in some words") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_edited(docs).collect()}
    order = sorted(ids, reverse=True)
    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        a, b = f"text of {here} in some words", f"text of {after} in some words"
        half = len(a) // 2
        assert got[here] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
