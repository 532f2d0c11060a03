"""Each operator on odd rows, on an empty table, and beside extra columns with its own names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat_format, fingerprints, html_consensus, license_scan, line_dedup, media_avi, ngram_join, packing, periodic_runs, quality, secret_scan, sentencepiece_dropout

PIECES, BYTES = packing.tokenizer_path("piece_bpe_32k.model"), packing.tokenizer_path("byte_bpe_50k.json")

OPERATORS = {
    "encode": lambda d: sentencepiece_dropout.decode(sentencepiece_dropout.encode(d, PIECES), PIECES),
    "secrets": secret_scan.scan,
    "redact": secret_scan.redact,
    "jaccard": ngram_join.jaccard_components,
    "avi": lambda d: media_avi.describe(media_avi.to_avi(d)),
    "clips": lambda d: media_avi.clips(media_avi.to_avi(d)),
    "fingerprint": fingerprints.compare_edited,
    "pack": lambda d: packing.pack_documents(d, BYTES),
    "licenses": license_scan.report,
    "runs": periodic_runs.find_runs,
    "lines": line_dedup.line_report,
    "drop_lines": line_dedup.drop_repeated_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd_docs, name):
    assert OPERATORS[name](odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["encode", "secrets", "redact", "jaccard", "avi", "fingerprint", "licenses", "runs"])
def test_one_row_each(odd_docs, name):
    assert OPERATORS[name](odd_docs).count() == odd_docs.count()


def test_encoding_is_lossless(odd_docs):
    out = OPERATORS["encode"](odd_docs).join(odd_docs.filter("doc_id is not null").select("doc_id", "text").distinct(), "doc_id")
    assert out.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


def test_secrets(odd_docs):
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(odd_docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in out[9]] == [("assign", 0, 26)]
    assert not out[3] and not out[4] and not out[1]
    assert secret_scan.redact(odd_docs).filter("doc_id = 9").first()["text"].startswith("[SECRET]'\n")


def test_jaccard(odd_docs):
    out = [tuple(r) for r in ngram_join.jaccard_components(odd_docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(x for x in out if x[0] is not None and x[0] != 7) == [(1, 10, 1), (2, 10, 1), (2, 10, 1), (3, 0, 3), (4, 0, 4), (8, 0, 8), (9, 14, 9)]
    assert sorted(x[1:] for x in out if x[0] is None) == [(0, None), (10, None)]
    kept = ngram_join.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 8


def test_media(odd_docs):
    out = {r["doc_id"]: r for r in OPERATORS["avi"](odd_docs).collect()}
    assert out[3]["n_bytes"] == 0 and out[3]["payload_bytes"] == 576 and out[3]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert out[3]["media_sha256"] == out[4]["media_sha256"] and out[1]["feature"] == out[2]["feature"]
    back = {r["doc_id"]: r["text"] for r in media_avi.to_text(media_avi.to_avi(odd_docs)).collect()}
    assert back[9] == odd_docs.filter("doc_id = 9").first()["text"]


def test_packing(odd_docs):
    rows = OPERATORS["pack"](odd_docs).collect()
    assert sum(r["length"] == 1 for r in rows) == 3  # the three texts without characters
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    long_ = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 7)
    assert all(n == 1024 for _, _, n in long_[1:]) and [s for _, s, _ in long_[1:]] == [long_[0][2] + 1024 * k for k in range(len(long_) - 1)]


def test_lines(odd_docs):
    out = {r["doc_id"]: r for r in line_dedup.line_report(odd_docs).collect()}
    assert set(out) == {1, 2, 3, 4, 7, 8, 9}
    assert out[2]["dropped"] == "0" and out[1]["dropped"] == "" and out[9]["dropped"] == "2" and out[3]["n_lines"] == 0
    kept = line_dedup.drop_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id is null").count() == 2
    assert kept.filter("doc_id = 9").first()["text"].count("the same line") == 1


def test_fingerprints(odd_docs):
    out = {r["doc_id"]: r for r in fingerprints.compare_edited(odd_docs).collect()}
    assert out[3]["fingerprint"] == "" and out[1]["fingerprint"] == out[2]["fingerprint"] and out[7]["n_chars"] > 400_000


def test_pages(odd_pages):
    out = {r["page_id"]: r for r in html_consensus.extract(odd_pages).collect()}
    assert out[1]["text"] == "One two three four five six seven eight nine ten eleven twelve." and out[4]["text"] == ""
    assert html_consensus.extract(odd_pages.limit(0)).collect() == []


def test_chats(odd_chats):
    # 1 and 3 are snapshots of 2, 5 (one turn without role and text) of 4, whose turn without a number comes first
    out = [tuple(r) for r in chat_format.format_chats(odd_chats).select("conv_id", "place", "start").collect()]
    assert sorted(x for x in out if x[0]) == [(2, 0, 0), (2, 1, 29), (2, 2, 63), (4, 0, 0), (4, 1, 24)]
    assert chat_format.format_chats(odd_chats.limit(0)).collect() == []


def test_quality(odd_docs, labels):
    docs = odd_docs.select("doc_id", "text")
    kept = quality.keep_good(odd_docs, labels, 1)
    assert kept.columns == odd_docs.columns
    assert quality.sample(docs.limit(0), labels, 1)[0].collect() == []
    assert quality.sample(docs, labels.limit(0), 1)[0].count() == odd_docs.count()
