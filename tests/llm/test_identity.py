"""Texts that rolling hashes take for one another: both Thue-Morse words of 2^11 letters, and other repetitive ones."""

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import line_dedup, ngram_join, packing, sentencepiece_dropout, texthash
from tickloom.llm.common import texts_of

MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def word_hashes(texts):
    return texthash.WordHasher().words(*texts_of(pa.array(texts)))


def test_words():
    texts = [MORSE, OTHER, "a" * 2048, "a" * 2047 + "b", "a" * 64 + "b" + "a" * 63, "b" + "a" * 127, "A" * 2048, f"x {MORSE} y {OTHER}", "", " \n", "é" * 100]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [1, 1, 1, 1, 1, 1, 1, 4, 0, 0, 1]
    assert hashes[0] == hashes[8] and hashes[1] == hashes[10] and hashes[2] == hashes[6] and len(set(hashes.tolist())) == 9
    many = sorted({f"{i % 97}{'ab' * (i % 40)}{i}" for i in range(5000)})
    assert len(set(word_hashes(many)[0].tolist())) == len(many)
    # alike wherever a word stands
    assert np.array_equal(word_hashes([" ".join(many)])[0], word_hashes(many)[0])


def test_lines():
    lines = [MORSE, OTHER, "a" * 2048, "a" * 2047, "", "a", MORSE]
    ids = line_dedup.Lines(["\n".join(lines)]).ids()
    apart = np.concatenate([line_dedup.Lines([x]).ids() for x in lines])
    assert np.array_equal(ids, apart) and ids[0] == ids[6] and len(set(ids.tolist())) == 6
    assert len(line_dedup.Lines([]).ids()) == 0


def test_reports_keep_different_texts_apart(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, f"{MORSE} one two three"), (4, f"{OTHER} one two three")], "doc_id long, text string")
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert joined == {1: 1, 2: 2, 3: 3, 4: 4}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs.filter("doc_id < 3")).collect()}
    assert kept == {1: MORSE, 2: OTHER}


@pytest.mark.parametrize("rate", [0.0, 0.1])
def test_pieces_decode_to_their_text(spark, rate):
    path = packing.tokenizer_path("piece_bpe_32k.model")
    rows = [(1, f"x{MORSE} {MORSE}"), (2, f"x{OTHER} {OTHER}"), (3, MORSE), (4, OTHER), (5, f"{MORSE[:32]} {OTHER[:32]} {MORSE[:64]} {OTHER[:64]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["decoded"] for r in sentencepiece_dropout.decode(sentencepiece_dropout.encode(docs, path, rate, 3), path).collect()}
    assert out == dict(rows)
