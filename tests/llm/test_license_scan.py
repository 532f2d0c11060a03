"""Licence scans: base places against a plain loop, notices with edits, and the SQL counterpart on odd rows."""

import random
import re

import duckdb
import pytest

from tickloom.llm import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(3)
    pool = "gnu general public license apache license cc by mit license CC BY MIT Apache LICENSE GNU the a über ſ K 2 0 version licence".split()
    marks = [" ", "  ", ", ", "-", "\n", "\x00", "_", " ", "\x7f", "[", "`"]
    made = ["".join(rng.choice(pool) + rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*made, "mit license " * 5000, "", None, " - ", "MITLicense mit  license", "MIT LICENSE"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = list(enumerate(texts()))
    return spark.createDataFrame([*rows, rows[0], (None, "cc by"), (None, None)], "doc_id long, text string")


def test_base_places_equal_a_plain_loop(frame):
    rows = frame.collect()
    got = license_scan.report(frame).collect()
    assert len(got) == len(rows)
    want = sorted(((r["doc_id"], *plain(r["text"])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"]) for r in got)


def compared(frame):
    documents = frame.toPandas()  # read by the SQL  # noqa: F841
    out = duckdb.sql(license_scan.ORACLE)
    theirs = sorted((tuple(r) for r in out.fetchall()), key=repr)
    return sorted((tuple(r[c] for c in out.columns) for r in license_scan.report(frame).collect()), key=repr), theirs


def test_the_sql_counterpart_gives_the_same_rows(spark, frame):
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    edits = ["x " * 40 + n for n in notices] + [n.replace(" the ", " der ") for n in notices] + [" ".join(n.split()[i] for i in range(len(n.split())) if i % 9) for n in notices]
    mine, theirs = compared(frame.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(notices + edits)], "doc_id long, text string")))
    assert mine == theirs
    assert compared(frame.limit(0)) == ([], [])


def test_notices(spark):
    mit = dict((n, t) for n, t, _ in license_scan.TEMPLATES)["mit-text"]
    texts = [
        f"Copyright someone. {mit.upper()}",  # whole
        mit.replace("free of charge", "without charge"),  # a key phrase is missing
        "free of charge permission is hereby granted " + " ".join(reversed(mit.split())),  # words without order
        mit.replace("rights to use", "rights of any kind whatsoever to use"),  # words put in
        "Released under CC-BY-NC 4.0", "licensed under CC BY-NC 4.0.", "licensed under the apache license, version 2.0",
    ]
    filler = [(100 + i, "the of to in and this software is permission copy use") for i in range(30)]
    out = {r["doc_id"]: r for r in license_scan.report(spark.createDataFrame([*enumerate(texts), *filler], "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(7)] == ["mit-text", "", "", "mit-text", "cc-by,cc-by-nc-4.0", "cc-by,cc-by-nc-4.0", "apache,apache-2.0"]
    assert out[0]["score"] == 1 and out[1]["score"] <= 0.5 and out[100]["labels"] == ""
