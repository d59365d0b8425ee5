"""Quality rules of the pipeline: prose that holds an everyday phrase stays."""

from __future__ import annotations

import pytest

import corpus_pipeline
from pairloom.llm import quality_rules
from tests.llm.helpers import frame, prose

PUMP = (
    "The village pump is powered by a small solar array that the local school installed after the old diesel engine broke"
    " down in 2015."
)
PROSE = [
    PUMP,
    "Those who cannot come are asked to click here on the wall map and to tell the guard where they live.",
    "Every spring the children sign up for swimming lessons in the lake behind the mill.",
    "My brother and I share this room with a parrot that our uncle brought home from the sea.",
    "They follow us on foot through the whole valley until the road ends at the river.",
    "The court found that the privacy policy of the bank had been written by a clerk without any training.",
]
JUNK = [
    "Powered by WordPress", "Click here", "Click here!", "Share this:", "Follow us on X", "Privacy Policy", "Sign up for | Home",
    "Privacy policy | Click here | Share this | Contact", "Click here to accept all cookies on this site of ours", "All rights reserved.",
]


def test_prose_with_everyday_phrases_stays(spark):
    rows = [(i, prose(i, 60) + "\n" + line, "en", "s", 0) for i, line in enumerate(PROSE)]
    rows += [(100, PUMP, "en", "s", 0), (101, "\n".join(PROSE), "en", "s", 0)]
    kept = {r["doc_id"]: r["text"] for r in quality_rules.keep_clean(frame(spark, rows)).collect()}
    assert kept == {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("line", JUNK)
def test_boilerplate_goes(spark, line):
    good = prose(1, 60)
    assert [r["text"] for r in quality_rules.keep_clean(frame(spark, [(0, good + "\n" + line, "en", "s", 0)])).collect()] == [good]


def test_pipeline_keeps_a_clean_line(spark):
    docs = frame(spark, [(0, PUMP, "en", "s", len(PUMP))])
    assert [r["text"] for r in corpus_pipeline.quality(spark, docs, "").collect()] == [PUMP]


def test_query_keeps_clean_lines_as_the_pipeline_does(spark):
    rows = [(i, line, "en", "s", 0) for i, line in enumerate(PROSE)] + [(100, "\n".join(PROSE), "en", "s", 0)]
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.digest(frame(spark, rows)).collect()}
    assert all(kept != failed for failed, kept in found.values())
    assert found[0] == found[100] == (False, True)
