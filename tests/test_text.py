"""Scalar semantics against plain Python."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def column(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(build(F.col("x"))).collect()]


def canonical(kind, name):
    return f"{kind}:" + re.sub(r"^_|_\Z", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))


def test_canonical_ids(spark):
    names = ["Acme, Inc.", "  x ", "__a__", "東京", "", "A--B  c", "9 Lives!"]
    assert column(spark, names, lambda c: T.canonical_id("entity", c)) == [canonical("entity", n) for n in names]


def test_tokens_are_utf16(spark):
    values = ["", "a", "abcd", "abcde", "😀", "😀😀😀"]
    assert column(spark, values, T.estimate_tokens) == [math.ceil(len(v.encode("utf-16-le")) / 2 / 4) for v in values]
    assert column(spark, ["ab😀cd"], lambda c: T.utf16_left(c, 4)) == ["ab😀"]


@given(st.lists(st.text("abcdefgilmnorstuvy", min_size=1, max_size=12), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_stem_column_is_stem_word(spark, words):
    words += ["ment", "ments", "running", "supplies", "glasses", "kindness", "relations", "visible", "dress", "cats"]
    assert column(spark, words, T.stem) == [T.stem_word(w) for w in words]


def test_stems():
    assert [T.stem_word(w) for w in ("running", "ments", "ment", "studies", "cats", "dress", "ness", "the")] == ["runn", "", "ment", "study", "cat", "dress", "", "the"]


def test_noise(spark):
    texts = ["short", "x" * 201, "OK then we should go and do that", "okay this long sentence is no chatter", "Need to fix the build on the server", "Ann is testing the new release candidate", "Ann Lee was fixing the old release again", "The port of the service is 3333 in prod", None, "oké this is a long sentence in prose"]
    assert column(spark, texts, T.is_noise_text) == [True, True, True, False, True, True, True, False, True, True]
    assert column(spark, ["ray confirmed the booking of the hall"], lambda c: T.is_noise_text(c, ("ray",))) == [True]
    assert column(spark, ["File", "ab", "123", "", None, "Acme", "csv file"], T.is_noise_entity) == [True, True, True, True, True, False, True]


def test_chat_detection(spark):
    line = "1/2/24, 10:00 - A: x"
    values = ["\n".join([line] * 3), "\n".join([line] * 2), "\n".join(["x"] * 20 + [line] * 3), "[1.2.2024 9:05 A: x\n" * 3]
    assert column(spark, values, T.is_chat) == [True, False, False, True]


def test_chat_times(spark):
    lines = ["1/2/24, 10:00 - A:", "1/2/2024, 12:30 AM - A:", "1/2/24 1:05:07 PM - A:", "13/1/24, 10:00 - A:", "1.2.24, 10:00 - A:", "1/2/99, 10:00 - A:", "none"]
    day = 1_704_153_600_000
    assert column(spark, lines, T.chat_millis) == [day + 36_000_000, day + 1_800_000, day + 47_107_000, None, None, 915_271_200_000, None]
