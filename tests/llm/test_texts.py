import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dissimap.llm import encoding, mixing, subjects
from dissimap.llm.commit_text import content, words

encode = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS).encode_ordinary

PIECES = ["a", "word", " word", "'", "'s", "'re", "'ve", "'l", "l", "re", "  ", " ", "\n", "\n\n ", "\r\n", "\t", "12", " 345", "!!", " !", "é", "漢字", "ש", "🚀", "<|endoftext|>", " ", "x'", "''", " '", "----", "　", "é", "ß"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.integers(1, 9))
def test_the_tree_gives_the_ids_of_the_whole_text(text, leaf):
    assert encoding.encode_tree(text, encode, leaf).tolist() == encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.integers(1, 5))
def test_any_text(text, leaf):
    assert encoding.encode_tree(text, encode, leaf).tolist() == encode(text)


def test_one_piece_longer_than_leaves():
    for text in ("x" * 5000, " " * 5000, "!" * 3000 + "a", "\n" * 999 + "b", "ab " * 3000):
        assert encoding.encode_tree(text, encode, 64).tolist() == encode(text)


def test_texts_decode_to_themselves_and_nulls_are_empty(spark):
    rows = [(1, "Hello, it's <|endoftext|> here"), (2, None), (3, ""), (4, "z'" * 40_000 + " end"), (None, "x"), (1, "again")]
    df = spark.createDataFrame([(a, b, "c", 0) for a, b in rows], "doc_id bigint, text string, ids string, n_tokens int")
    got = encoding.encode_texts(df, "doc_id", "text", leaf=1000)
    assert got.columns == ["doc_id", "ids"]
    dec = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS).decode
    assert sorted((str(r.doc_id), dec(r.ids)) for r in got.collect()) == sorted((str(a), b or "") for a, b in rows)
    n = {(r.doc_id, r.n_tokens) for r in encoding.count_tokens(df, "doc_id", "text").collect()}
    assert (2, 0) in n and (3, 0) in n and (None, 1) in n
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_capped_poisson_rates():
    for cap in (1, 2, 5):
        for mean in (0.05, 0.5, 0.9 * cap, cap):
            rate = mixing.rate_for(mean, cap)
            assert rate == float("inf") or mixing.capped_mean(rate, cap) == pytest.approx(mean, rel=1e-6)
    assert mixing.thresholds(3.0, 3) == [0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["Big", " big", "BIG "]), r.randrange(50, 150)) for k in range(4000)] + [(5000 + k, "small", 100) for k in range(400)]
    rows += [(9000 + k, "tiny", 100) for k in range(10)] + [(9900, None, 10), (9901, "other", 10), (None, "big", 5)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("Small ", 0.2, 4), ("tiny", 0.19, 3), ("none", 0.01, 2)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), targets


def test_mix_reaches_its_shares_within_the_caps(spark, corpus):
    sizes, targets = corpus
    plan = mixing.source_plan(sizes, targets)
    p = {r.source: r for r in plan.collect()}
    assert {s for s, r in p.items() if r.short} == {"tiny", "none"} and p["none"].n_tokens == 0
    mixed = mixing.mix(sizes, plan)
    rep = {r.source: r for r in mixing.report(mixed, plan).collect()}
    assert all(r.most_repeats <= r.max_repeats for r in rep.values())
    assert rep["tiny"].actual_tokens == 3000 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert {r.source for r in mixing.short_sources(mixed, plan).collect()} == {"tiny", "none"}
    with pytest.raises(RuntimeError):
        mixing.short_sources(mixed.where("source <> 'tiny' or copy < 3"), plan)
    for s in ("big", "small"):
        assert rep[s].actual_tokens == pytest.approx(p[s].target_tokens, rel=0.06)
    again = mixing.mix(sizes.repartition(9), plan)
    assert again.count() == mixed.count() and mixed.exceptAll(again).count() == 0
    whole = mixing.source_plan(sizes, targets.where("source <> 'none'"), "feasible").collect()
    assert not any(r.short for r in whole)


def test_mix_of_nothing(spark, corpus):
    sizes, targets = corpus
    plan = mixing.source_plan(sizes.limit(0), targets)
    assert mixing.mix(sizes.limit(0), plan).count() == 0 and mixing.report(mixing.mix(sizes.limit(0), plan), plan).count() == 4
    docs = spark.createDataFrame([(1, " BIG", "two words"), (2, None, "x"), (3, "big", None)], "doc_id bigint, source string, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in mixing.document_sizes(docs, targets).collect()) == [(1, 2), (3, 0)]


GIT = """commit 0123456789abcdef0123456789abcdef01234567
Author: Some Body <some.body@mail.example>
Date:   Mon Jan 1 10:00:00 2024 +0000

    Fix violin total

    See #12
    Signed-off-by: A Cello <a@b.example>

diff --git a/src/trumpet.py b/src/trumpet.py
index 1..2 100644
--- a/src/trumpet.py
+++ b/src/trumpet.py
@@ -1 +1 @@
 unchanged_oboe
-    old_fluteCount = 1
+
diff --git a/locale/cy.po b/locale/cy.po
+msgid "harp"

commit 1123456789abcdef0123456789abcdef01234567
Author: depwatch[bot] <x@y.example>
Date:   Mon Jan 1 10:00:00 2024 +0000

    Bump piano from 1.0 to 2.0
"""


def test_words_of_commits():
    got = words(GIT)
    assert {"violin", "trumpet", "flute", "count"} <= set(got)
    assert not {"cello", "oboe", "harp", "piano", "body", "author"} & set(got)
    assert words(None) == words("") == words(" \n\t") == [] and words("{broken json") == []
    assert "violin" in words('{"sha": "1", "message": "Fix violin", "patch": ""}')
    assert content(GIT.replace("\n", "\r\n"))[0] == "Fix violin total"
    assert "和弦" in words("commit 0123456\n\n    修复和弦")


def made(spark, seed=0):
    r = random.Random(seed)
    areas = {"music": [f"note{chr(97 + k)}x" for k in range(12)], "law": [f"clause{chr(97 + k)}x" for k in range(12)]}
    filler = [f"filler{chr(97 + k)}" for k in range(20)]
    docs, truth = [], {}
    for k in range(400):
        own = [s for s in areas if r.random() < 0.45]
        w = r.sample(filler, 8) + [x for s in own for x in r.sample(areas[s], 6)] + ([r.choice(areas[r.choice(sorted(areas))])] if r.random() < 0.2 else [])
        docs.append((k, "commit 0123456\n\n    " + " ".join(w), "en"))
        truth[k] = set(own)
    docs += [(1000, None, None), (1001, "", ""), (1002, "   ", None)]
    labels = [(k, s) for k in range(80) for s in (truth[k] or {None})] + [(3, "law"), (5000, "law"), (None, "law")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame([(s, "") for s in areas], "subject string, description string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), truth)


def test_areas_of_held_out_documents(spark):
    docs, areas, labels, truth = made(spark)
    got = {}
    for r in subjects.subject_areas(docs, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [k for k in truth if k >= 80]
    assert sum(got.get(k, set()) == truth[k] for k in held) >= 0.95 * len(held)
    assert not any(k >= 1000 for k in got)


def test_areas_without_labels_documents_or_subjects(spark):
    docs, areas, labels, _ = made(spark)
    assert subjects.subject_areas(docs, areas, labels.limit(0)).count() == 0
    assert subjects.subject_areas(docs.limit(0), areas, labels).count() == 0
    assert subjects.subject_areas(docs, areas.limit(0), labels).count() == 0


def test_changed_lines_that_begin_with_dashes_or_pluses_are_no_file_names():
    text = "commit 1234567\n\ndiff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1,2 @@\n--- old remark\n+-- new remark\n+++ counter\n--- a/r.sql\n+++ b/r.sql\n@@ -1 +1 @@\n--- last"
    assert content(text) == ["q.sql", "-- old remark", "-- new remark", "++ counter", "-- last"]
