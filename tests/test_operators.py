"""Worked examples and invariants."""

import pytest
from pyspark.sql import functions as F

from timeweave.functions import metrics as m
from timeweave.functions import text as X
from timeweave.functions import time as tm
from timeweave.functions import vectors as V
from timeweave.operators import filters, folds, joins, topics, windows
from timeweave.plans import answer as an
from timeweave.plans import lexical, search
from timeweave.sources import files, tables


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_metrics_of_a_list(spark):
    r = F.array(F.lit(False), F.lit(True), F.lit(True))
    assert value(spark, m.first_rank(r)) == 2
    assert value(spark, m.recall(r, 1)) == 0 and value(spark, m.recall(r, 2)) == 1
    assert value(spark, m.precision(r, 10)) == pytest.approx(2 / 3)
    assert value(spark, m.average_precision(r)) == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert value(spark, m.ndcg(r, 3)) == pytest.approx((0.6309297535714575 + 0.5) / (1 + 0.6309297535714575))
    with pytest.raises(ValueError):
        m.recall(r, 0)


def test_metrics_of_nothing(spark):
    none = F.array().cast("array<boolean>")
    assert [value(spark, f(none)) for f in (m.reciprocal_rank, m.average_precision)] == [0, 0]
    assert value(spark, m.first_rank(none)) is None and value(spark, m.precision(none, 5)) == 0 and value(spark, m.ndcg(none, 5)) == 0


def test_clocks(spark):
    assert value(spark, tm.clock(F.lit(3661.5), ",")) == "01:01:01,500"
    assert value(spark, tm.clock(F.lit(-1.0), ".")) == "00:00:00.000"
    assert value(spark, tm.clock(F.lit(float("nan")), ".")) == "00:00:00.000"
    assert value(spark, tm.stamp(F.lit(3725.9))) == "1:02:05" and value(spark, tm.stamp(F.lit(65.0))) == "01:05"
    assert value(spark, tm.stamp(F.lit(None).cast("double"))) == "--:--"
    assert value(spark, tm.parse_stamp(F.lit("1:02:05"))) == 3725 and value(spark, tm.parse_stamp(F.lit("a:b"))) is None


def test_text_functions(spark):
    assert value(spark, X.estimate_tokens(F.lit("a b c"))) == 4 and value(spark, X.estimate_tokens(F.lit(""))) == 1
    assert value(spark, X.is_indexable(F.lit("StopCoroutine(damageFeedbackCoroutine)")))
    assert not value(spark, X.is_indexable(F.lit("everyonehastherighttofreedomofthought")))
    assert value(spark, X.safe_filename(F.lit(' a<b>:c/d. '), "srt")) == "a b c d.srt" and value(spark, X.safe_filename(F.lit("///"), "md")) == "transcript.md"
    assert value(spark, X.split_sentences(F.lit("One. Two! three? Four."))) == ["One.", "Two! three?", "Four."]
    assert value(spark, X.capitalise(F.lit("let's"))) == "Let's"
    assert value(spark, X.content_type(F.lit("a.MOV"))) == "video/quicktime" and value(spark, X.content_type(F.lit("a.txt"))) == "application/octet-stream"


def test_scope_none_and_empty(spark):
    rows = spark.createDataFrame([(1, "ocr"), (2, "transcript")], "video_id long, kind string")
    assert filters.apply_filters(rows).count() == 2
    assert filters.apply_filters(rows, video_ids=[]).count() == 0
    assert filters.apply_filters(rows, kinds=["ocr"]).count() == 1


def test_repeats_compare_with_the_row_before(spark):
    rows = spark.createDataFrame([(1, 0, "Hi!"), (1, 1, "hi"), (1, 2, "..."), (1, 3, "..."), (1, 4, "HI")], "video_id long, position long, text string")
    assert [r["position"] for r in filters.drop_repeats(rows).orderBy("position").collect()] == [0, 2, 3, 4]


def uniform(spark, n, words="one two three four five six seven eight."):
    return spark.createDataFrame([(1, i, 3.0 * i, 3.0 * i + 3, words) for i in range(n)], "video_id long, position long, start_s double, end_s double, text string")


@pytest.mark.parametrize("n", [1, 2, 7, 120])
def test_chunks_cover_all_segments(spark, n):
    rows = uniform(spark, n)
    for target, longest, overlap in (folds.PARENT, folds.CHILD):
        made = folds.chunk(rows, target, longest, overlap).orderBy("position").collect()
        assert {i for r in made for i in range(r["first"], r["last"] + 1)} == set(range(n))
        assert all(r["end_s"] - r["start_s"] <= longest for r in made)
        assert all(a["first"] < b["first"] for a, b in zip(made, made[1:]))
        if overlap:
            assert all(b["first"] <= a["last"] for a, b in zip(made, made[1:]))


def test_chunks_of_blank_oversized_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 500.0, "long"), (1, 1, 500.0, 501.0, "  "), (1, 2, 501.0, 501.0, "end.")], "video_id long, position long, start_s double, end_s double, text string")
    made = folds.chunk(rows, *folds.CHILD).orderBy("position").collect()
    assert [(r["first"], r["last"]) for r in made] == [(0, 0), (2, 2)]
    assert folds.chunk(rows.limit(0), *folds.CHILD).count() == 0


def test_every_child_has_a_parent(spark):
    rows = folds.two_levels(uniform(spark, 200))
    assert rows.where("level = 'child' and parent_position is null").count() == 0


def test_as_of_clamps_or_not(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 25.0)], "video_id long, t double")
    parents = spark.createDataFrame([(1, 10.0, 0), (1, 20.0, 1)], "video_id long, start_s double, topic_id long")
    got = lambda clamp: [r["found"] for r in joins.as_of(points, parents, F.col("t"), clamp=clamp).orderBy("t").collect()]
    assert got(True) == [0, 0, 1] and got(False) == [None, 0, 1]


def test_best_frame_prefers_overlap_then_nearness(spark):
    hits = spark.createDataFrame([(1, 1, 10.0, 20.0), (2, 1, 100.0, 101.0)], "hit_id long, video_id long, start_s double, end_s double")
    frames = spark.createDataFrame([(1, 1, 0.0, 12.0, 0.0), (2, 1, 12.0, 19.0, 12.0), (3, 1, 95.0, 99.0, 95.0), (4, 1, 103.0, 106.0, 103.0)], "frame_id long, video_id long, start_s double, end_s double, time_s double")
    assert {r["hit_id"]: r["frame_id"] for r in joins.best_frame(hits, frames).collect()} == {1: 2, 2: 4}


def test_frames_are_contiguous(spark):
    samples = spark.createDataFrame([(1, 5.0 * i, 0 if i % 7 else (1 << 20) - 1) for i in range(50)], "video_id long, time_s double, phash long")
    kept = folds.select_frames(samples).orderBy("position").collect()
    assert kept[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(kept, kept[1:])) and kept[-1]["end_s"] == 245.0


def test_planted_topic_boundary(spark):
    rows = [(1, i, 30.0 * i, 30.0 * i + 30, "alpha alpha beta" if i < 20 else "gamma gamma delta", [1.0, 0.0] if i < 20 else [0.0, 1.0]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "video_id long, position long, start_s double, end_s double, text string, embedding array<float>")
    coarse = topics.build_topics(chunks).where("level = 'coarse'").orderBy("topic").collect()
    assert [(r["start_s"], r["end_s"]) for r in coarse] == [(0.0, 600.0), (600.0, 1200.0)]
    assert coarse[0]["title"].startswith("Alpha") and coarse[1]["title"].startswith("Gamma")


def test_short_timelines_have_one_topic(spark):
    chunks = spark.createDataFrame([(1, i, float(i), i + 1.0, "word word", [1.0, 0.0]) for i in range(5)], "video_id long, position long, start_s double, end_s double, text string, embedding array<float>")
    assert topics.build_topics(chunks).where("level = 'fine'").count() == 1


def test_evidence_is_one_a_passage(spark):
    rows = [(1, 1, 10, 7, 5.0, "parent", "child a"), (1, 2, 11, 7, 5.0, "parent", "child b"), (1, 3, 12, 7, None, None, "alone")]
    hits = spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, video_id long, parent_start double, parent_text string, text string")
    assert [(r["chunk_id"], r["marker"], r["evidence"]) for r in windows.dedupe_evidence(hits).orderBy("marker").collect()] == [(10, 1, "parent"), (12, 2, "alone")]


def test_citations(spark):
    text, cited, made_up = an.resolve(F.lit("A [c_1, c_2]. B [c_9] . C [c_1; c_3]"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    assert value(spark, text) == "A [c_1][c_2]. B. C [c_1][c_3]"
    assert value(spark, cited) == [1, 2, 3] and value(spark, made_up) == [9]


def test_uncited_sentences_go(spark):
    body, n = an.strip_uncited(F.lit("Known [c_1]. Guess. Also [c_2]."))
    assert value(spark, body) == "Known [c_1]. Also [c_2]." and value(spark, n) == 1
    assert value(spark, an.strip_uncited(F.lit("Nothing is known."))[0]) == "Nothing is known."
    assert value(spark, an.strip_uncited(F.lit("One. Two."))[0]) == ""


def test_refusal_comes_before_the_model(spark):
    hits = spark.createDataFrame([(1, 1, 5, 9, "t", "Text.", 0.0, "Parent text.", None, None, -4.0)], "query_id long, rank long, chunk_id long, video_id long, title string, text string, parent_start double, parent_text string, on_screen string, topic_title string, rerank_score double")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, text string")

    def never(system, prompt):
        raise AssertionError("asked")

    got = {r["query_id"]: (r["refused"], r["reason"]) for r in an.answer(hits, asked, never).collect()}
    assert got == {1: (True, "not relevant"), 2: (True, "no results")}


def test_fusion_formula(spark):
    lists = spark.createDataFrame([("semantic", 1, 7, 2), ("lexical", 1, 7, 1), ("lexical", 1, 8, 3)], "retriever string, query_id long, chunk_id long, rank int")
    got = {r["chunk_id"]: r["score"] for r in search.fuse(lists).collect()}
    assert got[7] == pytest.approx(1 / 62 + 0.25 / 61) and got[8] == pytest.approx(0.25 / 63)


def test_lexical_phrases_and_exclusions(spark):
    chunks = spark.createDataFrame([(1, "red fox jumps"), (2, "fox red jumps"), (3, "red fox sleeps")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, '"red fox" -sleeps')], "query_id long, text string")
    found = lexical.search(asked, chunks).orderBy("rank").collect()
    assert [(r["chunk_id"], r["pass"]) for r in found] == [(1, 1)]  # a phrase stays one when relaxed


def test_questions_round_trip(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = spark.createDataFrame([("a", "ünïcode?", [(1.0, 2.0)])], "id string, question string, gold_spans array<struct<s:double,e:double>>")
    files.save_questions(rows, path)
    assert files.load_questions(spark, path).first()["gold_spans"][0]["e"] == 2.0
    files.save_questions(rows.unionByName(rows), path)
    with pytest.raises(ValueError):
        files.load_questions(spark, path)


def hybrid_tables(spark):
    rows = [
        (1, 7, "a", "transcript", 0.0, 15.0, "the quick brown fox", [1.0, 0.0]), (2, 7, "a", "ocr", 15.0, 30.0, "lazy dogs", [0.9, 0.1]), (3, 8, "b", "transcript", 0.0, 15.0, "brown foxes run", [0.0, 1.0]),
        (4, 9, None, "transcript", 600.0, 615.0, "quick dogs", None),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, video_id long, parent_id string, kind string, start_s double, end_s double, text string, embedding array<double>")
    videos = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "video_id long, title string")
    parents = spark.createDataFrame([(7, "a", "both", 0.0, 30.0), (8, "b", "one", 0.0, 15.0)], "video_id long, parent_id string, parent_text string, parent_start double, parent_end double")
    return chunks, videos, parents


def test_hybrid_filters_reach_both_retrievers(spark):
    chunks, videos, parents = hybrid_tables(spark)
    asked = spark.createDataFrame([(1, "quick dogs", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    found = lambda **f: sorted(r["chunk_id"] for r in search.hybrid(asked, chunks, videos, **f).collect())
    assert found() == [1, 2, 3, 4]
    assert found(kinds=["ocr"]) == [2] and found(kinds=[]) == [] and found(video_ids=[8]) == [3] and found(window=(500.0, None)) == [4]
    scoped = asked.withColumn("video_ids", F.array(F.lit(9).cast("long")))
    assert [r["chunk_id"] for r in search.hybrid(scoped, chunks, videos).collect()] == [4]
    none = asked.withColumn("video_ids", F.array().cast("array<long>"))
    assert search.hybrid(none, chunks, videos).count() == 0
    rows = {r["chunk_id"]: r for r in search.hybrid(asked, chunks, videos, 10, 30, parents=parents).collect()}
    assert rows[1]["parent_text"] == "both" and rows[4]["parent_text"] is None and rows[4]["semantic_rank"] is None and rows[4]["lexical_rank"] == 1


def test_counters_stand_beside_hits(spark):
    chunks, videos, _ = hybrid_tables(spark)
    asked = spark.createDataFrame([(1, "quick dogs", [1.0, 0.0]), (2, "", None)], "query_id long, text string, embedding array<double>")
    both = search.retrieve(asked, chunks)
    got = {r["query_id"]: r for r in search.counters(asked, both, search.hybrid(asked, chunks, videos, 10, 30, lists=both)).collect()}
    assert (got[1]["semantic_candidates"], got[1]["lexical_candidates"], got[1]["fused_candidates"], got[1]["hits"]) == (3, 3, 4, 4) and got[1]["top_relevance"] == 10.0
    assert (got[2]["fused_candidates"], got[2]["hits"], got[2]["reranked"], got[2]["top_relevance"]) == (0, 0, False, None)


def test_lexical_strict_comes_first_and_words_are_stemmed(spark):
    chunks, _, _ = hybrid_tables(spark)
    asked = spark.createDataFrame([(1, "brown fox"), (2, "dog or run -lazy"), (3, '"brown fox" run')], "query_id long, text string")
    got = {}
    for r in lexical.search(asked, chunks).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["pass"]))
    assert got == {1: [(1, 1), (3, 2)], 2: [(2, 1), (3, 1), (4, 1)], 3: [(1, 2), (3, 2)]}


def test_nearest_keeps_ties_by_id(spark):
    chunks = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(5000)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r["chunk_id"] for r in search.nearest(asked, chunks, 5).collect()) == [1, 2, 4, 5, 7]


def test_items_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta."), (2, "xalpha beta"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, "alpha"), (3, "alpha beta"), (4, "a beta gamma delta."), (5, None)], "item_id long, item string")
    got = sorted((r["item_id"], r["doc_id"], r["at"]) for r in tables.contained(docs, items).collect())
    assert got == [(1, 1, 6), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1), (4, 1, 4)]


def test_white_space_alone_is_no_text(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "\t\n"), (1, 1, 1.0, 2.0, "\n x.\t")], "video_id long, position long, start_s double, end_s double, text string")
    assert [r["text"] for r in folds.chunk(rows, *folds.CHILD).collect()] == ["x."]


def test_unit_and_cosine_of_long_vectors(spark):
    import time

    rows = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    begun = time.perf_counter()
    got = rows.select(V.norm(V.unit(F.col("v"))).alias("n"), V.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert all(r["n"] == pytest.approx(1) and r["c"] == pytest.approx(1) for r in got) and time.perf_counter() - begun < 30
    assert value(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
