"""What is shuffled, read and held by queries that a finding of round 3 names."""

import pickle
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from timeweave.functions.text import counted
from timeweave.operators import filters, folds
from timeweave.plans import approximate, factors, search
from timeweave.queries import load
from timeweave.queries.base import Data
from timeweave.queries.joins import parents
from timeweave.sources import tables

QUERIES = load().QUERIES


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_parents_are_timed_without_texts(spark):
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(parents(Data(spark, SF))))
    assert moved and not any("text#" in columns for columns in moved)


@pytest.mark.parametrize("name", ["f15_frame_texts", "j8_frame_blocks"])
def test_texts_and_not_their_blocks_are_dealt_to_frames(spark, name):
    assert "Generate" not in formatted(QUERIES[name](spark, SF))


def test_screens_of_repeated_and_empty_documents(spark):
    rows = [(1, "alpha beta(1) gamma\ndelta"), (1, "omega x(2);"), (2, ""), (3, None), (None, "nothing=known here"), (4, " ".join(f"w{i}=" for i in range(25)))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    blocks, screens = tables.blocks(documents), tables.screens(documents)
    gathered = blocks.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "n", "text", "confidence"))).alias("b"))
    assert sorted(map(str, screens.collect())) == sorted(map(str, gathered.withColumnRenamed("b", "blocks").collect()))
    assert sorted(map(str, filters.screen_texts(screens).collect())) == sorted(map(str, filters.frame_texts(blocks).collect()))


def test_words_are_counted_in_their_rows(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["x"]), (4, None)], "id long, words array<string>")
    made = counted(rows, "words")
    assert "Exchange" not in formatted(made)
    assert sorted(tuple(r) for r in made.select("id", "word", "n").collect()) == [(1, "a", 1), (1, "b", 3), (3, "x", 1)]
    assert not any("word#" in c for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(QUERIES["x3_topic_words"](spark, SF))))


@pytest.mark.parametrize("stretch", [8, 2048])
def test_levels_of_chunks_are_folded_together(spark, stretch):
    rng = np.random.default_rng(3)
    rows, at = [], 0.0
    for i in range(120):
        at += float(rng.integers(1, 9))
        rows.append((1 + i % 2, i // 2, at, at + float(rng.integers(1, 7)), "Said." if rng.random() < 0.5 else "and so on"))
    segments = spark.createDataFrame(rows, "video_id long, position long, start_s double, end_s double, text string")
    for own, level in zip(folds.chunk_levels(segments, [folds.PARENT, folds.CHILD], stretch), (folds.PARENT, folds.CHILD), strict=True):
        alone = folds.chunk(segments, *level).orderBy("video_id", "position").collect()
        assert own.orderBy("video_id", "position").collect() == alone
        assert [r["position"] for r in alone if r["video_id"] == 1] == list(range(sum(r["video_id"] == 1 for r in alone)))


def test_fitted_embedder_reads_texts_once_and_remembers_words(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(f"word{i % 7} other{i % 5} topic{i}",) for i in range(40)], "text string")
    encode = factors.fit(rows.select(counting("text").alias("text")))
    assert read.value == 40
    encode(["word1 other2"])
    known = encode.counts
    encode(["word3"])
    assert encode.counts is known and len(known.columns) == 3
    assert pickle.loads(pickle.dumps(encode)).counts is None


def test_candidates_are_compared_where_they_are_read(spark, tmp_path, monkeypatch):
    """Nothing is joined but the few hits, and what is found is the nearest of the best by codes."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "chunk_id long, embedding array<float>")
    index = approximate.write_index(rows, f"file://{tmp_path}/index")
    asked = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    handed = []
    near = approximate.near

    def counting(*args):
        handed.append(near(*args))
        return handed[-1]

    monkeypatch.setattr(approximate, "near", counting)
    found = approximate.search(asked, index, 5, ranked=200).collect()
    assert handed[0].count() <= 12 * (5 + approximate.SLACK) and len(found) == 12 * 5
    whole = approximate.search(asked, index, 5, probed=1.0, ranked=600).select("query_id", "chunk_id", "rank")
    exact = search.nearest(asked, rows, 5).select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_a_group_of_videos_shares_its_state():
    import pandas as pd
    from timeweave.streaming.streams import FrameSelector

    class Rows(list):
        exists, get = (lambda self: bool(self)), (lambda self: iter(list(self)))
        appendList, put = list.extend, (lambda self, rows: self.__setitem__(slice(None), rows))

    class Handle:
        def __init__(self):
            self.lists, self.timers = {}, []

        def getListState(self, name, _):
            return self.lists.setdefault(name, Rows())

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, s):
            self.getCurrentWatermarkInMs = lambda: s * 1000

    for group, (a, b) in ((3, (1, 2)), (-1, (None, None))):
        own, handle = FrameSelector(threshold=1), Handle()
        own.init(handle)
        rows = pd.DataFrame({"video_id": [b, a, a], "time_s": [10.0, 20.0, 5.0], "phash": [0, 1, 0]})
        assert list(own.handleInputRows((group,), iter([rows]), Now(0))) == [] and handle.timers == [5001]
        (first,) = own.handleExpiredTimer((group,), Now(15), None)
        (then,) = own.handleExpiredTimer((group,), Now(30), None)
        got = [tuple(None if pd.isna(x) else x for x in r) for f in (first, then) for r in f.itertuples(index=False)]
        assert got == ([(1, 5.0, 0, 0), (2, 10.0, 0, 0), (1, 20.0, 1, 1)] if a else [(None, 5.0, 0, 0), (None, 20.0, 1, 1)])
        assert len(handle.lists["kept"]) == (2 if a else 1)
