"""The stored indexes of words and of vectors against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from timeweave.functions.stemmer import stem
from timeweave.functions.text import ENGLISH_STOP_WORDS
from timeweave.plans import approximate, lexical, search
from timeweave.queries.base import Data
from timeweave.queries.retrieval import asked, chunks

WORDS = "running runner dogs dog quick quickly fox lazy jumps jumping house houses red green blue the of not".split()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    return {i: " ".join(draw.choices(WORDS, weights=range(len(WORDS), 0, -1), k=draw.choice([0, 1, 3, 10, 60, 300]))) for i in range(300)}


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    rows = spark.createDataFrame([*texts.items(), (999, None)], "chunk_id long, text string")
    return lexical.write_postings(rows, f"file://{tmp_path_factory.mktemp('postings')}/table", block=8, folders=3)


def terms(text):
    return [stem(w) if w not in ENGLISH_STOP_WORDS else None for w in text.split()]


def plain_search(units, texts, limit):
    """``units``: alternatives of (words, negated) lists."""
    found = []
    for i, text in texts.items():
        have = terms(text)

        def tf(words):
            own = [(n, stem(w)) for n, w in enumerate(words) if w not in ENGLISH_STOP_WORDS]
            first = own[0][0]
            return sum(all(at + n - first < len(have) and have[at + n - first] == t for n, t in own) for at in range(len(have)))

        strict, total, out = None, 0, False
        for alternative in units:
            counts = [tf(w) for w, no in alternative if not no]
            gone = any(tf(w) for w, no in alternative if no)
            out, total = out or gone, total + sum(counts)
            if counts and all(counts) and not gone:
                strict = max(strict or 0, sum(counts))
        if strict is not None:
            found.append((1, -strict, i))
        elif total and not out:
            found.append((2, -total, i))
    return [(i, p, -s) for p, s, i in sorted(found)[:limit]]


QUERIES = {
    "dogs": [[(["dogs"], False)]],
    "quick fox lazy": [[(["quick"], False), (["fox"], False), (["lazy"], False)]],
    '"quick fox" red': [[(["quick", "fox"], False), (["red"], False)]],
    '"fox the dog"': [[(["fox", "the", "dog"], False)]],
    "green blue -house": [[(["green"], False), (["blue"], False), (["house"], True)]],
    "blue -red or lazy -jumping": [[(["blue"], False), (["red"], True)], [(["lazy"], False), (["jumping"], True)]],
    "unknown running": [[(["unknown"], False), (["running"], False)]],
    "the of": [[]],
}


@pytest.mark.parametrize("first", [1, 4])
def test_word_search_equals_brute_force(spark, texts, stored, first):
    rows = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {}
    for r in lexical.search(rows, None, 7, stored, first).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["pass"], round(r["score"] * 10)))
    for n, units in enumerate(QUERIES.values()):
        assert got.get(n, []) == plain_search(units, texts, 7), list(QUERIES)[n]


def test_word_search_reads_no_texts_and_skips_shards(spark, texts, stored, monkeypatch):
    """Chunks without a text column are enough, and shards that cannot reach the last hit stay unread."""
    looked, plain = [], lexical.hits

    def seen(wanted, blocks, places):
        looked.append(places.count())
        return plain(wanted, blocks, places)

    monkeypatch.setattr(lexical, "hits", seen)
    rows = spark.createDataFrame([(1, "dogs quick")], "query_id long, text string")
    known = spark.createDataFrame([(i,) for i in texts if i % 2], "chunk_id long")
    got = [r["chunk_id"] for r in lexical.search(rows, known, 5, stored, 2).orderBy("rank").collect()]
    assert got == [i for i, _, _ in plain_search(QUERIES["dogs"][:0] + [[(["dogs"], False), (["quick"], False)]], {i: t for i, t in texts.items() if i % 2}, 5)]
    assert sum(looked) < stored.docs.select("shard").distinct().count() / 2


def test_blocks_are_bounded(stored):
    """A stem of nearly every text has many blocks, none above some small multiple of the block's size."""
    sizes = stored.blocks.groupBy("term").agg(F.max("n").alias("largest"), F.sum("n").alias("n")).collect()
    assert max(r["n"] for r in sizes) > 100 and max(r["largest"] for r in sizes) <= 4 * 8


def test_word_search_keeps_no_table_of_queries_and_shards(spark, texts, stored, monkeypatch):
    """What a search writes has a row a unit or a hit, however many shards there are."""
    kept, plain = {}, lexical.Store.keep

    def seen(self, df, name):
        kept[name] = (out := plain(self, df, name)).count()
        return out

    monkeypatch.setattr(lexical.Store, "keep", seen)
    rows = spark.createDataFrame([(i, "dogs quick fox") for i in range(40)], "query_id long, text string")
    assert lexical.search(rows, None, 5, stored).count() == 200
    assert max(kept.values()) <= 200 and stored.docs.select("shard").distinct().count() > 20


def test_shards_that_hold_nothing_better_are_not_scored(texts, stored):
    asked = lexical.Asked([(1, 0, 0, False, 0, "dog"), (1, 0, 1, False, 0, "quick"), (2, 0, 0, False, 0, "unknown")])
    task = lexical.Search(asked, 5, 2)
    for batch in stored.rows.orderBy("words", "shard", ascending=False).toArrow().to_batches():
        task.add(batch)
    got = [task.best.settle().id[task.best.query == n].tolist() for n in range(2)]
    assert got == [[i for i, _, _ in plain_search([[(["dogs"], False), (["quick"], False)]], texts, 5)], []]
    assert task.scored < stored.docs.select("shard").distinct().count() / 2


@pytest.mark.parametrize("queries", [1, 3])
def test_word_search_in_passes_and_scopes(spark, texts, stored, monkeypatch, queries):
    """Queries in several blocks, each in its own videos, among some of the chunks."""
    monkeypatch.setattr(lexical, "QUERIES", queries)
    chunks = spark.createDataFrame([(i, i % 4) for i in texts if i % 5], "chunk_id long, video_id long")
    scopes = [None, [1, 3], [], [2], [0, 9]]
    rows = spark.createDataFrame([(n, '"quick fox" red', v) for n, v in enumerate(scopes)], "query_id long, text string, video_ids array<long>")
    got = {}
    for r in lexical.search(rows, chunks, 7, stored).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["pass"], round(r["score"] * 10)))
    for n, own in enumerate(scopes):
        seen = {i: t for i, t in texts.items() if i % 5 and (own is None or i % 4 in own)}
        assert got.get(n, []) == plain_search(QUERIES['"quick fox" red'], seen, 7)


def test_best_waits_and_settles():
    draw = np.random.default_rng(2)
    far = draw.integers(0, 50, (6, 4000)).astype(float)
    far[5] = np.inf
    own = search.Best(6, 9, most=100, first=1)
    for at in range(0, 4000, 250):
        own.add(far[:, at : at + 250], np.arange(at, at + 250))
        assert own.waiting <= 100
    own.add(far[:2, :0], np.arange(0), np.array([3, 4]))
    own.settle()
    for q in range(6):
        order = sorted((d, i) for i, d in enumerate(far[q]) if d < np.inf)[:9]
        assert list(zip(own.distance[own.query == q], own.id[own.query == q], strict=True)) == order


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_coded_search_finds_nine_tenths_with_a_quarter_of_the_vectors(spark, folder, tmp_path):
    """Recall of the ten nearest against the exact search, over the whole query set."""
    data = Data(spark, folder)
    rows = chunks(data).select("chunk_id", "embedding").where("embedding is not null")
    index = approximate.write_index(rows, f"file://{tmp_path}/index")
    ranked = None if index.rows.count() > 400 else index.rows.count() // 4
    near = approximate.search(asked(data), index, 10, ranked=ranked).select("query_id", "chunk_id")
    exact = search.nearest(asked(data), rows, 10).select("query_id", "chunk_id")
    shares = approximate.looked_at(asked(data), index, ranked=ranked).agg(F.max("vectors").alias("v"), F.avg("codes").alias("c")).first()
    recall = near.intersect(exact).count() / exact.count()
    assert recall >= 0.9 and shares["v"] <= 0.25 and shares["c"] <= 0.6
    assert index.rows.count() == rows.count()


def test_codes_are_near_their_vectors():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(2000, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    model = approximate.Model(rows[:10], [approximate.codewords(p, 64) for p in (rows[:, :4], rows[:, 4:])])
    file, code = model.encode(rows)
    about = model.products(rows[:5])
    for q in range(5):
        for r in range(100):
            guess = rows[q] @ model.centres[file[r]] + about[q, 0, code[r, 0]] + about[q, 1, code[r, 1]]
            assert abs(guess - rows[q] @ rows[r]) < 0.75
    assert approximate.codewords(np.zeros((3, 4)), 256).shape == (3, 4)


def test_scopes_of_queries():
    own = search.Scopes([None, [3, 5], [], [5]])
    assert own.allow(np.array([3, 4, 5])).tolist() == [[True] * 3, [True, False, True], [False] * 3, [False, False, True]]
    assert search.Scopes([None]).allow(np.array([1])).tolist() == [[True]] and search.Scopes([[]]).allow(np.array([1])).tolist() == [[False]]
