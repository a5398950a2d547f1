"""What the queries of round 4's findings leave on disk and send between tasks."""

import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from timeweave.functions.stemmer import stem
from timeweave.functions.text import ENGLISH_STOP_WORDS
from timeweave.plans import answer as an
from timeweave.plans import lexical, search
from timeweave.plans.index import index_timeline
from timeweave.queries import load, retrieval
from timeweave.queries.base import Data
from timeweave.sources import files
from timeweave.sources.scratch import CLEANUP, Store


def stored(spark):
    """Tables in the shared folder, as kind and name."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {(p.parent.name, p.name) for p in root.glob("*/*") if p.is_dir() and any(p.glob("*.parquet"))}


def test_an_index_keeps_one_table_and_files_frames_without_texts(spark):
    data = Data(spark, SF)
    frames = data.videos().select(F.col("video_id").alias("frame_id"), "video_id", (F.col("duration_s") / 2).alias("start_s"), (F.col("duration_s") / 2 + 5).alias("end_s"))
    before = stored(spark)
    made = index_timeline(data.segments(), frames, data.screens())
    assert [name for _, name in stored(spark) - before] == ["spoken"]
    assert spark.conf.get(CLEANUP, None) is None
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # blocks are not a row each
    shown = ["video_id", "kind", "level", "start_s", "end_s", "text", "parent_position", "token_count", "source_id"]
    own = lambda rows: sorted(map(str, rows.select(*shown).collect()))
    assert own(made) == own(index_timeline(data.segments(), frames, data.blocks()))


def test_replaced_rows_are_not_written_beside_the_table_first(spark, tmp_path, monkeypatch):
    kept, keep = [], Store.keep
    monkeypatch.setattr(Store, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    rows = spark.range(100).select((F.col("id") % 10).alias("video_id"), "id")
    for touched in (rows, rows.where("video_id < 5")):
        files.replace_keys(spark, touched.where("id % 2 = 0"), touched, f"file://{tmp_path}/table", buckets=4)
    assert kept == ["keys", "keys"]
    assert files.read_keyed(spark, f"file://{tmp_path}/table").count() == 50


def test_evidence_goes_to_its_questions_once_and_without_what_is_not_shown(spark, monkeypatch):
    """Against the same hits with all their texts."""
    monkeypatch.setattr(retrieval, "COPIES", 1)  # more copies of a passage than one
    data = Data(spark, SF)
    hits, items, texts = retrieval.evidence(data)
    assert not {"text", "parent_text", "quote"} & {*hits.columns, *items.columns}
    near = retrieval.around(data, hits).select("hit_id", "on_screen", "topic_title")
    full = hits.join(near, "hit_id", "left").join(retrieval.plain_chunks(data).select("chunk_id", "text"), "chunk_id").join(retrieval.passages(data), ["video_id", "parent_id"], "left")
    asked = retrieval.asked(data)
    own = an.answer(hits, asked, items=items, texts=texts)
    assert sorted(map(str, own.collect())) == sorted(map(str, an.answer(full, asked).collect()))
    windows = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(an.prompts(texts(items), asked)) == windows(asked)  # texts are not sorted to see how many videos there are


def test_a_text_is_split_once_for_all_queries_paired_with_it(spark):
    texts = ["", None, "One two; two THREE", "no such thing", "\u0130stanbul \u212a 3"]
    asked = ["", "two three four", "three", None, "i k 3 stanbul", "zero " + "two " * 50]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    pairs = queries.crossJoin(chunks.select("chunk_id")).select("query_id", "chunk_id", (F.col("query_id") * 10 + F.col("chunk_id")).alias("fused_rank"))
    made = search.scored_pairs(pairs, queries, chunks)
    plain = pairs.join(queries.withColumnRenamed("text", "question"), "query_id").join(chunks, "chunk_id").select(*pairs.columns, search.rerank_score(F.col("question"), F.col("text")).alias("rerank_score"))
    assert made.columns == plain.columns and sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate [chunk_id")  # texts meet the pairs of a chunk as one row
    data = Data(spark, SF)
    for name in ("m3_rerank", "w20_fused_rank"):
        assert "MapInArrow" in load().QUERIES[name](spark, data.folder)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_by_distinct_words_and_stored_by_shards(spark, tmp_path):
    texts = ["", None, "The and of", "Dogs dog DOGS running", "İx kK 1-b2 a_b 😀z", "w " * 300, "dogs", *[f"word{i % 7} word{i} the dogs" for i in range(60)]]
    for most in (3, 1000):
        coded = lexical.Coded(most)
        got = [(text, found) for at in range(0, len(texts), 5) for text, found in zip(texts[at : at + 5], coded.counted([t or "" for t in texts[at : at + 5]]), strict=True)]
        for text, (n, stems, codes, counts, places) in got:
            words, own = re.findall("[a-z0-9]+", (text or "").lower()), {}
            for place, word in enumerate(words):
                if word not in ENGLISH_STOP_WORDS:
                    own.setdefault(stem(word), []).append(place)
            ends = np.cumsum(counts)
            assert (n, own) == (len(words), {stems[c]: places[e - m : e].tolist() for c, m, e in zip(codes, counts, ends, strict=True)})
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    index = lexical.write_postings(chunks, f"file://{tmp_path}/index", block=8, folders=2)
    assert not any("array" in kind for _, kind in index.packed.dtypes) and index.packed.count() < len(texts) / 4
    rows = {r["chunk_id"]: r for r in index.rows.collect()}
    for i, text in enumerate(texts):
        words = [None if w in ENGLISH_STOP_WORDS else stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        assert rows[i]["words"] == len(words) and sum(rows[i]["counts"]) == len(rows[i]["places"])
        own = iter(rows[i]["places"])
        assert {t: [next(own) for _ in range(n)] for t, n in zip(rows[i]["terms"], rows[i]["counts"], strict=True)} == {t: [p for p, w in enumerate(words) if w == t] for t in words if t}
    for numbers in ([], [0, 255], [256], [65536, 1], [1 << 33]):
        assert lexical.unpack(lexical.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_long_documents_are_searched_first_and_counts_marked_once(spark, tmp_path, monkeypatch):
    texts = {i: " ".join(["dog", "quick", "fox"][i % 3 :] * (1 + i % 40)) for i in range(400)}
    index = lexical.write_postings(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"), f"file://{tmp_path}/index", block=10, folders=1)
    asked = lexical.Asked([(q, 0, n, False, 0, t) for q in range(6) for n, t in enumerate(["dog", "quick", "fox"][q % 3 :])])
    calls, plain = [], lexical.marked
    monkeypatch.setattr(lexical, "marked", lambda counts: calls.append(1) or plain(counts))
    monkeypatch.setattr(lexical, "SCORED", 1)

    def searched(rows):
        task = lexical.Search(asked, 5, 60)
        for batch in rows.toArrow().to_batches():
            task.add_packed(batch)
        best = task.best.settle()
        return task.scored, list(zip(best.query.tolist(), best.id.tolist(), best.distance.tolist(), strict=True))

    shards = index.packed.count()
    (few, first), (many, last) = (searched(index.packed.orderBy(order)) for order in (F.desc("longest"), F.asc("longest")))
    assert first == last and few < many / 2 and len(calls) <= 2 * shards < few + many


def test_lists_and_results_are_found_once(spark):
    """What is read twice is stored, and topics are sought without frames."""
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    data = Data(spark, SF)
    for rows in (retrieval.judged(data), load().QUERIES["c4_counters"](spark, SF)):
        assert "MapInPandas" not in plan(rows)  # the vectors were compared before
    assert "event_type" not in plan(load().QUERIES["c6_concept_context"](spark, SF)) and "events.parquet" not in "".join(load().QUERIES["c6_concept_context"](spark, SF).inputFiles())
