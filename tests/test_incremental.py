"""Streams that restart, writes that replace, digests, model surfaces and question builders against plain versions."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from timeweave.functions import models
from timeweave.functions.models import hashed_words
from timeweave.plans import curation, factors
from timeweave.plans.answer import strip_uncited
from timeweave.plans.index import index_timeline
from timeweave.queries import load
from timeweave.queries.base import Data
from timeweave.sources import files
from timeweave.streaming import streams

BASE = load()


@pytest.fixture
def with_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_catalogue_survives_restarts(spark, tmp_path):
    """Files arrive between runs, some of them copies; each content stands once, with its batch."""
    folder, table, state = tmp_path / "in", f"file://{tmp_path}/catalogue", f"file://{tmp_path}/state"
    folder.mkdir()

    def run():
        streams.stream_catalogue(streams.arriving_files(spark, f"file://{folder}", maxFilesPerTrigger=2), table, state).awaitTermination()
        return sorted((r["checksum"], r["size_bytes"], r["title"]) for r in spark.read.parquet(table).collect())

    def row(text, title):
        return hashlib.sha256(text).hexdigest(), len(text), title

    for name, text in [("a.mp4", b"first"), ("b one.webm", b"second"), ("c.exe", b"no"), ("d.mov", b"")]:
        (folder / name).write_bytes(text)
    assert run() == sorted([row(b"first", "a"), row(b"second", "b one")])
    (folder / "copy.mp4").write_bytes(b"first")
    (folder / "new.mkv").write_bytes(b"third")
    expected = sorted([row(b"first", "a"), row(b"second", "b one"), row(b"third", "new")])
    assert run() == expected and run() == expected


def test_a_batch_that_runs_twice_adds_nothing(spark, tmp_path, monkeypatch):
    """The same batch number with the same files, as after a failure before the commit."""
    rows = spark.createDataFrame([("/in/a.mp4", 5, bytearray(b"first"))], "path string, length long, content binary")
    runs = []

    class Writer:
        def foreachBatch(self, run):
            runs.append(run)
            return self

        def __getattr__(self, name):
            return lambda *a, **k: self

    class Arriving:
        writeStream = Writer()

    path = f"file://{tmp_path}/catalogue"
    streams.stream_catalogue(Arriving(), path, "unused")
    for number in (0, 0, 1):
        runs[0](rows, number)
    assert [(r["batch"], r["title"]) for r in spark.read.parquet(path).collect()] == [(0, "a")]


def test_digests_read_in_steps(spark, tmp_path):
    """A file over 2 GiB with no bytes on disk, and one of several steps."""
    sparse, small = tmp_path / "large.mp4", tmp_path / "small.mp4"
    with open(sparse, "wb") as file:
        file.truncate((2 << 30) + 7)
    small.write_bytes(b"x" * 1000)
    expected = hashlib.sha256()
    for _ in range(512):
        expected.update(bytes(4 << 20))
    expected.update(bytes(7))
    listed = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "length")
    good, _ = files.catalogue(listed)
    got = {r["title"]: (r["size_bytes"], r["checksum"]) for r in good.collect()}
    assert got == {"large": ((2 << 30) + 7, expected.hexdigest()), "small": (1000, hashlib.sha256(b"x" * 1000).hexdigest())}
    odd = spark.createDataFrame([(f"file:{small}",)], "path string")
    assert files.digests(odd, step=7).first()["checksum"] == hashlib.sha256(b"x" * 1000).hexdigest()


def plain_silences(rows, least=20.0):
    out = []
    for v in {r[0] for r in rows}:
        own = sorted(r[2:] for r in rows if r[0] == v)
        out += [(v, a[1], b[0]) for a, b in zip(own, own[1:]) if b[0] - a[1] >= least]
    return sorted(out)


def test_silences_of_shuffled_batches(spark, tmp_path, with_state):
    """Every batch is shuffled within the time that rows may be late; silences come before the end."""
    draw, rows = random.Random(2), []
    for v in (1, 2):
        t = 0.0
        for n in range(60):
            rows.append((v, n, t, t + 5.0))
            t += 5.0 + draw.choice([0.0, 10.0, 25.0])
    rows.sort(key=lambda r: r[2] + draw.uniform(0, 100))
    folder = f"file://{tmp_path}/in"
    schema = "video_id long, position long, start_s double, end_s double"
    for at in range(0, len(rows), 30):
        spark.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(9, 0, 1e6, 1e6)], schema).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = f"file://{tmp_path}/out"
    found = streams.stream_silences(arriving, late="200 seconds")
    q = found.withColumn("at", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r["video_id"], r["start_s"], r["end_s"]) for r in got) == plain_silences(rows)
    assert len({r["at"] for r in got}) > 1


def test_replaced_rows_leave_no_old_ones(spark, tmp_path):
    """Random replacements of a table of two buckets, down to nothing, against a dictionary."""
    draw, path, known = random.Random(4), f"file://{tmp_path}/table", {}
    for _ in range(5):
        keys = draw.sample(range(12), 5)
        new = {k: draw.randrange(4) for k in keys}
        rows = [(k, n) for k in keys for n in range(new[k])]
        known.update(new)
        files.replace_keys(spark, spark.createDataFrame(rows, "video_id long, n long"), spark.createDataFrame([(k,) for k in keys], "video_id long"), path, buckets=2)
        assert sorted(tuple(r) for r in files.read_keyed(spark, path).select("video_id", "n").collect()) == sorted((k, n) for k, many in known.items() for n in range(many))
    files.replace_keys(spark, spark.createDataFrame([], "video_id long, n long"), spark.createDataFrame([(k,) for k in known], "video_id long"), path, buckets=2)
    assert files.read_keyed(spark, path).count() == 0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('[{"n": 1, "question": "What is said here?"}, {"n": 2, "question": "And what is said th', [(0, "What is said here?")]),
        ('[{"n": 1, "question": "What is said here?"}, {"n": 2, "question": "What came after that?"', [(0, "What is said here?"), (1, "What came after that?")]),
        ('```json\n[{"n": 3, "question": "Is  this   fenced, or not?"}]\n``` done', [(2, "Is this fenced, or not?")]),
        ('Sure: [{"n": 1, "question": "SKIP"}, {"n": 2, "question": "Too short"}, {"n": 99, "question": "Out of the range?"}]', []),
        ('[{"n": "2", "question": "A number in quotes?"}]', [(1, "A number in quotes?")]),
        ("no answer", []),
    ],
)
def test_cut_answers_keep_their_questions(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "raw string").select(F.inline(curation.salvage(F.col("raw"), 8))).collect()
    assert [tuple(r) for r in got] == expected


def test_questions_are_those_of_a_plain_builder(spark):
    """Samples, batches, prompts, the stand-in's answers and gold spans, in plain Python."""
    segments = Data(spark, SF).segments().collect()
    by_video = {}
    for r in sorted(segments, key=lambda r: (r["video_id"], r["position"])):
        by_video.setdefault(r["video_id"], []).append(r)
    expected = set()
    for v, own in by_video.items():
        picked = own if len(own) <= 10 else [own[i] for i in sorted({k * len(own) // 10 for k in range(10)})]
        for at in range(0, len(picked), 8):
            part = picked[at : at + 8]
            prompt = "\n".join(f"[{n + 1}] {' '.join(r['text'].split())}" for n, r in enumerate(part))
            for item in json.loads(models.asking("", prompt).strip("`").removeprefix("json")):
                if item["question"] != "SKIP":
                    expected.add((f"gen-{v}-{part[item['n'] - 1]['position']}", item["question"], part[item["n"] - 1]["start_s"]))
    got = BASE.QUERIES["c9_questions"](spark, SF).collect()
    assert {(r["id"], r["question"], r["anchor_s"]) for r in got} == expected and len(got) == len(expected) and not any(r["verified"] for r in got)
    assert all(r["gold_s"] <= r["anchor_s"] <= r["gold_e"] for r in got)


def test_surfaces_equal_plain_functions(spark):
    rows = spark.createDataFrame([(1, "alpha beta. Gamma [c_1]"), (2, ""), (3, None), (4, "one two three four five")], "query_id long, prompt string")
    got = rows.select("query_id", models.embed_documents(F.col("prompt"), batch=2).alias("v"), models.embed_queries(F.coalesce("prompt", F.lit(""))).alias("q")).orderBy("query_id").collect()
    texts = ["alpha beta. Gamma [c_1]", "", "", "one two three four five"]
    assert np.allclose([r["v"] for r in got], hashed_words(texts)) and np.allclose([r["q"] for r in got], hashed_words([models.QUERY_PREFIX + t for t in texts]))
    said = models.complete(rows.where("prompt is not null"), lambda system, prompt: f"{system}: {prompt}", "S", most_tokens=4).orderBy("query_id").collect()
    assert [(r["completion"], r["completion_tokens"], r["truncated"]) for r in said] == [("S: alpha beta. Gamma", 4, True), ("S:", 1, False), ("S: one two three", 4, True)]
    body, removed = strip_uncited(F.col("prompt"))
    assert [tuple(r) for r in spark.createDataFrame([("One thing [c_1]. Another thing. Third [c_2].",), ("Only one",)], "prompt string").select(body, removed).collect()] == [("One thing [c_1]. Third [c_2].", 1), ("Only one", 0)]


def test_fitted_embedder_finds_related_passages(spark):
    """Halves of documents that the embedder was not fitted on: the other half is nearer by its vectors
    than by hashed word counts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    encode = factors.fit(rows.where("doc_id % 3 <> 0"))
    held = [r["text"].split() for r in rows.where("doc_id % 3 = 0").orderBy("doc_id").collect()]
    first, second = [" ".join(w[::2]) for w in held], [" ".join(w[1::2]) for w in held]

    def recall(embed):
        order = np.argsort(-(embed(first) @ embed(second).T), axis=1, kind="stable")
        return np.mean([i in order[i, :1] for i in range(len(held))])

    assert recall(encode) > recall(hashed_words)
    lengths = np.linalg.norm(encode([*first[:5], ""]), axis=1)
    assert np.allclose(lengths, [1] * 5 + [0], atol=1e-5)


def test_index_of_a_stream_is_that_of_a_batch(spark):
    """The table that ``st2_stream_index`` keeps holds what C1 gives for the same videos."""
    data = Data(spark, SF)
    frames = data.videos().select(F.col("video_id").alias("frame_id"), "video_id", (F.col("duration_s") / 2).alias("start_s"), (F.col("duration_s") / 2 + 5).alias("end_s"))
    made = index_timeline(data.segments().where("video_id < 3"), frames, data.blocks()).collect()
    assert {r["video_id"] for r in made} <= {0, 1, 2} and {r["level"] for r in made} == {"child", "parent"}
    parents = {(r["video_id"], r["source_id"]): r for r in made if r["level"] == "parent"}
    for r in made:
        if r["level"] == "child":
            assert np.allclose(r["embedding"], hashed_words([r["text"]])[0], atol=1e-6)
            own = parents.get((r["video_id"], r["parent_position"]))
            middle = r["start_s"] if r["kind"] == "ocr" else (r["start_s"] + r["end_s"]) / 2
            starts = sorted((p["start_s"], n) for (v, n), p in parents.items() if v == r["video_id"])
            before = [n for s, n in starts if s <= middle]
            assert (own["source_id"] if own else None) == (before[-1] if before else None if r["kind"] == "ocr" else starts[0][1])


SAID = [
    "First claim [c_1]. A guess without anything. Second claim [c_2, c_9; c_1] .",
    "Only made up [c_99].",
    "One sentence alone",
    "Guess. Another guess.",
    "(Aside [c_3].) Then more [ c_2 ]. [c_1] starts one.",
]


def plain_answer(hits, said, floor=-3.0, most=12):
    import re

    if not hits:
        return "", True, "no results", [], [], 0
    hits = sorted(hits, key=lambda h: h["rank"])
    if hits[0]["rerank_score"] < floor:
        return "", True, "not relevant", [], [], 0
    passages = []
    for h in hits:
        key = (h["video_id"], round(h["parent_start"], 2)) if h["parent_text"] else h["chunk_id"]
        if key not in passages:
            passages.append(key)
    known = set(range(1, min(len(passages), most) + 1))
    numbers = lambda g: [int(n) for n in re.findall(r"c_(\d+)", g)]
    group = r"\[\s*c_\d+(?:\s*[,;]\s*c_\d+)*\s*\]"
    made_up = [n for g in re.findall(group, said) for n in numbers(g) if n not in known]
    text = re.sub(group, lambda m: "".join(f"[c_{n}]" for n in numbers(m[0]) if n in known), said)
    text = re.sub(r"\s+([.,;:!?])", r"\1", re.sub(" {2,}", " ", text)).strip()
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z(\[])", text) if p.strip()]
    cited = [p for p in parts if re.search(r"\[c_\d+\]", p)]
    body, gone = (text, 0) if len(parts) <= 1 else (" ".join(cited), len(parts) - len(cited))
    return body, body == "", "unsupported" if body == "" else None, sorted({int(n) for n in re.findall(r"\[c_(\d+)\]", body)}), made_up, gone


def test_answers_equal_a_plain_version(spark):
    """Refusals, passages that repeat, citations in groups and made up, sentences without any."""
    from timeweave.plans import answer as an

    draw, rows = random.Random(6), []
    for q in range(40):
        for rank in range(1, draw.choice([0, 1, 4, 15]) + 1):
            parent = draw.choice([None, 0.0, 60.0, 120.001])
            rows.append((q, rank, draw.randrange(50), draw.randrange(2), "t", f"text {rank}", parent, None if parent is None else f"passage {parent}", None, None, draw.choice([-5.0, -1.0, 3.0, 3.0])))
    hits = spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, video_id long, title string, text string, parent_start double, parent_text string, on_screen string, topic_title string, rerank_score double")
    asked = spark.createDataFrame([(q, f"question {q}.") for q in range(40)], "query_id long, text string")
    said = lambda n: SAID[n % len(SAID)]
    texts = list(SAID)

    def model(system, prompt):
        n = int(prompt.split("question ")[1].split(".")[0])
        return texts[n % len(texts)]

    got = {r["query_id"]: (r["answer"], r["refused"], r["reason"], r["citations"], sorted(r["fabricated"]), r["uncited"]) for r in an.answer(hits, asked, model).collect()}
    for q in range(40):
        body, refused, reason, citations, made_up, gone = plain_answer([r.asDict() for r in hits.where(f"query_id = {q}").collect()], said(q)) if q < 12 else (None,) * 6
        if q < 12:
            assert got[q] == (body, refused, reason, citations, sorted(made_up), gone), q
    assert {r[2] for r in got.values()} >= {"no results", "not relevant", "unsupported", None}


def test_sessions_equal_plain_stretches(spark):
    """Every stretch that the watermark has passed, and no other."""
    got = {(r["video_id"], r["start"], r["end"], r["n"]) for r in BASE.QUERIES["st3_stream_sessions"](spark, SF).collect()}
    from datetime import timedelta

    gap, rows = timedelta(hours=6), spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).collect()
    expected = set()
    for user in {r["user_id"] for r in rows}:
        times = sorted(r["ts"] for r in rows if r["user_id"] == user)
        begin, n = times[0], 0
        for t, after in zip(times, [*times[1:], None], strict=True):
            n += 1
            if after is None or after >= t + gap:
                expected.add((user, begin, t + gap, n))
                begin, n = after, 0
    last = max(r["ts"] for r in rows) - timedelta(minutes=10)
    assert got == {e for e in expected if e[2] <= last}
