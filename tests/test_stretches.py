"""Folds and as-of joins that cut a video in stretches, against one plain pass over it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.operators import folds, topics
from timeweave.operators.joins import as_of

SEGMENTS = "video_id long, position long, start_s double, end_s double, text string, speaker_id string"


def plain_chunks(rows, target, longest, overlap):
    """Of (position, start, end, text, speaker) rows."""
    ends = lambda r: r[3].rstrip("'\")]").endswith((".", "!", "?"))
    out, i = [], 0
    while i < len(rows):
        n = i
        while n < len(rows) and not (n > i and rows[n][2] - rows[i][1] > longest):
            n += 1
            span = rows[n - 1][2] - rows[i][1]
            if span >= target and (ends(rows[n - 1]) or span >= longest):
                break
        if n - i > 1 and not ends(rows[n - 1]):
            for k in range(n - 2, i, -1):
                if ends(rows[k]) and rows[k][2] - rows[i][1] >= 0.6 * target:
                    n = k + 1
                    break
        part = rows[i:n]
        out.append((part[0][0], part[-1][0], part[0][1], part[-1][2], " ".join(r[3] for r in part), sorted({r[4] for r in part if r[4]})))
        if n == len(rows):
            break
        j = n
        if overlap:
            while j > i + 1 and rows[j - 1][2] > rows[n - 1][2] - overlap:
                j -= 1
        i = j
    return out


def random_segments(seed, videos=3, step=1):
    draw, rows = random.Random(seed), []
    for v in range(videos):
        t = 0.0
        for n in range(draw.choice([1, 40, 300])):
            length = draw.choice([0.0, 0.5, 2.0, 4.0, 30.0, 120.0][: draw.choice([3, 4, 6])])
            rows.append((v, n * step, t, t + length, "word" + draw.choice(["", "", ".", "?\")"]), draw.choice([None, "b", "a"])))
            t += length + draw.choice([0.0, 0.0, 1.0])
    return rows


@pytest.mark.parametrize(("seed", "stretch", "step"), [(1, 5, 1), (3, 64, 7)])
@pytest.mark.parametrize("level", [folds.PARENT, folds.CHILD])
def test_chunks_of_stretches_equal_one_fold(spark, seed, stretch, step, level):
    rows = random_segments(seed, step=step)
    got = folds.chunk(spark.createDataFrame(rows, SEGMENTS), *level, stretch=stretch).orderBy("video_id", "position").collect()
    expected = [(v, n, *c) for v in range(3) for n, c in enumerate(plain_chunks([r[1:] for r in rows if r[0] == v], *level))]
    assert [(r["video_id"], r["position"], r["first"], r["last"], r["start_s"], r["end_s"], r["text"], r["speakers"]) for r in got] == expected


def plain_frames(rows, least_s=4.0, most_s=90.0, threshold=10):
    kept = []
    for t, h in sorted(rows):
        change = (((h ^ kept[-1][1]) & (1 << 64) - 1).bit_count()) if kept else 0
        if not kept or (t - kept[-1][0] >= least_s and (change >= threshold or t - kept[-1][0] >= most_s)):
            kept.append((t, h, change))
    return kept


@pytest.mark.parametrize(("seed", "stretch"), [(1, 20.0), (2, 100.0)])
def test_frames_of_stretches_equal_one_fold(spark, seed, stretch):
    draw = random.Random(seed)
    rows = []
    for v in range(3):
        code, t = draw.getrandbits(63), 0.0
        for _ in range(draw.choice([3, 200, 600])):
            t += draw.choice([0.0, 0.5, 1.0, 5.0])
            for bit in draw.sample(range(63), draw.choice([0, 0, 1, 4, 20])):
                code ^= 1 << bit
            rows.append((v, t, code))
    got = folds.select_frames(spark.createDataFrame(rows, "video_id long, time_s double, phash long"), stretch=stretch).orderBy("video_id", "position").collect()
    kept = [(v, n, *f) for v in range(3) for n, f in enumerate(plain_frames([r[1:] for r in rows if r[0] == v]))]
    assert [(r["video_id"], r["position"], r["start_s"], r["phash"], r["change"]) for r in got] == kept
    last = {v: max(t for w, t, _ in rows if w == v) for v in range(3)}
    following = {(v, n): t for v, n, t, _, _ in kept}
    assert all(r["end_s"] == following.get((r["video_id"], r["position"] + 1), last[r["video_id"]]) for r in got)


def test_one_video_of_a_million_rows_is_several_tasks(spark):
    """The as-of join deals one video to bins: no task has all its rows, and the result is that of a
    plain search."""
    left = spark.range(1_000_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 3.0).alias("t"), F.lit("payload").alias("text"))
    right = spark.range(30_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 100.0 + 50).alias("start_s"), F.col("id").alias("topic_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = as_of(left, right, F.col("t"))
        wrong = found.where(F.col("found") != F.greatest(F.lit(0), F.least(F.lit(29_999), F.floor((F.col("t") - 50) / 100))))
        assert found.count() == 1_000_000 and wrong.count() == 0
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 600_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("clamp", [True, False])
def test_as_of_equals_a_plain_search(spark, clamp):
    draw = random.Random(5)
    right = [(v, draw.choice([1.0, 2.0, 700.0, 5000.0, 9000.0]), n) for v in (1, 2) for n in range(4)]
    left = [(v, draw.choice([None, 0.0, 1.0, 650.0, 700.0, 4000.0, 20_000.0])) for v in (1, 2, 3) for _ in range(20)]
    got = as_of(spark.createDataFrame(left, "video_id long, t double"), spark.createDataFrame(right, "video_id long, start_s double, topic_id long"), F.col("t"), clamp=clamp).collect()

    def plain(v, t):
        own = sorted((s, i) for w, s, i in right if w == v)
        before = [i for s, i in own if t is not None and s <= t]
        return before[-1] if before else own[0][1] if clamp and own and t is not None else None

    key = lambda x: tuple((a is None, a or 0) for a in x)
    assert sorted(((r["video_id"], r["t"], r["found"]) for r in got), key=key) == sorted(((v, t, plain(v, t)) for v, t in left), key=key)


@pytest.mark.parametrize("stretch", [3, 1000])
def test_coherence_of_stretches_equals_a_plain_pass(spark, stretch):
    draw = np.random.default_rng(stretch)
    rows = [(v, 10 * n, float(n), draw.normal(size=5).tolist() if n % 5 else [0.0] * 5) for v, many in ((1, 1), (2, 4), (3, 30)) for n in range(many)]
    got = topics.coherence(spark.createDataFrame(rows, "video_id long, position long, start_s double, embedding array<double>"), stretch=stretch).collect()
    expected = {}
    for v in (1, 2, 3):
        units = [np.array(e) / (np.linalg.norm(e) or 1) for w, _, _, e in rows if w == v]
        for i in range(len(units) - 1):
            a, b = np.mean(units[max(0, i - 3) : i + 1], axis=0), np.mean(units[i + 1 : i + 5], axis=0)
            expected[v, 10 * i] = (i + 1.0, len(units), float(a @ b) / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))
    assert {(r["video_id"], r["position"]) for r in got} == set(expected) and len(got) == len(expected)
    assert all(np.allclose((r["next_start"], r["n"], r["coherence"]), expected[r["video_id"], r["position"]]) for r in got)


def test_spacing_by_chains_equals_one_greedy_pass(spark):
    draw = random.Random(8)
    rows, expected = [], set()
    for v in range(4):
        times = sorted(draw.sample(range(0, 20_000, 7), 120))
        found = [(draw.choice([0.5, 0.7, 0.9, 1.1]), n, float(t)) for n, t in enumerate(times)]
        rows += [("fine", 120.0, v, n, t, d) for d, n, t in found]
        kept = []
        for d, n, t in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(abs(t - o) >= 120 for _, o in kept):
                kept.append((n, t))
        expected |= {(v, n) for n, _ in kept}
    frame = spark.createDataFrame(rows, "level string, least_s double, video_id long, position long, next_start double, depth double")
    assert {(r["video_id"], r["position"]) for r in topics.spaced(frame).collect()} == expected
