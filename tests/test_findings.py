"""What a reviewer found at larger sizes, made small."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from timeweave.functions import bits
from timeweave.llm import op10_jaccard_join as jaccard
from timeweave.operators import joins, topics
from timeweave.plans import best, lexical


@pytest.fixture
def table(spark, tmp_path):
    """Writes a table to a folder of its own; gives the rows of a query and of its SQL there."""

    def run(name, rows, query):
        rows.write.parquet(f"file://{tmp_path}/{name}.parquet")
        frame = entry.queries()[query](spark, f"file://{tmp_path}")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        theirs = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[query]})").fetchall()
        return sorted(map(tuple, frame.collect())), sorted(theirs)

    return run


def test_orders_of_many_lines_keep_all_their_evidence(spark, table):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") % 50)
    ours, theirs = table("lineitem", lines.withColumn("l_linenumber", F.monotonically_increasing_id() % 1000), "w18_evidence")
    assert ours == theirs and max(r[2] for r in ours) > 12


def test_points_of_one_id_are_one(spark, table):
    """A document of over 1000 sentences has points with the ids of the next one's."""
    text = " ".join(f"w{i} w{i * i % 7}." for i in range(1200))
    ours, theirs = table("documents", spark.createDataFrame([(1, text, "a", "en", len(text)), (2, text[3000:], "a", "en", len(text) - 3000)], "doc_id long, text string, source string, lang string, n_chars long"), "j13_snap")
    assert ours == theirs and len({r[0] for r in ours}) == len(ours)


def test_snap_without_parents(spark):
    points = spark.createDataFrame([(1, 1, 2.0, 4.0), (2, 9, 2.0, 4.0)], "pid long, video_id long, start_s double, end_s double")
    parents = spark.createDataFrame([(1, 5, 6.0, 7.0)], "video_id long, parent_id long, start_s double, end_s double")
    assert sorted(map(tuple, joins.snap(points, parents, "pid").collect())) == [(1, 5), (2, None)]


def test_pictures_of_long_texts(spark, tmp_path):
    """The time of a text's pictures grows with its length alone; this one would have taken minutes."""
    import time

    rows = spark.createDataFrame([(1, "ab\ncé𝄞z" * 205_000), (2, "x" * 71), (3, None), (4, "y" * 144), (5, "")], "doc_id long, text string")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    begun = time.perf_counter()
    got = entry.queries()["x7_dhash"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 205_000 * 7 // 72 + 2 and {r["phash"] for r in got if r["doc_id"] == 4} == {"0" * 16}
    grey = [ord(c) for c in ("ab\ncé𝄞z" * 205_000)[72 * 777 : 72 * 778]]
    plain = "".join("1" if grey[9 * r + c + 1] > grey[9 * r + c] else "0" for r in range(8) for c in range(8))
    assert [int(r["phash"], 16) for r in got if r["doc_id"] == 1 and r["n"] == 777] == [int(plain, 2)]
    assert time.perf_counter() - begun < 60


def test_dhash_against_a_plain_version(spark):
    grey = [[(i * j * 37 + i) % 256 for i in range(72)] for j in range(20)]
    got = spark.createDataFrame([(g,) for g in grey], "g array<int>").select(bits.dhash(F.col("g"))).collect()
    for g, (h,) in zip(grey, got, strict=True):
        plain = "".join("1" if g[9 * r + c + 1] > g[9 * r + c] else "0" for r in range(8) for c in range(8))
        assert h % (1 << 64) == int(plain, 2)


def test_large_sets_that_cannot_link_are_not_compared(spark):
    """Few classes of hashes are full in a set of thousands, so its parities said nothing."""
    rng = np.random.default_rng(1)
    made = rng.integers(0, 1 << 63, 9000, np.uint64)
    sets = [made[:3000], made[100:3100], made[1500:4500], made[6000:]]
    rows = [(i, [int(x) for x in jaccard.parities(s)], [int(x) for x in jaccard.parities(s, jaccard.WIDE)]) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "i long, sketch array<long>, wide array<long>")
    both = frame.join(frame.toDF("j", "sketch_b", "wide_b"), F.col("i") < F.col("j"))
    n = F.lit(6000)
    few = jaccard.could_link(F.col("sketch"), F.col("sketch_b"), n, 85, 100)
    many = jaccard.could_link(F.col("wide"), F.col("wide_b"), n, 85, 100, jaccard.WIDE)
    got = {(r["i"], r["j"]): (r["few"], r["many"]) for r in both.select("i", "j", few.alias("few"), many.alias("many")).collect()}
    assert all(few for few, _ in got.values()) and [p for p, (_, many) in got.items() if many] == [(0, 1)]


def test_a_passage_is_one_bucket(spark):
    rows = [(b, r, 9) for b in (1, 2, 3) for r in (10, 20, 30)] + [(4, r, 9) for r in (10, 20)] + [(5, 10, 9)]
    got = jaccard.distinct_buckets(spark.createDataFrame(rows, "bucket long, row long, n long")).collect()
    assert sorted((r["bucket"], r["row"]) for r in got) == [(1, 10), (1, 20), (1, 30), (4, 10), (4, 20)]


def test_a_pair_is_compared_in_one_bucket(spark):
    rows = [(b, r, 9) for b, own in {1: (10, 20), 2: (10, 20, 30), 3: (20, 30, 40), 4: (30, 40)}.items() for r in own]
    got = {(r["bucket"], r["row"]): r for r in jaccard.named_buckets(spark.createDataFrame(rows, "bucket long, row long, n long")).collect()}
    pairs = [(b, r, s) for b, r in got for c, s in got if b == c and r < s and not any(x < got[b, r]["place"] for x in got[b, r]["named"] if x in got[b, s]["named"])]
    assert sorted(pairs) == [(2, 10, 20), (2, 10, 30), (2, 20, 30), (3, 20, 40), (3, 30, 40)]


def test_words_of_topics_are_counted_by_more_tasks_as_chunks_grow(spark, monkeypatch):
    """One stage sorted all words of all texts, in tasks that were dealt by the size of the packed texts."""
    monkeypatch.setattr(topics, "COUNTED", 10)
    rows = [(v, p, 15.0 * p, 15.0 * p + 15, f"alpha{v} beta{p % 3} gamma delta", [1.0, float(p)]) for v in range(8) for p in range(10)]
    chunks = spark.createDataFrame(rows, "video_id long, position long, start_s double, end_s double, text string, embedding array<double>")
    made = topics.build_topics(chunks)
    got = {(r["level"], r["video_id"], r["topic"]): r["keywords"] for r in made.collect()}
    assert len(got) >= 16 and all(words and set(words) <= {f"alpha{v}", "beta0", "beta1", "beta2", "gamma", "delta"} for (_, v, _), words in got.items())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [video_id" in plan and "min(struct(" not in plan


def test_word_search_keeps_what_comes_before_the_bounds(spark, tmp_path):
    """Each task gave out all its best hits, so what was shuffled grew with tasks times queries."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, 12) % 40)) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    index = lexical.write_postings(chunks, f"file://{tmp_path}/index", block=16, folders=16)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{3 * q}") for q in range(1, 12)], "query_id long, text string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert index.rows.rdd.getNumPartitions() >= 16
        got = lexical.search(asked, None, 20, index).select("query_id", "chunk_id", "pass", "score", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = lexical.search(asked, chunks, 20, index).select("query_id", "chunk_id", "pass", "score", "rank").collect()  # one pass over all
    assert sorted(got) == sorted(plain) and len(got) > 100


def test_bounds_of_a_search():
    rng = np.random.default_rng(3)
    distances, ids = rng.integers(0, 9, (5, 400)).astype(float), rng.permutation(400)
    whole = best.Best(5, 10)
    whole.add(distances, ids)
    whole.settle()
    begun = best.Best(5, 10)
    begun.add(distances[:, :300], ids[:300])
    begun.settle()
    last = [(int(q), d, int(i)) for q in range(5) for d, i in [(begun.distance[begun.query == q][-1], begun.id[begun.query == q][-1])]]
    rest = best.Best(5, 10, bounds=best.bounds_of(np.arange(5), last))
    rest.add(distances[:, 300:], ids[300:])
    rest.settle()
    both = sorted([*zip(begun.query, begun.distance, begun.id), *zip(rest.query, rest.distance, rest.id)])
    got = [h for q in range(5) for h in [x for x in both if x[0] == q][:10]]
    assert got == [*zip(whole.query, whole.distance, whole.id)] and len(rest.id) < 50
