"""Folds over the rows of a video in order: chunks of speech, and frames worth keeping.

What a fold does with a row depends on all before it, yet a video need not be one task. Videos are cut
in stretches, and each is folded on its own, as if the fold began with it. Then each stretch is told
the state in which the stretch before ended. Folded from there it soon meets a state that it had
reached on its own as well; from there on both folds are the same, and only what lies before is folded
again. A stretch whose end changes by this is told to the next, until nothing changes: a table with a
row a stretch settles that. Results are those of one fold over the whole video.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from math import inf, nextafter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import ends_sentence, estimate_tokens, strip
from timeweave.operators.joins import as_of
from timeweave.sources.scratch import Store

#: Target, longest and overlapping seconds of chunks at the two levels.
PARENT, CHILD = (60.0, 90.0, 0.0), (15.0, 22.0, 3.0)
#: Positions of segments in a stretch, and its seconds of frames.
SEGMENTS, SECONDS = 2048, 7200.0


def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def by_stretch(fold: Callable[[list[tuple]], tuple], schema: pa.Schema, keys: int = 2, at_once: int = 20_000) -> Callable:
    """For mapInArrow over rows sorted by their first ``keys`` columns (video and stretch): these and the
    ``fold`` of each group's rows as a row, given out after so many rows that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        read = 0

        def given() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for key, own in groupby(sorted_rows(batches), key=lambda r: r[:keys]):
            rows = [r[keys:] for r in own]
            made.append((*key, *fold(rows)))
            read += len(rows)
            if read >= at_once:
                yield given()
                made, read = [], 0
        yield given()

    return run


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("video_id", "stretch").sortWithinPartitions("video_id", "stretch", *order)


def settle(first: DataFrame, again: Callable[[DataFrame, int], DataFrame], store: Store) -> DataFrame:
    """``video_id, stretch, items`` of all stretches. ``first`` has (video_id, stretch, exit, items) of
    each folded on its own; ``again`` gives for some (video_id, stretch, entry), and the number of the
    pass, a stored table of the same for those folded from that state, and in ``met`` the key from which
    on their own items hold, null if none does. Items are structs whose first field is their key."""
    order = Window.partitionBy("video_id").orderBy("stretch")
    now, redone, n = first.select("video_id", "stretch", "exit", F.lit(None).cast(first.schema["exit"].dataType).alias("entry")), None, 0
    while True:
        told = now.withColumn("told", F.lag("exit").over(order)).where("told is not null and not (told <=> entry)")
        changed = store.keep(told.select("video_id", "stretch", F.col("told").alias("entry")), f"changed-{n}")
        if changed.isEmpty():
            break
        new = again(changed, n)
        redone = new if redone is None else new.unionByName(redone.join(new, ["video_id", "stretch"], "left_anti"))
        last = new.select("video_id", "stretch", F.col("entry").alias("_entry"), F.col("exit").alias("_exit"))
        joined = now.join(last, ["video_id", "stretch"], "left").select("video_id", "stretch", F.coalesce("_exit", "exit").alias("exit"), F.coalesce("_entry", "entry").alias("entry"))
        now, n = store.keep(joined, f"now-{n}"), n + 1
    if redone is None:
        return first.select("video_id", "stretch", "items")
    key = first.schema["items"].dataType.elementType.fields[0].name
    fixed = redone.select("video_id", "stretch", "met", F.col("items").alias("_items"))
    rest = F.filter("items", lambda x: F.coalesce(x[key] >= F.col("met"), F.lit(False)))
    return first.select("video_id", "stretch", "items").join(fixed, ["video_id", "stretch"], "left").select("video_id", "stretch", F.when(F.col("_items").isNull(), F.col("items")).otherwise(F.concat("_items", rest)).alias("items"))


# Chunks of speech: the state between two stretches is the position at which the next chunk begins.

_CHUNK = "struct<first:long,last:long,start_s:double,end_s:double,text:string,speakers:array<string>>"
_ITEMS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string()), ("speakers", pa.list_(pa.string()))]))
_FOLDED = {"entry": ("long", pa.int64()), "exit": ("long", pa.int64()), "met": ("long", pa.int64()), "short": ("boolean", pa.bool_()), "items": (f"array<{_CHUNK}>", _ITEMS)}
#: The position after the end of a video.
END = (1 << 63) - 1


def take(rows: list[tuple], i: int, target: float, longest: float, overlap: float) -> tuple[int, int, bool]:
    """The end of the chunk that begins at ``i`` (of position, start, end, text, speaker, ends a
    sentence), where the next one begins, and whether the rows' end was felt. The next of the last chunk
    lies at the rows' end."""
    begin, n = rows[i][1], i
    while n < len(rows):
        length = rows[n][2] - begin
        if n > i and length > longest:
            break
        n += 1
        if length >= target and (rows[n - 1][5] or length >= longest):
            break
    felt = n == len(rows)
    if n - i > 1 and not rows[n - 1][5]:  # go back to the last sentence end that leaves enough
        n = next((k + 1 for k in range(n - 2, i, -1) if rows[k][5] and rows[k][2] - begin >= 0.6 * target), n)
    resume = n
    if overlap and n < len(rows):
        edge = rows[n - 1][2] - overlap
        while resume > i + 1 and rows[resume - 1][2] > edge:
            resume -= 1
    return n, resume, felt


def fold_chunks(rows: list[tuple], target: float, longest: float, overlap: float) -> tuple:
    """``entry, exit, met, short, items`` of a stretch: rows are (position, start, end, text, speaker, ends
    a sentence, ahead, own chunk begins, entry), those of the next stretch after its own."""
    own = sum(not r[6] for r in rows)
    entry, items, met, short, i = rows[0][8], [], None, False, 0
    if entry is not None:
        i = next((n for n, r in enumerate(rows) if r[0] >= entry), len(rows))
    exit_ = entry if entry is not None else END
    while i < own:
        if entry is not None and rows[i][7]:
            met = rows[i][0]
            break
        n, resume, felt = take(rows, i, target, longest, overlap)
        part, short = rows[i:n], short or felt
        speakers = sorted({r[4] for r in part if r[4]})
        items.append({"first": part[0][0], "last": part[-1][0], "start_s": part[0][1], "end_s": part[-1][2], "text": " ".join(r[3] for r in part), "speakers": speakers})
        i, exit_ = resume, rows[resume][0] if resume < len(rows) else END
    return entry, None if met is not None else exit_, met, short, items


def chunk(segments: DataFrame, target: float, longest: float, overlap: float, stretch: int = SEGMENTS) -> DataFrame:
    """Chunks of speech: ``video_id, position, start_s, end_s, text, first, last`` (of the segments)``,
    speakers``. Segments may have a ``speaker_id``; their positions count from 0."""
    return chunk_levels(segments, [(target, longest, overlap)], stretch)[0]


def chunk_levels(segments: DataFrame, levels: list[tuple], stretch: int = SEGMENTS, kept: list[Store] | None = None) -> list[DataFrame]:
    """``chunk`` for each of several targets: rows are dealt, sorted and read once for all of them. The stores
    that hold the chunks are added to ``kept``, for callers to close."""
    speaker = F.col("speaker_id") if "speaker_id" in segments.columns else F.lit(None).cast("string")
    rows = segments.where(strip(F.col("text")) != "").select("video_id", F.floor(F.col("position") / stretch).alias("stretch"), F.col("position").cast("long"), "start_s", "end_s", strip(F.col("text")).alias("text"), speaker.cast("string").alias("speaker"), ends_sentence(F.col("text")).alias("ends"))
    own, before = F.struct("stretch", F.lit(False).alias("ahead")), F.struct((F.col("stretch") - 1).alias("stretch"), F.lit(True).alias("ahead"))
    both = rows.withColumn("_of", F.explode(F.when(F.col("stretch") > 0, F.array(own, before)).otherwise(F.array(own)))).withColumns({"stretch": F.col("_of.stretch"), "ahead": F.col("_of.ahead")}).drop("_of")
    store, kept = Store(segments.sparkSession, "stretches", small=True), [] if kept is None else kept
    order = ["video_id", "stretch", "position", "start_s", "end_s", "text", "speaker", "ends", "ahead", "begins", "entry"]

    def folded(rows: DataFrame, levels: list[tuple]) -> DataFrame:
        names = [(f"{c}_{i}", kinds) for i in range(len(levels)) for c, kinds in _FOLDED.items()]
        schema = pa.schema([("video_id", pa.int64()), ("stretch", pa.int64()), *[(c, kind) for c, (_, kind) in names]])
        fold = by_stretch(lambda own: tuple(x for level in levels for x in fold_chunks(own, *level)), schema)
        shape = ", ".join(["video_id long", "stretch long", *[f"{c} {kind}" for c, (kind, _) in names]])
        return dealt(rows.select(*order), ["position"]).mapInArrow(fold, shape)

    none = {"begins": F.lit(False), "entry": F.lit(None).cast("long")}
    first = store.keep(folded(both.withColumns(none), levels).where(F.size("items_0") > 0), "first")
    of = lambda rows, i: rows.select("video_id", "stretch", *[F.col(f"{c}_{i}").alias(c) for c in _FOLDED])
    made = [_settled_chunks(of(first, i), both, lambda rows, level=level: of(folded(rows, [level]), 0), kept) for i, level in enumerate(levels)]
    store.close()
    return [chunk_levels(segments, [level], stretch * 8, kept)[0] if own is None else own for own, level in zip(made, levels, strict=True)]


def _settled_chunks(first: DataFrame, both: DataFrame, folded: Callable[[DataFrame], DataFrame], kept: list[Store]) -> DataFrame | None:
    """The chunks of one level; None if one needs longer stretches."""
    store = Store(first.sparkSession, "chunks", small=True)
    begins = first.select("video_id", "stretch", F.explode("items.first").alias("position")).withColumn("begins", F.lit(True))
    passes = [first]

    def again(changed: DataFrame, n: int) -> DataFrame:
        marked = both.join(changed, ["video_id", "stretch"]).join(begins, ["video_id", "stretch", "position"], "left")
        own = first.select("video_id", "stretch", F.col("exit").alias("_exit"))
        of = folded(marked.withColumn("begins", F.coalesce("begins", F.lit(False)))).join(own, ["video_id", "stretch"])
        passes.append(store.keep(of.withColumn("exit", F.coalesce("exit", "_exit")).drop("_exit"), f"redone-{n}"))
        return passes[-1]

    settled = settle(first, again, store)
    # a chunk that felt the end of the next stretch needs longer ones, if the video goes on
    last = first.groupBy("video_id").agg(F.max("stretch").alias("last"))
    if any(not p.where("short").select("video_id", "stretch").join(last, "video_id").where("stretch + 1 < last").isEmpty() for p in passes):
        store.close()
        return None
    # chunks of a stretch come after those of earlier ones, in the order of its items; most videos have one stretch
    later = settled.where("stretch > 0")
    before = F.sum("n").over(Window.partitionBy("video_id").orderBy("stretch")) - F.col("n")
    counts = settled.join(later.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "stretch", F.size("items").cast("long").alias("n"))
    counts = store.keep(counts.select("video_id", "stretch", before.alias("before")), "before")
    placed = settled.where("stretch <= 0").withColumn("before", F.lit(0).cast("long")).unionByName(later.join(counts, ["video_id", "stretch"]))
    each = placed.select("video_id", "before", F.posexplode("items").alias("n", "c")).select("video_id", (F.col("n") + F.col("before")).alias("position"), "c.*")
    result = store.keep(each, "result")
    store.only("result")
    kept.append(store)
    return result.select("video_id", "position", "start_s", "end_s", "text", "first", "last", "speakers")


def numbered(rows: DataFrame, by: str, width: float) -> DataFrame:
    """``rows`` with ``position``, their number in the video by ``by``: numbers within bins of it are added
    to the counts of earlier bins, a row each."""
    marked = rows.withColumn("_bin", F.floor(F.col(by) / width))
    sizes = marked.groupBy("video_id", "_bin").agg(F.count("*").alias("_n"))
    before = sizes.select("video_id", "_bin", (F.sum("_n").over(Window.partitionBy("video_id").orderBy("_bin")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("video_id", "_bin").orderBy(by)) - 1
    return marked.withColumn("_own", own).join(before, ["video_id", "_bin"]).withColumn("position", (F.col("_own") + F.col("_before")).cast("long")).drop("_bin", "_own", "_before")


def two_levels(segments: DataFrame, kept: list[Store] | None = None) -> DataFrame:
    """Children and parents in one table; each child names the parent that holds its middle. The stores that
    it reads are added to ``kept``."""
    parents, children = chunk_levels(segments, [PARENT, CHILD], kept=kept)
    linked = as_of(children, parents.select("video_id", "start_s", F.col("position").alias("parent")), (F.col("start_s") + F.col("end_s")) / 2, right_id="parent", to="parent_position")
    both = parents.withColumn("parent_position", F.lit(None).cast("long")).withColumn("level", F.lit("parent")).unionByName(linked.withColumn("level", F.lit("child")))
    return both.withColumn("token_count", estimate_tokens(F.col("text"))).withColumn("kind", F.lit("transcript"))


# Frames: the state between two stretches is the time and the hash of the last frame kept.

_STATE = pa.struct([("time_s", pa.float64()), ("phash", pa.int64())])
_FRAMED = pa.schema([("video_id", pa.int64()), ("stretch", pa.int64()), ("entry", _STATE), ("exit", _STATE), ("met", pa.float64()), ("items", pa.list_(pa.struct([("time_s", pa.float64()), ("phash", pa.int64()), ("change", pa.int64())])))])


def fold_frames(rows: list[tuple], least_s: float, most_s: float, threshold: int) -> tuple:
    """``entry, exit, met, items`` of a stretch: rows are (time, hash, kept by itself, entry). The frame at
    which both folds meet is given out with its change from here; what follows it holds."""
    entry = rows[0][3]
    last, items = (entry["time_s"], entry["phash"]) if entry else None, []
    for time, code, kept, _ in rows:
        change = 0
        if last is not None:
            change = ((code ^ last[1]) & (1 << 64) - 1).bit_count()
            if time - last[0] < least_s or (change < threshold and time - last[0] < most_s):
                continue
        last = (time, code)
        items.append({"time_s": time, "phash": code, "change": change})
        if entry and kept:
            return entry, None, nextafter(time, inf), items
    return entry, {"time_s": last[0], "phash": last[1]}, None, items


def select_frames(samples: DataFrame, least_s: float = 4.0, most_s: float = 90.0, threshold: int = 10, stretch: float = SECONDS) -> DataFrame:
    """Frames (video_id, time_s, phash) that differ enough from the last one kept, or come long after
    it: ``video_id, position, start_s, end_s, phash, change``. The spans have no gaps; the last ends
    with the samples."""
    store = Store(samples.sparkSession, "frames")
    rows = samples.select("video_id", F.floor(F.col("time_s") / stretch).alias("stretch"), F.col("time_s").cast("double"), F.col("phash").cast("long"))
    state = "struct<time_s:double,phash:long>"
    shape = f"video_id long, stretch long, entry {state}, exit {state}, met double, items array<struct<time_s:double,phash:long,change:long>>"

    def folded(rows: DataFrame) -> DataFrame:
        fold = by_stretch(lambda own: fold_frames(own, least_s, most_s, threshold), _FRAMED)
        return dealt(rows.select("video_id", "stretch", "time_s", "phash", "kept", "entry"), ["time_s", "phash"]).mapInArrow(fold, shape)

    first = store.keep(folded(rows.withColumns({"kept": F.lit(False), "entry": F.lit(None).cast(state)})), "first")
    kept = first.select("video_id", "stretch", F.inline("items")).select("video_id", "stretch", "time_s", "phash", F.lit(True).alias("kept"))

    def again(changed: DataFrame, n: int) -> DataFrame:
        marked = rows.join(changed, ["video_id", "stretch"]).join(kept, ["video_id", "stretch", "time_s", "phash"], "left")
        own = first.select("video_id", "stretch", F.col("exit").alias("_exit"))
        of = folded(marked.withColumn("kept", F.coalesce("kept", F.lit(False)))).join(own, ["video_id", "stretch"])
        return store.keep(of.withColumn("exit", F.coalesce("exit", "_exit")).drop("_exit"), f"redone-{n}")

    settled = settle(first, again, store).select("video_id", F.inline("items"))
    chosen = store.keep(numbered(settled, "time_s", stretch), "result")
    store.only("result")
    ends = samples.groupBy("video_id").agg(F.max("time_s").alias("end_s"))
    following = chosen.select("video_id", (F.col("position") - 1).alias("position"), F.col("time_s").alias("_next"))
    spans = chosen.join(following, ["video_id", "position"], "left").join(ends, "video_id")
    return spans.select("video_id", "position", F.col("time_s").alias("start_s"), F.coalesce("_next", F.greatest("end_s", "time_s")).alias("end_s"), "phash", "change")


def thin(kept: DataFrame, most: int) -> DataFrame:
    """At most so many frames of a video: the first, the last, and those that changed most."""
    own = Window.partitionBy("video_id")
    inner = (F.col("position") > 0) & (F.col("position") < F.col("_size") - 1)
    ranked = kept.withColumn("_size", F.count("*").over(own)).withColumn("_place", F.row_number().over(Window.partitionBy("video_id", inner).orderBy(F.desc("change"), "position")))
    few = ranked.where((F.col("_size") <= most) | ~inner | (F.col("_place") <= most - 2))
    after = F.lead("start_s").over(own.orderBy("position"))
    return few.withColumn("end_s", F.coalesce(after, "end_s")).drop("_size", "_place")
