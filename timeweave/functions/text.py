"""Scalar functions on text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no topic in spoken tutorials.
STOP_WORDS = """
a an and are as at be been but by can cant do does dont for from get gets go going gonna got had has have here how
i if in into is it its just know let lets like ll make makes making me my no not now of off ok okay on one or our out
over re right say see so some something take than that thats the their them then there these they thing things think
this those to too up us use using ve want was we well were what when where which who why will with would yeah yes you
your youre it's that's we're actually basically really very much more most also again
""".split()
# The words that English full-text search leaves out.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()
#: White space at the ends of texts.
WHITE = " \t\n\r\f\v"
# Fixed value: signs that mark code.
CODE_MARKS = "()[]{}.;:=_<>/\\-+*&|!#@$\"'"
# Accepted suffixes and their content types.
CONTENT_TYPES = {
    ".mp4": "video/mp4",
    ".m4v": "video/mp4",
    ".webm": "video/webm",
    ".mov": "video/quicktime",
    ".mkv": "video/x-matroska",
    ".avi": "video/x-msvideo",
    ".mpg": "video/mpeg",
    ".mpeg": "video/mpeg",
}
RUN_ON, SHORTEST_BLOCK = 24, 3


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def word_count(text: Column) -> Column:
    clean = strip(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+")))


def estimate_tokens(text: Column) -> Column:
    """Tokens from words: three words make four, and one is the least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / 0.75)).cast("long")


def ends_sentence(text: Column) -> Column:
    return strip(text).rlike(r"[.!?]['\")\]]*$")


def normalise(text: Column) -> Column:
    """Lower case, and each run of other than a-z and 0-9 one space."""
    return strip(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def topic_words(text: Column) -> Column:
    """Words that may carry a topic, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9'+#-]{1,}"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def counted(words: DataFrame, column: str) -> DataFrame:
    """``words`` with a row for each distinct word of the array ``column``, its ``word`` and ``n``, in its
    place: equal words lie together in the sorted array, so a row's words are counted where they are."""
    others = [c for c in words.columns if c != column]
    ordered = words.where(F.size(column) > 0).select(*others, F.array_sort(column).alias("_w"))
    places = F.sequence(F.lit(0), F.size("_w") - 1)
    first = F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    starts = ordered.select(*others, "_w", first.alias("_first"))
    runs = F.transform("_first", lambda i, k: F.struct(F.get("_w", i).alias("word"), (F.coalesce(F.get("_first", k + 1), F.size("_w")) - i).cast("long").alias("n")))
    return starts.select(*others, F.inline(runs))


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def is_indexable(text: Column) -> Column:
    """Whether a block on screen is worth an index entry: run-together prose is not, code is."""
    clean = strip(text)
    marks = "[" + "".join("\\" + c for c in CODE_MARKS) + "]"
    return (F.length(clean) >= SHORTEST_BLOCK) & (F.contains(clean, F.lit(" ")) | (F.length(clean) <= RUN_ON) | clean.rlike(marks))


def caption(text: Column) -> Column:
    """The lines of a cue, trimmed, without blank ones; an ellipsis if none is left."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    return F.when(joined == "", "…").otherwise(joined)


def safe_filename(title: Column, suffix: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " ")
    clean = strip(F.substring(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), 1, 80))
    return F.concat(F.when(clean == "", "transcript").otherwise(clean), F.lit(f".{suffix}"))


def split_sentences(text: Column) -> Column:
    parts = F.split(strip(text), r"(?<=[.!?])\s+(?=[A-Z(\[])")
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def looks_like_timestamp(text: Column) -> Column:
    return text.rlike(r"\b\d{1,2}:\d{2}(:\d{2})?\b") | text.rlike(r"(?i)\bat\s+\d+\s*(seconds?|minutes?|hours?)\b")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/]+(\.[^./]+)$", 1))


def storage_key(video_id: Column, name: Column) -> Column:
    key = video_id.cast("string")
    return F.concat(F.lit("videos/"), F.substring(key, 1, 2), F.lit("/"), key, F.lit("/source"), F.substring(suffix_of(name), 1, 16))


def content_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, suffix_of(name)), F.lit("application/octet-stream"))


def required(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))
