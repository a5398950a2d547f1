"""The training-data operators against plain versions, and their defined results at the edges."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tests.conftest import SF, compare  # noqa: E402
from timeweave.llm import (  # noqa: E402
    op1_token_counts,
    op2_chat_format,
    op3_html_text,
    op4_hamming_search,
    op5_token_records,
    op6_decontaminate,
    op7_license_scan,
    op8_bpe_codec,
    op9_quality,
    op10_jaccard_join,
    queries,
    toxicity,
)
from timeweave.llm.components import components  # noqa: E402
from timeweave.llm.common import Store  # noqa: E402
from timeweave.llm.pieces import cut  # noqa: E402

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", "   ", "'", "'r", "it's we'll 's 'S", "a \n b  \t c\n\n", "é" * 300, "ab" * 500, "你好 мир 12ⅣⅫ", "x<|endoftext|>y", " 　z", "=-" * 50, "\x00\x01", "🙂👍🏽"]
DOCS = "doc_id long, text string, key string, n long, row long, token string, root long, score double"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "lost id"), (99, None), (5, "again"), (5, "again"), (100, "long words here " * 20_000)]
    return spark.createDataFrame([(i, t, "k", 1, 2, "t", 3, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = compare(spark, duck, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs


def test_pieces_join_to_the_text():
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    for text, own in zip(ODD, cut(ODD), strict=True):
        assert own == [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]


def test_op1_counts_as_the_library(edge, empty, library):
    rows = op1_token_counts.token_counts(edge, JSON).collect()
    texts = [r["text"] or "" for r in edge.collect()]
    expected = sorted((r["doc_id"] or -1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for r, t in zip(edge.collect(), texts, strict=True))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert {r["over_limit"] for r in rows} == {True, False}
    assert op1_token_counts.token_counts(empty, JSON).count() == 0


def test_op1_counts_whole_table(spark, documents, library):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.queries()["op1_token_counts"](spark, SF).collect()}
    rows = documents.collect()
    assert got == {r["doc_id"]: len(e.ids) for r, e in zip(rows, library.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True)}


def test_other_vocabularies_are_refused(tmp_path):
    """Settings that the operators do not follow are errors, not other results."""
    import json

    from timeweave.llm import bpe

    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"ignore_merges": True}}]
    for change in changes:
        with pytest.raises(ValueError):
            bpe.check(spec | change)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec | changes[0]), encoding="utf-8")
    for of in (bpe.load, op5_token_records.LibraryEncoder):
        with pytest.raises(ValueError):
            of(str(path))


def test_op1_survives_a_full_transducer(library):
    own = op1_token_counts.CountingTransducer(op1_token_counts.bpe.load(JSON))
    before, op1_token_counts.MAX_STATES = op1_token_counts.MAX_STATES, 50
    try:
        for text in ("".join(random.Random(1).choices("abcdefgh", k=3000)), "the quick brown fox"):
            pieces = next(iter(cut([text])))
            assert sum(map(own.count, pieces)) == len(library.encode(text, add_special_tokens=False).ids)
    finally:
        op1_token_counts.MAX_STATES = before


def test_op2_layouts_become_the_same_turns(spark):
    layouts = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "q", "output": "a"}', '{"instruction": "q", "input": "", "output": "a"}', '{"prompt": "q", "completion": "a"}', '{"response": "a", "prompt": "q"}', '{"odd": 1}', '{"prompt": null, "completion": "a"}',
    ]
    rows = spark.createDataFrame(list(enumerate(layouts)), "id long, j string").withColumn("record", F.parse_json("j"))
    turns = {r["id"]: r["t"] for r in rows.select("id", op2_chat_format.canonical_turns(F.col("record")).alias("t")).collect()}
    assert all([tuple(t) for t in turns[i]] == [("user", "q"), ("assistant", "a")] for i in range(6))
    assert turns[6] is None and [tuple(t) for t in turns[7]] == [("user", ""), ("assistant", "a")]
    made = op2_chat_format.format_records(rows.withColumn("at", F.lit(0)), "id", "at", "record")
    assert made.where("id = 6" if "id" in made.columns else "conv_id = 6").first()["unknown"] == 1


def test_op2_records_with_more_fields(spark):
    layouts = [
        '{"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a"}], "id": 7}', '{"prompt": "q", "completion": "a", "meta": {"x": [1]}}', '{"instruction": "q", "input": "", "output": "a", "source": "s"}',
        '{"conversations": [{"from": "human", "value": "q", "w": 1}, {"from": "gpt", "value": "a"}], "system": null}', '{"system": "s", "instruction": "q", "output": "a"}', '{"messages": []}', '{"messages": [{"content": "no role"}]}', '[1]', '{"messages": 3}',
        '{"messages": [{"role": "user", "content": [{"type": "text"}]}, {"role": "assistant"}], "id": 1}',
    ]
    rows = spark.createDataFrame([*enumerate(layouts), (10, None)], "id long, j string").withColumn("record", F.parse_json("j"))
    got = {r["id"]: r["t"] and [tuple(t) for t in r["t"]] for r in rows.select("id", op2_chat_format.canonical_turns(F.col("record")).alias("t")).collect()}
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(4)), got
    assert got[4] == [("system", "s"), ("user", "q"), ("assistant", "a")] and got[5] == [] and got[6] is got[7] is got[8] is got[10] is None
    assert got[9] == [("user", '[{"type":"text"}]'), ("assistant", "")]
    made = {r["conv_id"]: r for r in op2_chat_format.format_records(rows.withColumn("at", F.lit(0)), "id", "at", "record").collect()}
    assert made[5]["formatted"] == "" and made[5]["unknown"] == 0 and made[6]["unknown"] == 1 and made[10]["unknown"] == 1


def test_op2_long_texts_repeated_rows_and_other_columns(spark):
    long = "word <|x \\ " * 100_000
    rows = spark.createDataFrame([(1, 0, "user", "q", "p", 5), (1, 0, "user", "q", "p", 5), (1, 1, "assistant", long, "p", 5)], "conv_id long, turn long, role string, text string, piece string, n int")
    formatted = op2_chat_format.format_records(op2_chat_format.turn_rows(rows), "conv_id", "turn", "record")
    back = op2_chat_format.digests(op2_chat_format.read_back(formatted)).first()
    assert back["n_turns"] == 3 and back["loss_chars"] == len(long) and back["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_op2_control_strings_come_back(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "\\p<\\p|\\s\\n", "<<||>", "", "a\nb<"]
    rows = spark.createDataFrame([(1, i, "assistant\nx" if i == 1 else "assistant", t) for i, t in enumerate(texts)] + [(None, None, None, None), (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    formatted = op2_chat_format.format_records(op2_chat_format.turn_rows(rows), "conv_id", "turn", "record")
    back = {r["conv_id"]: r["turns"] for r in op2_chat_format.read_back(formatted).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [("assistant\nx" if i == 1 else "assistant", t) for i, t in enumerate(texts)]
    assert [t["loss"] for t in back[1]] == [True, False, True, True, True] and [(t["role"], t["text"]) for t in back[None]] == [("", "")]
    for r in formatted.where("conv_id = 1").collect():
        assert [r["formatted"][t["start"] : t["end"]] for t in r["turns"]] == [t.replace("\\", "\\s").replace("<|", "<\\p") for t in texts]
    digest = {r["conv_id"]: r for r in op2_chat_format.digests(op2_chat_format.read_back(formatted)).collect()}
    loss = "".join(t for i, t in enumerate(texts) if i != 1)
    assert digest[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digest[2]["loss_chars"] == 0
    assert op2_chat_format.format_records(op2_chat_format.turn_rows(rows.limit(0)), "conv_id", "turn", "record").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="wrap"><div id=post><h2>Head &amp; more</h2><p>First, <b>bold</b>text &eacute;.<p>Second&nbsp;one<br>line.<ul><li>item one<li>item two</ul><blockquote>Said.</blockquote>
<script>var x="</p>";</script><div class="advert">Buy</div><form><p>Field</form><p>Last, of all, here.</div><aside>Side</aside><section id="comments"><p>Nice, very nice, so nice, really nice!</section></div><div class="cookie-notice">Cookies</div><footer>&copy;</footer></body></html>"""


def test_op3_keeps_the_article_alone():
    assert op3_html_text.main_text(PAGE) == "Head & more First, boldtext é. Second one line. item one item two Said. Last, of all, here."
    assert op3_html_text.main_text("<p>one <!-- x --> two") == "one two" and op3_html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert op3_html_text.main_text("<nav>only</nav>") == "" and op3_html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_op3_scores_forms_and_doubtful_names_before_cutting():
    """A page that is one form, a text that is one notice, rows of columns, and articles side by side."""
    text = op3_html_text.main_text
    long = "<p>" + "A paragraph of some length, with commas, of the text itself here. " * 5 + "</p>"
    words = len(" ".join(["A paragraph of some length, with commas, of the text itself here."] * 5))
    assert len(text(f"<body><form action=x><div>{long * 3}</div></form></body>")) == 3 * words + 2
    assert text(f"<body><div class=notice>{long * 3}</div><p>Short.</p></body>").startswith("A paragraph")
    assert "Cookies" not in text(f"<body><div class=notice><p>Cookies, here.</p></div><article>{long}</article></body>") and "Name" not in text(f"<body><article>{long}</article><form>Name, please: <input></form></body>")
    row = f"<div class=row><div class=col>{long * 3}</div></div>"
    assert len(text(f"<body>{row * 2}</body>")) == 6 * words + 5
    assert len(text(f"<body><article>{long * 3}</article><article>{long * 2}</article></body>")) == 5 * words + 4


def test_op3_names_of_whole_classes():
    text = op3_html_text.main_text
    for page in ('<div class="site no-sidebar"><p>An article, with text.</p></div>', '<nav>Menu</nav><div class="post comments-enabled"><p>An article, with text.</p></div>', '<div class="left-sidebar"><main><p>An article, with text.</p></main></div>'):
        assert text(page) == "An article, with text."
    assert text('<div id="post"><p>Kept, long enough.</p></div><div class="post-comments"><p>' + "No, no, no, no. " * 50 + "</p></div>") == "Kept, long enough."
    assert text('<div class="comments">all there is</div>') == "all there is"  # no text but in named elements


def test_op3_keeps_text_beside_the_best_container():
    text = op3_html_text.main_text
    assert text("<div><div>First block of it, long.</div><div>Second block.</div></div>") == "First block of it, long. Second block."
    assert text("<body><div><section><p>One, two, three, four.<p>More.</section>bare <b>words</b><section><h4>Head</h4><pre>x  y</pre></section><ul><li><a href=a>Only</a><li><a href=b>links</a></ul></div>") == "One, two, three, four. More. bare words Head x y"
    assert text("<div><table><tr><td>x</table>Line one, of text,<br><br>line two, of text, and more.</div>") == "x Line one, of text, line two, of text, and more."
    assert text("<article><header><h1>Title</h1></header><p>Body.</article><header>Site</header>") == "Title Body."
    assert text("<p>a <math><mi>x</mi><mo>+</mo></math> b<xmp><i>&amp;</i></xmp>") == "a x+ b <i>&amp;</i>"


def test_op3_takes_linear_time():
    import time

    for part, n in (("<ul><li>a", 3000), ("<blockquote><p>x", 3000), ('<a title="x ', 6000), ('<a x=">" ', 20_000), ("<div>", 20_000), ("<", 50_000), ("<table><tr><td>x", 5000), ("<xmp>x</xmp>", 10_000)):
        begun = time.perf_counter()
        op3_html_text.main_text(part * n)
        assert time.perf_counter() - begun < 5, part
    begun = time.perf_counter()
    op3_html_text.main_text("<b>" * 20_000 + "<hr>" * 20_000 + "</i>" * 20_000)
    assert time.perf_counter() - begun < 5


def test_op3_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, "t", 1), (None, None, "", "t", 1), (2, "u", "<p>a b</p>" * 5000, "t", 1), (2, "u", "<p>a b</p>" * 5000, "t", 1)], "page_id long, url string, html string, text string, n_chars long")
    found = op3_html_text.extract(rows).collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in found}
    assert len(found) == 4 and got[1] == got[None] == ("", 0) and got[2][1] == 5000 * 4 - 1
    assert op3_html_text.extract(rows.limit(0)).count() == 0


def test_op3_articles_of_the_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.queries()["op3_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", article)]
        assert r["text"] == " ".join(b for b in blocks if b)


def nearest_codes(known, q, code, k):
    return sorted((sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(code, c, strict=True)), i) for i, c in known if i != q)[:k]


@pytest.mark.parametrize("words", [1, 2])
def test_op4_equals_brute_force(spark, words):
    rnd = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [[rnd.getrandbits(64) for _ in range(words)] for _ in range(5)]
    codes = [(i, [signed(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))) for c in centres[i % 5]]) for i in range(200)] + [(i, [7] * words) for i in range(200, 240)]
    codes += [(None, [5] * words), (300, None), (3, [7] * words)]
    rows = spark.createDataFrame([(*c, "x", 1, 2) for c in codes], "id long, code array<long>, value string, n int, query int")
    got = {}
    for r in op4_hamming_search.search(rows, rows.where("id % 50 = 0"), k=5, bits=64 * words).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    known = [c for c in codes if None not in c]
    for q, code in known:
        if q % 50 == 0:
            assert sorted(got[q]) == nearest_codes(known, q, code, 5)
    assert op4_hamming_search.search(rows.limit(0), rows.limit(0)).count() == 0
    assert op4_hamming_search.search(rows.where("id < 3"), rows.where("id = 0"), bits=64 * words).count() == 2


def test_op4_codes_of_long_vectors_differ(spark):
    rnd = random.Random(6)
    vectors = [[rnd.choice((-1.0, 1.0)) for _ in range(100)] for _ in range(30)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>")
    coded = rows.select("id", op4_hamming_search.sign_code(F.col("v"), 100).alias("code"))
    bits = {r["id"]: r["code"] for r in coded.collect()}
    assert len({tuple(c) for i, c in bits.items() if c}) == 30 and bits[99] is None
    got = {}
    for r in op4_hamming_search.search(coded, coded.where("id < 5"), k=3, bits=100).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    for q in range(5):
        assert sorted(got[q]) == sorted((sum(a != b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in enumerate(vectors) if i != q)[:3]


def test_op5_files_give_the_ids_back(edge, empty, library, spark):
    rows = op5_token_records.digests(spark, edge, JSON).orderBy("start").collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in edge.collect()))
    start = 0
    for r, (has, doc_id, text) in zip(rows, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id if has else None, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert op5_token_records.digests(spark, empty, JSON).count() == 0


def test_op5_equals_the_library_on_the_whole_table(spark, documents, library):
    got = queries.queries()["op5_token_records"](spark, SF).orderBy("start").collect()
    rows, start = documents.orderBy("doc_id").collect(), 0
    for own, row, coded in zip(got, rows, library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False), strict=True):
        ids = [*coded.ids, 2]
        assert (own["doc_id"], own["start"], own["n_tokens"], own["ids_crc32"]) == (row["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5_finds_damage():
    record = op5_token_records.frame(b"payload")
    assert op5_token_records.unframe(record) == b"payload"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            op5_token_records.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (p != t)))
    return min(row)


def test_op6_distance_is_exact():
    rnd = random.Random(5)
    for _ in range(200):
        pattern = bytes(rnd.choices(b"abc", k=rnd.randint(1, 90)))
        text = bytes(rnd.choices(b"abc", k=rnd.randint(0, 120)))
        best, end = op6_decontaminate.Item(1, pattern, 0.1).distance(text)
        assert best == plain_distance(pattern, text) and 0 <= end <= len(text)


def test_op6_finds_all_within_the_budget(spark):
    rnd = random.Random(7)
    item = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(20))
    docs = []
    for i in range(60):
        body = list(item)
        for _ in range(i % 20):
            body[rnd.randrange(len(body))] = rnd.choice("xyz")
        docs.append((i, "Before it. " + "".join(body).upper() + "!! After."))
    docs += [(100, None), (None, item), (101, ""), (101, "other words " * 5000)]
    rows, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None), (3, "short"), (1, item)], "item_id long, text string")
    found = op6_decontaminate.contaminated(rows, tests).collect()
    budget = int(op6_decontaminate.RATE * len(op6_decontaminate.fold(item)))
    frame = lambda t: op6_decontaminate.framed(op6_decontaminate.fold(t))
    expected = {i for i, t in docs if t and plain_distance(frame(item), frame(t)[:400]) <= budget}
    assert {r["doc_id"] for r in found} == expected and len(found) == 2 * len(expected)
    kept = op6_decontaminate.clean(rows, tests)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - expected | {101, 100}
    assert op6_decontaminate.contaminated(rows.limit(0), tests).count() == 0 and op6_decontaminate.clean(rows, tests.limit(0)).count() == len(docs)


def test_op6_finds_exact_copies_of_short_items(spark):
    docs = spark.createDataFrame([(1, "Ask: WHO am I? Then."), (2, "who am ill"), (3, "他说：我是谁？然后"), (4, "swho am i")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "Who am I?"), (8, "我是谁"), (9, "?!"), (None, "who am i")], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"], r["distance"], r["budget"], r["end"]) for r in op6_decontaminate.contaminated(docs, tests).collect()), key=str)
    assert found == [(1, 7, 0, 0, 12), (1, None, 0, 0, 12), (3, 8, 0, 1, 19)]  # signs are words, parted by spaces
    assert {r["doc_id"] for r in op6_decontaminate.clean(docs, tests).collect()} == {2, 4}


def test_op7_edges(spark, edge, empty):
    texts = ["The MIT  License and CC-BY 4.0", "gnu general gnu general public license", "this work is kindly licensed under the gnu general public license, version 3", None, "éMIT licensE", "mit license mit license"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, label string")
    got = {}
    for r in op7_license_scan.scan(rows).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values())
    short = lambda i: (got[i][0]["n_base"], got[i][0]["first_word"], got[i][0]["last_word"], got[i][0]["base_labels"])
    assert short(0) == (2, 1, 4, "cc-by,mit") and short(1) == (1, 2, 2, "gpl") and short(3) == (0, None, None, "") and short(4) == (0, None, None, "") and short(5) == (2, 0, 2, "mit")
    assert "gpl-3.0" in got[2][0]["labels"] and got[3][0]["n_words"] == 0 and got[3][0]["score"] == 0
    assert op7_license_scan.scan(edge).count() == edge.count() and op7_license_scan.scan(empty).count() == 0


def test_op8_round_trip_equals_encode_and_decode(edge, empty):
    two = op8_bpe_codec.decode(op8_bpe_codec.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    one = op8_bpe_codec.round_trip(edge.withColumns({"ids": F.lit(1), "decoded": F.lit(2)}), RANKS, P.PATTERN).collect()
    assert sorted(map(str, two)) == sorted(str(r).replace(", exact=True", "") for r in one)
    assert op8_bpe_codec.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_op8_is_exact_and_reversible(edge, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = op8_bpe_codec.decode(op8_bpe_codec.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    expected = sorted(((r["doc_id"] or -1), own.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in edge.collect())
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in rows) == expected
    assert op8_bpe_codec.encode(empty, RANKS, P.PATTERN).count() == 0


def test_op8_equals_the_library_on_the_whole_table(spark, documents):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    got = queries.queries()["op8_bpe_codec"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op8_backtracks_as_the_merges():
    codec, rnd = op8_bpe_codec.codec(RANKS, P.PATTERN), random.Random(2)
    for _ in range(500):
        data = bytes(rnd.choices(b"etaoinsrh \xc3\xa9", k=rnd.randint(1, 40)))
        assert codec.backtrack(data) == codec.merges.merge(data)


def selected(model):
    return model.rows.select("doc_id", "n_grams", "score", "toxicity", "key", model.is_selected().alias("quality_selected"))


def plain_grams(text):
    """Byte four-grams and word repeats by the definition."""
    data = text.encode()
    grams = [int.from_bytes(data[i : i + 4], "big") * 0x9E3779B1 % (1 << 32) >> 16 for i in range(len(data) - 3)]
    words = data.split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    return grams + [1 << 16] * again + [(1 << 16) + 1] * (len(words) - again)


def test_op9_equals_brute_force(spark):
    """Counts, models, scores, Gumbel keys, k and the sample, in plain Python over the whole table."""
    import math
    from collections import Counter

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = op9_quality.classify(docs, labels)
    got = {r["doc_id"]: r for r in selected(model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = sorted({r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]} - {r["doc_id"] for r in labels.collect() if r["quality"] == 0 or r["toxic"]})
    held = [i for i in good if i * 0x9E3779B97F4A7C15 % (1 << 64) >> 32 <= (1 << 32) // 3]
    grams = {i: plain_grams(t) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, own in grams.items():
        raw.update(own)
        if i in good and i not in held:
            target.update(own)
    size = 1 << 16
    sums = [(sum(c[b] for b in range(size)) + size, c[size] + c[size + 1] + 2) for c in (raw, target)]
    ratio = lambda b: math.log((target[b] + 1) / sums[1][b >= size]) - math.log((raw[b] + 1) / sums[0][b >= size])
    table = {b: ratio(b) for b in raw}
    scores = {i: sum(map(table.__getitem__, own)) / len(own) if own else 0.0 for i, own in grams.items()}
    assert set(got) == set(texts) and all(got[i]["n_grams"] == len(grams[i]) and abs(got[i]["score"] - scores[i]) < 1e-9 for i in texts)
    own = sorted(scores[i] for i in held if i in scores)
    at = 0.002 * (len(own) - 1)
    least = own[int(at)] + (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) * (at - int(at))
    assert abs(model.cut - (min(least, 0.0) - 0.05)) < 1e-9
    noise = {r["doc_id"]: r["u"] for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("u")).collect()}
    keys = {i: scores[i] * 400 - math.log(-math.log((((noise[i] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53))) for i in texts}
    assert all(abs(got[i]["key"] - keys[i]) < 1e-6 for i in texts)
    clean = [i for i in texts if got[i]["toxicity"] <= model.toxic_cut]
    k = sum(scores[i] >= model.cut for i in clean)
    assert {i for i, r in got.items() if r["quality_selected"]} == set(sorted(clean, key=lambda i: -keys[i])[:k]) and k == model.selected


def test_op9_carries_any_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    names = ["quality_score", "quality_of", "own", "key", "of", "score", "hash", "toxicity"]
    wide = docs.select("*", *[F.lit(7.5).alias(n) for n in names])
    kept = op9_quality.keep_good(wide, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == wide.columns and all(r[n] == 7.5 for r in kept.collect() for n in names)


def test_op9_tells_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = selected(op9_quality.classify(docs, shown))
    shares = {(r["quality"], r["toxic"]): r["s"] for r in rows.join(held, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("quality_selected").cast("int")).alias("s")).collect()}
    assert shares[1, 0] >= 0.98 and shares[0, 0] <= 0.15


def test_op9_leaves_out_held_out_toxic_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = selected(op9_quality.classify(docs, labels.where("doc_id % 2 = 0")))
    held = rows.join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").groupBy("toxic").agg(F.avg(F.col("quality_selected").cast("int")).alias("s"))
    shares = {r["toxic"]: r["s"] for r in held.collect()}
    assert shares[1] <= 0.1 and shares[0] >= 0.99


def test_op9_toxicity_reads_whole_texts():
    found = np.concatenate([x[0] for x in toxicity.word_features("one Two « three »\n" * 100_000)])  # over several slices
    words = np.concatenate([x[0] for x in toxicity.word_features("one two three")])
    assert len(set(words)) == 3 and found.tolist() == words.tolist() * 100_000
    evidence = toxicity.Evidence(words[[1]], np.array([2.0]))
    assert evidence.toxicity("clean " * 500_000 + "(TWO)") == 2.0 and evidence.toxicity("two " + "clean " * 70 + "two") == 2.0 and evidence.toxicity("two " + "clean " * 62 + "two") == 4.0
    assert evidence.toxicity("") == 0 and evidence.toxicity("twofold") == 0 and evidence.toxicity("x" * (toxicity.SLICE_BYTES * 2)) == 0


def test_op9_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 0), (4, 0, 0), (4, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        kept = op9_quality.keep_good(edge, own)
        assert kept.columns == edge.columns and kept.count() <= edge.count()
    assert op9_quality.keep_good(edge, labels.limit(0)).count() == edge.count()
    assert op9_quality.keep_good(empty, labels).count() == 0


def test_op9_samples_in_proportion(spark):
    """At a strength of 1 rows far below the cut are drawn in proportion to their weights: three kinds of
    rows of weights 1, 3 and 9, a fiftieth of all."""
    scores = F.log(F.lit(3.0)) * (F.col("id") % 3)
    rows = spark.range(60_000).select((F.col("id") % 3).alias("kind"), (scores + op9_quality.gumbel(F.lit(5), F.col("id"), F.lit(1))).alias("key"))
    least = op9_quality.kth_greatest(rows, "key", 1200)
    n = {r["kind"]: r["count"] for r in rows.where(F.col("key") >= least).groupBy("kind").count().collect()}
    assert sum(n.values()) == 1200
    assert all(abs(n[kind] - 1200 * weight / 13) < 4 * (1200 * weight / 13) ** 0.5 for kind, weight in enumerate((1, 3, 9)))


def test_op9_samples_as_many_as_asked(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sampled = lambda k: selected(op9_quality.classify(documents, labels, k=k, toxic_loss=0.0)).where("quality_selected").count()
    assert sampled(20) == 20 and sampled(0.25) == round(0.25 * documents.count())


def test_op9_toxicity_equals_brute_force(spark):
    """Evidence, scores and cut from counts of plain features, over the labelled documents."""
    import math
    from collections import Counter

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = op9_quality.classify(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic_of = {r["doc_id"]: bool(r["toxic"]) for r in labels.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    words = {i: np.concatenate([f for f in toxicity.word_features(t)] or [np.zeros((5, 0), np.int64)], axis=1) for i, t in texts.items()}
    seen = {i: set(w.ravel().tolist()) - {0} for i, w in words.items()}
    known = [i for i in texts if i in toxic_of]
    a, b = Counter(), Counter()
    for i in known:
        (a if toxic_of[i] else b).update(seen[i])
    na, nb = sum(toxic_of[i] for i in known), sum(not toxic_of[i] for i in known)

    def weight(f, less):
        if a[f] < 2 or math.log((a[f] + 0.5) / (na + 1)) - math.log((max(b[f] - 1, 0) + 0.5) / nb) - 2 * math.sqrt(1 / (a[f] + 0.5) + 1 / (max(b[f] - 1, 0) + 0.5)) <= 0:
            return 0.0
        other, n = (max(b[f] - 1, 0), nb - 1) if less else (b[f], nb)
        return max(0.0, math.log((a[f] + 0.5) / (na + 1)) - math.log((other + 0.5) / (n + 1)) - 2 * math.sqrt(1 / (a[f] + 0.5) + 1 / (other + 0.5)))

    def score(i, less=False):
        each = [sum(weight(f, less) for f in column.tolist() if f) for column in words[i].T]
        return max((sum(each[max(0, j - 63) : j + 1]) for j in range(len(each))), default=0.0)

    assert all(abs(r["toxicity"] - score(r["doc_id"])) < 1e-6 for r in model.rows.collect())
    left = sorted(score(i, True) for i in texts if i in good)
    assert abs(model.toxic_cut - left[math.ceil((len(left) - 1) * 0.998)]) < 1e-6


def test_op9_kth_greatest(spark):
    values = [random.Random(4).gauss(0, 1) for _ in range(500)] + [0.5] * 50
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 200, 550):
        assert op9_quality.kth_greatest(rows, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]


def plain_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 80, 100)])
def test_op10_loses_no_link(spark, k, num, den, monkeypatch):
    rnd = random.Random(k)
    vocabulary = ["".join(rnd.choices("abcde", k=4)) for _ in range(300)]
    texts = []
    for size in (3, 8, 12, 20, 40, 90, 200, 450):
        for _ in range(4):
            base = rnd.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 2, 4, size // 20, size // 12):
                own = list(base)
                for _ in range(edits):
                    own[rnd.randrange(size)] = rnd.choice(vocabulary)
                texts.append(" ".join(own))
    passage = rnd.choices(vocabulary, k=50)
    texts += [" ".join(rnd.choices(vocabulary, k=30) + passage) for _ in range(30)] + ["", None, "  ", "one", "ONE", "two"]
    root, sizes = plain_components(texts, k, num, den)
    rows = spark.createDataFrame([(i, t, 9, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, root long, key string, n long")
    for boundary in (1, 512):  # lists alone, and subsets
        monkeypatch.setattr(op10_jaccard_join, "boundary", lambda *_, b=boundary: b)
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in op10_jaccard_join.join(rows, k, num, den).collect()}
        assert got == {i: (root[i], sizes[i]) for i in range(len(texts))}


def test_op10_keeps_one_of_each(spark, edge, empty):
    edge = edge.withColumns({"_row_id": F.lit(1), "own": F.lit(2), "hash": F.lit(3), "place": F.lit(4)})
    kept = op10_jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert got.count((5, "again")) == 1 and (99, None) in got and (0, "") in got and (None, "lost id") in got
    assert op10_jaccard_join.keep_one(empty).count() == 0
    ids = spark.createDataFrame([(None, "same text of nothing"), (None, "same text of nothing"), (7, "same text of nothing")], "doc_id long, text string")
    assert op10_jaccard_join.keep_one(ids).count() == 1


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (3, 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Store(spark, "chains"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert all(r["round_trip"] for r in out)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    order = sorted(kept)
    root, _ = plain_components([texts[i] for i in order], 5, 80, 100)
    kept = {order[j] for j in range(len(order)) if root[j] == j}
    tests = [op6_decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept -= {i for i in kept if any(t in op6_decontaminate.fold(texts[i]) for t in tests)}
    assert {r["doc_id"] for r in out} == kept


def test_pipeline_tokens_edges(spark, edge, empty):
    import corpus_pipeline

    got = {(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.tokens(spark, edge.withColumn("ids", F.lit(1)), SF).collect()}
    assert (99, 0, True) in got and (0, 0, True) in got and all(r[2] for r in got) and any(r[0] is None for r in got)
    assert corpus_pipeline.tokens(spark, edge, SF).count() == edge.count() and corpus_pipeline.tokens(spark, empty, SF).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_op6_extra_columns_and_blocks(spark, monkeypatch):
    """Items in several blocks, and columns whose names the operator uses."""
    items = [(i, f"item number {i} of the whole set, with words {i * 7919} {i * 104729} of its own to find") for i in range(20)]
    docs = [(i, f"Before. {items[i][1].upper()} After.") for i in range(20)] + [(50, "clean"), (51, None)]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, distance int, item string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op6_decontaminate, "BLOCK_BYTES", 400)
    assert {(r["doc_id"], r["item_id"]) for r in op6_decontaminate.contaminated(rows, tests).where("distance = 0").collect()} == {(i, i) for i in range(20)}
    kept = op6_decontaminate.clean(rows, tests)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {50, 51}


def test_op6_group_filter_loses_nothing(spark):
    """Altered passages against plain distances, at the operator's own rate."""
    rnd = random.Random(11)
    for _ in range(60):
        item = "".join(rnd.choices("abcdef ", k=rnd.randint(1, 160)))
        folded = op6_decontaminate.fold(item)
        if not folded:
            continue
        own = op6_decontaminate.Matcher([(1, item)], op6_decontaminate.RATE)
        body = list(item)
        for _ in range(rnd.randint(0, len(folded) // 8)):
            at = rnd.randrange(len(body))
            body[at : at + rnd.randint(0, 1)] = rnd.choice(["x", "y", ""])
        text = "start " + "".join(body) + " end"
        best = plain_distance(op6_decontaminate.framed(folded), op6_decontaminate.framed(op6_decontaminate.fold(text)))
        assert bool(own.hits(text)) == (best <= int(op6_decontaminate.RATE * len(folded)))


def test_op6_has_one_rule_for_all_items():
    """Short items have a budget, signs of any script fold, and the end of a match may cut a word at the
    cost of an edit."""
    found = lambda item, text: bool(op6_decontaminate.Matcher([(1, item)], op6_decontaminate.RATE).hits(text))
    assert found("What is the capital of France now?", "Tell me: what is the capitol of France now?")
    quoted = "\u201cHe said\u201d \u2014 the \u2018old\u2019 man of the \u201csea\u201d \u2014 that \u201call\u201d was \u201cwell\u201d"
    assert found(quoted, quoted.replace("\u201c", '"').replace("\u201d", '"').replace("\u2014", "-").replace("\u2018", "'").replace("\u2019", "'"))
    assert not found("yes", "yesterday was fine") and found("yes", "Oh, yes.") and found("capital city of it", "the capital city of its")


def test_op6_many_items_with_common_pieces():
    """Items that share most pieces are told apart by their grams; the index changes no result, and the
    time stays small (16 KB of text against 100,000 items took 0.15 s)."""
    import time

    rnd = random.Random(3)
    words = ["what", "is", "the", "name", "of", "first", "city", "in", "which", "people", "lived", "when", "king", "river", "was", "built"]
    items = [(i, " ".join(rnd.choices(words, k=14)) + f" {i * 7919}") for i in range(3000)]
    own = op6_decontaminate.Matcher(items, op6_decontaminate.RATE)
    text = " ".join(rnd.choices(words, k=200)) + " " + items[5][1].upper() + " " + items[77][1].replace("e", "a", 2) + " " + " ".join(rnd.choices(words, k=200))
    got = {h[0] for h in own.hits(text)}
    frame = op6_decontaminate.framed(op6_decontaminate.fold(text))
    near = [(i, t) for i, t in rnd.sample(items, 60) + [items[5], items[77]]]
    assert got >= {5} and all((i in got) == (plain_distance(op6_decontaminate.framed(op6_decontaminate.fold(t)), frame) <= int(0.1 * len(op6_decontaminate.fold(t)))) for i, t in near)
    begun = time.perf_counter()
    own.hits(" ".join(rnd.choices(words, k=3000)))
    assert time.perf_counter() - begun < 20


def test_op7_templates_of_any_length_and_spans(spark):
    whole = next(t for t, label in op7_license_scan.TEXTS if label == "mit-whole-text")
    words = whole.split()
    texts = [
        "Copyright. " + whole.capitalize() + ". End.", " ".join(words[:60]), " ".join(w for i, w in enumerate(words) if i != 80), " ".join(words[:100] + ["really"] + words[100:]),
        "licensed under cc " + "filler " * 30 + "under cc by 4 0",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in op7_license_scan.scan(rows).collect()}
    assert all("mit-whole-text" in got[i] for i in (0, 2, 3)) and "mit-whole-text" not in got[1] and "cc-by-4.0" not in got[4]
