"""Fill-in-the-middle, SimHash groups and the Merkle manifest against plain versions, and at their edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tests.conftest import SF
from timeweave.llm import op11_fill_in_middle, op12_simhash_dedup, op13_merkle_manifest, queries
from timeweave.llm.common import Store, join_by_hot_key
from timeweave.llm.components import components

DOCS = "doc_id long, source string, lang string, n_chars long, text string, i int, n int, g string, code long, form string, frames string"
LINES = ["", "a", "\n", "\n\n", "one\ntwo\nthree", "one\ntwo\n", "é\n你好\n🙂 x", "has <P> mark\nb", "ends <", "<S\n<M", "  \n x \r\n", "x" * 200_000, "line of text\n" * 20_000, "日本語" * 40_000 + "\nend"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, "web", "en", len(t), t) for i, t in enumerate(LINES)]
    rows += [(None, None, None, None, None), (None, "b", None, 3, "A b"), (7, "web", "en", 1, "Same Row"), (7, "web", "en", 1, "Same Row"), (-30, "", "", 0, ""), (3, "x", "de", None, "ABC abc")]
    return spark.createDataFrame([(*r, 1, 2, "g", 3, "form", "f") for r in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fim(doc_id, text):
    import re

    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_op11_equals_brute_force(edge, size):
    """Frames of five bytes part code points and marks; the results are the same."""
    rows = edge.collect() if size > 5 else [r for r in edge.collect() if len(r["text"] or "") < 100]
    docs = edge if size > 5 else edge.where("coalesce(length(text), 0) < 100")
    expected = []
    for r in rows:
        n, form, p, m, out = fim(r["doc_id"], r["text"])
        expected.append((r["doc_id"], n, form, p, m, sha(out), sha(r["text"] or "")))
    got = [tuple(r) for r in op11_fill_in_middle.transform(op11_fill_in_middle.store(docs, size=size), size=size).collect()]
    assert Counter(got) == Counter(expected)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_op11_texts_and_their_restoration(edge):
    stored = op11_fill_in_middle.store(edge)
    out = op11_fill_in_middle.texts(stored)
    assert Counter(r["output"] for r in out.collect()) == Counter(fim(r["doc_id"], r["text"])[4] for r in edge.collect())
    back = op11_fill_in_middle.restore(out)
    assert Counter((r["doc_id"], r["restored"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in edge.collect())


def test_op11_rates(documents):
    stored = op11_fill_in_middle.store(documents)
    assert {r["form"] for r in op11_fill_in_middle.transform(stored, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in op11_fill_in_middle.transform(stored, spm=100).collect()}


def test_op11_opens_cut_frames_only():
    """A cut costs the decompression of one frame, wherever it lies."""
    text = b"".join(b"%d line\n" % i for i in range(50_000))
    n, n_chars, frames = op11_fill_in_middle.pack(text, 1024)
    own = op11_fill_in_middle.Frames(n, n_chars, len(text), *[[f[c] for f in frames] for c in ("units", "chars", "data")], 1024)
    opened, plain = [], own.frame
    own.frame = lambda i: opened.append(i) or plain(i)
    for units in (1, 777, 25_000, 49_999):
        opened.clear()
        assert own.cut(units)[0] == len(b"".join(text.split(b"\n")[i] + b"\n" for i in range(units)))
        assert len(opened) == 1


def test_op11_output_without_its_marks_is_an_error():
    with pytest.raises(ValueError):
        list(op11_fill_in_middle.Restorer("psm").stream([b"<P>a<S>b"]))


def plain_print(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, most=3):
    """The least member of each print's group, from all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {p: find(p) for p in prints}


def expected_groups(rows):
    prints = [(r["doc_id"], plain_print(r["text"])) for r in rows]
    group = plain_groups([p for _, p in prints])
    ids = defaultdict(list)
    for doc_id, p in prints:
        ids[group[p]].append(doc_id)
    return Counter((doc_id, f"{p:016x}", min((i for i in ids[group[p]] if i is not None), default=None)) for doc_id, p in prints)


def test_op12_equals_brute_force_at_the_edges(edge):
    assert Counter(tuple(r) for r in op12_simhash_dedup.digests(edge).collect()) == expected_groups(edge.collect())
    assert op12_simhash_dedup.digests(edge.limit(0)).count() == 0


def test_op12_whole_table(spark, documents):
    assert Counter(tuple(r) for r in queries.queries()["op12_simhash_dedup"](spark, SF).collect()) == expected_groups(documents.collect())


def test_op12_long_texts_carry_their_counts():
    text = " ".join(f"w{i % 977} v{i}" for i in range(40_000))
    assert op12_simhash_dedup.fingerprint(text.encode()) % (1 << 64) == plain_print(text)


@pytest.mark.parametrize(("most", "segments"), [(5, 2)])
def test_op12_groups_of_codes_equal_all_pairs(spark, most, segments):
    """Dense clusters around a few centres: chains of links, large buckets, several rounds of pivots."""
    draw = random.Random(most * 10 + segments)
    codes = {0, -1}
    for centre in (0, draw.getrandbits(64), draw.getrandbits(64)):
        for _ in range(60):
            code = centre
            for bit in draw.choices(range(64), k=draw.randrange(7)):
                code ^= 1 << bit
            codes.add(code - (1 << 64) if code >> 63 else code)
    store = Store(spark, "test")
    rows = store.keep(spark.createDataFrame([(c,) for c in codes], "code long"), "codes")
    moved = {r["node"]: r["root"] for r in op12_simhash_dedup.group_codes(rows, store, most, segments).collect()}
    own = lambda c: c % (1 << 64)
    theirs = plain_groups([own(c) for c in codes], most)
    together = lambda of: {frozenset(x) for x in of}
    a, b = defaultdict(set), defaultdict(set)
    for c in codes:
        a[moved.get(c, c)].add(c)
        b[theirs[own(c)]].add(c)
    assert together(a.values()) == together(b.values())
    store.close()


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3])], "k long, i long")
    lookup = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (3, 1, "c")], "k long, n long, v string")
    got = join_by_hot_key(rows, lookup, "k", "n", share=4).collect()
    assert sorted((r["i"], r["v"]) for r in got) == [(i, "a" if i < 50 else "b" if i < 53 else "c") for i in range(54)]


def test_long_chains_are_one_component(spark):
    store = Store(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components(links, store, "chain").collect()} == {0}
    store.close()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity=8):
    """Rows of (doc_id, leaf, subroot, root, proof, folded root, verified), all trees in plain lists."""

    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % arity : i - i % arity + arity]
            out.append((run[: i % arity], run[i % arity + 1 :]))
            i //= arity
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, doc_id, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], i) + path(top, k)
            now = own
            if known and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r["text"] is not None:
                now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for before, after in steps:
                now = H(*before, now, *after)
            proof = H(*[x for before, after in steps for x in before + after])
            out.append((r["doc_id"], own, trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def test_op13_equals_brute_force_at_the_edges(edge):
    assert Counter(tuple(r) for r in op13_merkle_manifest.digests(edge).collect()) == Counter(plain_manifest(edge.collect()))
    assert op13_merkle_manifest.digests(edge.limit(0)).count() == 0


def test_op13_one_row_is_its_own_root(edge):
    row = op13_merkle_manifest.digests(edge.where("doc_id = 3 and lang = 'de'")).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H("")


@pytest.mark.parametrize("arity", [2])
def test_op13_other_arities(spark, documents, arity):
    """Binary trees find siblings by exclusive or; proofs fold to the root for untouched rows alone."""
    rows = op13_merkle_manifest.manifest(documents, arity=arity)
    fold = op13_merkle_manifest.fold
    got = rows.select("root", fold(rows["leaf"], rows["path"]).alias("own"), fold(rows["tampered"], rows["path"]).alias("other"), (rows["tampered"] == rows["leaf"]).alias("same")).collect()
    expected = plain_manifest(documents.collect(), arity)[0][3]
    assert len(got) == documents.count() and {bytes(r["root"]).hex() for r in got} == {expected}
    assert all(r["own"] == r["root"] for r in got)
    assert all((r["other"] == r["root"]) == r["same"] for r in got if r["other"] is not None)


def test_op13_many_groups(spark):
    """More groups than the arity: the upper tree has levels of its own."""
    rows = spark.createDataFrame([(i, "s", f"l{i % 70:02}", i, f"Text {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(tuple(r) for r in op13_merkle_manifest.digests(rows).collect()) == Counter(plain_manifest(rows.collect()))


def test_few_links_are_contracted_without_star_steps(spark):
    import random

    links = [(i, i + 1) for i in range(0, 400) if i % 40 != 39] + [(-5, 3), (7, 7)]
    random.Random(5).shuffle(links)
    want = {i: i // 40 * 40 for i in range(400) if i % 40} | {i: -5 for i in range(40)} | {400: 400}
    want = {k: v for k, v in want.items() if k != v}
    for held, steps in ((100_000, 2), (7, None)):  # the second: many at a time in no task, so star steps go on
        store, made = Store(spark, "few"), []
        store.keep = lambda df, name, made=made, store=store: (made.append(name), Store.keep(store, df, name))[1]
        frame = spark.createDataFrame(links, "a long, b long").repartition(3)
        assert {r["node"]: r["root"] for r in components(frame, store, "few", held).collect()} == want
        assert steps is None or len(made) == steps


def test_unknown_pieces_go_to_the_librarys_model_alone():
    import public_tokenizers
    from timeweave.llm.op5_token_records import LibraryEncoder

    own = LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " a  b\n\n", "don't 12345 é中文\U0001f600 \0\x7f", "x" * 5000, "́‍'ll '"]
    want = [own.pack([*own.tokenizer.encode(t, add_special_tokens=False).ids, 2]) for t in texts]
    own.tokenizer = None
    assert own.encode(texts, 2) == want


def test_pieces_that_come_again_are_encoded_once():
    import public_tokenizers
    from timeweave.llm.op8_bpe_codec import Codec

    own = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    made, own.packed.make = [], lambda piece: made.append(piece) or b""
    for _ in range(2):
        for at in range(0, 150_000, 500):
            own.encode("".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(at, at + 500)))
    assert len(made) == len(set(made)) == 150_000


def test_merges_of_the_same_bytes_in_two_ways():
    from timeweave.llm.bpe import MergeTable

    table = MergeTable({t: i for i, t in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"aa"])}, None, {})
    assert table.merge(b"abcbcab") == [b"abc", b"bc", b"ab"] and table.merge(b"aaaaa") == [b"aa", b"aa", b"a"]
