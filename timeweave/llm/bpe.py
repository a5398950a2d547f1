"""Byte-level BPE: merge tables, exact merges, and the test that two tokens may stand side by side.

A merge table knows each token's bytes, its id, and the priority of each merge. The tokens of
a text are those that remain when the adjacent pair of best priority is merged again and again.
Two tokens are *compatible* when the merges of their joined bytes give back just these two. A
sequence of tokens is the encoding of its bytes exactly if all neighbours are compatible, and for
every prefix of a text there is exactly one last token whose predecessor chain is compatible.
"""

from __future__ import annotations

import base64
import json

#: Pairs of tokens whose compatibility is remembered.
MAX_PAIRS = 300_000
#: The rank of a pair that does not merge.
NONE = float("inf")


class MergeTable:
    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int] | None, special: dict[str, int]):
        self.ids, self.pairs, self.special = ids, pairs, special
        #: Only tokens that merges can make are ever emitted.
        self.compatible_memo: dict[tuple[bytes, bytes], bool] = {}
        self.tokens = {t for t in ids if self.merge(t) == [t]}

    def rank(self, left: bytes, right: bytes) -> int | None:
        return self.ids.get(left + right) if self.pairs is None else self.pairs.get((left, right))

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of one piece, by the definition. For short pieces and as a reference."""
        parts = [data[i : i + 1] for i in range(len(data))]
        of = lambda i: NONE if (r := self.rank(parts[i], parts[i + 1])) is None else r
        ranks = [of(i) for i in range(len(parts) - 1)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            left, right = parts[i], parts[i + 1]
            while i < len(ranks):
                if ranks[i] == best and parts[i] == left and parts[i + 1] == right:
                    parts[i : i + 2] = [left + right]
                    del ranks[i]
                    if i:
                        ranks[i - 1] = of(i - 1)
                    if i < len(ranks):
                        ranks[i] = of(i)
                i += 1
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        known = self.compatible_memo.get(key)
        if known is None:
            if len(self.compatible_memo) >= MAX_PAIRS:
                self.compatible_memo.clear()
            known = self.compatible_memo[key] = self.merge(left + right) == [left, right]
        return known


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where
    Latin-1 prints it, else the next free code point from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check(spec: dict) -> None:
    """Raises where a vocabulary of the tokenizers library asks for what the operators do not do."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    asks = [name for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(name)]
    flags = [t["content"] for t in spec["added_tokens"] if any(t.get(f) for f in ("single_word", "lstrip", "rstrip", "normalized"))]
    if spec.get("normalizer") or not plain or model.get("type", "BPE") != "BPE" or asks or flags:
        raise ValueError(f"not a plain byte-level vocabulary: normalizer {spec.get('normalizer')}, pre-tokenizer {before}, model {asks}, added tokens {flags}")


def load(path: str) -> MergeTable:
    """A merge table from a ``.json`` of the tokenizers library, or a ``.tiktoken`` of ranks."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        return MergeTable(ids, None, {})
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check(spec)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_bytes = lambda s: bytes(letters[c] for c in s)
    ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return MergeTable(ids, {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}, special)
