"""Evidence that a text is toxic, learned from labelled documents.

Features of a word are the word, its first 4, 6 and 8 bytes (stems, of which compounds and inflected
forms are made) and the pair that it forms with the word before it. A feature's weight is the log
ratio of the shares of toxic and of other labelled documents that hold it, less ``deviations`` of
its standard deviations, and no less than 0: what is not known to mark toxic texts does not count,
and clean words never outweigh toxic ones. A text's toxicity is the greatest sum of weights in any
``WINDOW`` words in a row, over the whole text.

The cut is set on good labelled documents, each scored as if it had not been counted itself: at most
``loss`` of them (rounded down to whole documents) lie above it. Texts above the cut are toxic.

Features are 64-bit hashes. They are counted in the labelled sample only, within tasks and then by
feature; a stated number of weights at most, the greatest, come to the driver and go to tasks. The
cut is set where texts are scored.

Defined results: null or empty text has toxicity 0. Without labelled documents of both kinds nothing
is toxic. Words are runs of letters and digits in lower case; of scripts without spaces, signs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
SLICE_BYTES = 1 << 18
KINDS = 5  # features of a word
PREFIXES = (4, 6, 8)

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SIGNS = re.compile(r"[^\w]+")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(SLICE_BYTES, _BASE, np.uint64)])
    _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(SLICE_BYTES, pow(_BASE, -1, 1 << 64), np.uint64)])


def fold(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", _SIGNS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_SPACES)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)).view(np.int64)


def word_features(text: str) -> Iterator[np.ndarray]:
    """Arrays of ``KINDS`` rows and a column for each word, for slices of the text; 0 is no feature."""
    data, at, before = fold(text), 0, None
    while at < len(data):
        stop = at + SLICE_BYTES
        if stop < len(data):
            stop = data.rfind(b" ", at, stop) + 1 or stop  # a word beyond a slice's size is cut
        b = np.frombuffer(data[at:stop], np.uint8)
        at = stop
        word = np.r_[False, b != 32, False]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        sums = np.r_[np.uint64(0), np.cumsum((b + np.uint64(1)) * _POWERS[: len(b)])]
        out = np.zeros((KINDS, len(starts)), np.int64)
        whole = (sums[ends] - sums[starts]) * _INVERSES[starts]
        out[0] = _mixed(whole, 1)
        previous = np.r_[whole[:1] if before is None else before, whole[:-1]]
        out[1] = _mixed(previous * np.uint64(0xD6E8FEB86659FD93) + whole, 2)
        if before is None:
            out[1, 0] = 0
        before = whole[-1:]
        for row, size in enumerate(PREFIXES, 2):
            long = np.flatnonzero(ends - starts >= size)
            out[row, long] = _mixed((sums[starts[long] + size] - sums[starts[long]]) * _INVERSES[starts[long]], 2 + row)
        yield out


class Evidence:
    """Weights by feature, and those of texts that were counted themselves and are left out."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, left_out: np.ndarray | None = None):
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]
        self.left_out = self.weights if left_out is None else left_out[order]
        self.seen = np.zeros(1 << 20, bool)  # rules most words out at once
        self.seen[features & 0xFFFFF] = True

    def toxicity(self, text: str, left_out: bool = False) -> float:
        weights = self.left_out if left_out else self.weights
        most, carried = 0.0, np.zeros(0)
        if not len(self.features):
            return most
        for found in word_features(text):
            own = np.zeros(found.shape[1])
            row, column = np.nonzero(self.seen[found & 0xFFFFF])
            if len(row):
                wanted = found[row, column]
                place = np.minimum(np.searchsorted(self.features, wanted), len(self.features) - 1)
                np.add.at(own, column, np.where(self.features[place] == wanted, weights[place], 0.0))
            elif not carried.any():
                carried = own[-WINDOW + 1 :]
                continue
            both = np.concatenate([carried, own])
            sums = np.concatenate([np.zeros(WINDOW), np.cumsum(both)])  # a window may begin before the text
            most = max(most, float((sums[WINDOW:] - sums[:-WINDOW]).max()))
            carried = both[-WINDOW + 1 :]
        return most


def _weights(toxic, other, n_toxic: int, n_other: int, deviations: float):
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return np.maximum(0.0, ratio - deviations * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)))


class Counts:
    """Toxic and other documents that hold each feature, in arrays of bounded size."""

    LIMIT = 1 << 18

    def __init__(self):
        self.parts: list = []
        self.held = 0

    def add(self, text: str, toxic: bool) -> None:
        found = [np.unique(x) for x in word_features(text)]
        if found:
            own = np.unique(np.concatenate(found))
            own = own[own != 0]
            self.parts.append((own, toxic))
            self.held += len(own)

    def full(self) -> bool:
        return self.held > self.LIMIT

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The features and a row of two counts for each."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        features = np.concatenate([own for own, _ in self.parts])
        toxic = np.repeat([t for _, t in self.parts], [len(own) for own, _ in self.parts])
        self.parts, self.held = [], 0
        found, where = np.unique(features, return_inverse=True)
        marked = np.bincount(where, weights=toxic, minlength=len(found)).astype(np.int64)
        return found, np.stack([marked, np.bincount(where, minlength=len(found)) - marked], axis=1)


def fit(counts: DataFrame, n_toxic: int, n_other: int, most: int, deviations: float = 2.0) -> Evidence:
    """The evidence of ``feature, toxic, other``, from so many labelled documents."""
    if not n_toxic or not n_other:
        return Evidence(np.zeros(0, np.int64), np.zeros(0))
    fewer = F.greatest(F.col("other") - 1, F.lit(0)) + 0.5  # as for a document that was counted and is left out
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log(fewer / n_other) - deviations * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / fewer)
    table = counts.where("toxic >= 2").withColumn("weight", weight).where("weight > 0").orderBy(F.desc("weight"), "feature").limit(most).toPandas()
    features, toxic, other = (table[c].to_numpy(np.int64) for c in ("feature", "toxic", "other"))
    # A document only meets features that it holds, so all of them have counted it.
    left_out = _weights(toxic, np.maximum(other - 1, 0), n_toxic, n_other - 1, deviations)
    return Evidence(features, _weights(toxic, other, n_toxic, n_other, deviations), left_out)
