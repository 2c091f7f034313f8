"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns of the whole corpus estimates how accurate each labeller is;
the posterior label of each pattern then trains a linear scorer on hashed features, which
decides every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, grams, map_arrow, mix, prefix, span_hash, texts, windows, with_fields, words

BINS, SAMPLE_ROWS, THRESHOLD = 1 << 14, 8192, 0.5
#: Texts of fewer words say nothing about their share of short words.
FEW_WORDS = 20
GOOD, BAD = 1, 2
#: name, then the ranges in which a labeller votes good and bad.
LABELLERS = [
    ("symbols", (-1.0, 0.02), (0.06, 9e9)),
    ("upper case", (-1.0, 0.12), (0.4, 9e9)),
    ("repeated triples", (-1.0, 0.1), (0.3, 9e9)),
    ("word length", (2.5, 9.0), (12.0, 9e9)),
    ("short words", (0.15, 9e9), (-1.0, 0.05)),
    ("sentence ends", (0.02, 9e9), (-1.0, 0.004)),
    ("digits", (-1.0, 0.06), (0.2, 9e9)),
    ("marks in a row", (-1.0, 0.01), (0.05, 9e9)),
    ("same word in a row", (-1.0, 0.05), (0.2, 9e9)),
]


def _member(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER = _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _member("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL, _END = _member("0123456789"), _member("#$%&*|~^<>{}[]\\=_@+"), _member(".!?")
_MARK = _member("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
_SHAPE = np.zeros(256, np.uint32)
for _k, _c in enumerate(dict.fromkeys("".join(chr(c) for c in range(128) if not chr(c).isalnum()))):
    _SHAPE[ord(_c)] = 4 + _k
_SHAPE[_UPPER], _SHAPE[_DIGIT], _SHAPE[_LOWER], _SHAPE[128:] = 2, 3, 1, 1


def _sums(member: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=total[1:])
    return np.diff(total[offs])


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the labellers' statistics (rows, labellers), word hashes, row offsets into them, row has a word)."""
    s, e, row_offs = words(data, offs)
    h = span_hash(prefix(data), s, e)
    n_words, size = np.diff(row_offs), np.maximum(1, np.diff(offs))
    upper, lower = _sums(_UPPER[data], offs), _sums(_LOWER[data] | (data >= 128), offs)
    mark = _MARK[data]
    run = mark.copy()
    run[1:] &= mark[:-1]
    run[offs[:-1][offs[:-1] < len(data)]] = False
    at, row = windows(row_offs, 3)
    same = np.zeros(len(n_words), np.int64)
    if len(at):
        key = grams(h, 3)[at] ^ mix(row.astype(np.uint64))
        order = np.argsort(key)
        again = np.append(False, key[order][1:] == key[order][:-1])
        same = np.bincount(row[order][again], minlength=len(n_words))
    length = np.zeros(len(e) + 1, np.int64)
    np.cumsum(e - s, out=length[1:])
    w = np.maximum(1, n_words)
    short = np.zeros(len(e) + 1, np.int64)
    np.cumsum(e - s <= 3, out=short[1:])
    twice = np.zeros(len(e) + 1, np.int64)
    np.cumsum(np.append(False, h[1:] == h[:-1])[: len(h)], out=twice[1:])
    out = np.stack([
        _sums(_SYMBOL[data], offs) / size,
        upper / np.maximum(1, upper + lower),
        same / np.maximum(1, n_words - 2),
        np.diff(length[row_offs]) / w,
        np.where(n_words < FEW_WORDS, 0.3, np.diff(short[row_offs]) / w),
        _sums(_END[data], offs) / w,
        _sums(_DIGIT[data], offs) / size,
        _sums(run, offs) / size,
        np.diff(twice[row_offs]) / w,
    ], axis=1)
    return out, h, row_offs, n_words > 0


def votes(stats: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The votes of all labellers as one number in base 3; texts without a word get no vote."""
    out = np.zeros(len(stats), np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        x = stats[:, k]
        out += 3**k * np.where((x > good[0]) & (x <= good[1]), GOOD, np.where((x > bad[0]) & (x <= bad[1]), BAD, 0))
    return np.where(present, out, 0)


def digits_of(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], axis=1)


class LabelModel:
    """Expectation-maximisation over vote patterns: the share of good documents and, for each
    labeller, how often it is right on bad and on good ones, among those on which it votes."""

    def __init__(self, rounds: int = 200):
        self.rounds = rounds

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        v = digits_of(patterns)
        bad, voted = v == BAD, v > 0
        # most labellers know one kind of bad document only, but seldom accuse a good one
        self.share, self.on_bad, self.on_good = 0.8, np.full(v.shape[1], 0.5), np.full(v.shape[1], 0.97)
        for _ in range(self.rounds):
            good = self._posterior(v)
            w_bad, w_good = counts * (1 - good), counts * good
            # counts as of a few documents more keep every rate away from 0 and 1
            self.on_bad = (w_bad @ bad + 2) / (w_bad @ voted + 4)
            self.on_good = np.maximum(0.5, (w_good @ (v == GOOD) + 9.7) / (w_good @ voted + 10))
            self.share = float(np.clip(w_good.sum() / max(1, counts.sum()), 0.02, 0.98))
        return self

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.log(self.share / (1 - self.share)) + (v == BAD) @ np.log((1 - self.on_good) / self.on_bad) + (v == GOOD) @ np.log(self.on_good / (1 - self.on_bad))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are good."""
        return self._posterior(digits_of(patterns))


def features(data: np.ndarray, offs: np.ndarray, stats: np.ndarray, h: np.ndarray, row_offs: np.ndarray, bins: int):
    """Hashed features (row, bin, value): character-shape triples, words, and each statistic in steps; by row."""
    shape = _SHAPE[data]
    three = shape[:-2] * np.uint32(16384) + shape[1:-1] * np.uint32(128) + shape[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    three = ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - (bins.bit_length() - 1))).astype(np.int64)
    return three, (h >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64) + bins, steps(stats, bins)


def steps(stats: np.ndarray, bins: int) -> np.ndarray:
    """Bins of the statistics in sixteen steps each, (rows, labellers)."""
    scale = np.array([200, 20, 20, 1, 20, 100, 50, 200, 20])[: stats.shape[1]]
    return 2 * bins + np.minimum(15, (stats * scale).astype(np.int64)) + 16 * np.arange(stats.shape[1])


class Scorer:
    """Linear scorer: means of the weights of a text's shapes and of its words, plus the weights of its steps."""

    def __init__(self, bins: int = BINS):
        self.bins, self.w, self.bias = bins, np.zeros(2 * bins + 16 * len(LABELLERS)), 0.0

    def fit(self, rows: list[tuple[bytes, bytes]], y: np.ndarray, rounds: int = 80, rate: float = 0.3) -> Scorer:
        """rows: each document's bins (int32) and values (float32)."""
        if not len(rows):
            return self
        col = np.concatenate([np.frombuffer(a, np.int32) for a, _ in rows])
        val = np.concatenate([np.frombuffer(b, np.float32) for _, b in rows])
        row = np.repeat(np.arange(len(rows)), [len(a) // 4 for a, _ in rows])
        past, past_bias = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(row, val * self.w[col], minlength=len(rows)) + self.bias
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            g = np.bincount(col, val * err[row], minlength=len(self.w)) / len(rows) + 1e-6 * self.w
            past, past_bias = past + g * g, past_bias + err.mean() ** 2
            self.w -= rate * g / np.sqrt(past)
            self.bias -= rate * err.mean() / past_bias**0.5
        return self

    def score(self, data, offs, stats, h, row_offs) -> np.ndarray:
        three, word, step = features(data, offs, stats, h, row_offs, self.bins)
        z = self.bias + self.w[step].sum(axis=1)
        total = np.zeros(len(three) + 3)
        np.cumsum(self.w[three], out=total[1 : len(three) + 1])
        total[len(three) + 1 :] = total[len(three)]
        last = np.maximum(offs[:-1], offs[1:] - 2)
        z += 4 * (total[last] - total[offs[:-1]]) / np.maximum(1, last - offs[:-1])
        total = np.zeros(len(word) + 1)
        np.cumsum(self.w[word], out=total[1:])
        z += 2 * np.diff(total[row_offs]) / np.maximum(1, np.diff(row_offs))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sparse(data, offs, stats, h, row_offs, bins, chosen):
    """Per chosen row: bins (int32 bytes) and values (float32 bytes), weighted as score() weighs them."""
    three, word, step = features(data, offs, stats, h, row_offs, bins)
    for k in chosen:
        a, b = offs[k], max(offs[k], offs[k + 1] - 2)
        c1, n1 = np.unique(three[a:b], return_counts=True)
        c2, n2 = np.unique(word[row_offs[k] : row_offs[k + 1]], return_counts=True)
        col = np.concatenate([c1, c2, step[k]]).astype(np.int32)
        val = np.concatenate([4 * n1 / max(1, b - a), 2 * n2 / max(1, n2.sum()), np.ones(step.shape[1])]).astype(np.float32)
        yield col.tobytes(), val.tobytes()


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, bins: int = BINS) -> tuple[LabelModel, Scorer]:
    """Fit the label model on the vote patterns of all documents, and the scorer on at most sample_rows of them, those of least hash; one pass over the texts."""
    # twice the share, so that the rows of least hash are there; their number is bounded whatever repeats
    share = int(min(1.0, 2 * sample_rows / max(1, docs.count())) * (1 << 20)) + 1

    def run(batch):
        seen, rows, key = np.zeros(3 ** len(LABELLERS), np.int64), [], batch.column(1).to_pylist()
        for lo, _, data, offs in texts(batch.column(0)):
            stats, h, row_offs, present = statistics(data, offs)
            v = votes(stats, present)
            seen += np.bincount(v[present], minlength=len(seen))
            chosen = [k for k in range(len(v)) if present[k] and key[lo + k] < share]
            rows += [(key[lo + k], int(v[k]), 1, c, x) for k, (c, x) in zip(chosen, _sparse(data, offs, stats, h, row_offs, bins, chosen))]
        rows += [(None, int(p), int(seen[p]), None, None) for p in np.flatnonzero(seen)]
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "pattern", "n", "cols", "vals"])

    key = F.pmod(F.xxhash64("text", F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)), F.lit(1 << 20))
    scratch = Scratch(docs.sparkSession, "quality")
    got = scratch.save(map_arrow(docs.select("text", key.alias("h")), run, "h bigint, pattern int, n bigint, cols binary, vals binary"))
    counted = got.filter("h IS NULL").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = LabelModel().fit(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64))
    taken = got.filter("h IS NOT NULL").orderBy("h", "pattern", "cols", "vals").limit(sample_rows).select("pattern", "cols", "vals").toArrow()
    # the summands of a sum follow this order, so that it does not hang on the plan
    rows = sorted(zip(*(taken[c].to_pylist() for c in ("pattern", "cols", "vals"))))
    y = model.posterior(np.array([r[0] for r in rows], np.int64)) if rows else np.zeros(0)
    fitted = Scorer(bins).fit([(r[1], r[2]) for r in rows], y)
    scratch.clear()
    return model, fitted


def score(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, bins: int = BINS, threshold: float = THRESHOLD, keep_only: bool = True) -> DataFrame:
    """docs with a column quality (double, six digits); with keep_only, those of at least threshold.

    The label model counts all documents; the scorer is fitted on at most sample_rows of them,
    chosen by the hash of text and id. Null, empty and wordless texts score 0. Equal texts, and so
    repeated rows, score alike; a score equal to the threshold is kept. Texts of any length are read
    whole. All other columns pass through, of whatever name or type; an existing quality column is
    replaced; an empty table gives no rows.
    """
    docs = docs.drop("quality")
    names, body = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows, bins)[1])

    def run(batch):
        got = []
        for _, _, data, offs in texts(batch.column(body)):
            stats, h, row_offs, present = statistics(data, offs)
            got.append(np.where(present, shared.value.score(data, offs, stats, h, row_offs), 0.0))
        got = np.round(np.concatenate(got), 6)
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, "quality"])
        yield out.filter(pa.array(got >= threshold)) if keep_only else out

    return map_arrow(docs, run, with_fields(docs.schema, quality=T.DoubleType()))
