"""Toxicity by a convolutional text classifier.

Words are hashed into an embedding table; filters of several widths slide over the words, the
largest response of each filter over the whole text feeds a logistic output. Every labelled
document is used: three of four train all of it in numpy, in shards side by side whose
changes are averaged after each epoch, and the rest, held out, calibrate a threshold for
each language.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lowered, map_arrow, prefix, span_hash, texts, words

BUCKETS, DIM, WIDTHS, FILTERS, HELD_OUT = 1 << 18, 8, (1, 2, 3), 8, 0.25
#: Bytes of words (four for each word) that are trained on in one piece, about; labelled documents of no more are fitted on the driver.
SHARD_BYTES = 8 << 20
#: Labels that are broadcast to the documents; of more, documents and labels meet by shuffle.
MAX_BROADCAST_LABELS = 2_000_000
EPOCHS, MIN_POSITIVES = 8, 8
#: Steps of the whole numbers in which shards' changes are added, so that no sum depends on its order.
_STEPS = float(1 << 32)


def places(row_offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of each row, and the first window of each; a row shorter than width has one window."""
    counts = np.maximum(1, np.diff(row_offs) - width + 1)
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - first[row] + row_offs[row], first, row


def counts(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Texts, and toxic ones, that each bucket occurs in."""
    seen, toxic = np.zeros(buckets), np.zeros(buckets)
    for r, t in zip(rows, y):
        own = np.unique(r)
        seen[own] += 1
        toxic[own] += t
    return seen, toxic


class TextCnn:
    """Filters over hashed word embeddings; bucket BUCKETS is the empty word that fills up short texts."""

    def __init__(self, seed: int = 5, buckets: int = BUCKETS, dim: int = DIM, widths: tuple = WIDTHS, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.buckets, self.widths = buckets, widths
        self.emb = (rng.normal(size=(buckets + 1, dim)) * 0.05).astype(np.float32)
        self.emb[-1] = 0
        self.conv = [(rng.normal(size=(w, dim, filters)) * 0.3).astype(np.float32) for w in widths]
        self.out, self.bias = (rng.normal(size=len(widths) * filters) * 0.1).astype(np.float32), np.float32(-1)
        self.thresholds: dict[str | None, float] = {None: 0.5}
        self._tables = None

    @staticmethod
    def _index(bucket: np.ndarray, row_offs: np.ndarray, width: int, empty: int):
        at, first, row = places(row_offs, width)
        ext = np.append(bucket, empty)
        cols = [ext[np.where(at + j < row_offs[row + 1], at + j, len(bucket))] for j in range(width)]
        return cols, first

    def pooled(self, bucket: np.ndarray, row_offs: np.ndarray, tables=None):
        """(the largest response of every filter in each row; per width the words, rows' starts and responses of all windows; the buckets that those words number).

        Without tables, those of the words that occur here are made first, the empty word last.
        """
        known, empty = None, self.buckets
        if tables is None:
            known, bucket = np.unique(bucket, return_inverse=True)
            known, empty = np.append(known, self.buckets), len(known)
            own = self.emb[known]
            tables = [[own @ m for m in c] for c in self.conv]
        best, inner = [], []
        for k, w in enumerate(self.widths):
            cols, first = self._index(bucket, row_offs, w, empty)
            z = tables[k][0].take(cols[0], axis=0)
            for j in range(1, w):
                z += tables[k][j].take(cols[j], axis=0)
            best.append(np.maximum.reduceat(z, first, axis=0))
            inner.append((cols, first, z))
        return np.concatenate(best, axis=1), inner, known

    def tables(self) -> list[list[np.ndarray]]:
        """The response of each filter position to each bucket, made once in each Python worker: convolution is then a sum of looked-up rows."""
        if self._tables is None:
            self._tables = [[self.emb @ m for m in c] for c in self.conv]
        return self._tables

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.out + self.bias, -40, 40)))

    def start(self, seen: np.ndarray, toxic: np.ndarray, share: float) -> dict:
        """The first embedding dimension starts at how far a bucket leans to toxic texts, a share of all; returns the gradients' squares to begin with."""
        self.emb[:-1, 0] = np.clip((toxic - seen * share) / np.sqrt(np.maximum(1, seen) * share * (1 - share)), -2, 12) / 6
        self.conv[0][0][0, 0], self.out[0] = 1.0, 1.0
        return {"emb": np.full_like(self.emb, 1e-6), "out": np.full_like(self.out, 1e-6), "bias": 1e-6, "conv": [np.full_like(c, 1e-6) for c in self.conv]}

    def epoch(self, rows: list[np.ndarray], y: np.ndarray, share: float, past: dict, rng: np.random.Generator, batch: int = 128, rate: float = 0.05) -> None:
        """Every text once, in the order that rng draws; past: sums of the gradients' squares, which go on."""
        order, n = rng.permutation(len(rows)), len(rows)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for lo in range(0, n, batch):
            own = order[lo : lo + batch]
            bucket = np.concatenate([rows[i] for i in own])
            row_offs = np.cumsum([0, *(len(rows[i]) for i in own)])
            word, g_word, g_conv, g_out, g_bias = self.gradients(bucket, row_offs, y[own], weight[own] / len(own))
            g_out += 1e-4 * self.out
            for k, g in enumerate(g_conv):
                past["conv"][k] += g**2
                self.conv[k] -= rate * g / np.sqrt(past["conv"][k])
            past["emb"][word] += g_word**2
            self.emb[word] -= rate * g_word / np.sqrt(past["emb"][word])
            past["out"] += g_out**2
            self.out -= (rate * g_out / np.sqrt(past["out"])).astype(np.float32)
            past["bias"] += g_bias**2
            self.bias -= np.float32(rate * g_bias / past["bias"] ** 0.5)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.05, seed: int = 5) -> TextCnn:
        """rows: each text's word buckets."""
        rng, share = np.random.default_rng(seed), y.mean()
        past = self.start(*counts(rows, y, self.buckets), share)
        for _ in range(epochs):
            self.epoch(rows, y, share, past, rng, batch, rate)
        return self

    def flat(self, x: dict | None = None) -> np.ndarray:
        """All parameters, or what past holds for each, as rows of the embeddings' width: the embeddings, then the rest filled up with zeros."""
        x = x or {"emb": self.emb, "conv": self.conv, "out": self.out, "bias": self.bias}
        rest = np.concatenate([*(c.ravel() for c in x["conv"]), x["out"], [x["bias"]]])
        dim = self.emb.shape[1]
        return np.concatenate([x["emb"], np.append(rest, np.zeros(-len(rest) % dim)).reshape(-1, dim)]).astype(np.float64)

    def parts(self, flat: np.ndarray) -> dict:
        """What flat() laid out, as the arrays that it came from."""
        n, at, rest = len(self.emb), 0, flat[len(self.emb) :].ravel().astype(np.float32)
        out = {"emb": flat[:n].astype(np.float32), "conv": []}
        for c in self.conv:
            out["conv"].append(rest[at : at + c.size].reshape(c.shape).copy())
            at += c.size
        return out | {"out": rest[at : at + len(self.out)].copy(), "bias": rest[at + len(self.out)]}

    def load(self, flat: np.ndarray) -> None:
        x = self.parts(flat)
        self.emb, self.conv, self.out, self.bias, self._tables = x["emb"], x["conv"], x["out"], x["bias"], None

    def gradients(self, bucket: np.ndarray, row_offs: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """(words, their embeddings' gradients, those of the filters, of the output and of the bias) of the weighted logistic loss; the empty word has none."""
        pooled, inner, known = self.pooled(bucket, row_offs)
        act = np.maximum(pooled, 0)
        err = ((self.probability(pooled) - y) * weight).astype(np.float32)
        back = err[:, None] * self.out[None, :] * (pooled > 0)
        words_, parts, g_conv, f0 = [], [], [], 0
        for k, (cols, first, z) in enumerate(inner):
            f = z.shape[1]
            d, top = back[:, f0 : f0 + f], pooled[:, f0 : f0 + f]
            size = np.diff(np.append(first, len(z)))
            hit_w, hit_f = np.nonzero(z == np.repeat(top, size, axis=0))
            hit_r = np.searchsorted(first, hit_w, side="right") - 1
            _, one = np.unique(hit_r * f + hit_f, return_index=True)  # of equal responses the first
            hit_w, hit_f, hit_r = hit_w[one], hit_f[one], hit_r[one]
            amount, own = d[hit_r, hit_f], np.zeros_like(self.conv[k])
            for j, c in enumerate(cols):
                word = known[c[hit_w]]
                part = np.zeros((f, self.emb.shape[1]), np.float32)
                np.add.at(part, hit_f, amount[:, None] * self.emb[word])
                own[j] = part.T
                words_.append(word)
                parts.append(amount[:, None] * self.conv[k][j].T[hit_f])
            g_conv.append(own)
            f0 += f
        word, at = np.unique(np.concatenate(words_), return_inverse=True)
        g_word = np.zeros((len(word), self.emb.shape[1]), np.float32)
        np.add.at(g_word, at, np.concatenate(parts))
        real = word < self.buckets
        return word[real], g_word[real], g_conv, act.T @ err, err.sum()

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        tables, out = self.tables(), []
        for lo in range(0, len(rows), 256):
            own = rows[lo : lo + 256]
            out.append(self.probability(self.pooled(np.concatenate(own), np.cumsum([0, *map(len, own)]), tables)[0]))
        return np.concatenate(out)

    def calibrate(self, p: np.ndarray, y: np.ndarray, lang: list, weight: np.ndarray) -> TextCnn:
        """For each language the threshold of best F1 on held-out texts, weighted as the classes occur; languages with few toxic ones share that of all."""
        self.thresholds = {None: best_threshold(p, weight * (y > 0), weight) if y.any() else 0.5}
        lang = np.array([x or "" for x in lang])
        for x in set(lang.tolist()):
            own = lang == x
            if y[own].sum() >= MIN_POSITIVES:
                self.thresholds[x] = best_threshold(p[own], (weight * (y > 0))[own], weight[own])
        return self


def best_threshold(p: np.ndarray, hit: np.ndarray, flagged: np.ndarray) -> float:
    """The threshold of best F1, where texts of score p weigh flagged, and toxic ones of them hit; scores may repeat."""
    order = np.argsort(-p, kind="stable")
    q, hit, flagged = p[order], np.cumsum(hit[order]), np.cumsum(flagged[order])
    f1 = np.where(np.append(q[1:] < q[:-1], True), 2 * hit / (flagged + hit[-1]), -1.0)
    k = int(f1.argmax())
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0.0)) / 2)


def buckets_of(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    s, e, row_offs = words(data, offs)
    return (span_hash(prefix(data), s, e) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64), row_offs


def held_out(words_: bytes) -> bool:
    """Equal texts fall on one side, so that held-out texts are new ones."""
    return (sum(words_[:64]) + len(words_)) % 100 < 100 * HELD_OUT


_PACKED = "shard bigint, held boolean, words binary, sizes binary, toxic binary, langs array<string>"


def pack(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's documents in a fixed order, as one row of those to train on and one of those held out."""
    got = sorted(table.select(["words", "toxic", "lang"]).to_pylist(), key=lambda r: (r["words"], r["toxic"], r["lang"] or ""))
    out = []
    for held in (False, True):
        if own := [r for r in got if held_out(r["words"]) == held]:
            sizes, toxic = np.array([len(r["words"]) // 4 for r in own], np.int64), np.array([r["toxic"] for r in own], np.int8)
            out.append((key[0].as_py(), held, b"".join(r["words"] for r in own), sizes.tobytes(), toxic.tobytes(), [r["lang"] for r in own]))
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "held", "words", "sizes", "toxic", "langs"])


def unpack(batch: pa.RecordBatch):
    """(shard, held, each text's word buckets, toxic, languages) of each row."""
    for shard, held, words_, sizes, toxic, langs in zip(*(batch.column(k) for k in range(6))):
        at = np.cumsum(np.frombuffer(sizes.as_py(), np.int64))
        yield shard.as_py(), held.as_py(), np.split(np.frombuffer(words_.as_py(), np.int32).astype(np.int64), at[:-1]), np.frombuffer(toxic.as_py(), np.int8).astype(np.float32), langs.as_py()


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def fit_shards(packed: DataFrame, weights: tuple[float, float], epochs: int = EPOCHS, seed: int = 5) -> TextCnn:
    """Fit and calibrate on all shards, where they are.

    The words' counts are those of all texts to train on. In each epoch every shard goes on from
    the same parameters; each parameter then moves by the mean of the changes in the shards that
    changed it, and so do the squares of its gradients. The driver holds parameters and counts
    only, whose number is fixed. Changes are added as whole numbers: the model does not depend
    on how rows lie in partitions.
    """
    spark = packed.sparkSession
    model = TextCnn()

    def count(batch):
        for _, held, rows, y, _ in unpack(batch):
            seen, toxic = counts(rows, y)
            at = np.flatnonzero(seen)
            yield _batch(["held", "at", "seen", "toxic"], [held] * (len(at) + 1), np.append(at, -1), np.append(seen[at], len(y)).astype(np.int64), np.append(toxic[at], y.sum()).astype(np.int64))

    counted = map_arrow(packed, count, "held boolean, at bigint, seen bigint, toxic bigint").groupBy("held", "at").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    held, at, seen, toxic = (counted[c].to_numpy() for c in ("held", "at", "seen", "toxic"))
    of = {bool(held[k]): (int(seen[k]), int(toxic[k])) for k in np.flatnonzero(at < 0)}
    split = False in of and 0 < of[False][1] < of[False][0]
    use = (at >= 0) & (~held.astype(bool) | (not split))
    every = [np.bincount(at[use], c[use], minlength=model.buckets) for c in (seen, toxic)]
    n, hits = of[False] if split else (sum(x[0] for x in of.values()), sum(x[1] for x in of.values()))
    share = hits / n
    past = model.start(*every, share)
    fitted = packed.filter("NOT held") if split else packed
    # the sums of a task's shards meet in it: few tasks send little
    fitted = fitted.coalesce(max(1, 3 * spark.sparkContext.defaultParallelism))
    dim = model.emb.shape[1]
    names = [f"c{k}" for k in range(2 * dim)]
    for e in range(epochs):
        shared = spark.sparkContext.broadcast((model, past))

        def run(batch, e=e, shared=shared):
            for shard, _, rows, y, _ in unpack(batch):
                own, squares = copy.deepcopy(shared.value)
                before = own.flat(), own.flat(squares)
                own.epoch(rows, y, share, squares, np.random.default_rng([seed, e, shard]))
                move = np.concatenate([own.flat() - before[0], own.flat(squares) - before[1]], axis=1)
                at = np.flatnonzero(move[:, dim:].any(axis=1))
                move = np.rint(move[at] * _STEPS).astype(np.int64)
                yield _batch(["at", *names], at, *move.T)

        moved = map_arrow(fitted, run, "at bigint, " + ", ".join(f"{c} bigint" for c in names))
        got = moved.groupBy("at").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
        at, mean = got["at"].to_numpy(), np.stack([got[c].to_numpy() for c in names], axis=1) / _STEPS / got["n"].to_numpy()[:, None]
        values, squares = model.flat(), model.flat(past)
        values[at] += mean[:, :dim]
        squares[at] += mean[:, dim:]
        model.load(values)
        past = model.parts(squares)
        shared.destroy()
    test = packed.filter("held") if split and True in of else packed
    shared = spark.sparkContext.broadcast(model)

    def score(batch):
        for _, _, rows, y, langs in unpack(batch):
            p = np.round(shared.value.score(rows).astype(np.float64), 6)
            for whole in (False, True):
                yield _batch(["whole", "lang", "p", "toxic"], [whole] * len(p), ["" if whole else x or "" for x in langs], p, y.astype(np.int64))

    def threshold(key, t):
        hit = t["hit"].to_numpy()
        enough = hit.sum() >= (1 if key[0].as_py() else MIN_POSITIVES)
        clean = t["n"].to_numpy() - hit
        best = best_threshold(t["p"].to_numpy(), weights[1] * hit, weights[0] * clean + weights[1] * hit) if enough else None
        return pa.table({"whole": [key[0].as_py()], "lang": [key[1].as_py()], "threshold": pa.array([best], pa.float64())})

    scored = map_arrow(test, score, "whole boolean, lang string, p double, toxic bigint").groupBy("whole", "lang", "p").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    best = scored.groupBy("whole", "lang").applyInArrow(threshold, "whole boolean, lang string, threshold double").filter("threshold IS NOT NULL").collect()
    model.thresholds = {None: 0.5} | {None if r["whole"] else r["lang"]: r["threshold"] for r in best}
    shared.destroy()
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, sample_bytes: int | None = None, shard_bytes: int | None = None, max_broadcast: int = MAX_BROADCAST_LABELS) -> TextCnn | None:
    """Fit and calibrate on all labelled documents that have a word; None where one class is missing.

    Only where a caller asks for it, on at most sample_rows labelled documents of each class, or
    of at most sample_bytes of words in all, chosen by the hash of their id.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if sample_rows is not None:
        own = own.filter("toxic = 1").orderBy(*order).limit(sample_rows).union(own.filter("toxic = 0").orderBy(*order).limit(sample_rows))

    def run(batch):
        ids, lang, toxic = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, data, offs in texts(lowered(batch.column(1))):
            b, row_offs = buckets_of(data, offs)
            rows = [b[row_offs[k] : row_offs[k + 1]].astype(np.int32).tobytes() for k in range(hi - lo)]
            cols = [ids.slice(lo, hi - lo), pa.array(rows, pa.binary()), pa.array([len(r) for r in rows], pa.int64()), pa.array(lang[lo:hi], pa.string()), pa.array(toxic[lo:hi], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "words", "size", "lang", "toxic"])

    # pairs of numbers: as long as their number is bounded no text is shuffled
    few = sum(n.values() if sample_rows is None else (min(x, sample_rows) for x in n.values())) <= max_broadcast
    scratch = Scratch(docs.sparkSession, "toxic")
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").join(F.broadcast(own) if few else own.hint("merge"), "doc_id").select("doc_id", "text", "lang", "toxic")
    coded = scratch.save(map_arrow(joined, run, "doc_id bigint, words binary, size bigint, lang string, toxic int").filter("size > 0"))
    sized = coded.groupBy("doc_id").agg(F.max("size").alias("size"), F.max("toxic").alias("toxic"))
    total = {r["toxic"]: (r["n"], r["size"]) for r in sized.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    chosen = coded
    if sample_bytes is not None:
        # the driver gets sizes first, one for each id, and then the words of those that fit
        fits, room = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
        for r in sized.orderBy(*order).collect():
            room[r["toxic"]] -= r["size"]
            if room[r["toxic"]] >= 0:
                fits.append((r["doc_id"], r["toxic"], r["size"]))
        chosen = coded.join(F.broadcast(docs.sparkSession.createDataFrame([f[:1] for f in fits], "doc_id bigint")), "doc_id")
        total = {t: (sum(f[1] == t for f in fits), sum(f[2] for f in fits if f[1] == t)) for t in {f[1] for f in fits}}
    if len(total) < 2:
        scratch.clear()
        return None
    sampled = sample_rows is not None or sample_bytes is not None
    weights = tuple(n[t] / total[t][0] if sampled else 1.0 for t in (0, 1))
    shards = -(-(total[0][1] + total[1][1]) // (shard_bytes or SHARD_BYTES))
    one = F.min(F.struct("words", "lang", "toxic")).alias("r")
    if shards > 1:
        # rows of one id fall in one shard
        part = chosen.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition("shard")
        packed = scratch.save(part.groupBy("shard", "doc_id").agg(one).select("shard", "r.*").groupBy("shard").applyInArrow(pack, _PACKED))
        scratch.drop(coded)
        model = fit_shards(packed, weights)
        scratch.clear()
        return model
    got = sorted(chosen.groupBy("doc_id").agg(one).select("r.*").toArrow().to_pylist(), key=lambda r: (r["words"], r["toxic"], r["lang"] or ""))
    scratch.clear()
    y = np.array([r["toxic"] for r in got], np.float32)
    rows = [np.frombuffer(r["words"], np.int32).astype(np.int64) for r in got]
    held = np.array([held_out(r["words"]) for r in got])
    if y[~held].min(initial=2) == y[~held].max(initial=-1) or held.all():
        held[:] = False
    model = TextCnn().fit([r for r, h in zip(rows, held) if not h], y[~held])
    test = held if held.any() else ~held
    p = np.round(model.score([r for r, h in zip(rows, test) if h]).astype(np.float64), 6)
    return model.calibrate(p, y[test], [r["lang"] for r, h in zip(got, test) if h], np.where(y > 0, weights[1], weights[0])[test])


def find_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, flagged_only: bool = True) -> DataFrame:
    """(doc_id, lang, toxicity): the documents whose score reaches their language's threshold, or all.

    Whole texts are read. Null, empty and wordless texts score 0 and are never flagged; a score
    equal to the threshold is; a null or unknown language has the threshold of all languages.
    Repeated rows are scored each. Labels that repeat a doc_id count as toxic if any of them is.
    Without labels of both classes every score is 0; an empty table gives no rows; other columns,
    of whatever name, are not looked at.
    """
    spark = docs.sparkSession
    model = train(docs, labels, sample_rows)
    if model is not None:
        model._tables = None
    shared = spark.sparkContext.broadcast(model)

    def run(batch):
        ids, lang = batch.column(0), batch.column(2)
        cnn, p = shared.value, []
        tables = cnn.tables() if cnn else None
        for _, _, data, offs in texts(lowered(batch.column(1))):
            b, row_offs = buckets_of(data, offs)
            if cnn is None or not len(b):
                p.append(np.zeros(len(offs) - 1))
                continue
            full = np.diff(row_offs) > 0
            score = np.zeros(len(offs) - 1)
            score[full] = cnn.probability(cnn.pooled(b, np.append(row_offs[:-1][full], row_offs[-1]), tables)[0])
            p.append(score)
        p = np.round(np.concatenate(p).astype(np.float64), 6)
        out = pa.RecordBatch.from_arrays([ids, lang, pa.array(p)], ["doc_id", "lang", "toxicity"])
        if flagged_only:
            t = cnn.thresholds if cnn else {None: 2.0}
            out = out.filter(pa.array((p >= np.array([t.get(x, t[None]) for x in lang.to_pylist()])) & (p > 0)))
        yield out

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), run, "doc_id bigint, lang string, toxicity double")
