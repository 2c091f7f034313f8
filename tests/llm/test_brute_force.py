"""Operators that SQL cannot express against brute force, and the trained ones on held-out labels."""

import math
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from searchlake.llm import decontaminate, htmltext, kdshard, linededup, neardup, packing, quality, secrets, toxicity, vafile
from searchlake.llm.common import Scratch, read

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


def near_pairs(sigs, limit):
    ids, m = [i for i, _ in sigs], np.stack([np.frombuffer(bytes(s), np.uint8) for _, s in sigs])
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in np.flatnonzero((m != m[a]).sum(axis=1) <= limit) if ids[a] != ids[b]}


def test_hamming_join_gives_every_pair(spark):
    rng, rows = np.random.default_rng(1), []
    for _ in range(40):
        base = rng.integers(0, 256, neardup.SYMBOLS, dtype=np.uint8)
        for errors in (0, 5, 12, 20, 23, 24, 30):
            s = base.copy()
            at = rng.choice(neardup.SYMBOLS, errors, replace=False)
            s[at] += np.uint8(1)
            rows.append((len(rows), bytes(s)))
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "id bigint, sig binary")
    got = {(r.a, r.b) for r in neardup.hamming_join(df, Scratch(spark, "test"), every=True).collect()}
    assert got == near_pairs(rows, neardup.MAX_DISTANCE)
    forest = neardup.hamming_join(df, Scratch(spark, "test"))
    assert groups_of((r.a, r.b) for r in forest.collect()) == groups_of(got)


def test_hot_key_is_compared_in_parts(spark):
    rng, n = np.random.default_rng(13), 50_000
    base = rng.integers(0, 256, neardup.SYMBOLS, dtype=np.uint8)
    sig = np.tile(base, (n, 1))
    for row in sig:  # near copies, any two within the distance
        at = rng.choice(np.arange(6, neardup.SYMBOLS), 11, replace=False)
        row[at] += rng.integers(1, 256, 11, dtype=np.uint8)
    sig[1::500, 6:] = rng.integers(0, 256, (len(sig[1::500]), neardup.SYMBOLS - 6), dtype=np.uint8)  # alike in the first chunk only
    sig[501] = sig[1]
    sig[501, 70] += 1
    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sig)], "id bigint, sig binary")
    # one chunk only: every signature has the same keys
    keyed = df.select("id", "sig")
    parts = list(neardup._members([pa.RecordBatch.from_arrays([pa.array(np.zeros(5000, np.int64)), pa.array(np.arange(lo, lo + 5000))], ["key", "id"]) for lo in range(0, n, 5000)], 4096))
    assert sum(len(m) for b in parts for m in b.column(3).to_pylist()) == n and max(len(m) for b in parts for m in b.column(3).to_pylist()) <= 4096
    rows = spark.createDataFrame([(7, int(p), True, m) for b in parts for p, m in zip(b.column(1).to_pylist(), b.column(3).to_pylist())], "key bigint, part int, big boolean, members array<bigint>")
    got = []

    def verify(batch):
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {x["id"]: x["sig"] for x in [*one, *two]}
            pairs = neardup.linked(np.array(list(own)), np.frombuffer(b"".join(own.values()), np.uint8).reshape(len(own), -1), neardup.MAX_DISTANCE, False)
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    got = groups_of((r.a, r.b) for r in neardup._hot(rows, keyed, Scratch(spark, "test"), neardup.MAX_DISTANCE, False, verify).collect())
    far = set(range(1, n, 500))
    assert got == {k: 0 for k in range(1, n) if k not in far} | {501: 1}


def test_small_hot_bound_changes_nothing(spark):
    docs = read(spark, SMALL, "documents")
    sigs = neardup.signatures(docs).groupBy("sig").agg(F.min("doc_id").alias("id"))
    want = {(r.a, r.b) for r in neardup.hamming_join(sigs, Scratch(spark, "test"), every=True).collect()}
    assert want == {(r.a, r.b) for r in neardup.hamming_join(sigs, Scratch(spark, "test"), every=True, hot_rows=2).collect()}
    forest = neardup.hamming_join(sigs, Scratch(spark, "test"), hot_rows=2)
    assert groups_of((r.a, r.b) for r in forest.collect()) == groups_of(want)


def test_near_groups(spark):
    docs = read(spark, MIDDLE, "documents")
    sigs = [(r.doc_id, r.sig) for r in neardup.signatures(docs).collect()]
    want = groups_of(near_pairs(sigs, neardup.MAX_DISTANCE))
    assert {r.id: r.root for r in neardup.near_groups(docs).collect()} == want and want


def place_slowly(sizes, window):
    """Every open window is tried, and the sum of squares counted anew."""
    fill, out = [], []
    for size in sizes:
        levels = Counter(f for f in fill if f < window)
        options = {}
        for level in {0, *(f for f in levels if f + size <= window)}:
            after = levels.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            options[level] = sum(v * v for v in after.values())
        least = min(options.values())
        level = max(k for k, v in options.items() if v == least)
        out.append(level)
        if level:
            fill[max(k for k, f in enumerate(fill) if f == level)] += size
        else:
            fill.append(size)
    return out


def test_packer_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    for window in (2, 7, 32):
        sizes = rng.integers(1, window + 1, 300).tolist()
        packer = packing.Packer(window)
        assert [packer.place(s)[1] for s in sizes] == place_slowly(sizes, window)


def test_packing_places_every_token_once(spark):
    docs = read(spark, SMALL, "documents")
    got = packing.pack(docs, window=256, shard_windows=64).collect()
    want = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect() if r.n_tokens}
    total, windows = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        windows[r.shard, r.window].append((r.offset, r.n_tokens))
    assert total == want
    for parts in windows.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 256


def test_sharding_splits_at_weighted_medians(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "x" * int(n), "en", f"s{int(rng.integers(5))}", int(n)) for i, n in enumerate(rng.integers(0, 400, 300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    dims = ("n_chars", "doc_id")
    got = {r.doc_id: r.shard for r in kdshard.shard(df, 5000, dims, bins=16).collect()}
    x = np.array([[r[4], r[0]] for r in rows], float)
    w, whole, want = x[:, 0], np.ptp(x, axis=0), {}

    def split(at, node):
        span = np.ptp(x[at], axis=0) / whole
        if w[at].sum() <= 5000 or span.max() <= 0:
            want.update((int(x[k, 1]), node) for k in at)
            return
        v = x[at, span.argmax()]
        cut = next(c for c in np.unique(v) if w[at][v <= c].sum() >= w[at].sum() / 2)
        right = v >= cut if cut == v.max() else v > cut
        split(at[~right], 2 * node)
        split(at[right], 2 * node + 1)

    split(np.arange(len(x)), 1)
    assert got == want and len(set(got.values())) > 8


def test_sharding_by_whole_strings_and_nulls(spark):
    rng = np.random.default_rng(14)
    sources = [f"https://example.org/crawl/{c}" for c in "abcdefg"] + [None, ""]
    rows = [(int(i) + 2**60, "x" * int(n), rng.choice(["en", "fr", None]), sources[rng.integers(9)], int(rng.integers(-50, 50)) if i % 7 else None, float(rng.choice([-math.inf, -1.5, 0.0, 2.5, math.inf, math.nan]))) for i, n in enumerate(rng.integers(0, 400, 400))]
    rows = [(None if i == 5 else r[0], *(None if isinstance(x, str) and x == "None" else x for x in r[1:])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, odd double")
    for dims, bound in ((("source",), 1 << 20), (("lang", "source", "n_chars", "odd", "doc_id"), 0)):
        want, x, w = {}, np.zeros((len(rows), len(dims))), np.array([len(r[1]) for r in rows])
        for k, d in enumerate(dims):
            own = [r[df.columns.index(d)] for r in rows]
            if d in ("n_chars", "doc_id"):
                least = min(v for v in own if v is not None)
                x[:, k] = [0 if v is None else v - least + 1 for v in own]
            else:
                order = sorted({v for v in own if v is not None and v == v}) + [None]
                x[:, k] = [0 if v is None else len(order) if v != v else order.index(v) + 1 for v in own]
        whole = np.ptp(x, axis=0)

        def split(at, node):
            span = np.ptp(x[at], axis=0) / whole
            if w[at].sum() <= 12_000 or span.max() <= 0:
                want.update((k, node) for k in at.tolist())
                return
            v = x[at, span.argmax()]
            cut = next(c for c in np.unique(v) if w[at][v <= c].sum() >= w[at].sum() / 2)
            right = v >= cut if cut == v.max() else v > cut
            split(at[~right], 2 * node)
            split(at[right], 2 * node + 1)

        split(np.arange(len(rows)), 1)
        got = {r.doc_id: r.shard for r in kdshard.shard(df, 12_000, dims, max_broadcast=bound).collect()}
        assert got == {rows[k][0]: v for k, v in want.items()}, dims
        assert len(set(got.values())) > 4


def test_html_votes(spark):
    pages = read(spark, SMALL, "pages")
    rows, votes = pages.collect(), defaultdict(lambda: defaultdict(lambda: [0, 0.0]))
    host = {r.page_id: re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url)[1].lower() for r in rows}
    for r in rows:
        if best := htmltext.Page(r.html).best_path():
            path, score = best
            own = votes[host[r.page_id]][path]
            own[0] += 1
            own[1] += score
    winner = {h: min(v, key=lambda p: (-v[p][0], -round(v[p][1], 3), p)) for h, v in votes.items()}
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert len(got) == len(rows) and any(r.consensus for r in got.values())
    for r in rows:
        own = htmltext.Page(r.html).text_at(winner[host[r.page_id]])
        assert got[r.page_id].consensus == (own is not None)
        if own is not None:
            assert (got[r.page_id].path, got[r.page_id].text) == (winner[host[r.page_id]], own)


@pytest.mark.parametrize(
    ("page", "path", "text"),
    [
        ("<body><div>first<div>second</div>third</div></body>", "body>div", "first\nsecond\nthird"),
        ("<body><div>first<nav>menu<p>more</nav>third</div>last</body>", "body>div", "first\nthird"),
        ("<body><nav>menu</nav></body>", "body>nav", "menu"),
        ("<div class='b7 a12'>x &amp; y</div><p>no<div class='a9 b1'>z", "div.a#.b#", "x & y\nz"),
        ("<!DOCTYPE html><!-- c > --><script>if (a < b) {}</script><p>I <3 <b>you</b>", "", "I <3 you"),
        ("<p title='a > b' class=x>one<br>two\t  three</p>", "", "one\ntwo three"),
        ("<div>a<section>b</div>c", "div>section", "b"),
        ("<p>kept <a href=x no end", "", "kept"),
    ],
)
def test_html_texts_by_hand(page, path, text):
    assert htmltext.Page(page).text_at(path) == text


def test_html_time_and_memory_follow_the_page():
    deep = "<div>" * 100_000 + "deep" + "</p></section>" * 100_000
    odd = ["<body><a " + '"' * 100 + " x", '<a href="' * 100_000, "<a" * 100_000, "<!" * 100_000, "<script" * 50_000, "</script   " * 50_000, "\n" * 100_000 + " " * 100_000 + "x", "<div class=" * 50_000]
    tracemalloc.start()
    began = time.process_time()
    for page in (deep, *odd):
        own = htmltext.Page(page)
        best = own.best_path()
        if best:
            own.text_at(best[0])
    assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert htmltext.Page(deep).text_at(htmltext.Page(deep).best_path()[0]) == "deep"


def test_entropy_by_counting_anew():
    rng = np.random.default_rng(5)
    raw = bytes(rng.choice(list(b"abcdef0123456789XYZ"), 500).tolist())
    data = np.frombuffer(raw, np.uint8)
    spans = [(0, 20), (20, 45), (45, 200), (200, 500), (3, 9)]
    got = secrets.best_entropy(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))

    def entropy(s):
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())

    for (a, b), g in zip(spans, got):
        assert g == pytest.approx(max(entropy(raw[k : k + 20]) for k in range(a, max(a, b - 20) + 1)) if b - a > 20 else entropy(raw[a:b]))


def test_line_dedup_both_ways(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    seen, want = set(), []
    for r in docs.orderBy("doc_id").collect():
        kept, n = [], 0
        for line in r.text.split("\n"):
            key = line.strip(linededup.BLANKS)
            gone = len(key) >= linededup.MIN_CHARS and key in seen
            seen.add(key)
            n += gone
            if not gone:
                kept.append(line)
        want.append((r.doc_id, "\n".join(kept), n))
    for bound, firsts in ((linededup.MAX_BROADCAST_BYTES, linededup.MAX_FIRSTS), (linededup.MAX_BROADCAST_BYTES, 0), (-1, 0)):
        assert sorted(map(tuple, linededup.dedup_lines(docs, max_broadcast=bound, max_firsts=firsts).collect())) == want


def test_decontamination_both_ways(spark):
    docs, bench = read(spark, SMALL, "documents"), read(spark, SMALL, "benchmark")
    want = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert want and want == sorted(map(tuple, decontaminate.find_leaks(docs, bench, max_grams=0).collect()))
    clean = [sorted(map(tuple, decontaminate.clean(docs, bench, max_grams=m).collect())) for m in (decontaminate.MAX_BROADCAST_GRAMS, 0)]
    assert clean[0] == clean[1] != sorted(map(tuple, docs.collect()))


def test_bloom_filter_forgets_nothing():
    h = np.random.default_rng(12).integers(0, 1 << 63, 30_000, dtype=np.uint64)
    f = linededup.Bloom()
    f.add(h[:20_000])
    assert f.seen(h[:20_000]).all() and f.seen(h[20_000:]).mean() < 0.05


def nearest_slowly(rows, k, asked):
    """{(query, its vector): ids} by sorting all distances."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    scale = np.abs(x).max()
    out = defaultdict(list)
    for row in range(len(x)):
        if asked(ids[row]):
            d = np.sqrt((((x - x[row]) / scale) ** 2).sum(axis=1))
            d[ids == ids[row]] = np.inf
            order = np.lexsort((ids, np.round(d, 8)))[:k]
            out[int(ids[row])] += ids[order[np.isfinite(d[order])]].tolist()
    return out


def found_by(df, **parameters):
    out = defaultdict(list)
    for r in sorted(vafile.nearest(df, **parameters).collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append(r.vec_id)
    return out


def test_topk_over_several_blocks(spark):
    v = read(spark, MIDDLE, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    counts: dict = {}
    got = found_by(v, k=5, block_rows=64, queries=F.col("vec_id") % 50 == 0, counts=counts)
    assert got == nearest_slowly(rows, 5, lambda i: i % 50 == 0)
    # exact vectors are read for few of all pairs
    assert counts["queries"] == 10 and counts["vectors"] == 500
    assert 5 * 10 <= counts["exact"] < 0.1 * counts["queries"] * counts["vectors"] and counts["exact"] <= counts["candidates"]


@pytest.mark.parametrize("scale", [1e20, 1e-30])
def test_topk_of_large_and_small_numbers_and_copies(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, (x[i] * np.float32(scale)).tolist()) for i in range(60)]
    rows += [(0, rows[0][1])] * 12 + [(100 + i, rows[3][1]) for i in range(30)]  # many rows of one id, many ids of one vector
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got, want = found_by(df, k=5, block_rows=16), nearest_slowly(rows, 5, lambda i: True)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_bounds_hold():
    rng = np.random.default_rng(15)
    x = np.r_[rng.normal(size=(200, 16)), rng.normal(size=(1, 16)).repeat(5, axis=0)]
    codes = vafile.Codes(x.min(axis=0), x.max(axis=0))
    y = codes.scaled(x)
    c = codes.encode(y)
    lower, upper = codes.bounds(y, c, codes.radius(y, c))
    true = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
    assert (lower <= true).all() and (true <= upper).all() and (upper - lower).max() < 0.2


def test_label_model_finds_the_accuracies():
    rng, n = np.random.default_rng(6), 40_000
    good = rng.random(n) < 0.7
    right = np.array([0.9, 0.8, 0.95, 0.7, 0.85, 0.6, 0.9, 0.75, 0.8])
    v = np.where((rng.random((n, 9)) < right) == good[:, None], quality.GOOD, quality.BAD)
    pattern, count = np.unique(v @ 3 ** np.arange(9), return_counts=True)
    m = quality.LabelModel().fit(pattern, count)
    assert abs(m.share - 0.7) < 0.03 and np.abs(m.on_bad - right).max() < 0.05
    assert ((m.posterior(v @ 3 ** np.arange(9)) > 0.5) == good).mean() > 0.97


def test_quality_on_labels_that_it_never_saw(spark):
    docs, labels = read(spark, LARGE, "documents"), {r.doc_id: r.quality for r in read(spark, LARGE, "labels").collect()}
    got = {r.doc_id: r.quality for r in quality.score(docs.select("doc_id", "text"), keep_only=False).collect()}
    good, kept = [k for k, q in labels.items() if q == 1], {k for k, s in got.items() if s >= quality.THRESHOLD}
    assert sum(k in kept for k in good) / len(good) > 0.95
    assert sum((k in kept) == (q == 1) for k, q in labels.items()) / len(labels) > 0.85


def test_toxicity_on_held_out_labels(spark):
    docs, labels = read(spark, LARGE, "documents"), read(spark, LARGE, "labels")
    flagged = {r.doc_id for r in toxicity.find_toxic(docs, labels.filter("doc_id % 2 = 0")).collect()}
    test = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    hit = sum(t and k in flagged for k, t in test.items())
    precision, recall = hit / sum(k in flagged for k in test), hit / sum(test.values())
    assert precision > 0.8 and recall > 0.8


def test_pipeline_stage_by_stage(spark):
    docs, kept = read(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Scratch(spark, "test").save(stage(spark, docs, SMALL))
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    before, after = kept["line_dedup"]
    want = {r.doc_id: r.text for r in linededup.dedup_lines(before).collect()}
    assert all(want[r.doc_id] == r.text and r.n_chars is not None for r in after.collect())
    before, after = kept["near_dedup"]
    sigs = [(r.doc_id, r.sig) for r in neardup.signatures(before).collect()]
    gone = set(groups_of(near_pairs(sigs, neardup.MAX_DISTANCE)))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone
    before, after = kept["decontaminate"]
    bench = read(spark, SMALL, "benchmark")
    assert decontaminate.find_leaks(before, bench).count() > 0 == decontaminate.find_leaks(after, bench).count()
    clean = {r.doc_id for r in before.collect()} - {r.doc_id for r in decontaminate.find_leaks(before, bench).collect()}
    assert clean <= {r.doc_id for r in after.collect()}
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in packing.token_counts(before).filter("n_tokens > 0").collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, after.collect()))
