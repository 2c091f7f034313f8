"""The registered SQL of the operators, the trained ones' arithmetic in plain loops, and the pipeline on odd tables."""

import math
import string
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from searchlake.llm import decontaminate, packing, quality, secrets, toxicity
from searchlake.llm.common import WORD_REGEX, Scratch, words
from searchlake.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(f"{r[k]:.8g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, cur = QUERIES[name](spark, SMALL), con.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_expectation_maximisation_by_loops():
    rng = np.random.default_rng(21)
    v = rng.integers(0, 3, (60, len(quality.LABELLERS)))
    pattern, count = np.unique(v @ 3 ** np.arange(v.shape[1]), return_counts=True)
    model = quality.LabelModel(rounds=5).fit(pattern, count)
    m = v.shape[1]
    share, on_bad, on_good = 0.8, [0.5] * m, [0.97] * m

    def posterior(row):
        good, bad = share, 1 - share
        for k in range(m):
            if row[k] == quality.BAD:
                good, bad = good * (1 - on_good[k]), bad * on_bad[k]
            elif row[k] == quality.GOOD:
                good, bad = good * on_good[k], bad * (1 - on_bad[k])
        return good / (good + bad)

    for _ in range(5):
        p = [posterior(row) for row in v]
        new_bad, new_good = [], []
        for k in range(m):
            voted = [(q, row[k]) for q, row in zip(p, v) if row[k]]
            new_bad.append((sum(1 - q for q, x in voted if x == quality.BAD) + 2) / (sum(1 - q for q, _ in voted) + 4))
            new_good.append(max(0.5, (sum(q for q, x in voted if x == quality.GOOD) + 9.7) / (sum(q for q, _ in voted) + 10)))
        on_bad, on_good, share = new_bad, new_good, min(0.98, max(0.02, sum(p) / len(p)))
    assert model.share == pytest.approx(share) and model.on_bad == pytest.approx(on_bad) and model.on_good == pytest.approx(on_good)
    assert model.posterior(pattern[:5]) == pytest.approx([posterior(row) for row in quality.digits_of(pattern[:5])])


def test_quality_statistics_by_loops():
    text = "Ab ab ab, 12!! xx yy zz xx yy zz #tag end. Und SO weiter\n" * 3
    raw = text.encode()
    stats, _, _, present = quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    tokens = "".join(c if c.isalnum() else " " for c in text).split()
    triples = [tuple(tokens[k : k + 3]) for k in range(len(tokens) - 2)]
    marks = [c in string.punctuation for c in text]
    want = [
        sum(c in "#$%&*|~^<>{}[]\\=_@+" for c in text) / len(text),
        sum(c.isupper() for c in text) / sum(c.isalpha() for c in text),
        sum(n - 1 for n in Counter(triples).values()) / len(triples),
        sum(map(len, tokens)) / len(tokens),
        sum(len(w) <= 3 for w in tokens) / len(tokens),
        sum(c in ".!?" for c in text) / len(tokens),
        sum(c.isdigit() for c in text) / len(text),
        sum(a and b for a, b in zip(marks, marks[1:])) / len(text),
        sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens),
    ]
    assert present.all() and stats[0] == pytest.approx(want)


def test_scorer_by_loops():
    rng = np.random.default_rng(22)
    texts = ["one two three", "A b! c", "x" * 50, "aa bb aa bb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    stats, h, row_offs, _ = quality.statistics(data, offs)
    s = quality.Scorer(1 << 8)
    s.w, s.bias = rng.normal(size=len(s.w)), 0.3
    got = s.score(data, offs, stats, h, row_offs)
    for k, (cols, vals) in enumerate(quality._sparse(data, offs, stats, h, row_offs, s.bins, range(len(texts)))):
        z = s.bias + sum(float(x) * s.w[c] for c, x in zip(np.frombuffer(cols, np.int32), np.frombuffer(vals, np.float32)))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def small_cnn(seed=3):
    m = toxicity.TextCnn(seed, buckets=64, dim=3, widths=(1, 2, 3), filters=2)
    rng = np.random.default_rng(seed)
    m.emb[:-1] = rng.normal(size=m.emb[:-1].shape)
    m.out = rng.normal(size=len(m.out)).astype(np.float32)
    return m


def forward(m, row):
    """One text, by loops."""
    pooled = []
    for k, w in enumerate(m.widths):
        best = [-math.inf] * m.conv[k].shape[2]
        for at in range(max(1, len(row) - w + 1)):
            for f in range(len(best)):
                z = sum(float(m.emb[row[at + j] if at + j < len(row) else m.buckets][d]) * float(m.conv[k][j][d, f]) for j in range(w) for d in range(m.emb.shape[1]))
                best[f] = max(best[f], z)
        pooled += best
    return 1 / (1 + math.exp(-(sum(max(0.0, x) * float(o) for x, o in zip(pooled, m.out)) + float(m.bias))))


def test_cnn_forward_and_gradient_by_loops():
    m, rng = small_cnn(), np.random.default_rng(4)
    texts = [rng.integers(0, 64, n) for n in (1, 2, 5, 9)]
    y, weight = np.array([1, 0, 1, 0], np.float32), np.array([0.1, 0.2, 0.3, 0.4], np.float32)
    assert m.score(texts) == pytest.approx([forward(m, t) for t in texts], abs=1e-5)

    def loss():
        return -sum(w * math.log(p if t else 1 - p) for w, t, p in zip(weight, y, (forward(m, t) for t in texts)))

    def slope(array, at, step=1e-2):
        was = array[at]
        array[at] = was + step
        up = loss()
        array[at] = was - step
        down = loss()
        array[at] = was
        return (up - down) / (2 * step)

    word, g_word, g_conv, g_out, g_bias = m.gradients(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), y, weight)
    for k in range(3):
        for at in [(0, 0, 0), (k, 2, 1)]:
            assert g_conv[k][at] == pytest.approx(slope(m.conv[k], at), abs=3e-3)
    for at in (0, 3, 5):
        assert g_out[at] == pytest.approx(slope(m.out, at), abs=3e-3)
    for k in range(0, len(word), 3):
        assert g_word[k, 1] == pytest.approx(slope(m.emb, (word[k], 1)), abs=3e-3)
    bias = m.bias
    m.bias = bias + np.float32(1e-2)
    up = loss()
    m.bias = bias - np.float32(1e-2)
    assert g_bias == pytest.approx((up - loss()) / 2e-2, abs=3e-3)


def test_convolutions_add_to_single_words():
    """Toxic is the order of two words that both classes have: filters of width 1 cannot tell, wider ones do."""
    rng, texts, y = np.random.default_rng(5), [], []
    for k in range(1200):
        t = rng.integers(10, 60, 12)
        at = int(rng.integers(0, 10))
        t[at : at + 2] = (1, 2) if k % 2 else (2, 1)
        texts.append(t)
        y.append(k % 2)
    y = np.array(y, np.float32)
    right = {}
    for widths in ((1,), (1, 2)):
        m = toxicity.TextCnn(buckets=64, widths=widths).fit(texts[:900], y[:900], epochs=30)
        right[widths] = ((m.score(texts[900:]) > 0.5) == (y[900:] > 0)).mean()
    assert right[(1,)] < 0.65 and right[(1, 2)] > 0.9


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7} bad words here" if k % 2 else "good words here and there", "en") for k in range(200)] + [(k, "copy of a row", "en") for k in [3] * 50], "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).distinct()
    seen = []
    fit = toxicity.TextCnn.fit
    toxicity.TextCnn.fit = lambda self, rows, y, **k: (seen.append(sum(4 * len(r) for r in rows)), fit(self, rows, y, epochs=1))[1]
    try:
        toxicity.train(docs, labels, sample_bytes=800)
        toxicity.train(docs, labels)
    finally:
        toxicity.TextCnn.fit = fit
    assert seen[0] <= 800 < seen[1]


def labelled(spark, toxic, clean, late):
    """Short texts, toxic if they say vile, or foul in the toxic rows that come after the first `late` by the hash of their id."""
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id")))
    docs = spark.range(toxic + clean).select(F.col("id").alias("doc_id"), (F.col("id") < toxic).cast("int").alias("toxic"))
    bad = F.when(F.col("toxic") == 0, "kind").when(place <= late, "vile").otherwise("foul")
    text = F.concat_ws(" ", F.concat(F.lit("a"), F.col("doc_id") % 50), bad, F.concat(F.lit("b"), F.col("doc_id") % 37), F.concat(F.lit("n"), F.col("doc_id")))
    return docs.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), "toxic").localCheckpoint()


@pytest.mark.parametrize("shard_bytes", [None, 1 << 15])
def test_toxicity_fits_all_labels(spark, shard_bytes, monkeypatch):
    """A word that stands in no toxic text among the first 8000 by hash."""
    if shard_bytes:
        monkeypatch.setattr(toxicity, "SHARD_BYTES", shard_bytes)
    docs = labelled(spark, 9000, 600, 8000)
    want = {r.doc_id for r in docs.filter("toxic = 1").collect()}
    assert docs.filter("text LIKE '% foul %'").count() == 1000
    assert {r.doc_id for r in toxicity.find_toxic(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()} == want


def test_toxicity_in_shards(spark, monkeypatch):
    """Every text to train on is trained on once in each epoch, every other one calibrates; no way of joining or partitioning changes the model."""
    docs = labelled(spark, 300, 900, 200)
    docs, labels = docs.drop("toxic").union(docs.drop("toxic").filter("doc_id < 100")), docs.select("doc_id", "toxic")
    read, fit = [], toxicity.fit_shards

    def kept(packed, weights):
        read.append([x for b in packed.toArrow().to_batches() for x in toxicity.unpack(b)])
        return fit(packed, weights, epochs=2)

    monkeypatch.setattr(toxicity, "fit_shards", kept)
    a = toxicity.train(docs, labels, shard_bytes=2000)
    b = toxicity.train(docs.repartition(7).sortWithinPartitions("text"), labels.repartition(3), shard_bytes=2000, max_broadcast=0)
    assert a.thresholds == b.thresholds and (a.flat() == b.flat()).all()
    for one in read:
        assert len({x[0] for x in one}) > 5 and sum(len(x[2]) for x in one) == 1200 and sum(x[3].sum() for x in one) == 300
        assert all(x[1] == toxicity.held_out(r.astype(np.int32).tobytes()) for x in one for r in x[2])
    rows, y, held = [r for x in read[0] for r in x[2]], np.concatenate([x[3] for x in read[0]]), np.concatenate([[x[1]] * len(x[2]) for x in read[0]])
    start, some = toxicity.TextCnn(), [r for r, h in zip(rows, held) if not h]
    start.start(*toxicity.counts(some, y[~held]), y[~held].mean())
    p, one = np.round(a.score([r for r, h in zip(rows, held) if h]).astype(np.float64), 6), toxicity.TextCnn()
    one.calibrate(p, y[held], ["en"] * int(held.sum()), np.ones(int(held.sum())))
    assert one.thresholds == a.thresholds
    unseen = np.setdiff1d(np.arange(toxicity.BUCKETS), np.concatenate(some))
    assert (a.emb[unseen] == start.emb[unseen]).all() and (a.emb[some[0]] != start.emb[some[0]]).any()


def test_flat_parameters_come_back():
    m = small_cnn()
    was, texts = m.flat(), [np.array([1, 2, 3]), np.array([4])]
    p = m.score(texts)
    other = small_cnn(8)
    other.load(was)
    assert (other.flat() == was).all() and (other.score(texts) == p).all()


def test_secrets_in_long_runs_and_texts(spark):
    rng = np.random.default_rng(23)
    letters = list(string.ascii_letters + string.digits)
    key = "".join(rng.choice(letters, 40))
    texts = ["a" * 200_000 + "9" + key + "b" * 1000, " ".join(["plain words"] * 50_000) + " " + key, "=".join("".join(rng.choice(letters, 24)) for _ in range(3000)), f"id {key}\n{key}", key[:19]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.process_time()
    got = Counter((r.doc_id, r.start, r.length) for r in secrets.find_secrets(df).collect())
    assert got[0, 0, 201_041] == 1 and got[1, 600_000, 40] == 1 and got[3, 3, 40] == got[3, 44, 40] == 1
    assert not [k for k in got if k[0] == 4] and time.process_time() - began < 20
    data = np.frombuffer(texts[0].encode(), np.uint8)
    began = time.process_time()
    best = secrets.best_entropy(data, np.array([0, 200_000]), np.array([len(data), len(data)]))
    assert time.process_time() - began < 2 and abs(best[0] - best[1]) < 1e-9


def test_packing_spreads_a_hot_id(spark):
    df = spark.createDataFrame([(None, "three words here")] * 400 + [(k, "two words") for k in range(50)], "doc_id bigint, text string")
    got = packing.pack(df, window=16, shard_windows=4, hot_rows=20).collect()
    assert len(got) == 450
    size = Counter(r.shard for r in got if r.doc_id is None)
    assert len(size) > 8 and max(size.values()) < 150
    used = Counter()
    for r in got:
        used[r.shard, r.window] += r.n_tokens
    assert max(used.values()) <= 16


def test_pipeline_on_odd_tables(spark, odd, none):
    for docs in (odd, none, odd.union(odd)):
        had = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, Scratch(spark, "test").save(stage(spark, docs, SMALL))
            if name != "packing":
                assert docs.columns == before.columns and docs.count() <= before.count()
        assert docs.columns == ["shard", "window", "offset", "doc_id", "piece", "start", "n_tokens"]
        assert docs.count() if had else not docs.count()


def test_words_are_those_of_the_regex(spark):
    texts = ["“Curly” quotes—and dashes… l’été naïve 3×4", "日本語のテキスト。これはtest文です", "한국어 단어 둘", "emoji 😀x😀y", "ไทย ab", "", "é", "𠀀a𐍈b", "a b　c", "plain words_and-signs"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    s, e, row_offs = words(data, np.cumsum([0, *map(len, raw)]))
    found = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    got = [found[row_offs[k] : row_offs[k + 1]] for k in range(len(texts))]
    assert got[0] == ["Curly", "quotes", "and", "dashes", "l", "été", "naïve", "3", "4"] and got[2] == ["한국어", "단어", "둘"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r[1] for r in df.select("k", F.regexp_extract_all("t", F.lit(WORD_REGEX), F.lit(0))).orderBy("k").collect()] == got
    assert [duckdb.execute("SELECT regexp_extract_all(?, ?)", [t, WORD_REGEX]).fetchone()[0] for t in texts] == got


def test_benchmark_in_a_script_without_blanks(spark):
    item = "日本の首都は東京であり人口が最も多い都市です"
    docs = spark.createDataFrame([(1, f"前書きがある。{item}。そして続く文章がここにあります。" + "別の話。" * 20), (2, "まったく関係のない文章です。"), (3, f"the “{item[:9]}” and more")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, "one “two” three — four five six seven eight nine")], "item_id bigint, text string")
    for bound in (10**6, 0):
        got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.find_leaks(docs, bench, max_grams=bound).collect()}
        assert got == {(1, 7): len(item) - 7, (3, 7): 2}
        clean = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, max_grams=bound).collect()}
        assert item not in clean[1] and clean[1].startswith("前書きがある。。そして") and clean[2] == "まったく関係のない文章です。"
