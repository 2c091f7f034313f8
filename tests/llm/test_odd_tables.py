"""Every operator on odd rows and on empty tables: defined results, no crash."""

import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlake.llm import decontaminate, htmltext, kdshard, linededup, neardup, packing, quality, secrets, toxicity, vafile

BENCH = "item_id bigint, text string, gram string, pos int"


@pytest.fixture
def bench(spark):
    rows = [(1, "quick river runs over the old stone bridge at noon", "x", 1), (2, "stone bridge at noon and", None, None), (3, "too short", None, 1), (None, "the quick river runs over the old", None, 1), (4, None, None, 1), (1, "quick river runs over the old stone bridge at noon", "x", 1)]
    return spark.createDataFrame(rows, BENCH)


CLASHES = ("__suspects", "__first", "__id", "__hits", "suspects", "first", "ID_", "body", "digest", "hits", "item_id", "doc", "h", "gram", "pos", "size")


@pytest.fixture
def clashing(odd):
    """More columns whose names are used inside, and a field with a blank in its name."""
    return odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)], F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c`d")).alias("nested one"))


def test_clashing_columns(clashing, bench):
    def rest(df):
        return sorted((str(r["doc_id"]), *(r[c] for c in CLASHES), tuple(r["nested one"])) for r in df.collect())

    want = rest(clashing)
    for bound, firsts in ((1 << 20, 100), (1 << 20, 0), (-1, 0)):
        got = linededup.dedup_lines(clashing, max_broadcast=bound, max_firsts=firsts)
        assert got.columns == [*clashing.columns, "n_removed"] and rest(got) == want
    for bound in (10**6, 0):
        got = decontaminate.clean(clashing, bench.withColumn("hits", F.lit(1)), drop_share=1.0, max_grams=bound)
        assert got.columns == clashing.columns and rest(got) == want
    assert quality.score(clashing, keep_only=False).columns == [*clashing.columns, "quality"]
    assert neardup.keep_one(clashing).columns == clashing.columns


def test_line_dedup(odd, none):
    for bound, firsts in ((1 << 20, 100), (1 << 20, 0), (-1, 0)):
        got = linededup.dedup_lines(odd, max_broadcast=bound, max_firsts=firsts)
        assert got.columns == [*odd.columns, "n_removed"]
        rows = got.collect()
        assert len(rows) == odd.count()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        # repeated rows keep the first occurrence alike; the row without id and the later ones lose theirs
        assert [r.n_removed for r in by[1]] == [0, 0]
        assert sorted((r.text is None, r.text, r.n_removed) for r in by[None]) == [(False, "", 2), (True, None, 0)]
        assert by[2][0].text == "" and by[3][0].text is None and by[4][0].text == "   \n\t\n"
        assert by[7][0].text == "É ü 漢字 – “quoted”" and by[7][0].n_removed == 1
        assert by[5][0].n_removed == 0 and by[6][0].text == "" and by[6][0].n_removed == 2
        assert by[8][0].key == 2 and by[8][0].number is None
        assert linededup.dedup_lines(none, max_broadcast=bound).collect() == []


def test_near_groups(odd, none):
    assert sorted(map(tuple, neardup.near_groups(odd).collect())) == [(6, 5)]
    assert neardup.near_groups(none).collect() == []
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    # of the row without id and the two rows of id 1, which are alike, one stays
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert neardup.keep_one(none).collect() == []
    own = neardup.keep_one(odd.filter("doc_id > 4"))
    assert sorted(r.doc_id for r in own.collect()) == [5, 7, 8]
    null = neardup.keep_one(odd.filter("doc_id IS NULL").union(odd.filter("doc_id IS NULL")))
    assert sorted(r.text is None for r in null.collect()) == [False, True, True]


def test_decontaminate(odd, none, bench):
    for bound in (10**6, 0):
        got = sorted(map(tuple, decontaminate.find_leaks(odd, bench, max_grams=bound).collect()))
        assert [r[:2] for r in got] == [(1, 1), (1, 2), (7, 1)]
        clean = decontaminate.clean(odd, bench, max_grams=bound)
        assert clean.columns == odd.columns
        rows = {(r.doc_id, r.text) for r in clean.collect()}
        assert (2, "") in rows and (3, None) in rows and (None, None) in rows
        assert not any(t and "stone bridge" in t for _, t in rows)
        assert decontaminate.find_leaks(none, bench, max_grams=bound).collect() == []
        assert decontaminate.find_leaks(odd, bench.limit(0), max_grams=bound).collect() == []
        assert decontaminate.clean(odd, bench.limit(0), max_grams=bound).count() == odd.count()
        assert decontaminate.clean(none, bench, max_grams=bound).collect() == []


def test_size_of_the_benchmark_counts_words_and_bytes(spark):
    lines = spark.createDataFrame([(1, "\n".join(f"w{k}" for k in range(30_000)))], "item_id bigint, text string")
    assert decontaminate._collected(lines, 8, 5, 1000) is None
    assert len(decontaminate._collected(lines, 8, 5, 30_000).sizes[8][0]) == 29_993
    long = spark.createDataFrame([(1, "x" * (decontaminate.MAX_BROADCAST_BYTES + 1))], "item_id bigint, text string")
    assert decontaminate._collected(long, 8, 5, 1000) is None


def test_packing(odd, none):
    got = packing.pack(odd, window=64, shard_windows=2).collect()
    assert {r.doc_id for r in got} == {1, None, 5, 6, 7, 8}
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 40_007
    assert packing.pack(none).collect() == []


def test_quality(odd, none):
    got = {(r.doc_id, r.text): r.quality for r in quality.score(odd, keep_only=False).collect()}
    assert got[2, ""] == got[3, None] == got[4, "   \n\t\n"] == got[None, None] == 0
    assert quality.score(odd).columns == [*odd.columns, "quality"]
    assert quality.score(none).collect() == []


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 0), (7, 0, 0), (None, 1, 1), (8, 1, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.find_toxic(odd, labels, flagged_only=False).collect()
    assert len(got) == odd.count()
    assert all(r.toxicity == 0 for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.find_toxic(odd, labels.limit(0)).collect() == []
    assert toxicity.find_toxic(none, labels).collect() == []


def test_secrets(spark, odd, none):
    assert secrets.find_secrets(odd).collect() == [] == secrets.find_secrets(none).collect()


def test_planted_keys(spark):
    rng = np.random.default_rng(9)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    forms = [("key=", "0123456789abcdef", 32), ("token=", "0123456789ABCDEF", 40), ("api_key=", "0123456789abcdef", 32), ("AKIA", upper + digits, 16), ("", lower + digits, 24), ("", upper + digits, 20), ("", lower + upper + digits, 20), ("sk_live_", lower + upper + digits, 24), ("password=", lower + digits, 20), ("ghp_", lower + upper + digits, 36)]
    rows = [(f * 1000 + i, f"note é {name}{''.join(rng.choice(list(letters), n))} end", name, n) for f, (name, letters, n) in enumerate(forms) for i in range(300)]
    found = {}
    for r in secrets.find_secrets(spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    for f, (name, letters, n) in enumerate(forms):
        # the whole key is within what is reported
        hit = sum(any(a <= 7 + len(name) and a + m == 7 + len(name) + n for a, m in found.get(f * 1000 + i, [])) for i in range(300))
        assert hit >= 0.95 * 300, (name, n, hit)
    plain = ["key=user/settings/page/2024/overview", "internationalization2024", "id=3f2b8c1e-1111-4222-8333-abcdefabcdef", "name=quick_river_over_the_bridge"]
    assert secrets.find_secrets(spark.createDataFrame(list(enumerate(plain)), "doc_id bigint, text string")).collect() == []


def test_sharding(odd, none):
    got = kdshard.shard(odd, target_bytes=100).collect()
    assert len(got) == odd.count()
    # rows that agree in every dimension stay together
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert kdshard.shard(none, target_bytes=100).collect() == []
    assert {r.shard for r in kdshard.shard(odd).collect()} == {1}


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0], 1, 5), (2, [0.0, 1.0], 1, None), (2, [0.0, 1.0], 1, None), (3, [0.0, 1.0], None, 1), (None, [1.0, 1.0], 1, 1), (4, None, 1, 1), (5, [nan, 1.0], 1, 1), (6, [inf, 1.0], 1, 1), (7, [1.0, None], 1, 1), (8, [1.0], 1, 1), (9, [], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, block int")
    got = sorted(map(tuple, vafile.nearest(df, k=2, block_rows=2).collect()))
    assert [r for r in got if r[0] == 1] == [(1, 1, 2, 1.0), (1, 2, 2, 1.0)]
    assert {r[0] for r in got} == {1, 2, 3}
    assert vafile.nearest(df.limit(0)).collect() == []


def test_html(spark):
    rows = [(1, "http://A.example.com/x", "<body><article><p>Some text, long enough to win here.</p></article></body>", "w"), (1, "http://A.example.com/x", "<body><article><p>Some text, long enough to win here.</p></article></body>", "w"), (2, None, "<p>No host", "w"), (3, "http://a.example.com/y", None, None), (4, "http://a.example.com/z", "", "w"), (None, "nonsense", "< > <<p <!-- unclosed", "w"), (5, "http://b.example.com/", "<div>" * 3000 + "deep" + "</div>" * 3000, "w"), (6, "http://c.example.com", "<script>var x = 1;</script><style>p{}</style>", "w")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, winner string")
    for bound in (1 << 20, 0):
        got = {}
        for r in htmltext.extract(pages, max_broadcast=bound).collect():
            got.setdefault(r.page_id, []).append(r)
        assert [r.text for r in got[1]] == ["Some text, long enough to win here."] * 2
        assert got[1][0].host == "a.example.com" and got[1][0].consensus
        assert got[2][0].text == "No host" and not got[2][0].consensus
        assert got[3][0].text == got[4][0].text == got[6][0].text == "" and got[3][0].path is None
        assert got[5][0].text == "deep"
    assert htmltext.extract(pages.limit(0)).collect() == []
