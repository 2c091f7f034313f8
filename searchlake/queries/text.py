"""Text analysis and full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..operators import postings
from ..plans import parser
from ..plans.compiler import Compiler
from ..types import TextOption
from .base import collection, matching, query, read

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def bm25_sql(tokens: list[str], table: str = "documents", key: str = "doc_id", field: str = "text", having: str = "count(*) >= 1", boost: str = "") -> str:
    """SELECT of (key, _score) of the records that have tokens, by BM25 over the whole table."""
    listed = ", ".join(f"'{t}'" for t in tokens)
    return f"""
      SELECT {key}, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))){boost} AS _score
      FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM (
              SELECT {key}, token, count(*) AS tf, any_value(dl) AS dl
              FROM (SELECT {key}, len(t) AS dl, unnest(t) AS token FROM (SELECT {key}, {TOKENS.format(field)} AS t FROM {table}))
              WHERE token IN ({listed}) GROUP BY {key}, token)),
           (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM (SELECT {TOKENS.format(field)} AS t FROM {table}) WHERE len(t) > 0)
      GROUP BY {key} HAVING {having}"""


def rounded(sql: str, key: str = "doc_id", extra: str = "") -> str:
    return f"SELECT {key}, round(_score, 6) AS _score FROM ({sql}){extra}"


def _rounded(df, key="doc_id"):
    return df.select(key, F.round("_score", 6).alias("_score"))


def _search(name: str, where: str, sql: str, table: str = "documents", key: str = "doc_id") -> None:
    def run(spark, sf_dir):
        return _rounded(collection(spark, sf_dir, table).matches(parser.parse_where(where)), key)

    run.__doc__ = f"{table} WHERE {where}"
    query(sql, name)(run)


_search("text_or", "text = text('ther thth ndon')", rounded(bm25_sql(["ther", "thth", "ndon"])))
_search("text_and", "text = text('ther thth', operator='and')", rounded(bm25_sql(["ther", "thth"], having="count(*) = 2")))
_search("text_implicit_eq", "text = 'Ther of'", rounded(bm25_sql(["ther", "of"])))
_search("text_boost", "text = text('ther', boost=2.5)", rounded(bm25_sql(["ther"], boost=" * 2.5")))
_search("text_and_filter", "text = text('ther thth') AND lang = 'en' AND n_chars > 500", f"SELECT doc_id, round(_score + 2, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])}) JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 500")
_search(
    "text_or_filter", "text = text('ther') OR lang = 'fr'",
    f"SELECT d.doc_id, round(coalesce(s._score, 0) + CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END, 6) AS _score FROM documents d LEFT JOIN ({bm25_sql(['ther'])}) s USING (doc_id) WHERE lang = 'fr' OR s.doc_id IS NOT NULL",
)


def _phrase_sql(first: str, second: str, slop: int) -> str:
    place = "list_filter(list_transform(range(len(t)), lambda i: CASE WHEN t[i + 1] = '{}' THEN i END), lambda i: i IS NOT NULL)"
    return f"""
      WITH p AS (SELECT doc_id, unnest({place.format(first)}) AS x, {place.format(second)} AS ys
                 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) WHERE list_contains(t, '{first}') AND list_contains(t, '{second}')),
      hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, x, unnest(ys) AS y FROM p) WHERE y BETWEEN x + 1 - {slop} AND x + 1 + {slop})
      SELECT doc_id, round(_score, 6) AS _score FROM ({bm25_sql([first, second])}) JOIN hit USING (doc_id)"""


_search("phrase_exact", "text = phrase('of the')", _phrase_sql("of", "the", 0))
_search("phrase_slop", "text = phrase('of the', slop=2)", _phrase_sql("of", "the", 2))
_search("phrase_single", "text = phrase('ther')", rounded(bm25_sql(["ther"])))
_search("text_pages", "html = text('article ther')", rounded(bm25_sql(["article", "ther"], "pages", "page_id", "html"), "page_id"), "pages", "page_id")

BENCH_PHRASE = "thshhe thanheha"


@query(f"SELECT doc_id, round(_score, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])}) ORDER BY round(_score, 6) DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    """The ten best by BM25."""
    hits = _rounded(collection(spark, sf_dir, "documents").matches(parser.parse_where("text = text('ther thth')")))
    return hits.orderBy(F.desc("_score"), "doc_id").limit(10)


def flagship(spark, sf_dir):
    """Text and structure in one query, best ten first."""
    c = collection(spark, sf_dir, "documents")
    return c.search(parser.parse("SELECT doc_id, lang, n_chars FROM documents WHERE text = text('ther thth') AND lang = 'en' ORDER BY _score DESC LIMIT 10"))


@query(f"SELECT doc_id, lang, n_chars, round(_score + 1, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])}) JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY round(_score + 1, 6) DESC, doc_id LIMIT 10", "hybrid_topk")
def _hybrid_topk(spark, sf_dir):
    c = collection(spark, sf_dir, "documents").matches(parser.parse_where("text = text('ther thth') AND lang = 'en'"))
    return c.select("doc_id", "lang", "n_chars", F.round("_score", 6).alias("_score")).orderBy(F.desc("_score"), "doc_id").limit(10)


def _multi(tokens, boost_a, boost_b):
    a, b = bm25_sql(tokens, "pages", "page_id", "html", boost=f" * {boost_a}"), bm25_sql(tokens, "pages", "page_id", "url", boost=f" * {boost_b}")
    return f"SELECT page_id, round(sum(_score), 6) AS _score FROM (SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})) GROUP BY page_id"


@query(_multi(["blog", "ther"], 1.0, 1.0))
def text_multi_field(spark, sf_dir):
    """One text over two fields; a record scores for each."""
    c = Compiler(read(spark, sf_dir, "pages"), "page_id", {"html": Analyzer(), "url": Analyzer()})
    return _rounded(c.matches(parser.parse_where("html = text('blog ther') OR url = text('blog ther')")), "page_id")


@query(_multi(["blog", "ther"], 0.5, 3.0))
def multi_field_boost(spark, sf_dir):
    """The same with a weight for each field."""
    c = Compiler(read(spark, sf_dir, "pages"), "page_id", {"html": Analyzer(), "url": Analyzer()})
    return _rounded(c.matches(parser.parse_where("html = text('blog ther', boost=0.5) OR url = text('blog ther', boost=3)")), "page_id")


@query(rounded(bm25_sql(["ther", "ndon", "whon"])))
def text_synonym(spark, sf_dir):
    """A query word stands for its whole group of synonyms."""
    option = TextOption(synonyms=(("ther", "ndon", "whon"),))
    c = Compiler(read(spark, sf_dir, "documents"), "doc_id", {"text": Analyzer(option)})
    return _rounded(c.matches(parser.parse_where("text = text('ther')")))


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query(f"SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INTEGER) AS n FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize_standard(spark, sf_dir):
    t = _documents(spark, sf_dir).select("doc_id", Analyzer().tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(r"SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INTEGER) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)")
def tokenize_whitespace(spark, sf_dir):
    a = Analyzer(TextOption("whitespace", lowercase=False))
    t = _documents(spark, sf_dir).select("doc_id", a.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') AS tokens FROM documents")
def analyze_no_lowercase(spark, sf_dir):
    a = Analyzer(TextOption(lowercase=False))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(a.tokens(F.col("text")), " ").alias("tokens"))


@query(r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(html), '\s+'), lambda x: x <> ''), ' ') AS tokens FROM pages")
def analyze_lowercase(spark, sf_dir):
    a = Analyzer(TextOption("whitespace"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(a.tokens(F.col("html")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_filter({TOKENS.format('text')}, lambda x: x NOT IN ('the', 'of', 'and', 'to')), ' ') AS tokens FROM documents")
def analyze_stopwords(spark, sf_dir):
    a = Analyzer(TextOption(stopwords=("the", "of", "and", "to")))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(a.tokens(F.col("text")), " ").alias("tokens"))


@query()
def analyze_stem(spark, sf_dir):
    """Every distinct token of documents with its stem."""
    tokens = _documents(spark, sf_dir).select(F.explode(Analyzer().tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", Analyzer(TextOption("whitespace", stemmer="english")).tokens(F.col("token"))[0].alias("stem"))


@query()
def tokenize_uax29(spark, sf_dir):
    """Unicode word segments with letters or digits."""
    t = _documents(spark, sf_dir).select("doc_id", Analyzer(TextOption("uax29")).tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(f"SELECT conv_id, turn, unnest(t) AS token, CAST(unnest(range(len(t))) AS INTEGER) AS pos FROM (SELECT conv_id, turn, list_filter({TOKENS.format('text')}, lambda x: x <> 'the') AS t FROM conversations)")
def token_positions(spark, sf_dir):
    """Positions count after stop words are gone."""
    a = Analyzer(TextOption(stopwords=("the",)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(a.tokens(F.col("text"))).alias("pos", "token"))


@query(f"""
  SELECT doc_id, token, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, CAST(any_value(dl) AS INTEGER) AS dl
  FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)) GROUP BY doc_id, token""")
def postings_build(spark, sf_dir):
    p = postings.postings(_documents(spark, sf_dir), "text", id_col="doc_id")
    return p.select(F.col("_id").alias("doc_id"), "token", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "dl")


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS dl FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) WHERE len(t) > 0")
def doc_lengths(spark, sf_dir):
    return postings.doc_lengths(_documents(spark, sf_dir), "text", id_col="doc_id").withColumnRenamed("_id", "doc_id")


@query(f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)) GROUP BY token")
def term_doc_freq(spark, sf_dir):
    tokens = _documents(spark, sf_dir).select(F.explode(F.array_distinct(Analyzer().tokens(F.col("text")))).alias("token"))
    return postings.document_frequencies(tokens)


matching("conv_search", "conversations", "text = text('ther')", "conv_id, turn", f"SELECT conv_id, turn FROM conversations WHERE list_contains({TOKENS.format('text')}, 'ther')")
