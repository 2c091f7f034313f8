"""From a query tree to a DataFrame.

Each node becomes a pair of columns, whether a record matches and what it then scores, over one
DataFrame. A test of a field is written bare, so that Parquet gets it: a missing value makes it
null, which a filter drops like false. NOT is carried down to the tests, where it lets missing
values in. Text nodes add the token counts that they need; each text is tokenised once, and only
where the tests of other fields hold; the collection's statistics are one broadcast row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParam, NotSupported
from ..functions import vectors
from ..functions.analysis import Analyzer
from ..functions.values import literal
from ..types import FieldType
from .ir import And, Between, InList, Knn, Node, Not, Or, Phrase, Search, Term, Text

K1, B = 1.2, 0.75


def bm25(tf: Column, df: Column, n: Column, length: Column, mean_length: Column) -> Column:
    """BM25 of one token, with an inverse document frequency that is negative for tokens of most records."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))).otherwise(0.0)


def _equal(token: str):
    return lambda x: x == token


def _place(token: str):
    return lambda x, i: F.when(x == token, i)


def _within(at: Column, slop: int):
    return lambda y: (y >= at + 1 - slop) & (y <= at + 1 + slop)


def phrase_match(positions: list[Column], slop: int) -> Column:
    """Whether tokens at these positions follow each other: from each place of the first, every next
    token's first position within slop of where it is expected."""
    if len(positions) == 1:
        return F.size(positions[0]) > 0

    def follow(p: Column) -> Column:
        at = p
        for own in positions[1:]:
            near = F.filter(own, _within(at, slop))
            at = F.try_element_at(near, F.lit(1))
        return at.isNotNull()

    return F.exists(positions[0], follow)


class Compiler:
    """Compiles queries over records that have an id column and typed columns."""

    def __init__(self, df: DataFrame, id_col: str = "_id", analyzers: dict[str, Analyzer] | None = None):
        self.df, self.id_col, self.analyzers = df, id_col, analyzers or {}
        self.types = {f.name: f.dataType for f in df.schema.fields}

    # Fields and literals

    def _type(self, name: str) -> T.DataType:
        if name not in self.types:
            raise InvalidParam(f"no field {name}")
        return self.types[name]

    def _literal(self, value, kind: T.DataType) -> Column:
        if isinstance(kind, T.BooleanType):
            return F.lit(literal(str(value), FieldType.BOOL))
        if isinstance(kind, T.IntegralType):
            if isinstance(value, float):
                return F.lit(value)
            return F.lit(literal(str(value), FieldType.INT))
        if isinstance(kind, T.FloatType):
            return F.lit(literal(str(value), FieldType.FLOAT)).cast("float")
        if isinstance(kind, (T.DoubleType, T.DecimalType)):
            return F.lit(literal(str(value), FieldType.FLOAT))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(str(value)).cast(kind)
        return F.lit(str(value).lower() if isinstance(value, bool) else str(value))

    def _leaf(self, name: str, test, negated: bool) -> Column:
        """A test of a scalar, or of any element of a list; missing values pass no test, and every negated one."""
        kind, col = self._type(name), F.col(f"`{name}`")
        if name in self.analyzers:
            raise NotSupported(f"{name} is a text field: only = matches it")
        if isinstance(kind, T.ArrayType):
            any_of = F.exists(col, lambda x: test(x, kind.elementType))
            return ~F.coalesce(any_of, F.lit(False)) if negated else any_of
        return ~test(col, kind) | col.isNull() if negated else test(col, kind)

    # Text

    def _analysed(self, node: Text | Phrase) -> list[list[str]]:
        if node.field not in self.types:
            raise InvalidParam(f"no field {node.field}")
        return self.analyzers.get(node.field, Analyzer()).expand(str(node.value))

    def _text_nodes(self, node: Node | None) -> list[Text | Phrase]:
        if isinstance(node, (And, Or)):
            return self._text_nodes(node.left) + self._text_nodes(node.right)
        if isinstance(node, Not):
            return self._text_nodes(node.child)
        return [node] if isinstance(node, (Text, Phrase)) else []

    def _implicit(self, node: Node | None) -> Node | None:
        """textfield = 'words' is a text query."""
        if isinstance(node, (And, Or)):
            return type(node)(self._implicit(node.left), self._implicit(node.right))
        if isinstance(node, Not):
            return Not(self._implicit(node.child))
        if isinstance(node, Term) and node.field in self.analyzers and not node.negated:
            return Text(node.field, str(node.value), "or", node.boost)
        return node

    def _with_tokens(self, where: Node | None) -> tuple[DataFrame, DataFrame | None]:
        """The records with token counts and, for phrases, positions; and the one row of statistics."""
        need: dict[str, dict[str, bool]] = {}
        for node in self._text_nodes(where):
            own = need.setdefault(node.field, {})
            for group in self._analysed(node):
                for t in group:
                    own[t] = own.get(t, False) or isinstance(node, Phrase)
        self.slots = {(f, t): k for k, (f, t) in enumerate((f, t) for f, own in need.items() for t in own)}
        self.fields = {f: k for k, f in enumerate(need)}
        if not need:
            return self.df, None

        def counted(df: DataFrame, positions: bool) -> DataFrame:
            def values(*tokens: Column) -> Column:
                out = [F.coalesce(F.size(t), F.lit(0)).alias(f"__dl{k}") for k, t in enumerate(tokens)]
                for (f, t), k in self.slots.items():
                    own = tokens[self.fields[f]]
                    out.append(F.coalesce(F.size(F.filter(own, _equal(t))), F.lit(0)).alias(f"__tf{k}"))
                    if positions and need[f][t]:
                        out.append(F.filter(F.transform(own, _place(t)), lambda i: i.isNotNull()).alias(f"__pos{k}"))
                return F.struct(*out)

            # a generator over one element: its columns cannot be pushed below it, so that every text is tokenised once
            made = F.struct(*[self.analyzers.get(f, Analyzer()).tokens(F.col(f"`{f}`")).alias(f"t{k}") for f, k in self.fields.items()])
            each = F.transform(F.array(made), lambda x: values(*[x[f"t{k}"] for k in self.fields.values()]))
            return df.select("*", F.inline(each))

        narrow = counted(self.df.select(*[F.col(f"`{f}`") for f in self.fields]), False)
        stats = narrow.agg(
            *[F.sum((F.col(f"__dl{k}") > 0).cast("bigint")).alias(f"__n{k}") for k in self.fields.values()],
            *[F.sum(f"__dl{k}").alias(f"__len{k}") for k in self.fields.values()],
            *[F.sum((F.col(f"__tf{k}") > 0).cast("bigint")).alias(f"__df{k}") for k in self.slots.values()],
        )
        return counted(self.df, True), stats

    # Nodes

    def node(self, n: Node, negated: bool = False) -> tuple[Column, Column]:
        """(match, score) of a node, or of its negation; the score counts where it matches."""
        if isinstance(n, (And, Or)):
            (lm, ls), (rm, rs) = self.node(n.left, negated), self.node(n.right, negated)
            if isinstance(n, And) != negated:
                return lm & rm, ls + rs
            return lm | rm, F.when(lm, ls).otherwise(0.0) + F.when(rm, rs).otherwise(0.0)
        if isinstance(n, Not):
            return self.node(n.child, not negated)[0], F.lit(1.0)
        if isinstance(n, (Text, Phrase)):
            match, score = self._text(n) if isinstance(n, Text) else self._phrase(n)
            return ~match if negated else match, score
        if isinstance(n, Knn):
            raise NotSupported("knn stands by itself or joined by AND to the rest of a query")
        inverted = n.negated != negated
        if isinstance(n, Term):
            match = self._leaf(n.field, lambda x, kind: x == self._literal(n.value, kind), inverted)
        elif isinstance(n, InList):
            match = self._leaf(n.field, lambda x, kind: x.isin(*[self._literal(v, kind) for v in n.values]) if n.values else F.lit(False), inverted)
        else:
            match = self._leaf(n.field, lambda x, kind: self._range(n, x, kind), inverted)
        return match, F.lit(float(n.boost))

    def _range(self, n: Between, x: Column, kind: T.DataType) -> Column:
        tests = []
        if n.low is not None:
            low = self._literal(n.low, kind)
            tests.append(x >= low if n.low_eq else x > low)
        if n.high is not None:
            high = self._literal(n.high, kind)
            tests.append(x <= high if n.high_eq else x < high)
        return reduce(lambda a, b: a & b, tests) if tests else x.isNotNull()

    def _bm25(self, field: str, tokens: list[str], boost: float) -> Column:
        k = self.fields[field]
        n, mean = F.col(f"__n{k}"), F.col(f"__len{k}") / F.col(f"__n{k}")
        parts = [bm25(F.col(f"__tf{i}"), F.col(f"__df{i}"), n, F.col(f"__dl{k}"), mean) for i in (self.slots[field, t] for t in tokens)]
        return reduce(lambda a, b: a + b, parts) * boost

    def _text(self, n: Text) -> tuple[Column, Column]:
        groups = self._analysed(n)
        if not groups:
            return F.lit(False), F.lit(0.0)
        any_of = [reduce(lambda a, b: a | b, [F.col(f"__tf{self.slots[n.field, t]}") > 0 for t in g]) for g in groups]
        match = reduce((lambda a, b: a & b) if n.operator == "and" else (lambda a, b: a | b), any_of)
        return match, self._bm25(n.field, list(dict.fromkeys(t for g in groups for t in g)), n.boost)

    def _phrase(self, n: Phrase) -> tuple[Column, Column]:
        groups = self._analysed(n)
        if not groups:
            return F.lit(False), F.lit(0.0)
        # the cheap counts come first, the walk over positions only where all tokens are there
        have = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(f"__tf{self.slots[n.field, t]}") > 0 for t in g]) for g in groups])
        places = [F.array_sort(F.flatten(F.array(*[F.col(f"__pos{self.slots[n.field, t]}") for t in g]))) if len(g) > 1 else F.col(f"__pos{self.slots[n.field, g[0]]}") for g in groups]
        return have & phrase_match(places, n.slop), self._bm25(n.field, list(dict.fromkeys(t for g in groups for t in g)), n.boost)

    # Whole queries

    def _split_knn(self, n: Node | None) -> tuple[Node | None, Knn | None]:
        if isinstance(n, Knn):
            return None, n
        if isinstance(n, And):
            (left, a), (right, b) = self._split_knn(n.left), self._split_knn(n.right)
            if a and b:
                raise NotSupported("one knn in a query")
            rest = And(left, right) if left and right else left or right
            return rest, a or b
        return n, None

    def matches(self, where: Node | None) -> DataFrame:
        """All matching records with their _score, in no order."""
        where, knn = self._split_knn(self._implicit(where))
        names = [c for c in self.df.columns if c != "_score"]
        df, stats = self._with_tokens(where)
        match, score = self.node(where) if where is not None else (None, F.lit(0.0))
        if match is not None:
            df = df.filter(match)
        if stats is not None:
            df = df.crossJoin(F.broadcast(stats))
        if knn is not None:
            df, score = self._nearest(df, knn, score)
        return df.select(*[F.col(f"`{c}`") for c in names], score.alias("_score"))

    def _nearest(self, df: DataFrame, knn: Knn, score: Column) -> tuple[DataFrame, Column]:
        if not isinstance(self._type(knn.field), T.ArrayType):
            raise InvalidParam(f"{knn.field} is no vector field")
        col = F.col(f"`{knn.field}`")
        q = F.array(*[F.lit(float(x)) for x in knn.vector])
        if isinstance(self._type(knn.field).elementType, T.ArrayType):  # several vectors in a record: the nearest counts
            near = F.array_min(F.transform(F.filter(col, lambda v: vectors.is_valid(v, len(knn.vector))), lambda v: vectors.distance(v, q, knn.metric)))
            df = df.withColumn("__distance", near).filter("__distance IS NOT NULL")
        else:
            df = df.filter(vectors.is_valid(col, len(knn.vector))).withColumn("__distance", vectors.distance(col, q, knn.metric))
        return df.orderBy(F.col("__distance").asc(), F.col(self.id_col).asc()).limit(knn.k), score + F.col("__distance") * knn.boost

    def order_columns(self, order) -> list[Column]:
        out = []
        for name, ascending in order:
            if name != "_score":
                kind = self._type(name)
                if name in self.analyzers or isinstance(kind, (T.ArrayType, T.MapType)):
                    raise InvalidParam(f"cannot order by {name}")
            c = F.col(f"`{name}`")
            out.append(c.asc_nulls_first() if ascending else c.desc_nulls_last())
        return [*out, F.col(self.id_col).asc()]

    def search(self, s: Search) -> DataFrame:
        """The page of a query: matches in order, cut and projected. _score is always there."""
        df = self.matches(s.where).orderBy(*self.order_columns(s.order))
        if s.offset:
            df = df.offset(s.offset)
        if s.limit is not None:
            df = df.limit(s.limit)
        if s.fields:
            for name, _ in s.fields:
                if name != "_score":
                    self._type(name)
            shown = [F.col(f"`{name}`").alias(alias) for name, alias in s.fields]
            if not any(alias == "_score" for _, alias in s.fields):
                shown.append(F.col("_score"))
            if not any(alias == self.id_col for _, alias in s.fields):
                shown.insert(0, F.col(self.id_col))
            df = df.select(*shown)
        return df

    def total_hits(self, where: Node | None) -> DataFrame:
        """The number of matching records, as one row."""
        return self.matches(where).agg(F.count("*").alias("total_hits"))


class IndexedCompiler(Compiler):
    """A compiler that asks indexes: postings for text fields, graphs for vector fields. Other fields are tested on the records.

    texts: by field its postings, or None where nothing is indexed yet; graphs: by field a function
    of (vector, k, allowed ids) that gives the ids found.
    """

    def __init__(self, df: DataFrame, analyzers: dict[str, Analyzer], texts: dict, graphs: dict):
        super().__init__(df, "_id", analyzers)
        self.texts, self.graphs = texts, graphs

    def _must(self, n: Node | None, field: str) -> bool:
        """Whether every match has a token of a query over the field."""
        if isinstance(n, And):
            return self._must(n.left, field) or self._must(n.right, field)
        if isinstance(n, Or):
            return self._must(n.left, field) and self._must(n.right, field)
        return isinstance(n, (Text, Phrase)) and n.field == field

    def _with_tokens(self, where: Node | None) -> tuple[DataFrame, DataFrame | None]:
        nodes = self._text_nodes(where)
        if not nodes or any(self.texts.get(n.field) is None for n in nodes):
            return super()._with_tokens(where)
        need: dict[str, dict[str, bool]] = {}
        for node in nodes:
            own = need.setdefault(node.field, {})
            for t in (t for group in self._analysed(node) for t in group):
                own[t] = own.get(t, False) or isinstance(node, Phrase)
        self.slots = {(f, t): k for k, (f, t) in enumerate((f, t) for f, own in need.items() for t in own)}
        self.fields = {f: k for k, f in enumerate(need)}
        df, stats = self.df, None
        for f, k in self.fields.items():
            index = self.texts[f]
            hits = index.posts.filter(F.col("token").isin(list(need[f])))
            aggs = [F.max("dl").alias(f"__dl{k}")]
            for t in need[f]:
                own, j = F.col("token") == t, self.slots[f, t]
                aggs.append(F.max(F.when(own, F.col("tf"))).alias(f"__tf{j}"))
                if need[f][t]:
                    aggs.append(F.max(F.when(own, F.col("positions"))).alias(f"__pos{j}"))
            wide = hits.groupBy(F.col("_id").alias("__hit")).agg(*aggs)
            df = df.join(wide, F.col("_id") == F.col("__hit"), "inner" if self._must(where, f) else "left").drop("__hit")
            df = df.withColumns({f"__tf{self.slots[f, t]}": F.coalesce(f"__tf{self.slots[f, t]}", F.lit(0)) for t in need[f]} | {f"__dl{k}": F.coalesce(f"__dl{k}", F.lit(0))})
            df = df.withColumns({f"__pos{self.slots[f, t]}": F.coalesce(f"__pos{self.slots[f, t]}", F.array().cast("array<int>")) for t, phrase in need[f].items() if phrase})
            counts = hits.agg(F.lit(0), *[F.count(F.when(F.col("token") == t, 1)).alias(f"__df{self.slots[f, t]}") for t in need[f]]).drop("0")
            own = counts.crossJoin(F.broadcast(index.stats.select(F.col("n").alias(f"__n{k}"), F.col("total").alias(f"__len{k}"))))  # one row each
            stats = own if stats is None else stats.crossJoin(F.broadcast(own))
        return df, stats

    def _nearest(self, df: DataFrame, knn: Knn, score: Column) -> tuple[DataFrame, Column]:
        found = None
        if knn.metric == "euclidean" and knn.field in self.graphs:
            found = self.graphs[knn.field](list(knn.vector), knn.k, df.select("_id") if self._filtered else None)
        if found is not None:
            df = df.join(found.distinct(), "_id", "left_semi")
        return super()._nearest(df, knn, score)

    def matches(self, where: Node | None) -> DataFrame:
        self._filtered = self._split_knn(where)[0] is not None
        return super().matches(where)
