"""Exact top-k by dense and lexical scores for a batch of queries.

Queries go to the executors in blocks of bounded size, several of them at a
time; each batch of rows is made into vectors once and meets every block's
matrix in one product. A partition hands on its k best rows of each query only,
so neither rows nor vectors are shuffled.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.frames import ship, union
from ..functions.text import tokens
from .ranked import ranked

#: Queries of a block, blocks that meet the rows in one pass, and rows that meet a block at once.
QUERY_BLOCK, PASS_BLOCKS, ROWS_AT_ONCE = 2048, 8, 2000
#: Words of rows times the queries that have them, counted at once: arrays of 8 MB each.
HITS_AT_ONCE = 1_000_000
#: Words whose places a worker keeps.
KNOWN_WORDS = 500_000


def _md5(word: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:8], 16) % dim, -1.0 if int(h[8:10], 16) % 2 else 1.0


def _blake2b(word: str, dim: int) -> tuple[int, float]:
    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "big") % dim, -1.0 if h[4] % 2 else 1.0


class Hasher(dict):
    """Unit vectors of word lists: each word adds its sign to its place; a list without words is all zeros."""

    def __init__(self, dim: int = fixed.EMBEDDING_DIM, blake2b: bool = False):
        super().__init__()
        self.dim, self.place = dim, _blake2b if blake2b else _md5

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = self[word] = self.place(word, self.dim)
        return out

    def sums(self, lists: pa.ListArray) -> np.ndarray:
        """Before they are made unit vectors: whole numbers."""
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        at, sign = (np.array(x) for x in zip(*map(self.__getitem__, words), strict=True)) if words else (np.empty(0, np.int64), np.empty(0))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        i = flat.indices.to_numpy()
        return np.bincount(row * self.dim + at[i], sign[i], len(lists) * self.dim).astype(float).reshape(len(lists), self.dim)

    def __call__(self, lists: pa.ListArray) -> np.ndarray:
        return unit(self.sums(lists))


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


class Vectors:
    """Unit vectors of number lists; null lists and those of another length are all zeros, as they're like nothing."""

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self, lists: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(lists), self.dim))
        good = lists.value_lengths().fill_null(-1).to_numpy() == self.dim
        if good.any():
            out[good] = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.dim)
        return unit(out)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of some rows, which are sorted by id, for each query by falling score, then id, in any order; ``scores`` is (rows, queries)."""
    n, m = scores.shape
    if n <= k:
        return np.repeat(ids[:, None], m, 1), scores
    least = np.partition(scores, n - k, axis=0)[n - k]
    at, columns = np.empty((k, m), np.int64), np.ascontiguousarray(scores.T)
    for q in range(m):
        above = np.flatnonzero(columns[q] > least[q])
        at[: len(above), q] = above
        at[len(above) :, q] = np.flatnonzero(columns[q] == least[q])[: k - len(above)]
    return ids[at], np.take_along_axis(scores, at, 0)


def _merged(a: tuple | None, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of two lists of each query."""
    if a is None:
        return b
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -scores), axis=0)[:k]
    return np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)


def topk(rows: DataFrame, blocks, k: int, *, id_col: str, value: Column, prepare) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of each query.

    ``blocks`` are (query ids, block); ``prepare(blocks)`` gives a function
    from an Arrow column of ``value`` to the scores (rows, queries) of each
    block in turn, rounded here to 6 places. Every row counts, also with scores
    of 0 and below; ties go by id.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType
    ship(spark)
    narrow, sent_type = rows.select(F.col(id_col).alias("id"), value.alias("value")), to_arrow_type(kind)
    out, blocks = None, iter(blocks)
    while some := list(islice(blocks, PASS_BLOCKS)):
        sent = spark.sparkContext.broadcast(some)

        def run(batches, sent=sent):
            names = [ids for ids, _ in sent.value]
            score, best, none = prepare([block for _, block in sent.value]), [None] * len(names), None
            for b in batches:
                for start in range(0, b.num_rows, ROWS_AT_ONCE):
                    part = b.slice(start, ROWS_AT_ONCE)
                    ids = part.column(0)
                    if ids.null_count:  # null ids come first, as Spark sorts them; the least value stands for them here
                        none = int(np.iinfo(ids.type.to_pandas_dtype()).min) if pa.types.is_integer(ids.type) else ""
                        ids = ids.fill_null(none)
                    ids = ids.to_numpy(zero_copy_only=False)
                    order = np.argsort(ids, kind="stable")
                    for i, s in enumerate(score(part.column(1))):
                        best[i] = _merged(best[i], _best(ids[order], np.round(s[order], 6) + 0.0, k), k)
            for queries, found in zip(names, best, strict=True):
                if found is not None and len(queries):
                    ids, scores = found
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(queries, len(ids))), id_col: pa.array([x if none is None or x != none else None for x in ids.T.ravel().tolist()], sent_type), "score": pa.array(scores.T.ravel())})

        fields = [T.StructField("query_id", T.LongType()), T.StructField(id_col, kind), T.StructField("score", T.DoubleType())]
        part = narrow.mapInArrow(run, T.StructType(fields))
        out = part if out is None else union(out, part)
    if out is None:
        out = narrow.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    return ranked(out, k, id_col=id_col)


def blocks_of(queries: DataFrame, *cols: str, size: int = QUERY_BLOCK):
    """(query ids, rows of the other columns) of the stated queries, ``size`` at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", *cols).toLocalIterator():
        ids.append(r[0])
        rows.append(tuple(r)[1:])
        if len(ids) == size:
            yield np.array(ids), rows
            ids, rows = [], []
    if ids:
        yield np.array(ids), rows


def hash_topk(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", blake2b: bool = False) -> DataFrame:
    words = queries.select("query_id", tokens(F.col("query")).alias("words"))
    blocks = ((ids, Hasher(blake2b=blake2b)(pa.array([r[0] for r in rows], pa.list_(pa.string())))) for ids, rows in blocks_of(words, "words"))

    def prepare(matrices):
        known = Hasher(blake2b=blake2b)

        def scores(column):
            vectors = known(column)
            return (vectors @ m.T for m in matrices)

        return scores

    return topk(docs, blocks, k, id_col=id_col, value=tokens(F.col(text_col)), prepare=prepare)


class Words:
    """The distinct words of each row of a column: numbers of row and word, how often, and the rows' lengths. Rows are lists of words, or of (term, tf)."""

    def __init__(self, column: pa.ListArray):
        sizes, flat = column.value_lengths().fill_null(0).to_numpy(), column.flatten()
        times = None
        if pa.types.is_struct(flat.type):
            flat, times = flat.flatten()
            times = times.to_numpy()
        flat = flat.dictionary_encode()
        self.n, self.dictionary, row = len(column), flat.dictionary, np.repeat(np.arange(len(column)), sizes)
        many = max(len(flat.dictionary), 1)
        pair, at = np.unique(row * many + flat.indices.to_numpy(), return_inverse=True)
        self.row, self.code = pair // many, pair % many
        self.tf = np.bincount(at, times, len(pair))
        self.dl = np.bincount(self.row, self.tf, self.n)


class Asked:
    """A block of queries' words with their weights, by word."""

    def __init__(self, lists: list):
        self.m, self.sizes = len(lists), np.array([max(len(terms), 1) for terms in lists])
        numbers: dict[str, int] = {}
        word = np.array([numbers.setdefault(term, len(numbers)) for terms in lists for term, _ in terms], np.int64)
        order = np.argsort(word, kind="stable")
        self.terms = pa.array(list(numbers), pa.string())
        self.query = np.repeat(np.arange(self.m), [len(terms) for terms in lists])[order]
        self.weight = np.array([w for terms in lists for _, w in terms], float)[order]
        self.start = np.searchsorted(word[order], np.arange(len(numbers) + 1))

    def sums(self, words: Words, value: np.ndarray) -> np.ndarray:
        """(rows, queries): of the words that both have, each one's value in the row times its weight in the query; -inf without any."""
        place = pc.index_in(words.dictionary, value_set=self.terms).fill_null(-1).to_numpy()[words.code] if len(words.code) else np.empty(0, np.int64)
        on = place >= 0
        row, value, place = words.row[on], value[on], place[on]
        order = np.lexsort((place, row))  # equal rows are summed in the same order, wherever they are
        row, value, place = row[order], value[order], place[order]
        fan = self.start[place + 1] - self.start[place]
        ends = np.cumsum(fan)
        out, held = np.zeros(words.n * self.m), np.zeros(words.n * self.m, bool)
        a = 0
        while a < len(row):
            done = ends[a] - fan[a]
            b = max(a + 1, int(np.searchsorted(ends, done + HITS_AT_ONCE, side="right")))
            each = np.repeat(np.arange(a, b), fan[a:b])
            at = self.start[place[each]] + np.arange(len(each)) - (ends[each] - fan[each] - done)
            low = row[a] * self.m
            cell = row[each] * self.m + self.query[at] - low
            found = np.bincount(cell, value[each] * self.weight[at])
            out[low : low + len(found)] += found
            held[cell + low] = True
            a = b
        out[~held] = -np.inf
        return out.reshape(words.n, self.m)


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 places as Spark and SQL do."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def lexical_topk(rows: DataFrame, asked: DataFrame, k: int, *, id_col: str, words: Column, value, share: bool = False) -> DataFrame:
    """By the words that a row and a query share; rows without any are left out.

    ``asked`` has query_id and ``terms``, an array of (term, weight) without
    repeats; ``value(tf, dl)`` is what a word counts in a row; with ``share``
    sums are divided by the number of the query's words. A row's words meet a block's in its own task, so neither postings nor hits are shuffled.
    """

    def prepare(blocks):
        each = [Asked([terms or () for (terms,) in lists]) for lists in blocks]

        def scores(column):
            found = Words(column)
            of = value(found.tf, found.dl[found.row])
            return (half_up(a.sums(found, of) / (a.sizes if share else 1)) for a in each)

        return scores

    found = topk(rows, blocks_of(asked, "terms"), k, id_col=id_col, value=words, prepare=prepare)
    return found.filter(F.col("score") > float("-inf"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """By cosine; a row of another length than the query's scores 0."""

    def blocks():
        for ids, rows in blocks_of(queries, "query_vec"):
            sizes = np.array([len(r[0] or ()) for r in rows])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                yield ids[at], unit(np.array([rows[i][0] or () for i in at], float).reshape(len(at), dim))

    def prepare(matrices):
        known = {d: Vectors(d) for d in {m.shape[1] for m in matrices}}

        def scores(column):
            vectors = {d: v(column) for d, v in known.items()}
            return (vectors[m.shape[1]] @ m.T for m in matrices)

        return scores

    return topk(vectors, blocks(), k, id_col=id_col, value=F.col(vec_col).cast("array<double>"), prepare=prepare)


def substring_topk(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many of the query's white-space terms, repeats counted, a text contains: of those that contain some, or else the first texts."""
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")
    rows = queries.select("query_id", terms.alias("terms"))

    def one(lists):
        import ahocorasick

        number = {t: i for i, t in enumerate(dict.fromkeys(t for (ts,) in lists for t in ts or ()))}
        weight = np.zeros((len(number), len(lists)), np.float32)
        for q, (ts,) in enumerate(lists):
            for t in ts or ():
                weight[number[t], q] += 1
        machine = ahocorasick.Automaton()
        for t, i in number.items():
            machine.add_word(t, i)
        if number:
            machine.make_automaton()

        def score(column):
            held = np.zeros((len(column), len(number)), np.float32)
            for r, text in enumerate(column.to_pylist() if number else ()):
                held[r, list({i for _, i in machine.iter(text)} if text else ())] = 1
            return (held @ weight).astype(float)

        return score

    def prepare(blocks):
        each = [one(lists) for lists in blocks]
        return lambda column: (score(column) for score in each)

    found = topk(docs, blocks_of(rows, "terms", size=256), k, id_col=id_col, value=F.lower(text_col), prepare=prepare)
    return found.withColumn("_best", F.max("score").over(Window.partitionBy("query_id"))).filter("score > 0 or _best = 0").drop("_best")

