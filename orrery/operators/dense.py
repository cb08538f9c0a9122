"""Dense retrieval: exact cosine similarity against a query set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.operators.retrieval import ranked
from orrery.session import staged

#: Numbers of a query matrix that is sent to every task; larger query sets meet the vectors in blocks of as many.
BLOCK_NUMBERS = 1 << 22
#: Similarities that a task holds at once.
TASK_NUMBERS = 1 << 20


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, of equal ones the smaller documents'; -inf counts for nothing."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    at = np.flatnonzero((scores >= least) & (scores > -np.inf))
    return at[np.lexsort((docs[at], -scores[at]))[:k]]


class _Nearest:
    """The best ``k`` so far of each query of a block; types are numbers that stand for them."""

    def __init__(self, matrix: np.ndarray, kinds: np.ndarray | None, k: int):
        self.matrix, self.kinds, self.k = matrix, kinds, k
        self.scores, self.docs = [np.zeros(0)] * len(matrix), [np.zeros(0, dtype=np.int64)] * len(matrix)

    def add(self, vectors: np.ndarray, ids: np.ndarray, kinds: np.ndarray | None) -> None:
        if not len(ids) or not len(self.matrix):
            return
        turned = _unit(vectors).T
        step = max(1, TASK_NUMBERS // len(ids))
        for a in range(0, len(self.matrix), step):
            sim = np.round(self.matrix[a : a + step] @ turned, 9)
            for q, row in enumerate(sim, a):
                if kinds is not None:
                    row = np.where(kinds == self.kinds[q], row, -np.inf)
                at = _best(row, ids, self.k)
                s, d = np.concatenate([self.scores[q], row[at]]), np.concatenate([self.docs[q], ids[at]])
                keep = _best(s, d, self.k)
                self.scores[q], self.docs[q] = s[keep], d[keep]

    def table(self, names, name_type, doc_type) -> pa.Table:
        n, empty = [len(s) for s in self.scores], [np.zeros(0)]
        docs = pa.array(np.concatenate(self.docs or empty).astype(np.int64)).cast(doc_type)
        return pa.table({"query": pa.array([x for x, m in zip(names, n) for _ in range(m)], name_type), "doc": docs, "similarity": pa.array(np.concatenate(self.scores or empty))})


def _vectors(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, *, typed: bool = False) -> DataFrame:
    """query, doc, similarity, rank of the ``k`` nearest of all vectors.

    ``queries``: query, vec[, type]; ``vectors``: doc (a whole number), vec[, type], all vectors of
    one length.  A query set of at most ``BLOCK_NUMBERS`` numbers is sent to all tasks,
    which keep their own best ``k`` of each query; of a larger one, blocks meet
    blocks of vectors in pairs through a shuffle, and nothing passes the driver.  With ``typed``
    only vectors of the query's type count.  Null vectors have no neighbours.
    """
    spark = queries.sparkSession
    kind = F.xxhash64("type") if typed else F.lit(0).cast("long")
    queries = queries.where("vec is not null").select("query", "vec", kind.alias("kind"))
    vectors = vectors.where("vec is not null").select("doc", "vec", kind.alias("kind"))
    one = queries.select(F.size("vec")).first()
    dim = max(one[0], 1) if one else 1
    query_kind, doc_kind = queries.schema["query"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString()
    name_type, doc_type = to_arrow_type(queries.schema["query"].dataType), to_arrow_type(vectors.schema["doc"].dataType)
    schema = f"query {query_kind}, doc {doc_kind}, similarity double"
    most = max(1, BLOCK_NUMBERS // dim)
    first = queries.limit(most + 1).collect()
    if len(first) <= most:
        matrix = _unit(np.array([r["vec"] for r in first], dtype=np.float64).reshape(len(first), -1)) if first else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((matrix, [r["query"] for r in first], np.array([r["kind"] for r in first], dtype=np.int64)))

        def near(batches):
            matrix, names, kinds = shared.value
            best = _Nearest(matrix, kinds if typed else None, k)
            for b in batches:
                best.add(_vectors(b.column("vec"), dim) if b.num_rows else np.zeros((0, dim)), b.column("doc").to_numpy().astype(np.int64), b.column("kind").to_numpy() if typed else None)
            yield from best.table(names, name_type, doc_type).to_batches()

        out = vectors.mapInArrow(near, schema)
    else:
        queries, vectors = staged(queries, "queries"), staged(vectors, "vectors")
        q_blocks, v_blocks = -(-queries.count() // most), max(1, -(-vectors.count() // most))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        left = queries.select("query", F.col("vec").alias("asked"), F.col("kind").alias("asked_kind"), own("query", q_blocks).alias("a"), every(v_blocks).alias("b"))
        right = vectors.select("doc", "vec", "kind", every(q_blocks).alias("c"), own("doc", v_blocks).alias("d"))

        def meet(query: pa.Table, rows: pa.Table) -> pa.Table:
            best = _Nearest(_unit(_vectors(query.column("asked"), dim)) if query.num_rows else np.zeros((0, dim)), query.column("asked_kind").to_numpy() if typed else None, k)
            if query.num_rows and rows.num_rows:
                best.add(_vectors(rows.column("vec"), dim), rows.column("doc").to_numpy().astype(np.int64), rows.column("kind").to_numpy() if typed else None)
            return best.table(query.column("query").to_pylist(), name_type, doc_type)

        out = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(meet, schema)
    return ranked(out, ["query"], [F.desc(F.round("similarity", 9)), F.col("doc")], k)
