"""Exact top-k of every query over a corpus, without pairing rows.

The corpus streams through ``mapInArrow`` in batches. Each task scores a batch
against the whole query block as one matrix and keeps only the best k per query,
so at most k rows per query and task reach the shuffle; no pair is ever a row.

The query block is shipped to the tasks only when it is within the row and byte
limits of the settings. A larger one is cut into blocks that meet the corpus
tiles in a cogroup, in which every group has a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.config import settings

# Builds, once per task, what scoring needs from the query block.
Prepare = Callable[[pa.Table], Any]
# Scores a corpus batch: one row per document, one column per query.
Score = Callable[[Any, pa.Table], np.ndarray]

#: Scores, and items of list columns, that a worker holds at once; a batch of long lists is cut further.
_CELLS, _ITEMS = 500_000, 500_000
# Scores that differ by rounding noise only count as ties, settled by id.
SCORE_DECIMALS = 9


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy()
    return values.astype(str) if values.dtype == object else values


class _Best:
    """The best k (score, id) of each query seen so far; ties go to the lower id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0)] * n_queries
        self.ids: list[np.ndarray | None] = [None] * n_queries

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for q in range(scores.shape[1]):
            column, picked = scores[:, q], ids
            if len(self.scores[q]) == self.k:
                keep = column >= self.scores[q][-1]
                column, picked = column[keep], ids[keep]
            if len(column) > self.k:
                keep = column >= np.partition(column, -self.k)[-self.k]
                column, picked = column[keep], picked[keep]
            if not len(column):
                continue
            if self.ids[q] is not None:
                column = np.concatenate([self.scores[q], column])
                picked = np.concatenate([self.ids[q], picked])
            order = np.lexsort((picked, -column))[: self.k]
            self.scores[q], self.ids[q] = column[order], picked[order]

    def table(self, query_ids: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
        counts = [len(s) for s in self.scores]
        picked = [i for i in self.ids if i is not None]
        if not picked:
            return schema.empty_table()
        repeat = np.repeat(np.arange(len(counts)), counts)
        columns = [
            query_ids.take(pa.array(repeat)).combine_chunks().cast(schema.field(0).type),
            pa.array(np.concatenate(picked)).cast(schema.field(1).type),
            pa.array(np.concatenate(self.scores)),
        ]
        return pa.Table.from_arrays(columns, schema=schema)


def _items(table: pa.Table) -> int:
    """How many items the list columns hold."""
    lists = (c for c in table.columns if pa.types.is_list(c.type))
    return max((pc.sum(pc.list_value_length(c)).as_py() or 0 for c in lists), default=0)


def _feed(best: _Best, state: Any, score: Score, table: pa.Table, n_queries: int) -> None:
    step = max(1, min(_CELLS // max(1, n_queries), _ITEMS * table.num_rows // max(1, _items(table))))
    for start in range(0, table.num_rows, step):
        part = table.slice(start, step)
        best.add(np.round(score(state, part), SCORE_DECIMALS), _keys(part.column(0)))


def block_topk(
    corpus: DataFrame,
    queries: DataFrame,
    prepare: Prepare,
    score: Score,
    k: int,
    max_query_rows: int | None = None,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query.

    The first column of each side is its id; the others feed ``prepare`` and ``score``.
    """
    query_name, doc_name = queries.columns[0], corpus.columns[0]
    out = T.StructType([
        T.StructField("query_id", queries.schema[query_name].dataType),
        T.StructField("doc_id", corpus.schema[doc_name].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    schema = to_arrow_schema(out)
    limit = settings.max_query_rows if max_query_rows is None else max_query_rows
    block = queries.limit(limit + 1).toArrow()
    if block.num_rows <= limit and block.nbytes <= settings.max_query_bytes:
        shipped = corpus.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shipped.value
            state = prepare(wanted)
            best = _Best(wanted.num_rows, k)
            for batch in batches:
                _feed(best, state, score, pa.Table.from_batches([batch]), wanted.num_rows)
            yield from best.table(wanted.column(0), schema).to_batches()

        partial = corpus.mapInArrow(scan, out)
    else:
        n_blocks = -(-queries.count() * 2 // max(1, limit))
        n_tiles = -(-corpus.count() // settings.tile_rows)

        def meet(docs: pa.Table, wanted: pa.Table) -> pa.Table:
            if not docs.num_rows or not wanted.num_rows:
                return schema.empty_table()
            docs = docs.drop_columns(["_tile", "_block"])
            wanted = wanted.drop_columns(["_tile", "_block"])
            best = _Best(wanted.num_rows, k)
            _feed(best, prepare(wanted), score, docs, wanted.num_rows)
            return best.table(wanted.column(0), schema)

        def spread(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
            )

        tiles = spread(corpus, doc_name, "_tile", n_tiles, "_block", n_blocks)
        blocks = spread(queries, query_name, "_block", n_blocks, "_tile", n_tiles)
        partial = (
            tiles.groupBy("_tile", "_block")
            .cogroup(blocks.groupBy("_tile", "_block"))
            .applyInArrow(meet, out)
        )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; every list must have the same length."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(lists):
        return flat.reshape(0, 0)
    if len(flat) % len(lists):
        raise ValueError("vectors differ in dimension")
    return flat.reshape(len(lists), -1)
