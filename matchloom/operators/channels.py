"""The three recall channels: dense vectors, BM25 and career trajectories."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import text as tx
from matchloom.functions import vocab as V
from matchloom.functions.tokens import token_parts
from matchloom.functions.trajectory import CRITERIA_COLUMNS, TRAJECTORY_COLUMNS
from matchloom.operators.block_topk import block_topk, vectors
from matchloom.session import settle

# ---- dense ---------------------------------------------------------------------

# Texts in, one vector per text out.
Encoder = Callable[[list[str]], np.ndarray]


class TokenHashEncoder:
    """Deterministic stand-in for a sentence encoder: unit-length hashed token counts."""

    #: Tokens whose slot is remembered at most.
    KNOWN = 100_000

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim
        self.name = f"token-hash-{dim}"
        self.slots: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        slots, dim = self.slots, self.dim
        out = np.zeros((len(texts), dim))
        if len(slots) >= self.KNOWN:
            slots.clear()
        for rows, tokens, row in token_parts(texts):
            distinct = tokens.dictionary_encode()
            seen = []
            for token in distinct.dictionary.to_pylist():
                slot = slots.get(token)
                if slot is None:
                    slot = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                    if len(slots) < self.KNOWN:
                        slots[token] = slot
                seen.append(slot)
            slot = np.array(seen, dtype=np.int64)[distinct.indices.to_numpy()]
            n_rows = rows.stop - rows.start
            out[rows] = np.bincount(row * dim + slot, minlength=n_rows * dim).reshape(n_rows, dim)
        return out


#: Texts that a worker encodes at once: its memory is bounded by these, not by the rows of a batch.
ENCODE_ROWS = 512


def _unit_vectors(encoder: Encoder, texts: pa.Array) -> np.ndarray:
    raw = np.asarray(encoder([t or "" for t in texts.to_pylist()]), dtype=np.float64)
    norms = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return (raw / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def encode(df: DataFrame, text: str, encoder: Encoder | None = None, out: str = "vector", keep_text: bool = True) -> DataFrame:
    """Adds an L2-normalised float vector of a text column, some texts at a time."""
    encoder = encoder or TokenHashEncoder()
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(start, ENCODE_ROWS)
                unit = _unit_vectors(encoder, batch.column(text))
                lists = pa.ListArray.from_arrays(
                    np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32), pa.array(unit.ravel())
                )
                # a text that nothing after the encoder asks for is not sent back
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, lists], names=[*kept, out])

    return df.mapInArrow(run, schema)


def l2_normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, max_query_rows: int | None = None) -> DataFrame:
    """Exact inner-product top-k of (id, vector) sides."""
    def prepare(block: pa.Table) -> np.ndarray:
        return vectors(block.column(1)).T

    def score(wanted: np.ndarray, docs: pa.Table) -> np.ndarray:
        return vectors(docs.column(1)) @ wanted

    return block_topk(corpus, queries, prepare, score, k, max_query_rows)


def text_dense_topk(corpus: DataFrame, queries: DataFrame, k: int, encoder: Encoder | None = None, max_query_rows: int | None = None) -> DataFrame:
    """``dense_topk`` of (id, text) sides: a text is encoded where it is scored, and its vector is sent nowhere."""
    encoder = encoder or TokenHashEncoder()
    query_id, query_text = queries.columns
    wanted = encode(queries, query_text, encoder, keep_text=False).select(query_id, "vector")

    def prepare(block: pa.Table) -> np.ndarray:
        return vectors(block.column(1)).T

    def score(asked: np.ndarray, docs: pa.Table) -> np.ndarray:
        parts = (docs.column(1).slice(start, ENCODE_ROWS) for start in range(0, docs.num_rows, ENCODE_ROWS))
        scores = [_unit_vectors(encoder, texts).astype(np.float64) @ asked for texts in parts]
        return np.concatenate(scores) if scores else np.zeros((0, asked.shape[1]))

    return block_topk(corpus, wanted, prepare, score, k, max_query_rows)


def similar_items(items: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Nearest other items of each probe; the probe's own id is left out."""
    hits = dense_topk(items, probes, k + 1).filter(F.col("doc_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---- BM25 ------------------------------------------------------------------------

K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.75, 0.25


def tokenised(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, tx.tokens(F.col(text_col)).alias("toks"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(tok, df): each document sends a token once and tasks pre-count before the shuffle.

    A plain explode has the tokens made once more, for a filter before it.
    """
    rows = docs.select(F.explode_outer(F.array_distinct("toks")).alias("tok")).filter(F.col("tok").isNotNull())
    return rows.groupBy("tok").agg(F.count("*").alias("df"))


def text_counts(texts: DataFrame) -> DataFrame:
    """(tok, df, size) of a table of one text column, in one pass; the row without a token has the number of texts, and of all their tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens = 0
            for _, tokens, row in token_parts(batch.column(0)):
                n_tokens += len(tokens)
                distinct = tokens.dictionary_encode()
                n = max(1, len(distinct.dictionary))
                found = np.unique(row * n + distinct.indices.to_numpy()) % n
                df = np.bincount(found, minlength=len(distinct.dictionary))
                yield pa.RecordBatch.from_arrays([distinct.dictionary, pa.array(df), pa.array(np.zeros(len(df), np.int64))], names=["tok", "df", "size"])
            yield pa.RecordBatch.from_pydict({"tok": pa.array([None], pa.string()), "df": [batch.num_rows], "size": [n_tokens]})

    parts = texts.mapInArrow(count, "tok string, df long, size long")
    return parts.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))


def inverse_frequencies(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(tok, idf); an idf below zero becomes a share of the vocabulary's mean idf."""
    raw = frequencies.withColumn(
        "raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.agg(F.avg("raw").alias("m")).first()["m"] or 0.0
    return raw.select("tok", F.when(F.col("raw") < 0, NEGATIVE_IDF_SHARE * mean).otherwise(F.col("raw")).alias("idf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, max_query_rows: int | None = None) -> DataFrame:
    """BM25 top-k of (id, text) sides; documents without any query token rank with score 0.

    Documents are scored one at a time as they stream by, so a token that is in
    most documents never becomes a join key.
    """
    doc_id, doc_text = docs.columns
    query_id, query_text = queries.columns
    counts = settle(text_counts(docs.select(doc_text)), "frequencies")
    size = counts.filter(F.col("tok").isNull()).first()
    n_docs, mean_length = (size["df"], size["size"] / size["df"] or 1.0) if size else (0, 1.0)
    idf = inverse_frequencies(counts.filter(F.col("tok").isNotNull()), n_docs)
    wanted = (
        tokenised(queries, query_id, query_text)
        .select(query_id, F.explode_outer("toks").alias("tok"))
        .groupBy(query_id, "tok").agg(F.count("*").alias("n"))
        .join(idf, "tok", "left")
        .groupBy(query_id)
        .agg(F.array_sort(F.collect_list(F.struct("tok", (F.col("n") * F.coalesce("idf", F.lit(0.0))).alias("w")))).alias("terms"))
    )

    def prepare(block: pa.Table):
        terms = block.column(1).combine_chunks()
        flat = terms.flatten()
        owner = pc.list_parent_indices(terms).to_numpy()
        words = pc.unique(flat.field("tok").drop_null())
        at = pc.index_in(flat.field("tok"), value_set=words).to_numpy(zero_copy_only=False)
        weight = flat.field("w").to_numpy(zero_copy_only=False)
        table = np.zeros((len(words), block.num_rows))
        real = ~np.isnan(at.astype(float))
        table[at[real].astype(int), owner[real]] = weight[real]
        # few queries ask for a word: their weights alone are kept, word by word
        asked, asking = np.nonzero(table)
        return words, block.num_rows, np.searchsorted(asked, np.arange(len(words) + 1)), asking, table[asked, asking]

    def score(state, docs_part: pa.Table) -> np.ndarray:
        words, n_queries, ends, asking, weights = state
        out = np.zeros((docs_part.num_rows, n_queries))
        if not len(words):
            return out
        for rows, tokens, row in token_parts(docs_part.column(1)):
            lengths = np.bincount(row, minlength=rows.stop - rows.start)
            at = pc.index_in(tokens, value_set=words)
            known = pc.is_valid(at)
            pair, tf = np.unique(row[known.to_numpy(zero_copy_only=False)] * len(words) + at.filter(known).to_numpy(), return_counts=True)
            row, word = pair // len(words), pair % len(words)
            share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean_length))
            n = ends[word + 1] - ends[word]
            cells = np.repeat(ends[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places = np.repeat(row, n) * n_queries + asking[cells]
            out[rows] = np.bincount(places, np.repeat(share, n) * weights[cells], out[rows].size).reshape(-1, n_queries)
        return out

    return block_topk(docs, wanted, prepare, score, k, max_query_rows)


# ---- trajectories -------------------------------------------------------------------


def experience_topk(
    resumes: DataFrame,
    jobs: DataFrame,
    k: int,
    weights: dict[str, float] = V.TRAJECTORY_WEIGHTS,
    recency_bias: float = V.RECENCY_BIAS,
    use_company_tier: bool = True,
) -> DataFrame:
    """Top-k by trajectory score of (id, trajectory...) and (id, criteria...) sides.

    Postings that ask for the same thing rank the same candidates, so each
    distinct set of criteria is scored once.
    """
    doc_id, job_id = resumes.columns[0], jobs.columns[0]
    bias = min(1.0, max(0.0, recency_bias))
    domains = [*V.DOMAIN_WORDS, V.GENERAL_DOMAIN]
    place = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    general = domains.index(V.GENERAL_DOMAIN)
    asks = jobs.select(job_id, F.to_json(F.struct(*CRITERIA_COLUMNS)).alias("ask"), *CRITERIA_COLUMNS)
    distinct_asks = asks.select(
        "ask", F.col("min_yoe").cast("double"), F.col("target_seniority").cast("double"),
        place[F.col("target_domain")].cast("double").alias("target_domain"),
    ).dropDuplicates(["ask"])
    numbers = {c: F.col(c).cast("double") for c in TRAJECTORY_COLUMNS}
    for c in ("domain", "recent_domain"):
        numbers[c] = place[F.col(c)].cast("double")
    corpus = resumes.select(doc_id, *[c.alias(n) for n, c in numbers.items()])

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.float64)

    def prepare(block: pa.Table) -> dict[str, np.ndarray]:
        return {c: column(block, c)[None, :] for c in CRITERIA_COLUMNS}

    def yoe(have, want):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.clip(have / want, 0.0, 1.0)
        known = np.where(np.isnan(have), 0.3, ratio)
        return np.where(np.isnan(want) | (want <= 0), 0.5, known)

    def level(have, want):
        gap = np.minimum(np.abs(have - want), 3).astype(int)
        return np.where((have == V.UNKNOWN) | (want == V.UNKNOWN), 0.5, np.array([1.0, 0.7, 0.4, 0.1])[gap])

    def field(have, want):
        return np.where(have == want, 1.0, np.where((have == general) | (want == general), 0.5, 0.0))

    def score(want: dict[str, np.ndarray], docs: pa.Table) -> np.ndarray:
        have = {c: column(docs, c)[:, None] for c in TRAJECTORY_COLUMNS}
        recent = ~np.isnan(have["recent_yoe"]) & (have["n_recent_roles"] > 0)
        beta = np.where(recent, bias, 0.0)

        def blend(whole, latest):
            return (1 - beta) * whole + beta * np.where(recent, latest, 0.0)

        total = weights["yoe_match"] * blend(
            yoe(have["years_experience"], want["min_yoe"]), yoe(have["recent_yoe"], want["min_yoe"]))
        total = total + weights["seniority_match"] * blend(
            level(have["seniority"], want["target_seniority"]),
            level(have["recent_seniority"], want["target_seniority"]))
        total = total + weights["domain_overlap"] * blend(
            field(have["domain"], want["target_domain"]), field(have["recent_domain"], want["target_domain"]))
        total = total + weights["tenure"] * have["tenure_signal"]
        if use_company_tier:
            total = total + weights["tier_bonus"] * blend(have["company_tier"], have["recent_company_tier"])
        return total

    hits = block_topk(corpus, distinct_asks, prepare, score, k).withColumnRenamed("query_id", "ask")
    return (
        asks.select(F.col(job_id).alias("query_id"), "ask")
        .join(hits, "ask")
        .select("query_id", "doc_id", "score", "rank")
    )
