"""Quality classifier by co-training.

The text view sees what a document says (shares of character classes, repetition, hashed words), the metadata view only
its source, language and length. Both start from the same labelled rows. In each round either view scores every unlabelled
document, and the most confident of each class train the other view. Both are calibrated on labelled rows that trained
neither, joined by a logistic model on their log-odds, and score all documents.

Features are taken once from whole texts and written, some hundred numbers a document; rounds read only those and never
shuffle them: labels are joined to keys, a round writes keys and log-odds, and only the features of chosen keys are
fetched, by a broadcast of at most as many keys as the plan allows. Choices are cuts of histograms of hashes and log-odds,
so the driver gets histograms of bounded size, the labelled sample and the pseudo-labels, bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import as_bytes, joined_words, span_hashes
from .store import settle

WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_BINS = 64, 64, 16, 20
N_STATS = 20
_UPPER, _DIGIT, _PUNCT, _SYMBOL = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?\"'()-", b"#*$%&|<>"))


@dataclass(frozen=True)
class CoTraining:
    labelled: int = 20_000  # rows of the labelled sample at most, by hash
    rounds: int = 2
    pseudo: int = 5_000  # pseudo-labels for each view, class and round at most
    share: float = 0.02  # and no more of the unlabelled rows than this share
    confident: float = 0.95
    lost: float = 0.01  # share of held-out good documents that the threshold may reject, labels on junk included


def text_view(text: str | None) -> np.ndarray:
    data = as_bytes(text)
    out = np.zeros(N_STATS + WORD_BUCKETS, np.float32)
    words, starts, ends = joined_words(data)
    n = len(starts)
    if not n:
        out[0] = 1
        return out
    size = len(data)
    hashes = span_hashes(words, starts, ends)
    _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    sizes = ends - starts
    last = words[ends - 1]
    lines = (text or "").split("\n")
    out[1:N_STATS] = [
        np.log1p(size) / 10, np.log1p(n) / 10, sizes.mean() / 10, min(5.0, sizes.std() / 10), _UPPER[data].mean(), _DIGIT[data].mean(), _PUNCT[data].mean() * 5,
        min(1.0, _SYMBOL[data].mean() * 5), (data == 33).mean() * 5, (data == 124).mean() * 5, (data >= 128).mean(), len(times) / n, times.max() / n,
        (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0, (times[back] > 1).mean(), 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 10,
        (_SYMBOL[last] | (last == 33)).mean(), _UPPER[words[starts]].mean(),
    ]
    out[N_STATS:] = np.sqrt(np.bincount((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS) / n)
    return out


def meta_view(source: np.ndarray, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BINS), np.float64)
    at = np.arange(len(source))
    out[at, source] = 1
    out[at, SOURCE_BUCKETS + lang] = 1
    out[at, SOURCE_BUCKETS + LANG_BUCKETS + np.clip(length, 0, LENGTH_BINS - 1)] = 1
    return out


def meta_columns() -> dict[str, Column]:
    """Buckets of source and language and the order of the length, by hashes and logarithms."""
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    order = F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + F.lit(1))).cast("int")
    return {"s": bucket("source", SOURCE_BUCKETS), "l": bucket("lang", LANG_BUCKETS), "n": order}


def view_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, s, l, n (metadata) and x (the text view as float32 bytes) of every document, written once.

    The key is a hash of the rest: equal rows share it, and it does not depend on how the input is split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["s", "l", "n"]].copy()
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            out["x"] = [text_view(t if isinstance(t, str) else None).tobytes() for t in batch["text"]]
            yield out

    rows = docs.select("doc_id", "text", *(c.alias(k) for k, c in meta_columns().items())).mapInPandas(run, "doc_id long, s int, l int, n int, x binary")
    return settle(rows.withColumn("key", F.xxhash64("doc_id", "s", "l", "n", "x")))


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ self.w))
            grad = z.T @ (p - y) + penalty * self.w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def views_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), N_STATS + WORD_BUCKETS).astype(np.float64)
    return text, meta_view(*(rows[c].to_numpy(np.int64) for c in "sln"))


@dataclass
class Model:
    views: tuple[Logistic, Logistic] | None = None
    joint: Logistic | None = None
    threshold: float = 0.0

    def score(self, rows: pd.DataFrame) -> np.ndarray:
        """Calibrated probability of good quality; without any labels every document is taken as good."""
        if self.joint is None or not len(rows):
            return np.ones(len(rows))
        return 1 / (1 + np.exp(-self.joint.odds(np.stack([m.odds(x) for m, x in zip(self.views, views_of(rows), strict=True)], 1))))


def settled_labels(labels: DataFrame) -> DataFrame:
    """One label for each doc_id: the majority of its rows that are not null; doc_ids whose rows are split evenly have none."""
    mean = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("mean"))
    return mean.filter("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("double").alias("y"))


def highest(rows: DataFrame, bins: list[Column], limit: int) -> DataFrame:
    """The rows of the highest bins, at most `limit` of them: whole bins by the first column and, where the next one is too
    large, whole ones by the second column within it. The driver gets counts by bin, so bins must be few."""
    kept = F.lit(False)
    inside = F.lit(True)
    for column in bins:
        counts = sorted(rows.filter(inside).groupBy(column.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True)
        edge = None
        for row in counts:
            if row["n"] > limit:
                edge = row["bin"]
                break
            limit -= row["n"]
        kept = kept | (inside & ((column > F.lit(edge)) if edge is not None else F.lit(True)))
        if edge is None:
            break
        inside = inside & (column == F.lit(edge))
    return rows.filter(kept)


def features_of(table: DataFrame, chosen: DataFrame) -> pd.DataFrame:
    """The features of the chosen keys (key, y), of which there are no more than the plan allows; equal rows come once."""
    fetched = table.select("key", "s", "l", "n", "x").join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    return fetched.toPandas().sort_values("key", ignore_index=True)


def _hash_bin(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 52)  # 4096 bins


def co_train(table: DataFrame, labels: DataFrame, plan: CoTraining) -> Model:
    told = settle(settled_labels(labels))
    known = settle(table.select("doc_id", "key").join(told, "doc_id").select("key", "y").distinct())
    sample = features_of(table, highest(known, [_hash_bin(1), _hash_bin(2)], plan.labelled))
    held = (sample["key"] % 4 == 0).to_numpy()
    y = sample["y"].to_numpy()
    if len(sample) < 8 or any(len(set(part)) < 2 for part in (y[held], y[~held])):
        return Model()
    views = views_of(sample)
    taught = [[(v[~held], y[~held])] for v in views]
    done: set[int] = set()
    for turn in range(plan.rounds + 1):
        models = tuple(Logistic(np.vstack([a for a, _ in own]), np.concatenate([b for _, b in own])) for own in taught)
        if turn == plan.rounds:
            break
        for who, picked in enumerate(most_confident(table, told, models, plan)):
            picked = picked[~picked["key"].isin(done)]
            if len(picked):
                done |= set(picked["key"])
                taught[1 - who].append((views_of(picked)[1 - who], picked["y"].to_numpy(np.float64)))
    both = np.stack([m.odds(v[held]) for m, v in zip(models, views, strict=True)], 1)
    joint = Logistic(both, y[held], ridge=0.1)
    model = Model(models, joint)
    model.threshold = threshold(model.score(sample[held]), y[held], plan.lost)
    return model


def threshold(p: np.ndarray, y: np.ndarray, lost: float) -> float:
    """The cut with the least sum of the shares of good rows lost and of bad rows kept that loses no more than the share
    `lost` of the good ones: the lowest such cut, moved to the middle of the gap in log-odds between the rows around it, and
    no more than 0.5. Held-out rows of both classes are at hand."""
    good, bad = np.sort(p[y == 1]), np.sort(p[y == 0])
    edges = np.unique(np.concatenate([[0.0], good, np.nextafter(bad, 2)]))
    missed = np.searchsorted(good, edges) / len(good)
    error = missed + 1 - np.searchsorted(bad, edges) / len(bad)
    error[missed > lost] = np.inf
    cut = edges[np.argmin(error)]
    log_odds = lambda q: np.log(np.clip(q, 1e-12, 1 - 1e-12) / np.clip(1 - q, 1e-12, 1))
    above = good[np.searchsorted(good, cut)]  # there is one, as not all good rows are lost
    return float(min(0.5, 1 / (1 + np.exp(-(log_odds(cut) + log_odds(above)) / 2))))


def most_confident(table: DataFrame, told: DataFrame, models: tuple[Logistic, Logistic], plan: CoTraining) -> list[pd.DataFrame]:
    """For either view the unlabelled rows it is surest of, with its labels: of each class at most plan.pseudo and the share
    plan.share of all unlabelled rows. Log-odds are compared in steps of 1/100, and within a step by a hash."""
    edge = float(np.log(plan.confident / (1 - plan.confident)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                odds = {f"o{k}": m.odds(x) for k, (m, x) in enumerate(zip(models, views_of(batch), strict=True))}
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], **odds})

    scored = table.select("doc_id", "key", "s", "l", "n", "x").mapInPandas(run, "doc_id long, key long, o0 double, o1 double")
    free = settle(scored.join(told.select("doc_id"), "doc_id", "left_anti").select("key", "o0", "o1").distinct())
    limit = min(plan.pseudo, int(plan.share * free.count()))
    out = []
    for k in (0, 1):
        ends = []
        for sign in (1, -1):
            sure = F.col(f"o{k}") * sign
            rows = highest(free.filter(sure >= edge), [F.floor(sure * 100), _hash_bin(3)], limit)
            ends.append(rows.select("key", F.lit(float(sign > 0)).alias("y")))
        out.append(features_of(table, ends[0].union(ends[1])))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, plan: CoTraining = CoTraining()) -> DataFrame:
    """Per document: doc_id, score (calibrated probability of good quality) and kept.

    A null text is an empty one; null source or lang is a value of its own; repeated rows get equal scores and train as
    one; without enough labels of both kinds everything is kept with score 1; an empty table gives no rows; a null doc_id
    has no label and stays null; other columns are not read; the features of a long text are those of the whole of it.
    """
    table = view_table(docs)
    model = co_train(table, labels, plan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.score(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p, "kept": p >= model.threshold})

    return table.select("doc_id", "s", "l", "n", "x").mapInPandas(run, "doc_id long, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, plan: CoTraining = CoTraining()) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, whatever they are called.

    Nulls, repeated rows, missing labels and long texts are as in quality_scores; an empty table stays empty.
    """
    model = co_train(view_table(docs), labels, plan)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series, s: pd.Series, l: pd.Series, n: pd.Series) -> pd.Series:  # noqa: E741
        x = [text_view(t if isinstance(t, str) else None).tobytes() for t in text]
        return pd.Series(model.score(pd.DataFrame({"s": s, "l": l, "n": n, "x": x})) >= model.threshold)

    return docs.filter(kept("text", *meta_columns().values()))
