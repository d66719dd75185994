"""Boosted trees for the log loss, grown as pyspark.ml grows them, on rows that stay with their executors.

A row is kept as a few bytes: the places of its values among the bounds. A job for each level counts rows and residuals by
node and place; only these counts, some kilobytes a task, reach the driver, which takes the splits. Of two children the
smaller is counted, as the other has what is left of their parent.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import discard, scratch_path

#: Places of all slots of a group together at most, and rows that are counted at once.
GROUP_PLACES, ROWS = 8192, 1 << 18
NODE_SCHEMA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def binary_slots(features: DataFrame) -> set[int]:
    """The slots of ``features`` that hold 0 or 1 only, by its metadata."""
    return {a["idx"] for a in features.schema["features"].metadata["ml_attr"]["attrs"].get("binary", [])}


def _slots(rows: DataFrame, n: int, *more: Column | str) -> DataFrame:
    """Each slot of ``features`` in a column of its own, x0 to x<n-1>."""
    cells = rows.select(vector_to_array("features").alias("_x"), *more)
    return cells.select(*[F.col("_x")[k].alias(f"x{k}") for k in range(n)], *[c for c in cells.columns if c != "_x"])


def slot_bounds(rows: DataFrame, trees: GBTClassifier) -> list[np.ndarray]:
    """The bounds between which the library's trees would split each slot of (features, label, weight), found by the library itself."""
    trees._transfer_params_to_java()
    spark, learner = SparkContext._active_spark_context._jvm.org.apache.spark, trees._java_obj
    module = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    algo = module(spark.mllib.tree.configuration, "Algo")
    slots = module(spark.ml.util, "MetadataUtils").getCategoricalFeatures(rows._jdf.schema().apply("features"))
    strategy = learner.getOldBoostingStrategy(slots, algo.Classification()).treeStrategy().copy()
    getattr(strategy, "algo_$eq")(algo.Regression())
    instances = module(spark.ml.util, "DatasetUtils").extractInstances(learner, rows._jdf, SparkContext._active_spark_context._jvm.scala.Option.empty())
    metadata = module(spark.ml.tree.impl, "DecisionTreeMetadata").buildMetadata(instances, strategy, 1, trees.getFeatureSubsetStrategy())
    found = module(spark.ml.tree.impl, "RandomForest").findSplits(instances, metadata, trees.getSeed())
    binary = binary_slots(rows)
    return [np.array([0.5]) if k in binary else np.array([split.threshold() for split in found[k]], float) for k in range(len(found))]


def slot_groups(sizes: dict[int, int], most: int = GROUP_PLACES) -> list[list[int]]:
    """Slots whose places are counted together, the largest first where they fit."""
    groups: list[list[int]] = []
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        fits = [g for g in groups if np.prod([sizes[s] for s in g]) * sizes[slot] <= most]
        (fits[0] if fits else groups.append([]) or groups[-1]).append(slot)
    return groups


def _arrays(codes: list[np.ndarray], y: np.ndarray, n: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """All that is kept of rows; y is -1 or 1, and n how many rows a row stands for."""
    own = {"y": y, "n": n, **{f"code{g}": c for g, c in enumerate(codes)}}
    made = {f"{name}{k}": np.zeros(len(y)) for name in ("margin", "residual") for k in (0, 1)}
    return own | made | {"residual0": y.astype(float)} | {f"node{k}": np.zeros(len(y), np.uint8) for k in range(depth + 1)}


class Rows:
    """Rows of a task: joint places of each group of slots with the label as first digit, margins, and the nodes that they are in.

    They are held by the task, or in files of its executor, with which any of its worker processes can go on. A job reads
    nothing that it has written, so a task that runs twice writes the same: the nodes of each level are apart, and so are
    the margins and residuals of even and of odd rounds.
    """

    def __init__(self, kept: dict[str, np.ndarray] | str, n_groups: int) -> None:
        self.kept = kept
        self.codes = [self._open(f"code{g}", "r") for g in range(n_groups)]
        self.y, self.n = self._open("y", "r"), self._open("n", "r")

    def _open(self, name: str, mode: str = "r+") -> np.ndarray:
        if isinstance(self.kept, dict):
            return self.kept[name]
        path = f"{self.kept}/{name}.npy"
        return np.asarray(np.load(path, mmap_mode=mode if os.path.getsize(path) > 128 else None))  # no rows cannot be mapped

    def chunks(self) -> Iterator[slice]:
        for start in range(0, len(self.y), ROWS):
            yield slice(start, start + ROWS)

    def descend(self, right: dict[int, np.ndarray], width: list[int], level: int) -> None:
        """From the nodes of a level to those of the next; ``right`` says for each node and place of a group who goes right."""
        old, new = self._open(f"node{level}", "r"), self._open(f"node{level + 1}")
        for part in self.chunks():
            node = old[part]
            goes = np.zeros(len(node), np.uint8)
            for g, table in right.items():
                goes |= table.take(np.multiply(node, width[g], dtype=np.int64) + self.codes[g][part])
            new[part] = (node << 1) + goes

    def grow(self, values: np.ndarray, step: float, grown: int, depth: int) -> None:
        """Adds a tree by the values of its last nodes, and sets what the next one is fitted to."""
        now, then = grown % 2, (grown + 1) % 2
        old, new, residual, node = self._open(f"margin{now}", "r"), self._open(f"margin{then}"), self._open(f"residual{then}"), self._open(f"node{depth}", "r")
        for part in self.chunks():
            y = self.y[part].astype(float)
            new[part] = old[part] + step * values[node[part]]
            residual[part] = 4.0 * y / (1.0 + np.exp(2.0 * y * new[part]))

    def loss(self, grown: int) -> float:
        total = 0.0
        for part in self.chunks():
            x = -2.0 * self.y[part] * self._open(f"margin{grown % 2}", "r")[part]
            total += float(np.dot(self.n[part], 2.0 * (np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x))))))
        return total

    def squares(self, grown: int, depth: int, weight: np.ndarray) -> np.ndarray:
        """For each last node: rows, and weighted squares of the residuals."""
        out, node, residual = np.zeros((2, 1 << depth)), self._open(f"node{depth}", "r"), self._open(f"residual{grown % 2}", "r")
        for part in self.chunks():
            n, y = self.n[part], self.y[part]
            out[0] += np.bincount(node[part], n, 1 << depth)
            out[1] += np.bincount(node[part], n * np.where(y > 0, weight[1], weight[0]) * residual[part] ** 2, 1 << depth)
        return out.T

    def counts(self, nodes: list[int], level: int, grown: int, width: list[int], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each group, (nodes, places) with the rows and with the weighted residuals."""
        rank = np.full(1 << level, -1, np.int64)
        rank[nodes] = np.arange(len(nodes))
        out = [(np.zeros(len(nodes) * w), np.zeros(len(nodes) * w)) for w in width]
        node, residual = self._open(f"node{level}", "r"), self._open(f"residual{grown % 2}", "r")
        for part in self.chunks():
            y, n, r, codes = self.y[part], self.n[part], residual[part], [c[part] for c in self.codes]
            if level:
                at = rank[node[part]]
                kept = np.flatnonzero(at >= 0)
                at, y, n, r, codes = at[kept], y[kept], n[kept], r[kept], [c[kept] for c in codes]
            pulled = n * r * np.where(y > 0, weight[1], weight[0])
            for (rows, sums), code, w in zip(out, codes, width):
                place = at * w + code if level else code
                rows += np.bincount(place, n, len(rows))
                sums += np.bincount(place, pulled, len(sums))
        return [(a.reshape(len(nodes), -1), b.reshape(len(nodes), -1)) for a, b in out]


@dataclass
class Tree:
    """Splits and totals (weight, weighted residuals) of each level's nodes, and the values of the last ones."""

    splits: list[dict[int, tuple]]
    totals: list[dict[int, tuple]]
    values: np.ndarray


class Grower:
    """What a fit knows besides its rows, and what follows from counts."""

    def __init__(self, bounds: list[np.ndarray], binary: set[int], positive_weight: float, depth: int) -> None:
        self.bounds, self.binary, self.depth = bounds, binary, depth
        self.weight = np.array([1.0, positive_weight])
        self.sizes = {k: len(b) + 1 for k, b in enumerate(bounds) if len(b)}
        self.slots = sorted(self.sizes)
        self.groups = [sorted(g, key=lambda s: self.sizes[s]) for g in slot_groups(self.sizes)]
        self.width = [2 * int(np.prod([self.sizes[s] for s in g])) for g in self.groups] or [2]

    def places(self, batch: pd.DataFrame) -> list[np.ndarray]:
        """The joint places of a batch, group by group; the label is the first digit."""
        positive = (batch["label"].to_numpy() > 0).astype(np.int64)
        out = []
        for group in self.groups or [[]]:
            code = positive
            for slot in group:
                code = code * self.sizes[slot] + np.searchsorted(self.bounds[slot], batch[f"x{slot}"].to_numpy())
            out.append(code.astype(np.uint16))
        return out

    def by_slot(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(nodes, places of all slots, 3): rows with label 0, rows with label 1, weighted residuals."""
        found = {}
        for group, (rows, sums) in zip(self.groups or [[]], counts):
            k = len(rows)
            left = np.concatenate([rows.reshape(k, 2, -1), sums.reshape(k, 2, -1).sum(1, keepdims=True)], axis=1)
            if not group:
                found[-1] = left.transpose(0, 2, 1)
            for slot in group:  # each slot is the first digit of what the ones before leave
                left = left.reshape(k, 3, self.sizes[slot], -1)
                found[slot] = left.sum(3).transpose(0, 2, 1)
                left = left.sum(2)
        return np.concatenate([found[s] for s in (self.slots or [-1])], axis=1)

    def best(self, sums: np.ndarray) -> list[tuple[int, int, bool, float] | None]:
        """(slot, place, flipped, gain) of each of some nodes: rows up to the place go left, or those beyond where it is flipped.

        Gains that differ by rounding only count as equal, and the first of them is taken.
        """
        n = sums[:, :, 0] + sums[:, :, 1]
        w, r = self.weight[0] * sums[:, :, 0] + self.weight[1] * sums[:, :, 1], np.where(n > 0, sums[:, :, 2], 0.0)
        found: list[list[tuple]] = [[] for _ in sums]
        start = 0
        for slot in self.slots:
            here = slice(start, start + self.sizes[slot])
            start = here.stop
            n_left, w_left, r_left = (np.cumsum(x[:, here], axis=1) for x in (n, w, r))
            n_all, w_all, r_all = n_left[:, -1:], w_left[:, -1:], r_left[:, -1:]
            n_left, w_left, r_left = n_left[:, :-1], w_left[:, :-1], r_left[:, :-1]
            fair = (n_left > 0) & (n_left < n_all)
            w_l, w_r = np.where(fair, w_left, 1.0), np.where(fair, w_all - w_left, 1.0)
            level = np.where(w_all > 0, r_all * r_all / np.where(w_all > 0, w_all, 1.0), 0.0)
            gain = np.where(fair, r_left * r_left / w_l + (r_all - r_left) * (r_all - r_left) / w_r - level, -1.0)
            top = gain.max(axis=1, keepdims=True)
            place = np.argmax(gain >= top - 1e-9 * np.abs(top), axis=1)
            for node in np.flatnonzero((top > 0)[:, 0] & (top > 1e-12 * level)[:, 0]):
                k = int(place[node])
                flipped = slot in self.binary and bool(r_left[node, 0] / w_l[node, 0] > (r_all[node, 0] - r_left[node, 0]) / w_r[node, 0])
                found[node].append((slot, k, flipped, float(gain[node, k] / w_all[node, 0])))
        out = []
        for some in found:
            top = max((f[3] for f in some), default=0.0)
            out.append(next((f for f in some if f[3] >= top * (1 - 1e-9)), None))
        return out

    def goes_right(self, splits: dict[int, tuple], level: int) -> dict[int, np.ndarray]:
        """For each group that a split of the level needs: by node and joint place, whether a row goes right."""
        out: dict[int, np.ndarray] = {}
        for node, (slot, place, flipped, _) in splits.items():
            g = next(k for k, group in enumerate(self.groups) if slot in group)
            table = out.setdefault(g, np.zeros((1 << level, self.width[g]), np.uint8))
            group, beyond = self.groups[g], (np.arange(self.sizes[slot]) > place) != flipped
            shape = [1] + [self.sizes[s] if s == slot else 1 for s in group]
            full = [2] + [self.sizes[s] for s in group]
            table[node] = np.broadcast_to(beyond.reshape(shape), full).reshape(-1)
        return {g: table.reshape(-1) for g, table in out.items()}

    def tree(self, root: np.ndarray, ask: Callable[[int, dict, list[int]], np.ndarray]) -> Tree:
        """A tree from the counts at its root; ``ask`` splits the nodes of a level and counts at some of the next."""
        known, tree = {0: root}, Tree([], [{0: self._total(root)}], np.zeros(1 << self.depth))
        for level in range(self.depth):
            splits = {node: split for node, split in zip(known, self.best(np.stack(list(known.values())))) if split} if known else {}
            tree.splits.append(splits)
            sides = {}
            for node, (slot, place, flipped, _) in splits.items():
                start = sum(self.sizes[s] for s in self.slots if s < slot)
                part = known[node][start : start + self.sizes[slot]]
                low, high = part[: place + 1].sum(0), part[place + 1 :].sum(0)
                sides[node] = (high, low) if flipped else (low, high)
            tree.totals.append({2 * node + k: self._stats(side) for node, pair in sides.items() for k, side in enumerate(pair)})
            after: dict[int, np.ndarray] = {}
            if level + 1 < self.depth and splits:
                # the child with fewer rows is counted, the other has what is left of its parent
                nodes = sorted(2 * node + int(b[0] + b[1] < a[0] + a[1]) for node, (a, b) in sides.items())
                for child, sums in zip(nodes, ask(level, splits, nodes).reshape(len(nodes), -1, 3)):
                    after[child], after[child ^ 1] = sums, known[child >> 1] - sums
            known = after
        for level, found in enumerate(tree.totals):
            width = 1 << (self.depth - level)
            for node, (w, r) in found.items():
                tree.values[node * width : (node + 1) * width] = r / w if w else 0.0
        return tree

    def descend(self, rows: Rows, tree: Tree, since: int = 0) -> None:
        for level in range(since, self.depth):
            rows.descend(self.goes_right(tree.splits[level], level), self.width, level)

    def _stats(self, sums: np.ndarray) -> tuple[float, float]:
        return float(self.weight[0] * sums[0] + self.weight[1] * sums[1]), float(sums[2])

    def _total(self, sums: np.ndarray) -> tuple[float, float]:
        return self._stats(sums[: self.sizes[self.slots[0]]].sum(0) if self.slots else sums[0])

    def nodes(self, tree: Tree, squares: np.ndarray) -> list[dict]:
        """The tree in the form that the library saves; ``squares`` are (rows, squared residuals) of the last nodes."""
        out: list[dict] = []

        def add(level: int, node: int) -> int:
            width = 1 << (self.depth - level)
            n, square = (float(x) for x in squares[node * width : (node + 1) * width].sum(0))
            w, r = tree.totals[level][node]
            here = {"id": len(out), "prediction": r / w if w else 0.0, "impurity": max(0.0, (square - r * r / w) / w) if w else 0.0,
                    "impurityStats": [w, r, square], "rawCount": int(round(n)), "gain": -1.0, "leftChild": -1, "rightChild": -1,
                    "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            out.append(here)
            if level < self.depth and node in tree.splits[level]:
                slot, place, flipped, gain = tree.splits[level][node]
                told = ([float(flipped)], 2) if slot in self.binary else ([float(self.bounds[slot][place])], -1)
                here |= {"gain": gain, "split": {"featureIndex": slot, "leftCategoriesOrThreshold": told[0], "numCategories": told[1]},
                         "leftChild": add(level + 1, 2 * node), "rightChild": add(level + 1, 2 * node + 1)}
            return here["id"]

        add(0, 0)
        return out


def _parts(batches: Iterator[pd.DataFrame], grower: Grower) -> list[dict[str, np.ndarray]]:
    """The rows of a task, those to fit and those held out."""
    parts: list[list[tuple]] = [[], []]
    for batch in batches:
        held, y, n = batch["held"].to_numpy().astype(bool), np.where(batch["label"].to_numpy() > 0, 1, -1).astype(np.int8), batch["weight"].to_numpy()
        places = grower.places(batch)
        for kind, some in enumerate(parts):
            kept = held == bool(kind)
            some.append(([p[kept] for p in places], y[kept], n[kept]))
    return [_arrays(
        [np.concatenate([p[0][g] for p in some] or [np.empty(0, np.uint16)]) for g in range(len(grower.width))],
        np.concatenate([p[1] for p in some] or [np.empty(0, np.int8)]), np.concatenate([p[2] for p in some] or [np.empty(0)]), grower.depth)
        for some in parts]


class Rounds:
    """What is asked of all rows for a tree. None is the answer where some are not as the trees grown so far leave them."""

    def __init__(self, grower: Grower, step: float) -> None:
        self.grower, self.step, self.trees = grower, step, []

    def _asked(self, one: Callable[[Rows, Rows], np.ndarray], before: int, after: int) -> np.ndarray | None:
        raise NotImplementedError

    def root(self) -> np.ndarray | None:
        """The counts at the root of the next tree."""
        grower, grown = self.grower, len(self.trees)
        return self._asked(lambda train, _: grower.by_slot(train.counts([0], 0, grown, grower.width, grower.weight)), grown, grown)

    def level(self, level: int, splits: dict[int, tuple], nodes: list[int]) -> np.ndarray | None:
        """Splits the nodes of a level and counts at some of the next."""
        grower, grown = self.grower, len(self.trees)

        def one(train: Rows, _: Rows) -> np.ndarray:
            train.descend(grower.goes_right(splits, level), grower.width, level)
            return grower.by_slot(train.counts(nodes, level + 1, grown, grower.width, grower.weight))

        return self._asked(one, grown, grown)

    def add(self, tree: Tree, since: int) -> np.ndarray | None:
        """Adds a tree of which the train rows have passed so many levels: loss on the held rows, their number, squares, next root."""
        grower, grown, step = self.grower, len(self.trees), self.step if self.trees else 1.0  # the library adds its first tree whole

        def one(train: Rows, held: Rows) -> np.ndarray:
            grower.descend(train, tree, since)
            grower.descend(held, tree)
            squares = train.squares(grown, grower.depth, grower.weight)
            for rows in (train, held):
                rows.grow(tree.values, step, grown, grower.depth)
            root = grower.by_slot(train.counts([0], 0, grown + 1, grower.width, grower.weight))
            return np.concatenate([[held.loss(grown + 1), float(len(held.y))], squares.reshape(-1), root.reshape(-1)])

        found = self._asked(one, grown, grown + 1)
        if found is not None:
            self.trees.append(tree)
        return found


class OneTask(Rounds):
    """Rows that one task holds, which grows all trees by itself."""

    def __init__(self, batches: Iterator[pd.DataFrame], grower: Grower, step: float) -> None:
        super().__init__(grower, step)
        self.rows = [Rows(arrays, len(grower.width)) for arrays in _parts(batches, grower)]

    def _asked(self, one: Callable[[Rows, Rows], np.ndarray], before: int, after: int) -> np.ndarray:
        return one(*self.rows).reshape(-1)


class Fleet(Rounds):
    """Rows in files of the executors, of which a job for each level of a tree asks.

    The name of a task's folder is cached where it ran, so that later tasks run there. Where an executor is lost the rows
    are dealt anew and go through the trees that are grown.
    """

    def __init__(self, ready: DataFrame, grower: Grower, step: float) -> None:
        super().__init__(grower, step)
        self.ready, self.folders = ready, None
        self.deal()

    def deal(self) -> None:
        self.close()
        grower, trees, step = self.grower, list(self.trees), self.step

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            path = tempfile.mkdtemp(prefix="matchloom-fit-")
            for kind, arrays in enumerate(_parts(batches, grower)):
                rows = Rows(arrays, len(grower.width))
                for k, tree in enumerate(trees):
                    grower.descend(rows, tree)
                    rows.grow(tree.values, step if k else 1.0, k, grower.depth)
                os.mkdir(f"{path}/{kind}")
                for name, values in arrays.items():
                    np.save(f"{path}/{kind}/{name}.npy", values)
            with open(f"{path}/grown", "w") as f:
                f.write(str(len(trees)))
            yield pd.DataFrame({"path": [path]})

        self.folders = self.ready.mapInPandas(load, "path string").rdd.map(lambda row: row["path"]).persist(StorageLevel.MEMORY_AND_DISK)
        self.folders.count()

    def _asked(self, one: Callable[[Rows, Rows], np.ndarray], before: int, after: int) -> np.ndarray | None:
        n_groups = len(self.grower.width)

        def each(paths: Iterator[str]) -> Iterator[bytes | None]:
            for path in paths:
                try:
                    with open(f"{path}/grown") as f:
                        now = int(f.read())
                except FileNotFoundError:
                    now = -1
                if now not in (before, after):
                    yield None
                    continue
                yield one(*(Rows(f"{path}/{kind}", n_groups) for kind in (0, 1))).tobytes()
                if now != after:
                    with open(f"{path}/grown.{os.getpid()}", "w") as f:
                        f.write(str(after))
                    os.replace(f.name, f"{path}/grown")

        answers = self.folders.mapPartitions(each).collect()
        if any(a is None for a in answers):
            return None
        total = np.zeros(len(answers[0]) // 8)
        for a in answers:
            total = total + np.frombuffer(a)
        return total

    def close(self) -> None:
        def drop(paths: Iterator[str]) -> Iterator[int]:
            for path in paths:
                shutil.rmtree(path, ignore_errors=True)
                yield 1

        if self.folders is not None:
            self.folders.mapPartitions(drop).count()
            self.folders.unpersist()


class Stale(Exception):
    """Rows are gone, or not as the trees grown so far leave them."""


def _fresh(found: np.ndarray | None) -> np.ndarray:
    if found is None:
        raise Stale
    return found


def grow(rounds: Rounds, trees: int, rounds_kept: Callable[[list[float]], tuple[int, bool]]) -> list[list[dict]]:
    """The nodes of each kept tree."""
    grower, done, losses, root, keep, over, tries = rounds.grower, [], [], None, trees, False, 0
    while len(done) < trees and not over:
        passed = 0

        def ask(level: int, splits: dict, nodes: list[int]) -> np.ndarray:
            nonlocal passed
            found = _fresh(rounds.level(level, splits, nodes))
            passed = level + 1
            return found

        try:
            root = _fresh(rounds.root()).reshape(-1, 3) if root is None else root
            tree = grower.tree(root, ask)
            told = _fresh(rounds.add(tree, passed))
        except Stale:
            tries += 1
            if tries > 10:
                raise RuntimeError("the rows of a fit were lost again and again") from None
            rounds.deal()
            root = None
            continue
        squares, root = told[2 : 2 + (2 << grower.depth)], told[2 + (2 << grower.depth) :].reshape(-1, 3)
        done.append(grower.nodes(tree, squares.reshape(-1, 2)))
        losses.append(float(told[0]))
        if told[1]:
            keep, over = rounds_kept(losses)
    return done[:keep]


def boosted_trees(rows: DataFrame, grower: Grower, n_slots: int, trees: int, step: float, rounds_kept: Callable[[list[float]], tuple[int, bool]], tasks: int) -> list[list[dict]]:
    """The nodes of each kept tree, grown on the rows (features, label, weight, held) that are not held out.

    ``weight`` says how many rows a row stands for. After each round ``rounds_kept`` is told the losses on the held rows and
    says how many rounds to keep, and whether that is final. The rows are in ``tasks`` partitions; where that is one, its
    task grows the trees without a job for each level.
    """
    ready = _slots(rows, n_slots, "label", "weight", "held")
    if tasks == 1:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = grow(OneTask(batches, grower, step), trees, rounds_kept)
            yield pd.DataFrame({"tree": range(len(found)), "nodes": [json.dumps(nodes) for nodes in found]})

        return [json.loads(r["nodes"]) for r in sorted(ready.mapInPandas(run, "tree int, nodes string").collect())]
    fleet = Fleet(ready, grower, step)
    try:
        return grow(fleet, trees, rounds_kept)
    finally:
        fleet.close()


def saved_nodes(model: GBTClassificationModel) -> list[list[dict]]:
    """The nodes of each tree by id, through the library's own files: asking the trees node by node takes minutes."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    out: list[list[dict]] = [[] for _ in range(model.getNumTrees)]
    for row in spark.read.schema(NODE_SCHEMA).parquet(f"{path}/data").collect():
        out[row["treeID"]].append(row["nodeData"].asDict(recursive=True))
    discard(spark, path)
    return [sorted(nodes, key=lambda node: node["id"]) for nodes in out]


def as_model(spark: SparkSession, trees: list[list[dict]], step: float, depth: int, seed: int, n_slots: int) -> GBTClassificationModel:
    """A classifier of the given nodes, read by the library from files in its form."""
    path, version, params = scratch_path(spark, "grown"), spark.version, {"maxDepth": depth, "seed": seed}

    def described(kind: str, uid: str, more: dict) -> str:
        return json.dumps({"class": kind, "timestamp": 0, "sparkVersion": version, "uid": uid, "paramMap": params, "defaultParamMap": {"impurity": "variance"}} | more)

    def write(rows: list, schema: str, name: str) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")

    mark = uuid.uuid4().hex[:12]
    whole = described("org.apache.spark.ml.classification.GBTClassificationModel", f"boosted_{mark}", {"paramMap": {**params, "maxIter": len(trees), "stepSize": step}, "numFeatures": n_slots, "numTrees": len(trees)})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(k, described("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"tree_{mark}_{k}", {}), step if k else 1.0) for k in range(len(trees))]
    write(each, "_1 int, _2 string, _3 double", "treesMetadata")
    write([(k, node) for k, nodes in enumerate(trees) for node in nodes], NODE_SCHEMA, "data")
    model = GBTClassificationModel.load(path)
    discard(spark, path)
    return model
