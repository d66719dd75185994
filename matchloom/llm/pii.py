"""Personal data by candidate gradient boosting.

Fixed patterns give base spans, which always stay. High-recall generators propose further, overlapping spans: numbers
without the plus, cards with other separators or a failing check digit, spelled-out addresses. These are unlabelled: some
are personal data, some are not. Boosted trees learn from base spans, also rewritten in the loose forms where they stand
(plus and country code, card grouping and @ hidden), against near-miss junk: what fails a base check, what lies in a base
span of another kind, and decoys of the loose forms. Features hold none of the base checks. For each kind the share of
hidden personal data among the unlabelled is estimated from their scores, and the threshold is the lowest score from which
spans of that share would be precise enough, by the rates at which held-out hidden spans and junk pass it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle

KINDS = ("email", "ip", "card", "phone")
SCORE_STEPS = 4096  # steps of a score in which candidates are counted: the driver holds no more for each kind and label
FIT_ROWS = 100_000  # different candidates that a task of the fit holds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2,3}(?![0-9])"),
}
_SPELLED = re.compile(r"[A-Za-z0-9._+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,24}){1,4}")
_CONTEXT = re.compile(r"tel|phone|call|mobile|mail|contact|card|visa|pay|host|server|addr", re.I)
SPAN = "struct<kind:string,start:bigint,stop:bigint>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, candidates array<struct<kind:string,start:bigint,stop:bigint,label:double,free:boolean,features:array<double>>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, so that long runs without one cost nothing."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            found.append((start, floor))
        at = text.find("@", max(floor, at + 1))
    return found


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each four parts of a dotted chain of numbers, and whether all are at most 255."""
    for chain in _CHAIN.finditer(text):
        parts = [(m.start(), m.end()) for m in re.finditer("[0-9]+", chain.group())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            fits = all(len(p := chain.group()[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four)
            yield chain.start() + four[0][0], chain.start() + four[3][1], fits


def propose(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the other candidates."""
    base, loose = [], []
    if "@" in text:
        base += [("email", a, b) for a, b in emails(text)]
    for a, b, fits in addresses(text):
        (base if fits else loose).append(("ip", a, b))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19:
            (base if luhn(digits) else loose).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            fits = 9 <= sum(map(str.isdigit, m.group())) <= 15
            (base if fits else loose).append(("phone", *m.span()))
    for kind, pattern in _LOOSE.items():
        loose += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "at)" in text or "at]" in text:
        loose += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    return base, loose


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    """Format and surroundings; a leading plus is left out, and no check digit or range is looked at."""
    span = text[start:stop].lstrip("+")[:200]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    near = text[max(0, start - 24) : start] + " " + text[stop : stop + 12]
    seen = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in seen.values()) if span else 0.0
    digits = sum(groups)
    return [
        *(float(kind == k) for k in KINDS), float(len(span)), float(digits), float(len(groups)), float(max(groups)), float(groups[0]), float(groups[-1]),
        float(sum(c.isalpha() for c in span)), float(sum(c in " -" for c in span)), float(span.count(".")), float("(" in span), float(len(set(span))), entropy,
        _side(text[start - 1 : start]), _side(text[stop : stop + 1]), float(bool(_CONTEXT.search(near))), float(sum(c.isdigit() for c in near)),
    ]


def hidden_forms(kind: str, said: str) -> list[str]:
    """A base span in the forms that the loose generators look for."""
    if kind == "phone" and (m := _LOOSE["phone"].search(said)):
        groups = re.findall("[0-9]+", m.group())
        return [m.group(), *(sep.join(groups) for sep in "-. ")]
    if kind == "card":
        digits = re.sub("[^0-9]", "", said)
        return [sep.join(digits[i : i + 4] for i in range(0, 16, 4)) for sep in "./_"] if len(digits) == 16 else []
    if kind == "email":
        local, _, domain = said.partition("@")
        return [f"{local} (at) {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain.replace('.', '(dot)')}"]
    return []


def decoys(kind: str, text: str, start: int, stop: int) -> list[str]:
    """Near misses of the loose forms, drawn by a hash of the place: numbers and words that are no personal data."""
    seed = hashlib.sha256(f"{kind}:{start}:{text[start:stop]}".encode("utf-8", "surrogatepass")).digest()
    digits = "".join(str(x % 10) for x in seed)
    if kind == "phone":
        year, sep = 1950 + seed[0] % 90, "-. "[seed[1] % 3]
        return [f"{year}{sep}{year + 1}{sep}{year + 2}", f"{digits[:2]}{sep}{digits[2:6]}{sep}{digits[6:9]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:9]}", f"{digits[9:11]} {digits[11:14]} {digits[14:17]}"]
    if kind == "card":
        year, sep = 1950 + seed[0] % 90, "./_"[seed[1] % 3]
        return [sep.join(str(year + k) for k in range(3)), sep.join((digits[:4], digits[4:8], digits[8:12]))]
    if kind == "email":
        words = re.findall(r"[^\W\d_]+", text[max(0, start - 60) : start]) or ["met"]
        return [f"{words[-1][:20]} (at) {words[0][:20]}. {words[seed[0] % len(words)][:20].title()}", f"{words[0][:20]} [at] {words[-1][:20]}. {words[seed[1] % len(words)][:20].title()}"]
    return []


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def fails(kind: str, said: str) -> bool:
    """Whether a loose candidate has the check of its kind and fails it."""
    return kind == "ip" or said[:1] == "+" or (kind == "card" and not luhn(re.sub("[^0-9]", "", said)))


def find_candidates(docs: DataFrame) -> DataFrame:
    def one(text: str | None) -> tuple:
        text = text if isinstance(text, str) else ""
        base, loose = propose(text)
        count = Counter(k for k, _, _ in base)
        by_kind = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        rows = []

        def add(kind: str, a: int, b: int, label: float | None, free: bool, said: str = text) -> None:
            rows.append({"kind": kind, "start": a, "stop": b, "label": label, "free": free, "features": features(said, kind, a, b)})

        for kind, a, b in base:
            add(kind, a, b, 1.0, False)
            near, rest = text[max(0, a - 64) : a], text[b : b + 64]
            for label, forms in ((1.0, hidden_forms(kind, text[a:b])), (0.0, decoys(kind, text, a, b))):
                for form in forms:
                    add(kind, len(near), len(near) + len(form), label, False, near + form + rest)
        for kind, a, b in loose:
            if any(a < d and c < b for c, d in by_kind[kind]):
                continue  # part of a base span of its kind, which its hidden forms stand for
            inside = any(a < d and c < b for _, c, d in base)
            add(kind, a, b, 0.0 if inside or fails(kind, text[a:b]) else None, not inside)
        return (*(count[k] for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), [dict(zip(("kind", "start", "stop"), s, strict=True)) for s in base], rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, FOUND)


def hidden_share(odds: np.ndarray, counts: np.ndarray) -> float:
    """The share of personal data among candidates of these likelihood ratios, by expectation maximisation."""
    share = 0.5
    for _ in range(200):
        share = float(np.average(share * odds / (share * odds + 1 - share), weights=counts))
    return share


def score_counts(scored: DataFrame) -> DataFrame:
    """kind, label, p, mean and n: how many candidates have a score of a step, the lowest of them and their mean."""
    step = F.floor(F.col("p") * SCORE_STEPS)
    return scored.groupBy("kind", "label", step.alias("step")).agg(F.min("p").alias("p"), F.avg("p").alias("mean"), F.count("*").alias("n")).drop("step")


def thresholds(counted: pd.DataFrame, precision: float) -> dict[str, float]:
    """Per kind the lowest score from which the unlabelled are precise enough; none: above every score.

    counted: score_counts of held-out and unlabelled candidates (label null). The rate of junk is smoothed.
    """
    found = {}
    for kind, own in counted.groupby("kind"):
        real, junk, open_ = (own[own["label"].isna() if label is None else own["label"] == label].sort_values("p") for label in (1.0, 0.0, None))
        if not len(real) or not len(junk) or not len(open_):
            continue
        n_real, n_junk = real["n"].sum(), junk["n"].sum()
        p = np.clip(open_["mean"].to_numpy(), 1e-4, 1 - 1e-4)
        share = hidden_share(p / (1 - p) * n_junk / n_real, open_["n"].to_numpy())
        for limit in np.unique(np.floor(real["p"][real["p"] > 0.5] * SCORE_STEPS) / SCORE_STEPS):
            right = share * real["n"][real["p"] >= limit].sum() / n_real
            wrong = (1 - share) * (junk["n"][junk["p"] >= limit].sum() + 0.05) / (n_junk + 0.1)
            if right >= precision * (right + wrong):
                found[kind] = float(limit)
                break
    return found


def select_spans(found: DataFrame, precision: float, fit_rows: int = FIT_ROWS) -> DataFrame:
    """row and extra (the spans selected beside the base). All candidates are fitted on, held out or, if unlabelled, weighed."""
    rows = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    none = found.select("row", F.array().cast("array<struct<p:double,kind:string,start:bigint,stop:bigint>>").alias("extra")).limit(0)
    # ip has no loose form: its other candidates fail the check
    sizes = {(r["kind"], r["label"]): r["count"] for r in rows.groupBy("kind", "label").count().collect()}
    if not any(all((k, label) in sizes for label in (None, 0.0, 1.0)) for k in KINDS):
        return none
    judged = rows.withColumn("x", array_to_vector("features"))
    # a span and its hidden forms share a side
    side = F.pmod(F.xxhash64("row"), F.lit(3))
    # equal candidates are one that weighs as they do together, and a task of the fit holds some rows only
    fit = settle(judged.filter((side > 0) & F.col("label").isNotNull()).groupBy("features", "label").agg(F.count("*").cast("double").alias("weight")))
    counts = fit.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    if counts["labels"] < 2:
        return none
    dealt = fit.withColumn("x", array_to_vector("features")).repartition(max(1, -(-counts["n"] // fit_rows)), "features").sortWithinPartitions("features", "label")
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=15, maxDepth=4, seed=7).fit(dealt)
    p = vector_to_array("probability")[1]
    held = judged.filter((side == 0) | F.col("label").isNull())
    limits = thresholds(score_counts(model.transform(held).select("kind", "label", p.alias("p"))).toPandas(), precision)
    if not limits:
        return none
    limit = F.lit(None).cast("double")
    for kind, least_p in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(least_p)).otherwise(limit)
    scored = model.transform(judged.filter("free")).withColumn("p", p)
    return scored.filter(F.col("p") >= limit).groupBy("row").agg(F.collect_list(F.struct("p", "kind", "start", "stop")).alias("extra"))


def find_personal_data(docs: DataFrame, precision: float = 0.995) -> DataFrame:
    """Per document: doc_id, base counts, base_sha256 and spans (kind:start:end of all spans, in code points).

    Of overlapping additions the higher score wins, then the earlier start. A null or empty text has no spans; repeated
    rows are each judged; an empty table has no additions, nor does a kind without base spans to learn from; columns
    beyond doc_id and text are not read.
    """
    found = settle(find_candidates(docs).withColumn("row", F.monotonically_increasing_id()))
    extra = select_spans(found, precision)

    @F.pandas_udf("string")
    def all_spans(base: pd.Series, more: pd.Series) -> pd.Series:
        def one(own, others) -> str:
            spans = [(s["kind"], int(s["start"]), int(s["stop"])) for s in own]
            for s in sorted(others if others is not None else [], key=lambda s: (-s["p"], s["start"], s["stop"], s["kind"])):
                if not any(s["start"] < b and a < s["stop"] for _, a, b in spans):
                    spans.append((s["kind"], int(s["start"]), int(s["stop"])))
            return told(spans)

        return pd.Series([one(a, b) for a, b in zip(base, more, strict=True)], dtype=object)

    joined = found.drop("candidates").join(extra, "row", "left")
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", all_spans("base", "extra").alias("spans"))
