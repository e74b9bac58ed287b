"""The name model: its 46 features, training by distributed Newton steps, a verified bundle, and guarded scoring.

Features and probabilities are Column expressions. What is learned is small whatever the data: a table of transitions
between 40 symbols, and 46 weights. Training sums the gradient and the curvature of all rows on the executors, and
solves 47 equations on the driver. A bundle is a folder of texts with checksums and golden names; one that fails any
check isn't used, and names are then judged by the lexical rule alone.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapline.functions import columns as fn
from tapline.operators.tables import nearest_rank
from tapline.sources.shared import remove_folder, shared_folder

# Fixed values of the feature contract: its version, symbols (boundaries ^ and $, ? for any other), bounds and order.
CONTRACT, SYMBOLS, BUCKETS, LEAST_LABEL = "dga_lexical-1.0.0", "abcdefghijklmnopqrstuvwxyz0123456789-^$?", 32, 6
NAMES = [
    "sld_len", "sld_entropy", "sld_digit_ratio", "sld_vowel_ratio", "sld_consonant_ratio", "sld_max_consonant_run", "sld_max_digit_run", "sld_hyphen_count",
    "sld_unique_char_ratio", "sld_hex_ratio", "query_len", "subdomain_depth", "suffix_label_count", "sld_bigram_logprob_mean", *(f"sld_bigram_hash_{i:02d}" for i in range(BUCKETS)),
]
#: Scoring stops for the rest of a partition after so many errors in a row.
MOST_ERRORS = 20


def _framed(label: Column) -> Column:
    """A label in symbols, between its boundaries."""
    return F.concat(F.lit("^"), F.regexp_replace(label, "[^a-z0-9-]", "?"), F.lit("$"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` the value, which is computed once: elsewhere an expression is written out wherever it is used, in lambdas for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: of(v)), 1)


def _pairs(label: Column) -> Column:
    return _once(_framed(label), lambda framed: F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: F.substring(framed, i, F.lit(2))))


def transition_table(labels: DataFrame, label: str = "label") -> list[float]:
    """Natural logarithms of P(next symbol | symbol), add-one smoothed, by 40 * symbol + next; null labels don't count."""
    n = len(SYMBOLS)
    pairs = labels.filter(F.col(label).isNotNull()).select(F.explode(_pairs(F.col(label))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = np.ones((n, n))
    for row in pairs.collect():  # at most 1600 rows
        counts[SYMBOLS.index(row["pair"][0]), SYMBOLS.index(row["pair"][1])] += row["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel().tolist()


def log_probability(label: Column, table: list[float]) -> Column:
    """The mean over a label's transitions of their logarithmic probability."""
    n, symbols = len(SYMBOLS), F.lit(SYMBOLS)
    known = F.split(F.lit(" ".join(map(repr, table))), " ").cast("array<double>")  # one constant; 1600 take a second to name
    place = lambda pair, i: F.instr(symbols, F.substring(pair, i, 1)) - 1
    steps = F.transform(_pairs(label), lambda p: F.element_at(known, (place(p, 1) * n + place(p, 2) + 1).cast("int")))
    return _once(steps, lambda steps: F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps))


def vector(query: Column, table: list[float]) -> Column:
    """The features of a name in the contract's order; null for names that aren't eligible."""
    parts = lambda text: F.size(F.split(text, r"\."))
    most = lambda x, bound: F.least(x, F.lit(bound))
    consonants = "bcdfghjklmnpqrstvwxyz"

    def shares(label: Column) -> Column:
        hashed = F.transform(_pairs(label), lambda p: fn.fnv1a32(p) % BUCKETS)
        return _once(hashed, lambda hashed: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(hashed, lambda h: h == b)) / F.size(hashed)))

    def features(name: Column, label: Column, registrable: Column) -> Column:
        plain = [
            most(F.length(label), 63), fn.entropy(label), fn.class_ratio(label, "0-9"), fn.class_ratio(label, "aeiou"), fn.class_ratio(label, consonants), most(fn.longest_run(label, consonants), 63), most(fn.longest_run(label, "0-9"), 63),
            most(F.length(label) - F.length(F.replace(label, F.lit("-"), F.lit(""))), 10), F.size(F.array_distinct(F.filter(F.split(label, ""), lambda c: F.length(c) > 0))) / F.length(label), fn.class_ratio(label, "0-9a-f"),
            most(F.length(name), 253), most(parts(name) - parts(registrable), 10), parts(registrable) - 1, log_probability(label, table),
        ]
        return F.when(F.length(label) >= LEAST_LABEL, F.concat(F.array(*(c.cast("double") for c in plain)), shares(label)))

    named = lambda name: _once(fn.second_label(name), lambda label: _once(fn.registrable(name), lambda registrable: features(name, label, registrable)))
    return _once(fn.normal_name(query), named)


@dataclass(frozen=True)
class NameModel:
    """A linear model of names. Scores from `threshold` on call a name generated."""

    table: list[float]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    threshold: float = 0.5
    version: str = "0"

    def probability(self, features: Column) -> Column:
        logit = F.aggregate(self.contributions(features), F.lit(self.intercept), lambda a, x: a + x)
        return 1 / (1 + F.exp(-logit))

    def contributions(self, features: Column) -> Column:
        """What each feature adds to the logit."""
        slopes = [w / s for w, s in zip(self.weights, self.scales)]
        return F.zip_with(F.zip_with(features, F.lit(self.means), lambda x, m: x - m), F.lit(slopes), lambda x, w: x * w)


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows (x array<double>, y double) of the vectors that `of` makes of a batch's X and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            if len(y):
                total += of(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    sums = rows.select("x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for row in sums:
        out[row["i"]] = row["v"]
    return out


def fit(rows: DataFrame, table: list[float], penalty: float = 1.0, most: int = 100) -> NameModel:
    """A ridge logistic model of rows (x array<double>, y 0 or 1) by Newton's method on standardised features.

    Features are made once, into a table that goes with the model's end. Each step sums the gradient and the curvature over
    all rows where they are. The intercept isn't penalised. Rows with null features don't count; constant features keep
    their scale.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    try:
        rows.select("x", F.col("y").cast("double")).write.parquet(folder)
        return _newton(spark.read.parquet(folder).filter("x IS NOT NULL AND y IS NOT NULL"), table, penalty, most)
    finally:
        remove_folder(spark, folder)


def _newton(rows: DataFrame, table: list[float], penalty: float, most: int) -> NameModel:
    d = len(rows.select("x").first()["x"])
    moments = _summed(rows, 2 * d + 1, lambda x, y: np.concatenate((x.sum(0), (x * x).sum(0), [len(y)])))
    n = moments[-1]
    means = moments[:d] / n
    spread = _summed(rows, d, lambda x, y: ((x - means) ** 2).sum(0))
    scales = np.sqrt(spread / n)
    scales[scales < 1e-9] = 1.0
    w, ridge = np.zeros(d + 1), np.append(np.full(d, penalty), 0.0)

    def step_of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        a = np.hstack([(x - means) / scales, np.ones((len(y), 1))])
        p = 1 / (1 + np.exp(-(a @ w)))
        return np.concatenate((a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()))

    for _ in range(most):
        now = w
        sums = _summed(rows, (d + 1) * (d + 2), lambda x, y: step_of(x, y, now))  # noqa: B023
        curvature = sums[d + 1 :].reshape(d + 1, d + 1) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curvature, sums[: d + 1] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return NameModel(table, means.tolist(), scales.tolist(), w[:-1].tolist(), float(w[-1]))


def threshold(scores: DataFrame, score: str = "p", share: float = 0.99) -> float:
    """The smallest score that `share` of benign scores don't exceed, between a half and 0.99."""
    n = scores.filter(F.col(score).isNotNull()).count()
    if not n:
        return 0.5
    row = nearest_rank(scores, score, [(math.ceil(share * n) - 0.5) / n], 0.01).first()
    return min(0.99, max(0.5, row["value"]))


def _write(spark: SparkSession, folder: str, name: str, content: dict) -> str:
    """One line of JSON under a name; returns its digest."""
    text = json.dumps(content)
    row = spark.createDataFrame([(text,)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return row.select(F.sha2("value", 256)).first()[0]


def save(spark: SparkSession, model: NameModel, golden: list[str], folder: str) -> dict[str, str]:
    """Write a bundle: weights, contract, and what golden names give. Returns the digests that a deployment selects."""
    made = spark.createDataFrame([(q,) for q in golden], "query string").withColumn("x", vector(F.col("query"), model.table))
    vectors = [{"query": r["query"], "features": r["x"], "p": r["p"]} for r in made.withColumn("p", model.probability(F.col("x"))).collect()]
    contents = {"model": asdict(model), "contract": {"version": CONTRACT, "features": NAMES}, "golden": {"vectors": vectors}}
    return {name: _write(spark, folder, name, content) for name, content in contents.items()}


def load(spark: SparkSession, folder: str, digests: dict[str, str]) -> tuple[NameModel | None, str]:
    """The model of a bundle and 'active', or None and why it isn't used: then the lexical rule judges alone.

    Checked are digests, the feature contract, and that golden names give their features (1e-9) and scores (1e-5) here.
    """
    try:
        texts = {name: spark.read.text(f"{folder}/{name}").first()["value"] for name in ("model", "contract", "golden")}
    except Exception as e:  # an unreadable bundle is no reason to stop
        return None, f"unreadable: {type(e).__name__}"
    found = {name: spark.createDataFrame([(text,)], "value string").select(F.sha2("value", 256)).first()[0] for name, text in texts.items()}
    for name, digest in found.items():
        if digests.get(name) != digest:
            return None, f"checksum of {name}"
    model, contract, golden = (json.loads(texts[n]) for n in ("model", "contract", "golden"))
    if contract != {"version": CONTRACT, "features": NAMES}:
        return None, "feature contract"
    model = NameModel(**model)
    made = spark.createDataFrame([(i, g["query"]) for i, g in enumerate(golden["vectors"])], "i int, query string").withColumn("x", vector(F.col("query"), model.table))
    for row in made.withColumn("p", model.probability(F.col("x"))).collect():
        known = golden["vectors"][row["i"]]
        if row["x"] is None or max(abs(a - b) for a, b in zip(row["x"], known["features"])) > 1e-9:
            return None, f"golden features of {known['query']}"
        if abs(row["p"] - known["p"]) > 1e-5:
            return None, f"golden score of {known['query']}"
    return model, "active"


def guarded(rows: DataFrame, model: NameModel | None, features: str = "x", most: int = MOST_ERRORS) -> DataFrame:
    """`rows` with p and reason (null: scored): no model, not eligible (null features), an error, or disabled.

    Features of another length or that aren't finite are errors. After `most` in a row, the rest of the partition isn't
    scored; a score in between starts the count anew.
    """
    if model is None:
        return rows.withColumns({"p": F.lit(None).cast("double"), "reason": F.lit("model_unavailable")})
    d, slopes, means, bias = len(model.weights), np.array(model.weights) / np.array(model.scales), np.array(model.means), model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for batch in batches:
            scores, reasons = [], []
            for x in batch.column(features).to_pylist():
                p, reason = None, None
                if x is None:
                    reason = "not_eligible"
                elif failed >= most:
                    reason = "model_disabled"
                elif len(x) != d or any(v is None or not math.isfinite(v) for v in x):
                    failed, reason = failed + 1, "model_error"
                else:
                    failed, p = 0, float(1 / (1 + np.exp(-(bias + (np.array(x) - means) @ slopes))))
                scores.append(p)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(reasons, pa.string())], names=[*batch.schema.names, "p", "reason"])

    schema = StructType(list(rows.schema.fields)).add("p", "double").add("reason", "string")
    return rows.mapInArrow(run, schema)
