"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

N-grams of one to three characters of the lower-cased whole text are hashed to ``2 ** bits`` features. Document
frequencies are counted over every learning document. Weights are fitted by follow-the-regularised-leader with elastic
net on a bounded sample of labelled documents (``sample_rows``, equal shares for all languages), and the temperature
that makes probabilities honest is fitted on a fifth of that sample, which the weights have not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, named

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def feature_counts(text: str, bits: int) -> np.ndarray:
    """How often each hashed n-gram of one to three characters occurs in the whole text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(1 << bits, np.int64)
    shift, rolling = np.uint64(64 - bits), None
    for order, mix in enumerate(_MIX):
        if len(points) <= order:
            break
        part = points[order:] * mix
        rolling = part if rolling is None else (rolling[:-1] ^ (rolling[:-1] >> np.uint64(29))) * _MIX[0] + part
        total += np.bincount(((rolling * _MIX[1]) >> shift).astype(np.int64), minlength=1 << bits)
    return total


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features present and their TF-IDF weights of length one."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    return at, values / max(np.sqrt((values**2).sum()), 1e-12)


@dataclass
class LanguageModel:
    """``weights`` has a row per feature and a last one for the bias, a column per language."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, values = weigh(feature_counts(text, self.bits), self.idf)
        p = softmax((values @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; a task sends its counts, not its rows."""

    def count(batches):
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += feature_counts(text, bits) > 0
                rows += 1
        at = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], rows))], names=["feature", "n"])

    summed = texts.mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << bits, np.int64)
    for feature, n in summed:
        if feature >= 0:
            df[feature] = n
    return df, sum(n for feature, n in summed if feature < 0)


def bounded_sample(rows: DataFrame, label: str, key: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows in equal shares of the labels, chosen by hash; repeated rows count once.

    Rows are counted per label and 16 bits of the hash first, so that of a label of any size only about ``limit`` are ranked in one task.
    The ends of the labels, which are the classes of a model, are broadcast.
    """
    spread = F.xxhash64(*key)
    keys = rows.select(label, spread.alias("_key")).distinct()
    bucket = F.shiftright("_key", 48)
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy(label, bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    ends = counts.filter(F.col("_before") < limit).groupBy(F.col(label).alias("_of")).agg(F.max("_bucket").alias("_end"))
    first = keys.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("_of")) & (bucket <= F.col("_end"))).select(label, "_key")
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_key")))
    chosen = ranked.filter(F.col("_rank") <= limit).orderBy("_rank", "_key", label).limit(limit).select(label, "_key")
    return rows.withColumn("_key", spread).join(F.broadcast(chosen), ["_key", label], "left_semi").dropDuplicates(["_key", label])


def fit_ftrl(rows, languages, size, alpha, beta, l1, l2, epochs) -> np.ndarray:
    """Follow the regularised leader, one example after the other; the last row of the weights is the free bias."""
    z, n = np.zeros((size + 1, languages)), np.zeros((size + 1, languages))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        free = at == size
        w[free] = -z[size] / ((beta + np.sqrt(n[size])) / alpha)
        return w

    for _ in range(epochs):
        for at, values, label in rows:
            at, values = np.append(at, size), np.append(values, 1.0)
            w = weights(at)
            error = softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_cols: list[str] | None = None, bits: int = 14,
    sample_rows: int = 3000, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, epochs: int = 3,
) -> LanguageModel:
    """Learn from rows with text and language.

    All rows are counted for the document frequencies; weights and temperature are fitted on at most ``sample_rows``
    of them, on the driver. Without any labelled row the model knows no language and predicts ``und``. ``key_cols`` only
    choose the sample.
    """
    rows = labelled.select(
        *[named(c).alias(f"_k{i}") for i, c in enumerate(key_cols or [])],
        named(text_col).alias("_text"), named(lang_col).alias("_label"),
    ).filter("_text is not null and _label is not null")
    df, n = document_frequencies(rows.select("_text"), bits)
    if not n:
        return LanguageModel([], np.zeros(((1 << bits) + 1, 0)), np.zeros(1 << bits), 1.0, bits)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    keys = [c for c in rows.columns if c.startswith("_k")] + ["_text"]

    def featurise(batch):
        pairs = [weigh(feature_counts(t, bits), idf) for t in batch["_text"]]
        return {"_key": batch["_key"], "_label": batch["_label"], "at": [p[0].tolist() for p in pairs], "w": [p[1].tolist() for p in pairs]}

    sample = bounded_sample(rows, "_label", keys, sample_rows).select("_key", "_label", "_text")
    found = map_batches(sample, featurise, "_key bigint, _label string, at array<int>, w array<float>").collect()
    found.sort(key=lambda r: (r["_key"], r["_label"]))
    languages = sorted({r["_label"] for r in found})
    data = [(np.asarray(r["at"]), np.asarray(r["w"]), languages.index(r["_label"])) for r in found]
    held = [d for i, d in enumerate(data) if i % 5 == 0 and len(data) >= 5 * max(len(languages), 2)]
    fitted = [d for i, d in enumerate(data) if i % 5 or not held]
    weights = fit_ftrl(fitted, len(languages), 1 << bits, alpha, beta, l1, l2, epochs)
    logits = np.array([values @ weights[at] + weights[-1] for at, values, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, weights, idf, fit_temperature(logits, np.array([d[2] for d in held], int)), bits)


def predict_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_into: str = "lang_pred", score_into: str = "score"
) -> DataFrame:
    """``docs`` with the likeliest language of every whole text and its calibrated probability.

    Null, empty and letterless texts are ``und`` with score 0. Columns of those two names are replaced, others stay. No
    shuffle.
    """

    @F.pandas_udf("struct<lang string, score double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    taken = {lang_into.lower(), score_into.lower()}
    kept = [named(c) for c in docs.columns if c.lower() not in taken]
    out = docs.select(*kept, predict(named(text_col)).alias("_predicted"))
    return out.withColumns({lang_into: F.col("_predicted.lang"), score_into: F.col("_predicted.score")}).drop("_predicted")


def learning_rows(fold: Column) -> Column:
    """Rows whose fold is not 0; those of a null fold are not learnt from."""
    return F.coalesce(fold != 0, F.lit(False))
