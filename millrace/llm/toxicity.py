"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text is its words (runs of letters, digits and underscores, lower-cased, cut every 24 characters), read in windows of
``WINDOW`` words of which each starts ``STRIDE`` after the one before, to the end of the text. The input of a word is an embedding of
the word, if the learning sample has it often enough, beside the mean of the embeddings of its characters. Two gated
recurrences run over a window, attention pools their states, a logistic unit scores the pool; the score of a text is
that of its worst window.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, staged
from millrace.llm.language import bounded_sample

WINDOW, STRIDE, PIECE = 64, 48, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION, CHARS = 12, 8, 8, 8, 512
#: Windows of a toxic text that count in full before its worst one is known.
FULL = 8
_WORD = re.compile(rf"\w{{1,{PIECE}}}")
#: Words that are scored together, which bounds the memory of a task whatever the texts' lengths.
_TOGETHER = 150_000


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> range:
    """Starts of the windows that cover ``n`` words."""
    return range(0, max(n - WINDOW + STRIDE, 1) if n else 0, STRIDE)


#: What is worked on in one go while fitting; bounds the arrays in between.
_WORDS_AT_ONCE, _WINDOWS_AT_ONCE = 1_000, 128


def char_ids(words: list[str]) -> np.ndarray:
    """Hashed characters of the words, one row per word, 0 behind the last."""
    points = np.array(words, dtype=f"<U{PIECE}").view(np.uint32).reshape(len(words), PIECE)
    return np.where(points > 0, 1 + points % (CHARS - 1), 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class ToxicityModel:
    """``vocabulary`` numbers the known words from 1; 0 is any other."""

    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]

    def char_means(self, ids: np.ndarray) -> np.ndarray:
        used = (ids > 0)[..., None]
        return (self.weights["chars"][ids] * used).sum(1) / np.maximum(used.sum(1), 1)

    def inputs(self, words: list[str]) -> np.ndarray:
        """What the gates of either direction get from each word: word, direction, gate."""
        w, out = self.weights, []
        for at in range(0, len(words), _WORDS_AT_ONCE):
            part = words[at : at + _WORDS_AT_ONCE]
            known = np.array([self.vocabulary.get(x, 0) for x in part])
            x = np.concatenate([w["words"][known], self.char_means(char_ids(part))], 1)
            out.append(np.einsum("nd,kdg->nkg", x, w["in"]) + w["in_b"])
        return np.concatenate(out).astype(np.float32)

    def score_windows(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of windows of word numbers into ``table``."""
        states, _ = recur([table[:, 0], table[:, 1]], ids, mask, self.weights["rec"])
        logits, _ = pool(states, mask, self.weights)
        return sigmoid(logits)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A score for each whole text: that of its worst window, 0 without words."""
        scores = np.zeros(len(texts))
        numbers: dict[str, int] = {}
        waiting: list[tuple[int, np.ndarray]] = []
        count = 0

        def flush() -> None:
            nonlocal count
            if waiting:
                table = self.inputs(list(numbers))
                order = sorted(range(len(waiting)), key=lambda i: len(waiting[i][1]))
                for at in range(0, len(order), 1024):
                    part = [waiting[i] for i in order[at : at + 1024]]
                    ids, mask = padded([ids for _, ids in part])
                    np.maximum.at(scores, [doc for doc, _ in part], self.score_windows(table, ids, mask))
            numbers.clear()
            waiting.clear()
            count = 0

        for doc, text in enumerate(texts):
            words = tokens(text)
            for start in window_starts(len(words)):
                part = words[start : start + WINDOW]
                waiting.append((doc, np.array([numbers.setdefault(w, len(numbers)) for w in part])))
                count += len(part)
                if count >= _TOGETHER:
                    flush()
        flush()
        return scores


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    mask = np.arange(lengths.max()) < lengths[:, None]
    ids = np.zeros(mask.shape, np.int64)
    ids[mask] = np.concatenate(rows)
    return ids, mask


def recur(tables, ids, mask, rec, trace=None):
    """States of both directions at every word: window, word, 2 * HIDDEN. ``trace`` collects what learning needs."""
    b, length = ids.shape
    h = np.zeros((2, b, HIDDEN), np.float32)
    states = np.empty((b, length, 2 * HIDDEN), np.float32)
    for step in range(length):
        there = (step, length - 1 - step)
        gates = np.stack([tables[k][ids[:, t]] for k, t in enumerate(there)])
        m = np.stack([mask[:, t] for t in there])[..., None]
        mix = h @ rec
        zr = sigmoid(gates[..., : 2 * HIDDEN] + mix[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        inner = mix[..., 2 * HIDDEN :]
        new = np.tanh(gates[..., 2 * HIDDEN :] + r * inner)
        after = np.where(m, new + z * (h - new), h)
        if trace is not None:
            trace.append((h, z, r, inner, new, m))
        h = after
        for k, t in enumerate(there):
            states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h[k]
    return states, trace


def pool(states, mask, w):
    """Attention over the states of each window and the logistic unit's input."""
    hidden = np.tanh(states @ w["att"] + w["att_b"])
    energy = np.where(mask, hidden @ w["att_v"], -1e9)
    share = np.exp(energy - energy.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    pooled = np.einsum("bl,bld->bd", share, states)
    return pooled @ w["out"] + w["out_b"][0], (hidden, share, pooled)


def gradients(model: ToxicityModel, word_ids, chars, mask, labels, cost):
    """Logits of windows and the gradients of their weighted cross entropy; ``chars``: characters of every known number."""
    w = model.weights
    b, length = word_ids.shape
    unique, ids = np.unique(word_ids, return_inverse=True)
    ids = ids.reshape(word_ids.shape)
    means = model.char_means(chars[unique])
    x = np.concatenate([w["words"][unique], means], 1)
    table = np.einsum("nd,kdg->nkg", x, w["in"]) + w["in_b"]
    trace: list = []
    states, _ = recur([table[:, 0], table[:, 1]], ids, mask, w["rec"], trace)
    logits, (hidden, share, pooled) = pool(states, mask, w)
    d_logit = (sigmoid(logits) - labels) * cost
    g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * w["out"]
    d_share = np.einsum("bd,bld->bl", d_pooled, states)
    d_energy = share * (d_share - (share * d_share).sum(1, keepdims=True))
    d_hidden = d_energy[..., None] * w["att_v"] * (1 - hidden**2)
    g["att_v"] = np.einsum("bl,bla->a", d_energy, hidden)
    g["att"], g["att_b"] = np.einsum("bld,bla->da", states, d_hidden), d_hidden.sum((0, 1))
    d_states = share[..., None] * d_pooled[:, None] + d_hidden @ w["att"].T
    d_table = np.zeros_like(table)
    g["rec"] = np.zeros_like(w["rec"])
    d_h = np.zeros((2, b, HIDDEN), np.float32)
    back = w["rec"].transpose(0, 2, 1)
    for step in range(length - 1, -1, -1):
        there = (step, length - 1 - step)
        h, z, r, inner, new, m = trace[step]
        d_h = d_h + np.stack([d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN] for k, t in enumerate(there)])
        d = d_h * m
        d_new = d * (1 - z) * (1 - new**2)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_mix = np.concatenate([d_z, d_r, d_new * r], 2)
        g["rec"] += h.transpose(0, 2, 1) @ d_mix
        d_h = np.where(m, d * z, d_h) + d_mix @ back
        d_gate = np.concatenate([d_z, d_r, d_new], 2)
        for k, t in enumerate(there):
            np.add.at(d_table[:, k], ids[:, t], d_gate[k])
    g["in"], g["in_b"] = np.einsum("nd,nkg->kdg", x, d_table), d_table.sum(0)
    d_x = np.einsum("nkg,kdg->nd", d_table, w["in"])
    g["words"] = np.zeros_like(w["words"])
    g["words"][unique] = d_x[:, :WORD_DIM]
    used = chars[unique] > 0
    part = d_x[:, WORD_DIM:] / np.maximum(used.sum(1), 1)[:, None]
    g["chars"] = np.zeros_like(w["chars"])
    np.add.at(g["chars"], chars[unique][used], np.repeat(part, used.sum(1), 0))
    return logits, g


def new_weights(words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    inputs = WORD_DIM + CHAR_DIM
    return {
        "words": normal(words + 1, WORD_DIM, scale=0.3), "chars": normal(CHARS, CHAR_DIM, scale=0.3),
        "in": normal(2, inputs, 3 * HIDDEN, scale=inputs**-0.5), "in_b": np.zeros((2, 3 * HIDDEN), np.float32),
        "rec": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "att": normal(2 * HIDDEN, ATTENTION, scale=0.3), "att_b": np.zeros(ATTENTION, np.float32),
        "att_v": normal(ATTENTION, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32),
    }


def train(
    texts: list[list[list[str]]], labels: list[int], seed: int = 7, epochs: int = 6, rate: float = 0.02, batch: int = 128,
    least_count: int = 5, most_words: int = 20_000, decay: float = 0.4,
) -> ToxicityModel:
    """Fit to texts given as windows of words.

    In the first two epochs every window has its text's label; then only the worst window of a toxic text has it, as the
    others may be clean. Until then the windows of a long toxic text weigh no more than ``FULL`` of them. Batches are smaller for few windows, so that an epoch has about 40 steps.
    """
    rng = np.random.default_rng(seed)
    counted = Counter(w for windows in texts for w in {x for window in windows for x in window})
    ranked = sorted(((n, w) for w, n in counted.items() if n >= least_count), key=lambda x: (-x[0], x[1]))[:most_words]
    vocabulary = {w: i + 1 for i, (_, w) in enumerate(ranked)}
    model = ToxicityModel(vocabulary, new_weights(len(vocabulary), rng))
    flat = [(doc, window) for doc, windows in enumerate(texts) for window in windows]
    if not flat or len(set(labels)) < 2:
        model.weights["out"][:] = 0
        model.weights["out_b"][:] = 8.0 if labels and min(labels) else -8.0
        return model
    # Numbers of words behind the vocabulary stand for unknown words, which share row 0 but keep their characters.
    others = sorted({x for _, window in flat for x in window} - vocabulary.keys())
    number = vocabulary | {w: len(vocabulary) + 1 + i for i, w in enumerate(others)}
    ordered = [""] + [w for _, w in ranked] + others
    chars = char_ids(ordered)
    owner = np.array([doc for doc, _ in flat])
    rows = [np.array([number[x] for x in window]) for _, window in flat]
    truth = np.array(labels)[owner].astype(np.float32)
    weight = np.where(truth == 1, np.minimum(1.0, FULL / np.bincount(owner)[owner]), 1.0)
    balance = float(np.clip((truth == 0).sum() / max(weight[truth == 1].sum(), 1), 1.0, 8.0))
    batch = max(8, min(batch, len(flat) // 40))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    wide = ToxicityModel(vocabulary, model.weights)
    step, steps = 0, 0
    for epoch in range(epochs):
        chosen = np.arange(len(flat))
        if epoch >= 2:
            table = model.inputs(ordered)
            got = np.zeros(len(flat))
            for at in range(0, len(flat), _WINDOWS_AT_ONCE):
                ids, mask = padded(rows[at : at + _WINDOWS_AT_ONCE])
                got[at : at + _WINDOWS_AT_ONCE] = model.score_windows(table, ids, mask)
            worst: dict[int, int] = {}
            for i in np.flatnonzero(truth == 1):
                if owner[i] not in worst or got[i] > got[worst[owner[i]]]:
                    worst[owner[i]] = i
            chosen = np.concatenate([np.flatnonzero(truth == 0), np.array(list(worst.values()), int)])
            weight = np.ones(len(flat))
            balance = 1.0 + len(np.flatnonzero(truth == 0)) / max(len(worst), 1) / 4
        chosen = rng.permutation(chosen)
        steps = epochs * (len(flat) // batch + 1)
        for at in range(0, len(chosen), batch):
            part = chosen[at : at + batch]
            ids, mask = padded([rows[i] for i in part])
            cost = np.where(truth[part] == 1, min(balance, 8.0), 1.0) * weight[part] / len(part)
            # Some known words are taken for unknown ones, so that row 0 and the characters learn as well.
            known = np.where(ids <= len(vocabulary), ids, 0)
            _, g = _masked_gradients(wide, ids, known, chars, mask, truth[part], cost.astype(np.float32))
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            scale = min(1.0, 2.0 / max(norm, 1e-9))
            pace = rate * max(0.1, 1 - step / steps)
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v * scale - m)
                s += 0.01 * ((v * scale) ** 2 - s)
                if k == "words":
                    model.weights[k] *= 1 - pace * decay
                model.weights[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def _masked_gradients(model, ids, known, chars, mask, labels, cost):
    """Gradients with words outside the vocabulary on row 0 of the word embeddings and their own characters."""
    full = model.weights["words"]
    extra = int(max(ids.max() - len(full) + 1, 0))
    lent = np.concatenate([full, np.repeat(full[:1], extra, 0)]) if extra else full
    logits, g = gradients(ToxicityModel(model.vocabulary, model.weights | {"words": lent}), ids, chars, mask, labels, cost)
    if extra:
        g["words"] = np.concatenate([g["words"][:1] + g["words"][len(full) :].sum(0, keepdims=True), g["words"][1 : len(full)]])
    return logits, g


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 2400, most_windows: int = 16_000, seed: int = 7,
) -> ToxicityModel:
    """Learn from a bounded sample: at most ``sample_rows`` labelled documents, in equal shares of both labels as far as
    there are so many, chosen by hash, with all their windows. If these are more than ``most_windows``, fewer documents are
    taken, in turn of both labels and at least one of each, but none in part: the driver's memory bounds the rows.

    Null ids and labels are left out; a document with both labels counts as toxic; of several texts under one id the
    least is taken. Without rows of both labels the model gives every text the one label it has seen, or 0. The network is
    fitted on the driver.
    """
    known = labels.select(named(id_col).alias("_id"), named(label_col).cast("int").alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).filter("_label in (0, 1)")
    chosen = bounded_sample(known, "_label", ["_id"], sample_rows).select("_id", "_label")
    found = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    @F.pandas_udf("array<string>")
    def windows(texts: pd.Series) -> pd.Series:
        split = (tokens(text) for text in texts)
        return pd.Series([[" ".join(words[s : s + WINDOW]) for s in window_starts(len(words))] for words in split], dtype=object)

    rows = staged(found.select("_id", "_label", F.xxhash64("_id").alias("_key"), windows("_text").alias("w")), "toxicity-sample")
    sizes = rows.select("_id", "_label", "_key", F.size("w").alias("n")).collect()
    kept = whole_rows(sizes, most_windows)
    if len(kept) < len(sizes):
        few = docs.sparkSession.createDataFrame([(i,) for i in kept], rows.select("_id").schema)
        rows = rows.join(F.broadcast(few), "_id", "left_semi")
    rows = sorted(rows.select("_id", "_label", "w").collect(), key=lambda r: r["_id"])
    # Equal words share one string, which keeps the sample small next to the network.
    return train([[[intern(x) for x in w.split(" ")] for w in r["w"]] for r in rows], [r["_label"] for r in rows], seed)


def whole_rows(sizes: list, most: int) -> list:
    """Ids of as many rows as have ``most`` windows together: each label's by hash, the labels in turn, one of each at least."""
    ranked: dict[int, list] = {}
    for r in sorted(sizes, key=lambda r: (r["_key"], r["_id"])):
        ranked.setdefault(r["_label"], []).append(r)
    turns = sorted(((k, label, r) for label, rs in ranked.items() for k, r in enumerate(rs)), key=lambda x: x[:2])
    out, total = [], 0
    for k, _, r in turns:
        total += r["n"]
        if k and total > most:
            break
        out.append(r["_id"])
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text, 0 to 1, in ``into`` (replacing a column of that name).

    Null texts and texts without words score 0. All overlapping windows are scored; no shuffle.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(texts)))

    kept = [named(c) for c in docs.columns if c.lower() != into.lower()]
    return docs.select(*kept, score(named(text_col)).alias(into))
