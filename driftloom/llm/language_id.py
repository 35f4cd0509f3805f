"""Language identification by a convolutional network over bytes.

Filters of several widths run over embedded bytes, each window keeps its largest response to every filter, and a softmax
layer turns these into probabilities. The network is trained in numpy on a bounded sample of labelled windows and applied
to all fixed-length windows of a text, whose probabilities are averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import documents, stored

WINDOW = 256
WIDTHS = (2, 3, 4)
REACH = max(WIDTHS)
DIM, FILTERS = 8, 16
UNKNOWN = "und"
#: Windows that go through the network at once.
BLOCK = 256


@dataclass
class ByteNetwork:
    """Weights: ``embed`` (256, DIM), ``conv`` (REACH * DIM, filters), ``bias``, ``out`` (filters, languages), ``shift``."""

    languages: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def patches(self, data: np.ndarray) -> np.ndarray:
        """Embedded bytes of each position and its followers; rows of ``data`` hold WINDOW + REACH - 1 bytes."""
        embedded = self.embed[data].reshape(len(data), -1)
        view = np.lib.stride_tricks.sliding_window_view(embedded, REACH * DIM, axis=1)[:, ::DIM]
        return view.reshape(len(data), WINDOW, REACH * DIM)

    def responses(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response to each filter in each window and where it is."""
        z = (self.patches(data).reshape(-1, REACH * DIM) @ self.conv).reshape(len(data), WINDOW, -1)
        at = z.argmax(axis=1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, 0), at

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        outs = []
        for k in range(0, len(data), BLOCK):
            part = data[k : k + BLOCK]
            z = (self.patches(part).reshape(-1, REACH * DIM) @ self.conv).reshape(len(part), WINDOW, -1).max(axis=1)
            outs.append(_softmax(np.maximum(z + self.bias, 0) @ self.out + self.shift))
        return np.concatenate(outs) if outs else np.empty((0, len(self.languages)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text in lower case, (n, WINDOW + REACH - 1) bytes, and how many bytes of the text each holds."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + REACH - 1, dtype=np.uint8)
    padded[: len(data)] = data
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + REACH - 1)[::WINDOW]
    return view, np.minimum(WINDOW, len(data) - WINDOW * np.arange(n)).clip(min=1)


def train(texts: list[str], labels: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Fit the network to one window of each text by Adam on the cross entropy; languages count alike, whatever their rows."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    data = np.stack([windows(t)[0][0] for t in texts])
    rng = np.random.default_rng(seed)
    count = FILTERS * len(WIDTHS)
    mask = np.zeros((REACH * DIM, count), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    net = ByteNetwork(
        languages,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.3, (REACH * DIM, count)) * mask).astype(np.float32),
        np.zeros(count, dtype=np.float32),
        rng.normal(0, 0.2, (count, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    names = ["embed", "conv", "bias", "out", "shift"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)).clip(min=1))).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            part, at_rows = data[rows], np.arange(len(rows))
            pooled, at = net.responses(part)
            p = _softmax(pooled @ net.out + net.shift)
            p[at_rows, y[rows]] -= 1
            p *= weight[y[rows], None] / len(rows)
            back = (p @ net.out.T) * (pooled > 0)
            places = at[:, :, None] + np.arange(REACH)
            seen = part[at_rows[:, None, None], places]
            grad = {
                "out": pooled.T @ p,
                "shift": p.sum(axis=0),
                "bias": back.sum(axis=0),
                "conv": np.einsum("rfd,rf->df", net.embed[seen].reshape(len(rows), count, -1), back) * mask,
                "embed": np.zeros_like(net.embed),
            }
            spread = (back[:, :, None] * net.conv.T).reshape(-1, DIM)
            for d in range(DIM):
                grad["embed"][:, d] = np.bincount(seen.ravel(), weights=spread[:, d], minlength=256)
            step += 1
            now = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                move = now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def labelled_sample(df: DataFrame, per_language: int, text_col: str, label_col: str, most_rows: int = 204_800) -> pd.DataFrame:
    """Labelled documents of every language, three windows of each: at most ``per_language`` a language and about ``most_rows`` in all.

    With more languages than ``most_rows / per_language`` each gets an equal share of ``most_rows``, but never less than one document, so
    that no language is lost. Documents are those of the smallest hashes of their text, distinct texts only, so the sample is bounded whatever ids are
    shared or texts repeated. Windows start at hashed places; one is full, one short and one very short, as texts may be.
    """
    rows = df.where(F.col(text_col).rlike(r"\p{L}") & F.col(label_col).isNotNull())
    rows = rows.select(F.xxhash64(text_col, F.lit("sample")).alias("hash"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    # Written, as one row a language, so that their number costs no pass of its own.
    sizes = stored(rows.groupBy("label").agg(F.approx_count_distinct("hash", 0.02).alias("n")), "languages")
    per_language = max(1, min(per_language, most_rows // max(1, sizes.count())))
    # By its chance about twice the documents wanted pass, with room for few; the exact bound is set on them.
    chance = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n")) * (1 << 20)
    rows = rows.join(sizes, "label").where(F.pmod("hash", F.lit(1 << 20)) < chance).drop("n")
    length = F.element_at(F.array(F.lit(WINDOW), F.lit(60), F.lit(20)), F.col("k") + 1)
    rows = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = F.pmod(F.xxhash64("hash", "k"), F.greatest(F.lit(1), F.length("text") - length + 1)) + 1
    found = rows.select("hash", "k", "label", F.substring("text", start.cast("int"), length).alias("text")).distinct()
    order = Window.partitionBy("label", "k").orderBy(F.pmod("hash", F.lit(1 << 20)), "hash", "text")
    found = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language).drop("at")
    return found.toPandas().sort_values(["label", "hash", "k", "text"], ignore_index=True)


def identify(df: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``carry`` columns, lang_pred, score (mean probability, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything without a network. All windows
    of a text count. Null ids and repeated rows are rows like any other; columns that are not carried are left out.
    """
    names = [f"c{k}" for k in range(len(carry))]
    kept = [F.col(c).alias(n) for c, n in zip(carry, names, strict=True)]
    back = [F.col("id").alias(id_col), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)), "lang_pred", "score"]
    # Texts without a letter need no look by the network.
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    base = df.select(F.col(id_col).alias("id"), *kept, F.when(letters, F.col(text_col)).alias("text"))
    if network is None:
        return base.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0)).select(*back)
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for pdf in batches:
            guess, score = np.full(len(pdf), UNKNOWN, dtype=object), np.zeros(len(pdf))
            held, rows = [], []
            for i, text in enumerate(pdf["text"]):
                if text is not None:
                    held.append(windows(text))
                    rows.append(i)
                if held and (sum(len(d) for d, _ in held) >= BLOCK or i == len(pdf) - 1):
                    _score(net, held, rows, guess, score)
                    held, rows = [], []
            if held:
                _score(net, held, rows, guess, score)
            yield pdf.drop(columns="text").assign(lang_pred=guess, score=score)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    return base.mapInPandas(run, f"{shape}, lang_pred string, score double").select(*back)


def _score(net: ByteNetwork, held: list, rows: list[int], guess: np.ndarray, score: np.ndarray) -> None:
    data, sizes = np.concatenate([d for d, _ in held]), np.concatenate([n for _, n in held])
    p = net.probabilities(data).astype(np.float64) * sizes[:, None]
    begins = np.cumsum([0, *(len(d) for d, _ in held[:-1])])
    mean = np.add.reduceat(p, begins, axis=0) / np.add.reduceat(sizes, begins)[:, None]
    best = mean.argmax(axis=1)
    guess[rows] = np.array(net.languages, dtype=object)[best]
    score[rows] = mean[np.arange(len(rows)), best].clip(0, 1)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fitted(df: DataFrame, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteNetwork | None:
    """A network trained on a bounded sample of the labelled rows that are not held out; None without such rows."""
    sample = labelled_sample(df.where(~held_out(id_col)), per_language, text_col, label_col)
    return train(sample["text"].tolist(), sample["label"].tolist()) if len(sample) else None


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fitted(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
