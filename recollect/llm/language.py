"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the bag of its words' character n-grams (with word edges), hashed to ``BUCKETS`` rows of an embedding table;
the average row goes through a linear softmax. Training runs on the driver over a bounded, deterministic sample of
labelled rows: at most ``per_language`` texts of each language, as counts made by the executors. The embedding and the
linear layer are then one table of bucket by language, which is what tasks receive; its size is bounded by parameters.

Probabilities are calibrated by a temperature, fitted on a fifth of the sample that training doesn't see. A text is
rejected if it has no letter, or if its calibrated probability falls below what all but ``reject`` of the held-back
texts reach, and below 0.4.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; a null lang is no label;
without any labelled row every text is ``und``; ties go to the language first in order; equal rows are predicted alike;
an empty table gives an empty result. Language, source and id of a text never enter its prediction.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recollect.llm.frames import arrow_filter, arrow_map, doc_bytes
from recollect.llm.hashing import mix

BUCKETS = 1 << 14
#: Parts in which the texts of a language are ranked for the sample.
PARTS = 8
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 16
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bag(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a text by bucket, and how many there are. No letters: no n-grams."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    small = points < 128
    letter = (points >= 97) & (points <= 122)
    if not small.all():
        other = np.unique(points[~small])
        letters = other[[chr(c).isalpha() for c in other.tolist()]]
        letter |= np.isin(points, letters)
    if not letter.any():
        return np.zeros(BUCKETS, dtype=np.int64), 0
    # every run of other characters becomes one blank, which stands for the edges of words
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.where(letter, points, 32)[keep]
    line = np.concatenate(([32], line, [32] if line[-1] != 32 else [])).astype(np.uint64)
    blank = line == 32
    counts, total = np.zeros(BUCKETS, dtype=np.int64), 0
    rolled = np.zeros(len(line), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(line) - order + 1
        if n <= 0:
            break
        rolled = rolled[:n] * np.uint64(0x100000001B3) + line[order - 1:]
        inner = ~blank[:n] if order == 1 else np.ones(n, dtype=bool)
        if order > 2:
            for k in range(1, order - 1):  # blanks stand at the ends only
                inner &= ~blank[k:n + k]
        if order in ORDERS:
            found = mix(rolled[inner] + np.uint64(order)) >> np.uint64(64 - 14)
            counts += np.bincount(found.astype(np.int64), minlength=BUCKETS)
            total += int(inner.sum())
    return counts, total


@dataclass
class Model:
    """Scores of each bucket for each language, the temperature of the softmax, and the least probability accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts, total = bag(text or "")
        if not total or not self.languages:
            return UNKNOWN, 0.0, True
        used = np.flatnonzero(counts)
        logits = ((counts[used] / total) @ self.table[used] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def sample(labelled: DataFrame, per_language: int) -> list:
    """At most ``per_language`` labelled rows of each language, by a hash of the text: (lang, buckets, counts, total).

    A language's texts are first ranked in ``PARTS`` parts, so that no task ranks more than ``PARTS`` * ``per_language`` of those left.
    """
    keys = labelled.select("lang", F.xxhash64("data").alias("_order"), F.sha2("data", 256).alias("_text")).distinct()
    for by in (["lang", F.pmod(F.xxhash64("_text"), F.lit(PARTS))], ["lang"]):
        keys = keys.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_order", "_text"))).where(F.col("_rank") <= per_language)
    keys = keys.select("lang", "_text")
    chosen = labelled.withColumn("_text", F.sha2("data", 256)).join(F.broadcast(keys), ["lang", "_text"], "left_semi")

    def step(batch: pa.RecordBatch) -> dict:
        out = {"lang": [], "order": [], "buckets": [], "counts": [], "total": []}
        for lang, key, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "_text", "data"))):
            counts, total = bag((data or b"").decode("utf-8", "replace"))
            used = np.flatnonzero(counts)
            for name, value in zip(out, (lang, key, used.tolist(), counts[used].tolist(), total)):
                out[name].append(value)
        return out

    bags = arrow_map(chosen.select("lang", "_text", "data"), step, "lang string, order string, buckets array<int>, counts array<bigint>, total bigint")
    return bags.where("total > 0").dropDuplicates(["lang", "order"]).sort("order", "lang").collect()


def train(labelled: DataFrame, per_language: int = 400, epochs: int = 12, rate: float = 0.5, reject: float = 0.001, seed: int = 1) -> Model:
    """A model from (lang, data) rows; the sample has at most ``per_language`` rows of each language."""
    rows = sample(labelled, per_language)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    linear, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    data = [(languages.index(r["lang"]), np.array(r["buckets"]), np.array(r["counts"]) / r["total"]) for r in rows]
    back = [i for i in range(len(data)) if i % 5 == 4] or list(range(len(data)))
    front = [i for i in range(len(data)) if i % 5 != 4] or back
    steps, done = epochs * len(front), 0
    for _ in range(epochs):
        for i in rng.permutation(front).tolist():
            y, at, share = data[i]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[at]
            logits = hidden @ linear + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back_to = linear @ p
            linear -= step * np.outer(hidden, p) * DIMENSIONS
            bias -= 0.01 * step * p
            embed[at] -= step * DIMENSIONS * np.outer(share, back_to)
    table = embed @ linear
    scores = np.array([data[i][2] @ table[data[i][1]] + bias for i in back])
    truth = np.array([data[i][0] for i in back])
    temperature = min(np.geomspace(0.02, 20, 60), key=lambda t: _loss(scores / t, truth))
    best = np.sort(_softmax(scores / temperature).max(axis=1))
    return Model(languages, table.astype(np.float32), bias, float(temperature), float(min(0.4, best[int(reject * len(best))])))


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(_softmax(logits)[np.arange(len(truth)), truth] + 1e-12).mean())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
        lang, score, rejected = zip(*found)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": lang, "score": score, "rejected": rejected}

    data = doc_bytes(docs, id_col, text_col, held_out(id_col).alias("held_out"))
    return arrow_map(data, step, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from the documents that carry a language and aren't held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    return train(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("data")), **options)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is accepted; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, text_col, lambda text: not shared.value.predict(text)[2])
