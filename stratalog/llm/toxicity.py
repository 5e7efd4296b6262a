"""Toxicity: a factorization machine over hashed terms, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .textops import LETTER, doc_of, slices, small_batches, word_bounds, word_hashes

#: Labelled documents that the model is fitted on, at most about so many.
SAMPLE = 16_000
#: Terms are hashed into 2 ** BITS buckets. A bucket that fewer sampled documents have is left out, whatever their labels.
BITS, DF_LEAST = 24, 4
#: Weight of the pair part in a document with one term; how fast weights shrink and factors decay in training.
PAIRS, SHRINK, DECAY = 8.0, 3e-4, 1e-2
PREFIXES = (4, 5, 6)


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(bucket, document) of every word and of its leading 4, 5 and 6 bytes, which catch the forms that a stem takes."""
    starts, ends = word_bounds(data, offsets, LETTER)
    hashes, places = [word_hashes(data, starts, ends)], [starts]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        hashes.append(word_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        places.append(starts[longer])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), doc_of(np.concatenate(places), offsets)


def _distinct(bucket: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct buckets, in order."""
    both = np.unique((d << BITS) + bucket)
    return both & ((1 << BITS) - 1), both >> BITS


def _sample_rows(batches):
    for batch in batches:
        labels, out = batch.column("toxic").to_pylist(), []
        for lo, hi, data, offsets in slices(batch.column("text")):
            h, d = _distinct(*_terms(data, offsets))
            cut = np.searchsorted(d, np.arange(hi - lo + 1))
            h = h.astype(np.int32)
            out += [(labels[lo + i], h[cut[i] : cut[i + 1]].tobytes()) for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["toxic", "terms"])


class _Batch:
    """Some documents' places of terms, one after the other, and their order by term, so that sums need no scatter."""

    def __init__(self, y: np.ndarray, at: list[np.ndarray]):
        self.y, self.n = y, np.array([len(x) for x in at])
        self.full = np.flatnonzero(self.n)
        self.starts = (np.cumsum(self.n) - self.n)[self.full]
        self.at = np.concatenate(at)
        self.doc = np.repeat(np.arange(len(at)), self.n)
        self.order = np.argsort(self.at, kind="stable")
        by = self.at[self.order]
        self.cut = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)
        self.terms = by[self.cut]

    def by_doc(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), *x.shape[1:]), x.dtype)
        if len(self.full):
            out[self.full] = np.add.reduceat(x, self.starts, axis=0)
        return out

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.cut, axis=0) if len(self.cut) else x[:0]


def train(sample, factors: int = 4, least_steps: int = 600, epochs: int = 4, batch: int = 128, seed: int = 4) -> dict:
    """Fit bias, weights w and factors v of a factorization machine on the terms that a document has: score = sigmoid(bias +
    sum of w_i + sum of v_i.v_j over pairs * PAIRS / n), n being the number of its terms, so that long documents do not drown
    in pairs. Proximal Adagrad: a weight shrinks towards zero and stays there unless it keeps telling something; factors
    decay. The factors begin to learn after a third of the steps, on what the weights alone leave unexplained.
    sample: label and distinct buckets of each document, which are let go as they are taken."""
    sample = list(sample)
    y = np.array([x[0] for x in sample], np.float32)
    n, pos = len(sample), float(y.sum())
    df = np.zeros(1 << BITS, np.uint16)
    for _, t in sample:  # a document's buckets are distinct
        df[t] = np.minimum(df[t], DF_LEAST - 1) + 1
    terms = np.flatnonzero(df >= DF_LEAST).astype(np.int32)
    for i in range(n):  # places take the room of buckets
        t = sample[i][1]
        sample[i] = np.searchsorted(terms, t[df[t] >= DF_LEAST]).astype(np.int32)
    del df
    rng = np.random.default_rng(seed)
    b = np.float32(np.log((pos + 0.5) / (n - pos + 0.5)))
    w, v = np.zeros(len(terms), np.float32), rng.normal(0, 0.1, (len(terms), factors)).astype(np.float32)
    gw, gv, gb = np.full(len(terms), 1e-3, np.float32), np.full(v.shape, 1e-4, np.float32), 1e-2
    batches = np.array_split(rng.permutation(n), max(1, n // batch)) if len(terms) and 0 < pos < n else []
    steps = max(least_steps, epochs * len(batches)) if batches else 0
    for k in range(steps):
        if k % len(batches) == 0:
            turn = rng.permutation(len(batches))
        own = batches[turn[k % len(batches)]]
        x = _Batch(y[own], [sample[i] for i in own])
        rate, pairs = 1 - k / steps, k >= steps // 3
        z = b + x.by_doc(w[x.at])
        if pairs:
            vt = v[x.at]
            total = x.by_doc(vt)
            scale = (PAIRS / np.maximum(x.n, 1)).astype(np.float32)
            z += 0.5 * scale * ((total**2).sum(1) - x.by_doc((vt**2).sum(1)))
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - x.y) / len(x.y)).astype(np.float32)
        t = x.terms
        dw = x.by_term(err[x.doc])
        gw[t] += dw**2
        step = 0.3 * rate / np.sqrt(gw[t])
        now = w[t] - step * dw
        w[t] = np.sign(now) * np.maximum(np.abs(now) - step * SHRINK, 0)
        if pairs:
            dv = x.by_term((err * scale)[x.doc][:, None] * (total[x.doc] - vt)) + DECAY * v[t]
            gv[t] += dv**2
            v[t] -= 0.1 * rate / np.sqrt(gv[t]) * dv
        gb += err.sum() ** 2
        b -= 0.1 * rate * err.sum() / np.sqrt(gb)
    return {"terms": terms.astype(np.int64), "w": w.astype(np.float64), "v": v.astype(np.float64), "bias": float(b)}


def fit(labelled: DataFrame, sample: int = SAMPLE, **how) -> dict:
    """Train on about `sample` rows (doc_id, text, toxic) at most, chosen by hash; their buckets are made on the executors."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    total = rows.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.where(chance < min(1.0, sample / max(total, 1)))
    rows = materialize(chosen.select("text", "toxic").mapInArrow(_sample_rows, "toxic int, terms binary"), "toxic-sample")
    # a part at a time, so that the driver's JVM never holds the sample
    got = sorted((r.toxic, bytes(r.terms)) for r in rows.toLocalIterator())
    release(rows)
    got.reverse()
    return train(((label, np.frombuffer(raw, np.int32)) for label, raw in iter(lambda: got.pop() if got else None, None)), **how)


def _scorer(model: dict, keep: list[str]):
    terms, w, v, bias = model["terms"], model["w"], model["v"], model["bias"]
    square = (v**2).sum(1)
    maybe = np.zeros(1 << BITS >> 3, bool)
    maybe[terms >> 3] = True

    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column("text")):
                h, d = _terms(data, offsets)
                z = np.full(hi - lo, bias)
                at = np.flatnonzero(maybe[h >> 3]) if len(terms) else np.zeros(0, np.int64)
                h, d = _distinct(h[at], d[at])
                place = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                real = terms[place] == h if len(h) else np.zeros(0, bool)
                if real.any():
                    rows, cols = d[real], place[real]
                    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    total, scale = np.add.reduceat(v[cols], first, axis=0), PAIRS / np.diff(np.r_[first, len(rows)])
                    twice = (total**2).sum(1) - np.add.reduceat(square[cols], first)
                    z[rows[first]] += np.add.reduceat(w[cols], first) + 0.5 * scale * twice
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep, score, predicted for every row of docs, from the whole text. A null or empty text has no terms and gets the
    model's bias; a model without labels of both kinds scores by their share; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, *[] if "text" in keep else ["text"]).mapInArrow(_scorer(model, keep), f"{shape}, score double, predicted int")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the labelled documents that are not held out; of a document with several labels, the highest counts."""
    marks = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    return fit(docs.select("doc_id", "text").where(~held_out()).join(marks, "doc_id"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with their columns, that the model does not predict as toxic."""
    names = [f"_c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]  # so that no column clashes with ours
    return score_toxicity(docs.toDF(*names), model, names).where("predicted = 0").select(*names).toDF(*docs.columns)
