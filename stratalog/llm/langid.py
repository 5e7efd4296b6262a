"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection. Trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LETTER, LOWER, doc_of, slices, small_batches

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Labelled rows that the classifier is fitted on, about so many for each language.
SAMPLE_PER_LANG = 1000
REJECT_BELOW = 0.5
UNKNOWN = "und"
_LETTER_RE = regex.compile(r"\p{L}")
_FOLD = np.where(LETTER, LOWER, 32).astype(np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray):
    """(bucket, start) of the 2-, 3- and 4-byte subwords of lower-cased texts, anything but letters being a space."""
    b = _FOLD[data]
    owner = np.zeros(len(data) + 1, np.int32)
    np.add.at(owner, offsets[1:-1], 1)
    owner = np.cumsum(owner[:-1], dtype=np.int32)
    code = b
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        # within one text, and not two spaces in a row at its front
        ok = (owner[n - 1 :] == owner[: len(data) - n + 1]) & ((code >> np.uint32(8 * (n - 2))) != 0x2020)
        at = np.flatnonzero(ok)
        yield ((code[at] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(16)).astype(np.int64), at


def _features(batches):
    for batch in batches:
        langs, out = batch.column("lang"), []
        for lo, hi, data, offsets in slices(batch.column("text")):
            got = list(subwords(data, offsets))
            ids = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            docs = doc_of(np.concatenate([g[1] for g in got]), offsets) if got else np.zeros(0, np.int64)
            keys, counts = np.unique(docs * BUCKETS + ids, return_counts=True)
            cut = np.searchsorted(keys, np.arange(hi - lo + 1) * BUCKETS)
            for i in range(hi - lo):
                part = slice(cut[i], cut[i + 1])
                out.append((langs[lo + i].as_py(), (keys[part] % BUCKETS).astype(np.uint16).tobytes(), counts[part].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["lang", "ids", "counts"])


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, least_steps: int = 500, batch: int = 32, rate: float = 40.0, seed: int = 3) -> dict:
    """Stochastic gradient descent on embeddings and softmax; a fifth of the sample sets the temperature.

    Returns langs, table (each bucket's contribution to each language's logit: embedding times softmax weights) and bias."""
    rng = np.random.default_rng(seed)
    langs = sorted({x[0] for x in sample})
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32)}
    y = np.array([langs.index(x[0]) for x in sample])
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weights += rng.normal(0, 0.3, weights.shape).astype(np.float32)
    order = rng.permutation(len(sample))
    held, rest = order[: len(order) // 5], order[len(order) // 5 :]

    shares = [x[2] / max(1.0, x[2].sum()) for x in sample]

    def softmax(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def mean(rows):
        return np.stack([shares[r] @ embed[sample[r][1]] for r in rows]).astype(np.float32)

    steps = max(least_steps, epochs * len(rest) // batch)
    for k in range(steps):
        step = rate * (1 - k / steps)
        rows = rest[rng.integers(0, len(rest), min(batch, len(rest)))]
        h = mean(rows)
        g = softmax(h @ weights + bias)
        g[np.arange(len(rows)), y[rows]] -= 1
        g /= len(rows)
        back = g @ weights.T
        weights -= 0.05 * step * (h.T @ g)
        bias -= 0.005 * step * g.sum(0)
        for r, move in zip(rows, step * back, strict=True):  # a row's ids are distinct
            embed[sample[r][1]] -= np.outer(shares[r], move)
    table = embed @ weights
    if len(held):
        z = mean(held) @ weights + bias
        loss = lambda t: -np.log(np.maximum(softmax(z * t)[np.arange(len(held)), y[held]], 1e-9)).mean()
        best = min(np.geomspace(0.25, 16, 25), key=loss)
        table, bias = table * best, bias * best
    return {"langs": langs, "table": table.astype(np.float32), "bias": bias.astype(np.float32)}


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, **how) -> dict:
    """Train on about per_lang rows (text, lang) of each language, chosen by hash; the features are made on the executors."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    keep = F.lit(0.0)
    for name, n in counts.items():
        keep = F.when(F.col("lang") == name, min(1.0, per_lang / n)).otherwise(keep)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.where(chance < keep).select("text", "lang").mapInArrow(_features, "lang string, ids binary, counts binary")
    sample = [(r.lang, np.frombuffer(r.ids, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.float32)) for r in chosen.limit(2 * per_lang * max(1, len(counts))).collect()]
    return train(sorted(sample, key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes())), **how)


def _predictor(model: dict, keep: list[str]):
    langs, table, bias = model["langs"], model["table"], model["bias"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            known = np.zeros(len(texts), bool)
            for lo, hi, data, offsets in slices(texts):
                z, n = np.zeros((hi - lo, len(langs))), np.zeros(hi - lo)
                for ids, at in subwords(data, offsets):
                    cut = np.searchsorted(at, offsets)
                    full = np.flatnonzero(cut[1:] > cut[:-1])
                    if len(full):
                        z[full] += np.add.reduceat(table[ids], cut[full], axis=0)
                        n[full] += cut[full + 1] - cut[full]
                z = z / np.maximum(n, 1)[:, None] + bias
                if langs:
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[lo:hi], score[lo:hi] = p.argmax(1), p.max(1)
                for i in range(lo, hi):
                    known[i] = bool(langs) and _LETTER_RE.search(texts[i].as_py() or "") is not None
            named = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            extra = [pa.array(named, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *extra], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep, lang_pred, score for every row of docs: the likeliest language of the whole text and its calibrated probability.

    A text that is null, empty or without a letter is `und` with score 0, as is everything if the model has learned no
    language. Ties go to the language first in order; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, *[] if "text" in keep else ["text"]).mapInArrow(_predictor(model, keep), f"{shape}, lang_pred string, score double")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, model: dict, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, with their columns, whose language is told with calibrated probability reject_below at least."""
    names = [f"_c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]  # so that no column clashes with ours
    told = identify(docs.toDF(*names), model, names)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= reject_below)).select(*names).toDF(*docs.columns)
