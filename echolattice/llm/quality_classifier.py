"""Quality classifier by co-training.

Two views of a document: its text (shares of kinds of characters, repeated words and lines, lengths of words) and its page's
metadata (language, source, number of characters). A logistic classifier of each view is fitted on a bounded sample of
labelled documents. In each round both score all other documents, and what one view is confident of, at its calibrated
probability, becomes a pseudo-label for the other. In the end each view is calibrated on labels that no classifier was
fitted on, and the calibrated log-odds are added up, with the prior counted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, ship, small, text_slices

#: Labelled documents to fit on at most; of them one in HELD_OUT calibrates.
LABELLED, HELD_OUT = 20_000, 4
ROUNDS, CONFIDENT, PSEUDO = 3, 0.95, 500
#: Least probability of good quality to be kept: what is rejected is bad with nine chances in ten.
KEEP = 0.1
LANGS, SOURCES = 16, 64

_TEXT = ("upper", "symbols", "shouts", "digits", "stops", "spaces", "other", "breaks", "distinct", "runs", "word_chars", "words", "again", "bars")


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_KINDS = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"#*$%&<>"),
        _class(b"!"),
        _class(bytes(range(48, 58))),
        _class(b".,;:?"),
        _class(b" \t\r\x0b\x0c"),
        _class(bytes(range(128, 256))),
        _class(b"\n"),
        _class(b"|"),
    ]
).astype(np.float64)


def text_view(text: str, data: np.ndarray) -> list[float]:
    """Features of a whole text, whose bytes are data."""
    n = max(len(data), 1)
    upper, symbols, shouts, digits, stops, spaces, other, breaks, bars = (_KINDS @ np.bincount(data, minlength=256) / n).tolist()
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    alike = sum(map(str.__eq__, words, words[1:]))
    return [upper, symbols, shouts, digits, stops, spaces, other, breaks, len(set(words)) / k, alike / k, min(n / k, 50) / 10, float(np.log1p(len(words))) / 10, 1 - len(set(lines)) / len(lines), bars]


def _views(batches):
    for b in batches:
        text, rows = b.column(0).fill_null(""), []
        for i, off, data in text_slices(text):
            whole = text.slice(i, len(off) - 1).to_pylist()
            rows += [text_view(t, data[x:y]) for t, x, y in zip(whole, off[:-1].tolist(), off[1:].tolist(), strict=True)]
        cols = np.array(rows, np.float64).reshape(-1, len(_TEXT)).T
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c) for c in cols)], names=[*b.schema.names[1:], *(f"t_{x}" for x in _TEXT)])


def views(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (64 bits of the text) and the columns of both views, from one pass over the texts."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    meta = [
        F.coalesce(F.pmod(F.xxhash64("lang"), F.lit(LANGS)).cast("int"), F.lit(0)).alias("m_lang"),
        F.coalesce(F.pmod(F.xxhash64("source"), F.lit(SOURCES)).cast("int"), F.lit(0)).alias("m_source"),
        (F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double")) / 10).alias("m_chars"),
    ]
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), *meta)
    schema = "doc_id long, text_key long, m_lang int, m_source int, m_chars double, " + ", ".join(f"t_{x} double" for x in _TEXT)
    return rows.mapInArrow(_views, schema)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant of a logistic classifier, by Newton's method with a ridge on the weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = weight * np.maximum(p * (1 - p), 1e-6)
        step = _solve((x * slope[:, None]).T @ x + np.diag(pen), x.T @ (weight * (y - p)) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky's method, for a small matrix; in this thread."""
    n = len(a)
    low = np.zeros_like(a)
    for i in range(n):
        d = a[i, i] - low[i, :i] @ low[i, :i]
        low[i, i] = np.sqrt(max(d, 1e-12))
        low[i + 1 :, i] = (a[i + 1 :, i] - low[i + 1 :, :i] @ low[i, :i]) / low[i, i]
    y = np.zeros(n)
    for i in range(n):
        y[i] = (b[i] - low[i, :i] @ y[:i]) / low[i, i]
    for i in reversed(range(n)):
        y[i] = (y[i] - low[i + 1 :, i] @ y[i + 1 :]) / low[i, i]
    return y


class View:
    """A view's matrix and classifier: x -> log-odds, then calibrated log-odds."""

    def __init__(self, names: list[str], spread: dict[str, int]):
        self.names, self.spread = names, spread  # spread: columns that stand for so many 0/1 features
        self.weights, self.scale = None, (1.0, 0.0)

    def matrix(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        parts = [np.eye(self.spread[n])[rows[n].astype(int)] if n in self.spread else rows[n][:, None] for n in self.names]
        return np.concatenate(parts, 1).astype(np.float64)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        mean, dev = x.mean(axis=0), x.std(axis=0)
        for at, n in self._places():
            if n in self.spread:
                mean[at], dev[at] = 0, 1
        dev[dev < 1e-9] = 1
        w = fit((x - mean) / dev, y, weight)
        self.weights = np.concatenate([w[:-1] / dev, [w[-1] - (w[:-1] * mean / dev).sum()]])

    def _places(self):
        at = 0
        for n in self.names:
            k = self.spread.get(n, 1)
            yield slice(at, at + k), n
            at += k

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and constant of the log-odds on labels that weren't fitted on; a slope below 0 counts as no information."""
        z = x @ self.weights[:-1] + self.weights[-1]
        a, b = fit(np.clip(z, -30, 30)[:, None], y, np.ones(len(y)), ridge=1e-3)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.scale = (float(a), float(b)) if a > 0 else (0.0, float(np.log(p / (1 - p))))

    def odds(self) -> Column:
        """Calibrated log-odds as a column expression over the table of views."""
        total = F.lit(float(self.weights[-1]))
        for at, n in self._places():
            w = self.weights[at].tolist()
            total = total + (F.element_at(F.array(*map(F.lit, w)), F.col(n) + 1) if n in self.spread else F.col(n) * F.lit(w[0]))
        a, b = self.scale
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total)) * F.lit(a) + F.lit(b)


def _columns(rows: list, names: list[str]) -> dict[str, np.ndarray]:
    return {n: np.array([r[n] for r in rows]) for n in names}


def co_train(table: DataFrame, labels: DataFrame, scratch: Scratch, labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, pseudo: int = PSEUDO) -> tuple[View, View, float] | None:
    """Both trained and calibrated views, and the prior log-odds; None if the labels lack one of the classes.

    table: the views of all documents, materialised. Of the labelled rows about `labelled` at most, by their hash, are fitted
    on, the same ones whatever the partitions; of those whose text has no label the `pseudo` that a view is surest of, for each class, become its pseudo-labels of a round, copies
    counted once. The driver gets those rows and no others.
    """
    text, meta = View([f"t_{x}" for x in _TEXT], {}), View(["m_lang", "m_source", "m_chars"], {"m_lang": LANGS, "m_source": SOURCES})
    names = [*text.names, *meta.names]
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    given = given.groupBy("doc_id").agg(F.min("y").alias("y"))
    given = scratch.write(given)
    part = min(1.0, 0.97 * labelled / max(1, given.count()))
    drawn = given.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(part * (1 << 30)))
    own = scratch.write(table.join(small(given), "doc_id").select("doc_id", "text_key"))
    sample = table.join(small(drawn), "doc_id").select("doc_id", "text_key", "y", *names).orderBy(F.xxhash64("doc_id", "text_key"), *names).limit(labelled).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text_key"]))
    x, y = _columns(sample, names), np.array([r["y"] for r in sample], float)
    if len(set(y.tolist())) < 2 or len(y) < 2 * HELD_OUT:
        return None
    held = np.array([r["text_key"] % HELD_OUT == 0 for r in sample])  # copies are on one side
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    fitted = np.flatnonzero(~held)
    check = np.flatnonzero(held) if held.any() else fitted
    tx, mx = text.matrix(x), meta.matrix(x)
    # Copies of a labelled text under other ids aren't pseudo-labelled: some calibrate.
    pool = table.join(small(given), "doc_id", "left_anti").join(small(own.select("text_key").distinct()), "text_key", "left_anti")
    extra: dict[str, list] = {"text": [], "meta": []}  # rows that the other view is sure of
    for turn in range(rounds + 1):
        for name, view, mat in (("text", text, tx), ("meta", meta, mx)):
            got = {r["text_key"]: r for r in extra[name]}.values()
            more = view.matrix(_columns(list(got), names)) if got else mat[:0]
            view.train(np.concatenate([mat[fitted], more]), np.concatenate([y[fitted], [r["y"] for r in got]]), np.concatenate([np.ones(len(fitted)), np.full(len(got), 0.5)]))
            view.calibrate(mat[check], y[check])
        if turn == rounds:
            break
        sure = float(np.log(confident / (1 - confident)))
        for view, other in ((text, "meta"), (meta, "text")):
            scored = pool.select("text_key", view.odds().alias("z")).distinct()
            good = scored.where(F.col("z") >= sure).orderBy(F.desc("z"), "text_key").limit(pseudo).select("text_key", F.lit(1.0).alias("y"))
            bad = scored.where(F.col("z") <= -sure).orderBy("z", "text_key").limit(pseudo).select("text_key", F.lit(0.0).alias("y"))
            keys = F.broadcast(scratch.write(good.unionByName(bad)))  # 2 * pseudo rows at most
            rows = pool.join(keys, "text_key").groupBy("text_key").agg(F.min(F.struct("y", "doc_id", *names)).alias("r")).select("text_key", "r.*").collect()
            extra[other] += [r.asDict() for r in sorted(rows, key=lambda r: r["text_key"])]
    p = np.clip(y[check].mean(), 1e-3, 1 - 1e-3)
    return text, meta, float(np.log(p / (1 - p)))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep: float = KEEP) -> DataFrame:
    """doc_id, text_key, text_score, meta_score, score (probabilities of good quality) and kept for every row of docs.

    docs(doc_id, text, lang, source, n_chars), labels(doc_id, quality 0 or 1). Null texts are scored as empty ones, null
    metadata as a bucket and length 0; rows that repeat a doc_id are scored one by one. Labels that are null, neither 0 nor 1
    or without document count for nothing; a doc_id labelled both ways is bad. Without both classes among the labels nothing
    can be told apart: all scores are null and all documents are kept. Other columns are ignored.
    """
    table = scratch.write(views(docs))
    models = co_train(table, labels, scratch)
    if models is None:
        none = F.lit(None).cast("double")
        return table.select("doc_id", "text_key", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    text, meta, prior = models
    logistic = lambda z: 1 / (1 + F.exp(-z))
    scored = table.select("doc_id", "text_key", text.odds().alias("t"), meta.odds().alias("m"))
    score = logistic(F.col("t") + F.col("m") - F.lit(prior))
    return scored.select("doc_id", "text_key", logistic(F.col("t")).alias("text_score"), logistic(F.col("m")).alias("meta_score"), score.alias("score"), (score >= keep).alias("kept"))


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict for all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, Scratch(spark, "quality")).select("doc_id", "text_score", "meta_score", "score", "kept")
