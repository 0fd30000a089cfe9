"""Operator 3: quality classifier by attention-based multiple-instance learning.

A text is a bag of passages (``PASSAGE`` words each, the whole text covered). Every passage is encoded
from features of its characters and words; gated attention weights the encoded passages; the weighted sum
is scored. Only labels of whole documents are needed. The model is fitted on a bounded sample of labelled rows
(``SAMPLE`` documents by hash of doc_id, of each at most ``SAMPLE_PASSAGES`` passages); scoring reads every passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import text_chunks
from shopflow.llm.shingles import _powers, _tables, mix

PASSAGE = 64
SAMPLE = 6000
SAMPLE_PASSAGES = 16
THRESHOLD = 0.3
CLASSES = 14
FEATURES = CLASSES + 8
_CLASS: list = []


def _class_table() -> np.ndarray:
    """Character class of each byte."""
    if not _CLASS:
        t = np.full(256, 13, np.uint8)          # other ASCII
        t[128:] = 0                             # bytes of letters beyond ASCII, mostly
        for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".?", b",;:", b"!",
                                   b"|", b"$%&*#", b"'\"()-", b"<>{}[]/\\=_@+", bytes(range(9)))):
            t[list(chars)] = k
        _CLASS.append(t)
    return _CLASS[0]


def passage_features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages per text); a text without words has one empty passage."""
    buf = np.frombuffer(b" ".join(x or b"" for x in texts) + b" ", np.uint8)
    tables = _tables()
    power, inverse = _powers(len(buf))
    word = np.empty(len(buf) + 1, np.int8)
    word[0], word[1:] = 0, ~tables["sep"][buf]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.cumsum([0] + [len(x or b"") + 1 for x in texts])
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    first_passage = np.concatenate([[0], np.cumsum(per_text)])
    total = int(first_passage[-1])
    x = np.zeros((total, FEATURES))
    if not len(starts):
        return x, per_text
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tables["byte"][buf] * power[:len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    text_of = np.repeat(np.arange(len(texts)), n_words)
    passage = first_passage[text_of] + (np.arange(len(starts)) - bounds[text_of]) // PASSAGE
    count = np.bincount(passage, minlength=total)
    size = np.maximum(count, 1)
    # bytes up to the next word belong to a word's passage
    reach = np.append(starts[1:], len(buf)) - starts
    of_byte = np.repeat(passage, reach)
    classes = _class_table()[buf[starts[0]:]]
    shares = np.bincount(of_byte * CLASSES + classes, minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = shares / np.maximum(shares.sum(1, keepdims=True), 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(passage, length, total) / size
    x[:, CLASSES] = np.log1p(count)
    x[:, CLASSES + 1] = mean / 8
    x[:, CLASSES + 2] = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / size - mean**2, 0)) / 8
    order = np.lexsort((hashes, passage))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    x[:, CLASSES + 3] = np.bincount(passage[order][new], minlength=total) / size            # distinct words
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])
    x[:, CLASSES + 4] = np.bincount(passage[same], minlength=total) / size                  # a word twice in a row
    order = np.lexsort((np.arange(len(hashes)), hashes, text_of))
    seen = np.concatenate([[False], (hashes[order][1:] == hashes[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])])
    x[:, CLASSES + 5] = np.bincount(passage[order][seen], minlength=total) / size           # said before in this text
    x[:, CLASSES + 6] = np.bincount(passage[length == 1], minlength=total) / size           # one-byte words
    x[:, CLASSES + 7] = np.log1p(np.repeat(n_words, per_text)) / 4
    return x, per_text


class Model:
    """Encoder, gated attention and scorer; ``fit`` is full-batch Adam on the log loss."""

    def __init__(self, features: int = FEATURES, hidden: int = 16, gate: int = 8, seed: int = 3):
        r = np.random.RandomState(seed)
        w = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"enc": w(features, hidden), "enc_b": np.zeros(hidden), "v": w(hidden, gate), "u": w(hidden, gate),
                  "a": w(gate, 1), "out": w(hidden, 1), "out_b": np.zeros(1)}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def _forward(self, x, per_text):
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        starts = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        h = np.tanh(x @ p["enc"] + p["enc_b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * g) @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), per_text))
        weight = e / np.repeat(np.add.reduceat(e, starts), per_text)
        z = np.add.reduceat(h * weight[:, None], starts)
        return x, starts, h, t, g, weight, z, 1 / (1 + np.exp(-np.clip((z @ p["out"])[:, 0] + p["out_b"][0], -30, 30)))

    def score(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return self._forward(x, per_text)[-1]

    def fit(self, x: np.ndarray, per_text: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Model:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        p, m, v = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            s, starts, h, t, g, weight, z, q = self._forward(x, per_text)
            d = (q - y)[:, None] / len(y)
            dz = np.repeat(d @ p["out"].T, per_text, axis=0)
            dw = (dz * h).sum(1)
            de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, starts), per_text))
            dtg = de[:, None] @ p["a"].T
            dt, du = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
            dh = (dz * weight[:, None] + dt @ p["v"].T + du @ p["u"].T) * (1 - h**2)
            grad = {"enc": s.T @ dh, "enc_b": dh.sum(0), "v": h.T @ dt, "u": h.T @ du, "a": (t * g).T @ de[:, None], "out": z.T @ d, "out_b": d.sum(0)}
            for k in p:
                gk = grad[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _sampled(batches):
    for rows, texts in text_chunks(batches, "text"):
        x, per_text = passage_features(texts)
        out, at = [], 0
        for n in per_text.tolist():
            pick = at + np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).astype(int))
            out.append(x[pick].astype(np.float32).tobytes())
            at += n
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("l_id")), rows.column(rows.schema.get_field_index("quality")),
                                          pa.array(out, pa.binary())], names=["l_id", "quality", "x"])


def held_out(doc_id):
    """Rows that no training sees: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that aren't held out. A doc_id with several labels
    has the largest; null labels are left out. Without labels of both kinds the model is a constant."""
    own = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("double").alias("quality"))
           .orderBy(F.xxhash64("l_id"), "l_id").limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("l_id")).select("l_id", "quality", "text")
            .mapInArrow(_sampled, "l_id long, quality double, x binary").collect())  # at most ``sample`` documents
    rows = sorted(rows, key=lambda r: (r["l_id"], r["x"]))
    model = Model()
    if not rows:
        return model
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float) for r in rows]
    return model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["quality"] for r in rows]))


def _scorer(model: Model):
    # the model is a few kilobytes and travels with the function
    def run(batches):
        for rows, texts in text_chunks(batches, "text"):
            score = model.score(*passage_features(texts))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns - 1)), pa.array(np.round(score, 6), pa.float64())],
                                             names=[*rows.schema.names[:-1], "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> one row for each row of ``docs``:
    ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.3).

    The score depends on the text alone. Null, empty or word-less texts have one empty passage; a null
    doc_id isn't held out. Rows that repeat a doc_id are scored each. Other columns are ignored. Empty
    documents give no rows; without labels every score is that of the initial model.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    scored = (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
              .mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text") + ", text string"

    def accepted(batches):
        for rows, texts in text_chunks(batches, "text"):
            good = model.score(*passage_features(texts)) >= THRESHOLD
            yield rows.filter(pa.array(good))

    return docs.select(*(n for n in names if n != "text"), F.col("text").cast("string").alias("text")).mapInArrow(accepted, schema).select(*names)
