"""Operator 12: token counts by a map-side two-tier lookup of pre-tokens.

A pre-token is a run of spaces with the text up to the next space or line break. No piece of the
vocabulary holds a line break or goes on after a space that follows other text, so merges never
cross from one pre-token to the next, and a text's tokens are the sum over its pre-tokens. That is
checked on the vocabulary; a model it doesn't hold for counts whole texts.

First tier: a compact table (keys and lengths in one byte string each) of the most frequent
pre-tokens, broadcast; its size is bounded by ``FREQUENT`` keys of ``LONGEST`` bytes. They are found by Misra-Gries
summaries of all texts, one row a task, merged 64 to 1: no pre-token is a shuffle key. Second
tier: other pre-tokens are encoded by the library and kept in a worker's bounded cache. The
tables decide speed, never counts.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import materialise, text_chunks
from shopflow.llm.exact_dedup import summarise

MARK = "▁".encode()  # stands for a space inside pieces, and equals one in a text
FREQUENT, LONGEST, CACHED = 1 << 16, 48, 1 << 20
SUMMARY = "keys binary, lengths binary, counts binary"
FAN_IN = 64


def pre_tokens(text: bytes) -> tuple[list[bytes], int]:
    """A text's pre-tokens, each without one of its leading spaces (the library puts one before
    whatever it encodes), and how many of them stand at a line break, where it puts one too many."""
    if MARK in text:
        text = text.replace(MARK, b" ")
    if b"  " in text or text[:1] == b" ":
        return [t[1:] for t in re.findall(b" +[^ ]*", b" " + text)], 0
    if b" \n" in text or text[:1] == b"\n":
        return text.split(b" "), 0
    return (text.replace(b"\n", b" \n").split(b" "), text.count(b"\n")) if text else ([], 0)


def _pack(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_pydict({"keys": [b"".join(keys)], "lengths": [array("B", map(len, keys)).tobytes()],
                                       "counts": [array("q", counts.values()).tobytes()]},
                                      schema=pa.schema([("keys", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())]))


def _unpack(keys: bytes, lengths: bytes, values: bytes, code: str = "q") -> dict:
    at, out = 0, {}
    for n, v in zip(lengths, array(code, values), strict=True):
        out[keys[at:at + n]] = v
        at += n
    return out


def _summaries(k: int):
    def run(batches):
        held: Counter = Counter()
        for _, texts in text_chunks(batches, "text"):
            for t in texts:
                if t:
                    held.update(pre_tokens(t)[0])
                if len(held) > 4 * k:
                    held = Counter(summarise({x: n for x, n in held.items() if len(x) <= LONGEST}, k))
        if held:
            yield _pack(summarise({x: n for x, n in held.items() if len(x) <= LONGEST}, k))
    return run


def _merge(k: int):
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                held.update(_unpack(row["keys"], row["lengths"], row["counts"]))
                held = Counter(summarise(held, k))
        if held:
            yield _pack(held)
    return run


def frequent_pre_tokens(docs: DataFrame, k: int = FREQUENT) -> list[bytes]:
    """At most ``k`` pre-tokens of ``docs(text)``, the most frequent ones among them."""
    found = materialise(docs.select("text").mapInArrow(_summaries(k), SUMMARY), "summaries")
    rows = found.count()
    while rows > 1:
        parts = -(-rows // FAN_IN)
        found = materialise(found.repartition(parts).mapInArrow(_merge(k), SUMMARY), "summaries")
        rows = min(parts, found.count())
    row = found.first()  # one summary of at most k keys
    return sorted(_unpack(bytes(row["keys"]), bytes(row["lengths"]), bytes(row["counts"]))) if row else []


class _Lengths:
    """Tokens of pre-tokens: the broadcast table, then what this worker has encoded so far."""

    def __init__(self, model: bytes, known: dict):
        import sentencepiece
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.known = known | {b"": 1}  # a lone space is one piece
        self.held = dict(self.known)

    def of(self, texts: list) -> list[int]:
        """Tokens of each text; all new pre-tokens of the list are encoded in one call."""
        split = [pre_tokens(t or b"") for t in texts]
        if len(self.held) > CACHED:
            self.held = dict(self.known)
        new = list(set(chain.from_iterable(keys for keys, _ in split)).difference(self.held))
        self.held.update(zip(new, map(len, self.encode(new)), strict=True))
        n = [sum(map(self.held.__getitem__, keys)) - extra for keys, extra in split]
        for key in new:
            if len(key) > LONGEST:
                del self.held[key]
        return n


def splits_apart(model: bytes) -> bool:
    """Whether every text's tokens are those of its pre-tokens."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    mark = MARK.decode()
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    written = lambda t: "".join(sp.encode(t, out_type=str))  # noqa: E731 - one space before, no other change
    plain = all(written(t) == mark + t.replace(" ", mark) for t in (" ", "  ", "a  b ", "ﬁ ½ Å"))
    return (plain and mark in pieces and len(sp.encode("\n")) == 2
            and not any("\n" in p or re.search(f"[^{mark}]{mark}", p) for p in pieces))


def _counter(shared, whole: bool, limit: int):
    def run(batches):
        held = shared.value  # one object for all of a worker's tasks, so its cache lasts
        if "lengths" not in held:
            held["lengths"] = _Lengths(held["model"], _unpack(held["keys"], held["sizes"], held["tokens"], "H"))
        lengths = held["lengths"]
        for rows, texts in text_chunks(batches, "text"):
            n = [len(x) for x in lengths.encode([t or b"" for t in texts])] if whole else lengths.of(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``
    as the piece model at ``model_path`` gives for the whole text, ``over_limit`` (more than ``limit``).

    Null and empty texts have no bytes and no tokens. Null and repeated ids are rows of their own;
    equal rows give equal rows. Strings like ``</s>`` in a text are text. The driver reads the model and sends it
    along (at most 64 MB, else ValueError), so workers need no copy. Other columns are ignored. An empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError("the model is too large to broadcast")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = not splits_apart(model)
    keys = [] if whole else frequent_pre_tokens(docs, frequent)
    tokens = map(len, _Lengths(model, {}).encode(keys))
    shared = docs.sparkSession.sparkContext.broadcast({
        "model": model, "keys": b"".join(keys), "sizes": array("B", map(len, keys)).tobytes(),
        "tokens": array("H", tokens).tobytes()})
    return docs.mapInArrow(_counter(shared, whole, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
