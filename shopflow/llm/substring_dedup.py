"""Operator 8: removal of repeated 50-byte strings with partitioned suffix arrays.

A corpus-wide suffix array is built in parts that never need each other. Every 50-byte window has
an anchor, the smallest hash of its 26-byte grams: equal windows have equal anchors, so neighbouring
windows with one anchor form a piece, and pieces of one anchor meet in one task.

1. Anchors of all texts are shipped as packed hashes; each hash range names those that two
   different texts hold. Other pieces can't repeat anything and stay where they are.
2. Texts (one of each group of exact copies) cut out their named pieces. In a task, a piece that several
   texts hold ships once, from the smallest doc_id; the others are settled. Pieces of an anchor that more
   than ``HOT`` texts hold are dealt out window by window instead, keyed by the window itself.
3. A range sorts the distinct pieces of its anchors with two-stage suffix sorting, and adjacent common
   prefixes of 50 bytes give each window's smallest doc_id.
4. Covered bytes are joined back to their texts and cut out.

Copies of a text smaller in doc_id are removed whole; texts are equal if their SHA-256 is, and its first
``ID`` bytes name a text in tasks. Hashes of 64 bits (44 as keys) only choose what meets; windows
themselves are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import gathered, materialise, ranges_for, text_bytes, text_chunks
from shopflow.llm.shingles import _powers, _splitmix, mix, range_key
from shopflow.llm.suffix import WINDOW, shared_runs

GRAM = 26
ID = 16                  # bytes of a text's SHA-256 that name it
HOT = 2000
PART = 512               # windows in one piece at most
LONG = 4 << 20           # longer texts are hashed part by part
SORT_BYTES = 1 << 20     # of pieces sorted together
_BYTE: list = []


def _minima(buf: np.ndarray) -> np.ndarray:
    """For each window start the smallest gram hash in it."""
    if not _BYTE:
        _BYTE.append(_splitmix(29, 256))
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[0][buf] * power[:len(buf)], out=sums[1:])
    m = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(buf) - GRAM + 1])
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    rest = WINDOW - GRAM + 1 - 16
    return np.minimum(m[:-rest], m[rest:])


def pieces(text: bytes):
    """(anchor hashes, first windows, last windows) of a text's runs of windows with one anchor."""
    hashes, first, last = [], [], []
    for at in range(0, max(len(text) - WINDOW + 1, 0), LONG):
        buf = np.frombuffer(text[at:at + LONG + WINDOW - 1], np.uint8)
        m = _minima(buf)
        s = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        e = np.append(s[1:], len(m)) - 1
        hashes.append(m[s])
        first.append(s + at)
        last.append(e + at)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last)


def _anchor_packets(bits: int):
    def run(batches):
        gather = gathered(1 << 19, bits)

        def flush(held):
            keys = np.concatenate([x[0] for x in held])
            doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            rng = (keys >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(rng, kind="stable")
            keys, doc, rng = keys[order].astype(np.uint32), doc[order], rng[order]
            node = np.array([x[1] for x in held], f"S{ID}")
            cols = [[], [], [], []]
            cuts = np.flatnonzero(np.concatenate([[True], rng[1:] != rng[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(rng)]):
                r = rng[a]
                own, n = np.unique(doc[a:b], return_counts=True)
                for c, v in zip(cols, (int(r), keys[a:b].tobytes(), n.astype(np.uint32).tobytes(), node[own].tobytes())):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                              names=["rng", "anchors", "counts", "nodes"])

        held, seen, total = [], set(), 0
        for rows, texts in text_chunks(batches, "text"):
            for text, node in zip(texts, rows.column(rows.schema.get_field_index("dg")).to_pylist()):
                if node in seen:  # copies are one text
                    continue
                seen.add(node)
                keys = np.unique(range_key(pieces(text or b"")[0], bits))
                if len(keys):
                    held.append((keys, node))
                    total += len(keys)
                if total >= gather:
                    yield flush(held)
                    held, seen, total = [], set(), 0
        if held:
            yield flush(held)
    return run


def _shared(pdf):
    """Of a hash range: for each text, the anchors that other texts hold too, and which are hot."""
    import pandas as pd
    names = np.unique(np.frombuffer(b"".join(pdf["nodes"]), f"S{ID}"))
    held = []
    for g, n, own in zip(pdf["anchors"], pdf["counts"], pdf["nodes"]):
        place = np.searchsorted(names, np.frombuffer(own, f"S{ID}")).astype(np.uint64)
        held.append((np.frombuffer(g, np.uint32).astype(np.uint64) << np.uint64(32)) | np.repeat(place, np.frombuffer(n, np.uint32)))
    both = np.concatenate(held)
    del held
    both.sort()
    if len(both):  # copies of a text in several tasks are one text
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    g = (both >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(g)))
    n = np.repeat(n, n)
    keep = n > 1
    g, v, n = g[keep], (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64), n[keep]
    order = np.argsort(v, kind="stable")
    g, v, hot = g[order], v[order], n[order] > HOT
    cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    ends = [*cuts[1:], len(v)]
    whole = names.tobytes()
    return pd.DataFrame({"node": [whole[ID * x:ID * x + ID] for x in v[cuts].tolist()], "rng": pdf["rng"].iloc[0],
                         "shared": [g[a:b].tobytes() for a, b in zip(cuts, ends)],
                         "hot": [hot[a:b].tobytes() for a, b in zip(cuts, ends)]}).astype({"rng": "int32"})


class _Holders:
    """Distinct pieces, each with the smallest doc_id that holds it; every other holder is settled:
    the piece is covered there."""

    def __init__(self):
        self.best: dict = {}      # (key, content) -> [doc, [(text, start), ...]]
        self.texts: dict = {}     # (text, doc) -> its number
        self.covered: list = []   # number, start, end, number, start, ...
        self.size = 0

    def cover(self, doc: int, dg: bytes, start: int, end: int) -> None:
        self.covered += (self.texts.setdefault((dg, doc), len(self.texts)), start, end)

    def add(self, key: int, content: bytes, doc: int, dg: bytes, start: int) -> None:
        old = self.best.setdefault((key, content), None)
        if old is None or doc < old[0]:
            if old:
                for g, s in old[1]:
                    self.cover(old[0], g, s, s + len(content))
            else:
                self.size += len(content) + 600
            self.best[key, content] = [doc, [(dg, start)]]
        elif doc == old[0]:
            old[1].append((dg, start))
        else:
            self.size += 130
            self.cover(doc, dg, start, start + len(content))

    def covered_columns(self) -> list:
        """text, doc, starts, ends of the covered stretches, overlapping ones joined."""
        runs = np.array(self.covered, np.int64).reshape(-1, 3)
        text, start, end = runs[np.lexsort((runs[:, 1], runs[:, 0]))].T
        shift = text << 40  # texts apart, so that one pass joins the runs of all
        start, end = join_sorted(start + shift, end + shift)
        text = start >> 40
        start, end = start - (text << 40), end - (text << 40)
        cuts = np.searchsorted(text, np.arange(len(self.texts) + 1)).tolist()
        return [[dg for dg, _ in self.texts], [doc for _, doc in self.texts],
                [start[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [end[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]]


def join_sorted(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs by ascending start -> the maximal runs they cover; touching ones join."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def join_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) rows -> starts and ends of the maximal runs they cover."""
    return join_sorted(*runs[np.argsort(runs[:, 0], kind="stable")].T)


PACKED = "rng int, dg binary, doc long, keys binary, docs binary, dgs binary, starts binary, ends binary, blob binary"


COLUMNS = PACKED.replace(",", "").split()[::2]
TYPES = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 6)
COVERED = -1


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=COLUMNS)


def _pack(held: _Holders, bits: int):
    """The covered stretches and, by hash range, the distinct pieces of a task."""
    rows = [(COVERED, dg, doc, None, None, None, a, b, None) for dg, doc, a, b in zip(*held.covered_columns())]
    by: dict[int, list] = {}
    for (key, content), (doc, places) in held.best.items():
        for dg, start in places:
            by.setdefault(key >> 32, []).append((key & 0xFFFFFFFF, doc, dg, start, content))
    for r, own in by.items():
        keys, docs, dgs, starts, contents = zip(*own)
        rows.append((r, None, None, np.array(keys, np.uint32).tobytes(), np.array(docs, np.int64).tobytes(), b"".join(dgs),
                     np.array(starts, np.int64).tobytes(), np.cumsum([len(x) for x in contents]).astype(np.int64).tobytes(), b"".join(contents)))
    return _rows(rows)


def _cut_pieces(bits: int, gather: int = 32 << 20):
    def run(batches):
        held = _Holders()
        for rows, texts in text_chunks(batches, "text"):
            col = lambda c: rows.column(rows.schema.get_field_index(c))
            named = col("named")
            part = named.flatten()
            ends = np.cumsum(np.diff(np.asarray(named.offsets))).tolist()
            rng, shared, hots = np.asarray(part.field("rng")), part.field("shared").to_pylist(), part.field("hot").to_pylist()
            for text, doc, dg, x, y in zip(texts, col("doc").to_pylist(), col("dg").to_pylist(), [0, *ends], ends):
                keys, first, last = pieces(text or b"")
                keys = range_key(keys, bits)
                wanted = np.frombuffer(b"".join(shared[x:y]), np.uint32) + (np.repeat(rng[x:y].astype(np.uint64), [len(v) // 4 for v in shared[x:y]]) << np.uint64(32))
                hot = np.frombuffer(b"".join(hots[x:y]), bool)
                order = np.argsort(wanted)
                wanted, hot = wanted[order], hot[order]
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                i = np.flatnonzero(wanted[at] == keys)
                for key, a, b, many in zip(keys[i].tolist(), first[i].tolist(), last[i].tolist(), hot[at[i]].tolist()):
                    if many:
                        for w in range(a, b + 1):
                            content = text[w:w + WINDOW]
                            held.add(int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big") >> (32 - bits), content, doc, dg, w)
                    else:
                        for w in range(a, b + 1, PART):
                            held.add(key, text[w:min(w + PART - 1, b) + WINDOW], doc, dg, w)
                    if held.size >= gather:
                        yield _pack(held, bits)
                        held = _Holders()
        if held.best or held.covered:
            yield _pack(held, bits)
    return run


def _sort_pieces(pdf):
    """Of a hash range: which windows of the pieces also start in a smaller doc_id."""
    import pandas as pd
    held = _Holders()
    for keys, docs, dgs, starts, ends, blob in zip(*(pdf[c] for c in ("keys", "docs", "dgs", "starts", "ends", "blob"))):
        ends = np.frombuffer(ends, np.int64).tolist()
        for key, doc, dg, start, a, b in zip(np.frombuffer(keys, np.uint32).tolist(), np.frombuffer(docs, np.int64).tolist(),
                                             [dgs[k:k + ID] for k in range(0, len(dgs), ID)], np.frombuffer(starts, np.int64).tolist(), [0, *ends], ends):
            held.add(key, blob[a:b], doc, dg, start)
    groups: dict[int, list] = {}
    for (key, content), value in held.best.items():
        groups.setdefault(key, []).append((content, value))
    batch, size = [], 0

    def settle():
        which, start, end = shared_runs([c for c, _ in batch], np.array([v[0] for _, v in batch], np.int64))
        for k, x, y in zip(which.tolist(), start.tolist(), end.tolist()):
            doc, places = batch[k][1]
            for dg, at in places:
                held.cover(doc, dg, at + x, at + y)

    for own in groups.values():
        if len(own) > 1:  # the windows of a single piece occur nowhere else
            batch += own
            size += sum(len(c) + 1 for c, _ in own)
            if size >= SORT_BYTES:
                settle()
                batch, size = [], 0
    if batch:
        settle()
    dg, doc, a, b = held.covered_columns()
    return pd.DataFrame({"dg": dg, "doc": pd.Series(doc, dtype="int64"), "starts": a, "ends": b})


def _cut_out(batches):
    for rows, texts in text_chunks(batches, "text"):
        col = lambda c: rows.column(rows.schema.get_field_index(c))
        out = [[], [], []]
        for text, found in zip(texts, col("found").to_pylist()):
            a, b = join_runs(np.concatenate([np.stack([np.frombuffer(x["starts"], np.int64), np.frombuffer(x["ends"], np.int64)], 1) for x in found]))
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist()):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            for c, v in zip(out, (int((b - a).sum()), len(a), kept.hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([col("dg"), col("doc"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                         names=["dg", "doc", "removed", "spans", "sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``, every byte removed that a 50-byte string covers which also starts in
    a text with a smaller doc_id (judged on the input; overlaps count).

    Null texts are empty; texts under 50 bytes lose nothing. A null doc_id counts as 2^63-1, the largest. Rows
    that repeat a doc_id don't act on each other. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = ranges_for(text_bytes(docs))
    docs = docs.withColumns({"dg": F.unhex(F.substring(F.sha2("text", 256), 1, 2 * ID)), "doc": F.coalesce("doc_id", F.lit((1 << 63) - 1))})
    texts = materialise(docs.select("doc_id", "doc", "dg", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha")), "texts")
    classes = texts.groupBy("own_sha").agg(F.first("dg").alias("c_dg"), F.min("doc").alias("rep")).drop("own_sha")
    shared = (docs.select("text", "dg").mapInArrow(_anchor_packets(bits), "rng int, anchors binary, counts binary, nodes binary")
              .groupBy("rng").applyInPandas(_shared, "node binary, rng int, shared binary, hot binary"))
    named = (shared.groupBy("node").agg(F.collect_list(F.struct("rng", "shared", "hot")).alias("named"))
             .join(classes, F.col("node") == F.col("c_dg")).select("node", "rep", "named"))
    cut = (docs.join(named.hint("merge"), (F.col("dg") == F.col("node")) & (F.col("doc") == F.col("rep"))).select("text", "doc", "dg", "named")
           .mapInArrow(_cut_pieces(bits), PACKED))
    cut = materialise(cut, "pieces")
    sorted_out = (cut.where(f"rng <> {COVERED}").drop("dg", "doc").groupBy("rng")
                  .applyInPandas(_sort_pieces, "dg binary, doc long, starts binary, ends binary"))
    covered = cut.where(f"rng = {COVERED}").select("dg", "doc", "starts", "ends").union(sorted_out)
    covered = covered.groupBy(F.col("dg").alias("f_dg"), F.col("doc").alias("f_doc")).agg(F.collect_list(F.struct("starts", "ends")).alias("found"))
    left = (docs.join(covered.hint("merge"), (F.col("dg") == F.col("f_dg")) & (F.col("doc") == F.col("f_doc")))
            .select("dg", "doc", "found", "text").mapInArrow(_cut_out, "dg binary, doc long, removed long, spans long, sha string")
            .groupBy(F.col("dg").alias("l_dg"), F.col("doc").alias("l_doc"))  # rows that repeat both id and text
            .agg(F.first("removed").alias("removed"), F.first("spans").alias("spans"), F.first("sha").alias("sha")))
    info = (classes.join(left, (F.col("c_dg") == F.col("l_dg")) & (F.col("rep") == F.col("l_doc")), "left")
            .select("c_dg", "rep", "removed", "spans", "sha"))
    whole = (F.col("doc") > F.col("rep")) & (F.col("n_bytes") >= WINDOW)
    first = F.col("doc") == F.col("rep")
    return texts.join(info, F.col("dg") == F.col("c_dg")).select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).when(first, F.coalesce("removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(first, F.coalesce("spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).when(first, F.coalesce("sha", "own_sha")).otherwise(F.col("own_sha")).alias("kept_sha256"))
