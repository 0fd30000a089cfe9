"""Operator 1: n-gram Jaccard self-join by vertical partitioning.

The global n-gram order puts rare n-grams first (frequent ones, counted over every document,
last; ties by hash). Passes over hashed shingle sets:

1. counts: each task combines its n-grams and ships packed (hash range, hashes, counts); each
   range keeps those above ``RARE``; at most ``HOT`` of them, the most frequent, are broadcast (a fixed size). They
   only decide the order, never what is compared.
2. candidates: two sets with Jaccard >= 0.8 share ``SHARED`` n-grams (fewer if they are that small) among the
   first n - ceil(0.8 n) + ``SHARED`` of either one in that order. The order is cut into fragments, the
   hash ranges; each counts the n-grams that pairs of a bucket of at most ``RARE`` sets share, and the partial
   counts are summed per pair. A larger bucket links neighbours in order of size (a chain, not
   all pairs), if their sizes allow 0.8. The components are the only groups inside which links can exist.
3. verification: in each group the order is cut into fragments again, the overlap of all pairs is
   counted fragment by fragment as a small matrix product, and the partial counts are summed per pair.
   Groups over ``BLOCK`` sets are dealt out as pairs of blocks, each a task of its own with bounded
   memory, so that no link is lost and no group is collected.

Equal sets (exact copies) are one node, so a large group of copies costs one comparison.
Hashes have 64 bits (n-grams) and 128 bits (whole sets); collisions are not checked further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import gathered, materialise, ranges_for, text_bytes, text_chunks
from shopflow.llm.components import components
from shopflow.llm.shingles import range_key, set_digest, shingle_sets

RARE = 8             # n-grams in more sets than this come late in the order
HOT = 1 << 21        # at most so many of them are told apart (18 MB broadcast)
SHARED = 4           # n-grams that candidates share at least
BLOCK = 512          # sets compared in one task: two blocks at most
BLOCK_GRAMS = 1 << 20
FRAGMENT = 2048      # distinct n-grams in one fragment


def shared_len(n):
    """n-grams that a set of n shares at least, as a candidate, with another one."""
    return np.minimum(SHARED, (4 * n + 4) // 5)


def prefix_len(n: int) -> int:
    """n-grams to look at so that Jaccard >= 0.8 with any other set shows in ``shared_len`` of them."""
    return n - (4 * n + 4) // 5 + int(shared_len(n)) if n else 0


def _doc_sets(carried: list[str]):
    def run(batches):
        for rows, texts in text_chunks(batches, "text"):
            sets = shingle_sets(texts)
            digests = [set_digest(s) if len(s) else (None, None) for s in sets]
            col = lambda c: rows.column(rows.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays(
                [col("doc_id").cast(pa.int64()), *(col(c).cast(pa.binary()) for c in carried), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())],
                names=["doc_id", *carried, "n", "hi", "lo"])
    return run


def _split(keys: np.ndarray):
    """(range, start, end) for sorted keys, whose lower 32 bits lie within a range."""
    rng = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], rng[1:] != rng[:-1]]))
    yield from zip(rng[at].tolist(), at.tolist(), [*at[1:].tolist(), len(rng)])


def _count_packets(bits: int):
    def run(batches):
        gather = gathered(1 << 20, bits)

        def flush(held):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            low, counts = keys.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
            out = [(r, low[a:b].tobytes(), counts[a:b].tobytes()) for r, a, b in _split(keys)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()),
                 pa.array([x[2] for x in out], pa.binary())], names=["rng", "grams", "counts"])

        held, size = [], 0
        for _, texts in text_chunks(batches, "text"):
            for s in shingle_sets(texts):
                # n-grams that can reach a prefix unless most earlier ones are frequent
                s = s[:2 * prefix_len(len(s))]
                if len(s):
                    held.append(range_key(s, bits))
                    size += len(s)
            if size >= gather:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
    return run


def _frequent(pdf):
    import pandas as pd
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["grams"]])
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts, first)
    keep = total > RARE
    keys, level = keys[first][keep], np.log2(total[keep]).astype(np.int32)
    at = [np.flatnonzero(level == x) for x in range(level.max(initial=-1) + 1)]
    return pd.DataFrame([(int(pdf["rng"].iloc[0]), x, len(a), keys[a].tobytes()) for x, a in enumerate(at) if len(a)],
                        columns=["rng", "level", "n", "grams"]).astype({"rng": "int32", "level": "int32", "n": "int64"})


def hot_grams(frequent: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, levels) of the most frequent n-grams, ``most`` at most, whole levels of frequency."""
    levels, total, least = frequent.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect(), 0, 99
    for r in levels:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    rows = frequent.where(F.col("level") >= least).collect()
    keys = [(np.uint64(r["rng"]) << np.uint64(32)) + np.frombuffer(r["grams"], np.uint32).astype(np.uint64) for r in rows]
    level = [np.full(len(k), r["level"], np.uint8) for k, r in zip(keys, rows)]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    keys, level = np.concatenate(keys), np.concatenate(level)
    order = np.argsort(keys)
    return keys[order], level[order]


def _prefix_packets(bits: int, hot):
    def run(batches):
        hot_keys, hot_levels = hot.value
        gather = gathered(1 << 19, bits)

        def flush(held):
            keys = range_key(np.concatenate([x[0] for x in held]), bits)
            doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            node, size = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int32)
            cols = [[], [], [], [], []]
            for r, a, b in _split(keys):
                own, ref = np.unique(doc[a:b], return_inverse=True)
                for c, v in zip(cols, (r, keys[a:b].astype(np.uint32).tobytes(), ref.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(),
                                       node[own].tobytes(), size[own].tobytes())):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                              names=["rng", "grams", "refs", "nodes", "sizes"])

        held, seen, total = [], set(), 0
        for _, texts in text_chunks(batches, "text"):
            for s in shingle_sets(texts):
                n = len(s)
                if not n or (digest := set_digest(s)) in seen:  # copies are one set
                    continue
                seen.add(digest)
                p = prefix_len(n)
                if len(hot_keys):
                    keys = range_key(s, bits)
                    at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                    frequent = hot_keys[at] == keys
                    rare = s[~frequent]
                    if len(rare) < p:
                        late = s[frequent]
                        late = late[np.lexsort((late, hot_levels[at[frequent]]))]
                        rare = np.concatenate([rare, late])
                else:
                    rare = s
                held.append((rare[:p], digest[0], n))
                total += p
            if total >= gather:
                yield flush(held)
                held, seen, total = [], set(), 0
        if held:
            yield flush(held)
    return run


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each vertex's component; vertices 0..n-1, edges a-b."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _candidates(pdf):
    """Of a hash range: pairs of sets with the n-grams they share in it, and chains through large buckets."""
    import pandas as pd
    grams, nodes, sizes = [], [], []
    for g, r, own, size in zip(pdf["grams"], pdf["refs"], pdf["nodes"], pdf["sizes"]):
        g = np.frombuffer(g, np.uint32)
        ref = np.frombuffer(r, np.uint16 if len(r) == 2 * len(g) else np.uint32)
        grams.append(g)
        nodes.append(np.frombuffer(own, np.int64)[ref])
        sizes.append(np.frombuffer(size, np.int32)[ref])
    g, v, n = map(np.concatenate, (grams, nodes, sizes))
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = order[np.lexsort((v[order], n[order], g[order]))]
    g, v, n = g[order], v[order], n[order].astype(np.int64)
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]) if len(g) else np.empty(0, bool)
    g, v, n = g[new], v[new], n[new]  # copies are one set
    size = np.bincount(np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]).astype(int))) if len(g) else np.empty(0, int)
    large = np.repeat(size, size) > RARE
    out = []
    for k in range(1, RARE):  # pairs k places apart in a small bucket
        link = (g[k:] == g[:-k]) & ~large[k:] & (5 * n[:-k] >= 4 * n[k:])
        a, b = v[:-k][link], v[k:][link]
        out.append((np.minimum(a, b), np.maximum(a, b), shared_len(n[:-k][link])))
    a, b, need = map(np.concatenate, zip(*out))
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, int)
    pairs = pd.DataFrame({"a": a[first], "b": b[first], "shared": np.diff([*first, len(a)]), "need": need[first]})
    link = (g[1:] == g[:-1]) & large[1:] & (5 * n[:-1] >= 4 * n[1:])
    ids, both = np.unique(np.concatenate([v[:-1][link], v[1:][link]]), return_inverse=True)
    label = _labels(both[:link.sum()], both[link.sum():], len(ids))
    off = np.flatnonzero(label != np.arange(len(ids)))
    chains = pd.DataFrame({"a": ids[off], "b": ids[label[off]], "shared": SHARED, "need": SHARED})
    return pd.concat([pairs, chains]).astype("int64")


def _member_sets(batches):
    for rows, texts in text_chunks(batches, "text"):
        sets = shingle_sets(texts)
        digests = [set_digest(s) if len(s) else (None, None) for s in sets]
        col = lambda c: rows.column(rows.schema.get_field_index(c))
        at = [i for i, (d, hi, lo) in enumerate(zip(digests, col("hi").to_pylist(), col("lo").to_pylist())) if d == (hi, lo)]
        yield pa.RecordBatch.from_arrays(
            [*(col(c).take(pa.array(at, pa.int64())) for c in ("root", "blocks", "block", "hi", "lo", "copies")),
             pa.array([sets[i].tobytes() for i in at], pa.binary())],
            names=["root", "blocks", "block", "hi", "lo", "copies", "grams"])


def overlaps(sets: list[np.ndarray], fragment: int = FRAGMENT) -> np.ndarray:
    """Sizes of all pairwise intersections: partial counts over fragments of the n-gram order,
    summed per pair."""
    grams = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, doc = grams[order], doc[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    rank = np.cumsum(first) - 1
    keep = (np.bincount(rank) > 1)[rank]  # an n-gram of one set overlaps with nothing
    doc, first = doc[keep], first[keep]
    total = np.zeros((len(sets), len(sets)), np.float64)
    if not len(doc):
        return total
    rank = np.cumsum(first) - 1
    cuts = np.searchsorted(rank, np.arange(0, rank[-1] + 1 + fragment, fragment))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            has = np.zeros((len(sets), fragment), np.float32)
            has[doc[a:b], rank[a:b] - rank[a]] = 1
            total += has @ has.T
    return total


def _verify(key, pdf):
    import pandas as pd
    _, left, right = key
    pdf = pdf.drop_duplicates(["hi", "lo"])
    sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
    size = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    if left != right:  # pairs inside a block belong to that block's own task
        block = pdf["block"].to_numpy()
        link &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(link))
    label = _labels(a, b, len(sets))
    hi = pdf["hi"].to_numpy()
    return pd.DataFrame({"node": hi, "peer": hi[label], "links": (link * pdf["copies"].to_numpy()[None, :]).sum(1).astype(np.int64)})


def _linked(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs(doc_id, text, *carried)`` -> for each row: ``doc_id``, ``carried``, ``n_shingles``, ``component_id``, ``n_links``,
    and ``group_hi``, ``group_lo``, the same for the rows of a component only (null without shingles).

    ``carried`` names the binary digest of the text: a row is found again by id and text, so null and repeated ids
    meet no other texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    texts = docs.select("text")
    bits = ranges_for(text_bytes(docs))
    own = materialise(docs.mapInArrow(_doc_sets(carried), ", ".join(["doc_id long", *(c + " binary" for c in carried), "n long, hi long, lo long"])), "sets")

    counted = (texts.mapInArrow(_count_packets(bits), "rng int, grams binary, counts binary")
               .groupBy("rng").applyInPandas(_frequent, "rng int, level int, n long, grams binary"))
    hot = spark.sparkContext.broadcast(hot_grams(materialise(counted, "frequent")))
    pairs = (texts.mapInArrow(_prefix_packets(bits, hot), "rng int, grams binary, refs binary, nodes binary, sizes binary")
             .groupBy("rng").applyInPandas(_candidates, "a long, b long, shared long, need long")
             .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need"))
    groups = components(pairs.select("a", "b"))

    # a class is found again by its smallest row, ids before nulls
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *carried))
    classes = (own.where("hi is not null").groupBy("hi", "lo")
               .agg(least.alias("least") if carried else F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    if carried:
        classes = classes.select("hi", "lo", F.col("least.doc_id").alias("rep"), "copies", "n", *(F.col("least." + c).alias("rep_" + c) for c in carried))
    members = materialise(classes.join(groups, classes["hi"] == groups["node"]).drop("node"), "members")
    stats = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = members.join(stats, "root").withColumn("block", F.pmod(F.xxhash64("lo"), F.col("blocks")).cast("int"))
    same = docs["doc_id"].eqNullSafe(placed["rep"])
    for c in carried:
        same = same & (docs[c] == placed["rep_" + c])
    found = (docs.join(placed.drop("n").hint("merge"), same)
             .select("root", "blocks", "block", "hi", "lo", "copies", "text")
             .mapInArrow(_member_sets, "root long, blocks int, block int, hi long, lo long, copies long, grams binary")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
             .select("root", "left", "right", "block", "hi", "lo", "copies", "grams")
             .groupBy("root", "left", "right").applyInPandas(_verify, "node long, peer long, links long"))
    found = materialise(found, "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    linked = found.groupBy(F.col("node").alias("l_hi")).agg(F.sum("links").alias("links"))
    roots = roots.select(F.col("node").alias("r_hi"), F.col("root").alias("top"))
    info = (members.join(linked, F.col("hi") == F.col("l_hi")).join(roots, F.col("hi") == F.col("r_hi"), "left")
            .select(F.col("hi").alias("i_hi"), F.col("lo").alias("i_lo"), "rep", "links", "top"))
    least = info.where("top is not null").groupBy(F.col("top").alias("least_top")).agg(F.min("rep").alias("least_id"))
    info = info.join(least, F.col("top") == F.col("least_top"), "left").select("i_hi", "i_lo", "links", "least_id", "top")
    named = classes.join(info, (F.col("hi") == F.col("i_hi")) & (F.col("lo") == F.col("i_lo")), "left").select(
        F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), F.coalesce("least_id", "rep").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("top", "hi").alias("group_hi"), F.when(F.col("top").isNull(), F.col("lo")).alias("group_lo"))
    return own.join(named, (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo")), "left").select(
        "doc_id", *carried, F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "group_hi", "group_lo")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row of ``docs``: ``doc_id``,
    ``n_shingles`` (distinct 5-word shingles), ``component_id`` (smallest doc_id reachable by
    links of Jaccard >= 0.8, itself included) and ``n_links`` (rows it links with, copies too).

    Null, empty or word-less text: no shingles, no link, its own component. Under five words:
    the whole sequence is the one shingle. Rows with the same text are linked; rows that repeat a
    doc_id each count; a null doc_id stays null unless its component has another id. Other
    columns are ignored. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("key"))
    return _linked(docs, ["key"]).drop("key", "group_hi", "group_lo")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of near copies.

    A row is told by doc_id and text, so null and repeated ids are rows of their own: of a group the
    smallest doc_id stays (nulls last), of texts that share it the smallest digest, of rows that share both one.
    Null, empty or word-less texts are in no group and stay.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("string"), 256))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("sha"))
    rows = materialise(_linked(docs.select("doc_id", "text", digest.alias("key")), ["key"]).where("group_hi is not null")
                       .select("doc_id", "key", "group_hi", "group_lo"), "near")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = rows.groupBy("group_hi", "group_lo").agg(least.alias("least")).select(F.col("least.doc_id").alias("k_doc"), F.col("least.key").alias("k_key"))
    texts = rows.groupBy(F.col("doc_id").alias("x_doc"), F.col("key").alias("x_key")).agg(F.count(F.lit(1)).alias("rows"))
    is_kept = F.col("x_doc").eqNullSafe(F.col("k_doc")) & (F.col("x_key") == F.col("k_key"))
    is_row = F.col("id").eqNullSafe(F.col("x_doc")) & (F.col("sha") == F.col("x_key"))
    out = whole.join(texts.join(kept, is_kept, "left_anti").drop("rows"), is_row, "left_anti")
    repeated = materialise(texts.where("rows > 1").join(kept, is_kept, "left_semi").drop("rows"), "repeated")
    if repeated.limit(1).count():  # rows that repeat both id and text
        one = out.join(repeated, is_row, "left_semi").dropDuplicates(["id", "sha"])
        out = out.join(repeated, is_row, "left_anti").unionByName(one)
    return out.select("row.*")
