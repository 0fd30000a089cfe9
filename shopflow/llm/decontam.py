"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search,
with DataFrame functions only.

Items are partitioned by the power of two of their number of shingles. In each partition an
item keeps the k lowest of its shingle hashes, k from the partition's largest size u: any document that
holds at least 0.8 of the item's shingles must hold one of the u - ceil(0.8 u) + 1 lowest, so the
search misses nothing however long the document is. Documents stream past the sketches; only the pairs
found are verified, by counting the item's very shingles (words, not hashes) in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import SPACE, ascii_lower, materialise

WIDTH = 5
DIGESTS = 1 << 20  # digests of candidate texts that are broadcast, 32 bytes each


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _shingles(parts: Column, width: int, make) -> Column:
    """``make`` of every ``width`` neighbours of ``parts``; none if there are fewer."""
    none = F.array().cast("array<int>")
    return bind(parts, lambda w: F.transform(F.when(F.size(w) >= width, F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))).otherwise(none),
                                             lambda i: make(F.slice(w, i, width))))


def shingle_hashes(text: Column, width: int) -> Column:
    return _shingles(F.transform(words(text), lambda w: F.xxhash64(w)), width, lambda x: F.xxhash64(x))


def shingle_words(text: Column, width: int) -> Column:
    """The distinct shingles themselves, words joined by a space (no word holds one)."""
    return F.array_distinct(_shingles(words(text), width, lambda x: F.concat_ws(" ", x)))


def by_width(width: Column, widths: list[int], make) -> Column:
    """``make(w)`` for the row's width ``w``, one of ``widths``."""
    out = make(widths[0])
    for w in widths[1:]:
        out = F.when(width == w, make(w)).otherwise(out)
    return out


def item_sketches(items: DataFrame, widths: list[int], threshold_percent: int = 80) -> DataFrame:
    """``items(key, text, width)`` -> ``(key, width, size_class, sketch)``."""
    hashes = by_width(F.col("width"), widths, lambda w: shingle_hashes(F.col("text"), w))
    s = items.select("key", "width", F.array_sort(F.array_distinct(hashes)).alias("h")).where(F.size("h") > 0)
    s = s.withColumn("size_class", F.floor(F.log2(F.size("h"))).cast("int"))
    top = s.groupBy("size_class").agg(F.max(F.size("h")).alias("u"))
    k = F.col("u") - F.ceil(F.col("u") * threshold_percent / 100).cast("int") + 1
    return s.join(F.broadcast(top), "size_class").select("key", "width", "size_class", F.slice("h", F.lit(1), k).alias("sketch"))  # one row a power of two


def _rows_of_widths(text: Column, widths: list[int], make) -> Column:
    """Rows (width, value) of a text's shingles of every width that some item has."""
    def tagged(w):  # a lambda of two arguments would get the index
        return lambda x: F.struct(F.lit(w).alias("width"), x.alias("value"))
    return F.explode(F.flatten(F.array(*[F.transform(make(text, w), tagged(w)) for w in widths])))


PAIRS = "doc_id {}, item_id {}, n_item_shingles long, n_shared long, containment double"


def contaminated(docs: DataFrame, items: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``items(item_id, text, ...)`` -> ``(doc_id, item_id,
    n_item_shingles, n_shared, containment)`` for every pair in which the document holds at least
    ``threshold_percent`` of the item's distinct 5-word shingles.

    An item under five words is one shingle, held by every document in which its words stand in a row.
    Null, empty or word-less texts of either side match nothing. Every item row counts, with a null or repeated
    item_id too; pairs of equal ids give one row, the one with the largest containment. Other columns are ignored.
    Empty tables give no rows.
    """
    text = F.col("text").cast("string")
    n_words = F.size(words(F.col("text")))
    items = materialise(items.select("item_id", text.alias("text")).withColumn("width", F.least(n_words, F.lit(WIDTH))).where("width > 0")
                        .withColumn("key", F.monotonically_increasing_id()), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most five
    docs = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    if not widths:
        types = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], PAIRS.format(*types))
    sketches = item_sketches(items, widths, threshold_percent).select("width", F.explode("sketch").alias("value")).distinct()
    found = materialise(docs.select("doc_id", "sha", _rows_of_widths(F.col("text"), widths, shingle_hashes).alias("s")).select("doc_id", "sha", "s.*")
                        .join(sketches, ["width", "value"]).select("doc_id", "sha").distinct(), "found")
    texts = materialise(found.select("sha").distinct(), "texts")
    held = (docs.join(F.broadcast(texts) if texts.count() <= DIGESTS else texts, "sha", "left_semi")  # beyond it texts are shuffled
            .select("sha", _rows_of_widths(F.col("text"), widths, shingle_words).alias("s")).select("sha", "s.*"))
    own = items.select("key", "item_id", "width", F.explode(by_width(F.col("width"), widths, lambda w: shingle_words(F.col("text"), w))).alias("value"))
    held = held.join(own.select("width", "value").distinct(), ["width", "value"], "left_semi").distinct()  # a text's copies count once
    shared = held.join(own, ["width", "value"]).groupBy("sha", "key").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = own.groupBy("key").agg(F.first("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_item_shingles"))
    both = (shared.join(sizes, "key").where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * threshold_percent)
            .join(found, "sha"))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared"))
    return both.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.n_item_shingles").cast("long").alias("n_item_shingles"),
        F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Each row is
    judged by its own text (told by its digest), whatever its doc_id or that of other rows, so equal rows fare
    alike. Null and empty texts stay; if either table is empty, all rows stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("sha"))
    bad = contaminated(docs.select(F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("doc_id"), "text"), items)
    return rows.join(bad.select(F.col("doc_id").alias("sha")).distinct(), "sha", "left_anti").select("row.*")
