"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is the sequence of its words (split at white space). Of every K consecutive words the inner S-word
substrings are hashed; the K words are an anchor if the smallest of these hashes stands first or last. The
choice depends on those K words alone, never on what surrounds them, so a passage brings its anchors along
wherever it stands. Anchors are hashed to 32 bits; a fingerprint is their sequence. Two fingerprints' likeness
is the Jaccard index of their anchor sets; positions are kept by anchors() for positional matching.

Fewer than K words, or none of the K words chosen (up to 2 K - S - 2 words): the whole sequence is the one
anchor. Null and empty texts have no anchor; two such are
alike (1.0), one such and another text are not (0.0). Equal texts have equal fingerprints.

Next documents go by descending id, ties by the hash of the text, and after the last the first. Rows without an id are
their own next document. Rows may repeat. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

#: Words of an anchor and of its inner substrings.
K, S = 7, 2
#: Rows of a bucket of neighbouring ids, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 1000, 16_384


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos: int, anchor: int>>: places (words from 0) and hashes of a text's closed syncmers."""
    return _anchors(text, k, s, lambda i, h: F.struct(i.alias("pos"), h.alias("anchor")))


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """array<int>: the anchors in order."""
    return _anchors(text, k, s, lambda i, h: h)


def _anchors(text: Column, k: int, s: int, out) -> Column:
    wide = k - s  # from the first inner substring to the last

    def of_words(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s))))

        def chosen(g: Column) -> Column:
            def chosen_at(first: Column, i: Column) -> Column:
                closed = F.least(first, F.get(g, i + wide)) <= F.least(*(F.get(g, i + j) for j in range(1, wide)), F.lit((1 << 63) - 1))
                return F.when(closed, out(i, F.hash(*(F.get(h, i + j) for j in range(k)))))

            return F.filter(F.transform(F.slice(g, F.lit(1), n - (k - 1)), chosen_at), lambda x: x.isNotNull())

        whole = F.array(out(F.lit(0), F.hash(h)))
        short = F.slice(whole, 1, F.when(n > 0, 1).otherwise(0))
        return F.when(n >= k, let(let(inner, chosen), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))).otherwise(short)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def as_text(anchors_: Column) -> Column:
    """Eight lowercase hex digits an anchor."""
    return F.lower(F.array_join(F.transform(anchors_, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key: a search in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda b: b <= key))
    top = below(F.lit([p[0] for p in parts]))
    inner = F.element_at(F.array(*(F.lit(p) for p in parts)), top)
    return F.when(top == 0, 0).otherwise((top - 1) * step + below(inner))


def with_next(docs: DataFrame, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `columns` (made from the text), each also as next_<name> of the next document.

    One shuffle carries the rows, by buckets of neighbouring ids whose bounds are quantiles. A bucket also
    gets, as its last row, a copy of the first row of the bucket that follows: no row waits for another
    bucket and nothing is ordered in one task. At most MAX_BUCKETS bounds and ids pass the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("id is not null")
    n = known.count()
    probabilities = min(MAX_BUCKETS, -(-n // BUCKET_ROWS)) if n else 0
    bounds = sorted({int(x) for x in known.approxQuantile("id", [i / probabilities for i in range(1, probabilities)], 1 / (8 * probabilities))}) if probabilities > 1 else []
    dealt = known.withColumn("bucket", _bucket(F.col("id"), bounds))
    # the first id of each bucket goes to the bucket before it, the very first one to the last: at most MAX_BUCKETS rows
    firsts = dealt.groupBy("bucket").agg(F.max("id").alias("first"))
    every = W.orderBy("bucket")
    wraps = F.max("first").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    table = F.broadcast(firsts.select(F.coalesce(F.lag("first").over(every), wraps).alias("id"), F.col("bucket").alias("guards")))
    heads = stored(known.join(table, "id").withColumn("h", F.xxhash64("text")), "heads")
    best = heads.groupBy("guards").agg(F.max("h").alias("h"))
    guards = heads.join(best, ["guards", "h"]).dropDuplicates(["guards"]).select("id", "text", F.col("guards").alias("bucket"), F.lit(1).alias("guard"))
    alone = rows.where("id is null").select("id", "text", F.lit(-1).alias("bucket"), F.lit(0).alias("guard"))
    every = dealt.withColumn("guard", F.lit(0)).unionByName(guards).select("id", "bucket", "guard", F.xxhash64("text").alias("h"), *(c.alias(name) for name, c in columns.items()))
    w = W.partitionBy("bucket").orderBy("guard", F.desc("id"), F.desc("h"))
    led = every.select("id", "guard", *columns, *(F.lead(name).over(w).alias(f"next_{name}") for name in columns)).where("guard = 0").drop("guard")
    own = alone.select("id", *(c.alias(name) for name, c in columns.items()))
    return led.unionByName(own.select("*", *(F.col(name).alias(f"next_{name}") for name in columns))).withColumnRenamed("id", id_col)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_chars, edited (the last third replaced by as much of the next document's
    beginning), fp, edited_fp, next_fp (arrays of anchors), near_edited, near_next."""
    both = with_next(docs, {"text": F.col("text"), "fp": fingerprint(F.col("text"))}, id_col, text_col)
    n = F.length("text")
    cut = (n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = both.select(id_col, n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    made = made.select("*", fingerprint(F.col("edited")).alias("edited_fp"))
    return made.select("*", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
