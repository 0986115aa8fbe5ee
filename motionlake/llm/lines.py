"""Line deduplication across documents, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z in lower case.  Keys travel as 128-bit hashes.  They are
partitioned by ranges of the hash and sorted by hash, document (largest first) and position; streaming through a key's rows,
the first document's stay and, if the key has enough documents, the others' go.  What comes back is one compressed keep
bitmap per document (64-bit words with a dropped line only), not text.

A range cannot split one key, so very frequent keys take another way with the same result: a frequent-items sketch names at
most ``HOT`` of them, map-side aggregation counts their documents and finds the largest one, and their lines are marked where
they lie.  What the sketch leaves out holds a small share of all lines.  A wrong guess of the sketch costs time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionlake.session import settle

from .common import field, fresh

#: Fixed by the contract: least code points of a key, least documents that hold it, white space at a line's ends.
MIN_CHARS = 20
MIN_DOCS = 3
SPACE = " \t\n\x0b\x0c\r"

#: The sketch names so many keys and tracks so many.
HOT = 1000
TRACKED = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_array(text: Column) -> Column:
    """The lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def keyed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2`` of every line of ``rows`` (``doc_id, text_hash, text``) whose key is long enough."""
    lines = rows.select("doc_id", "text_hash", F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
    # a key is never longer than its line
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    keys = keys.where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(lines: DataFrame, hot: int = HOT, tracked: int = TRACKED) -> DataFrame:
    """``h1`` of at most ``hot`` keys that may hold more than a thousandth of all lines."""
    sketch = lines.agg(F.expr(f"approx_top_k(h1, {hot}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = sketch.select("n", F.inline("top"))
    return settle(found.where(F.col("count") * hot > F.col("n")).select(F.col("item").alias("h1")).limit(hot))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, hot: int = HOT, tracked: int = TRACKED) -> DataFrame:
    """``doc_id, text_hash, pos`` of the lines that go, of settled ``lines`` with document ids."""
    frequent = F.broadcast(hot_keys(lines, hot, tracked))
    # frequent keys: partial aggregates leave one row for each of the named keys
    theirs = lines.join(frequent, "h1", "left_semi")
    largest = theirs.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("_docs"), F.max("doc_id").alias("_largest"))
    largest = settle(largest.where(F.col("_docs") >= min_docs).drop("_docs"))
    gone = theirs.join(F.broadcast(largest), ["h1", "h2"]).where(F.col("doc_id") != F.col("_largest"))
    # the others: ranges of the hash, then the order hash, document, position
    rest = lines.join(frequent, "h1", "left_anti").repartitionByRange("h1", "h2")
    rest = rest.sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    key = W.partitionBy("h1", "h2")
    placed = rest.withColumn("_place", F.dense_rank().over(key.orderBy(F.desc("doc_id"))))
    placed = placed.withColumn("_docs", F.max("_place").over(key))
    places = ["doc_id", "text_hash", "pos"]
    return gone.select(places).union(placed.where((F.col("_place") > 1) & (F.col("_docs") >= min_docs)).select(places))


def keep_bitmaps(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: int = HOT, tracked: int = TRACKED) -> DataFrame:
    """``doc_id, text_hash, keep`` of the documents that lose lines; ``rows`` are ``doc_id, text_hash, text`` with ids.

    ``keep`` holds ``word, bits``: bit i of word w is 0 if line 64 w + i goes.  Words without such a bit are left out.
    """
    gone = dropped_lines(settle(keyed_lines(rows, min_chars)), min_docs, hot, tracked)
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("word", "bits")).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; all of them where it is null."""
    bits = F.map_from_entries(keep)
    words = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int"))
    # all words written out, so that a line finds its bit at once
    dense = F.transform(words, lambda w: F.coalesce(F.try_element_at(bits, w), F.lit(-1).cast("long")))
    return F.when(keep.isNull(), lines).otherwise(_by_bits(lines, dense))


def _by_bits(lines: Column, dense: Column) -> Column:
    # the bitmap enters as a one-element array, so that it is formed once and not for each line
    each = F.transform(F.array(dense), lambda d: F.filter(lines, lambda _, i: F.getbit(F.get(d, F.floor(i / 64).cast("int")), i % 64) == 1))
    return F.element_at(each, 1)


def _judged(docs: DataFrame, id: str, text: str, limits: dict) -> tuple[DataFrame, str]:
    """``docs`` with each row's bitmap, and the name of that column; null where all lines stay."""
    hash_name, keep, other_id, other_hash = fresh(docs, "_text_hash", "_keep", "_other_id", "_other_hash")
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    marked = docs.withColumn(hash_name, hashed)
    named = marked.where(F.col(f"`{id}`").isNotNull())
    rows = named.select(field(named, id, "doc_id"), F.col(hash_name).alias("text_hash"), field(named, text, "text"))
    found = keep_bitmaps(rows, **limits).select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash), F.col("keep").alias(keep))
    same = (named[f"`{id}`"] == F.col(other_id)) & (named[hash_name] == F.col(other_hash))
    joined = named.join(found, same, "left").drop(other_id, other_hash, hash_name)
    # rows without an id are compared with nothing; they take no part in the join
    rest = marked.where(F.col(f"`{id}`").isNull()).drop(hash_name).withColumn(keep, F.lit(None).cast(found.schema[keep].dataType))
    return joined.union(rest), keep


def remove_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with all its columns and rows; lines that repeat across documents are out of the text.

    Lines whose key (see above) has at least ``min_chars`` code points and stands in at least ``min_docs`` documents go,
    except in the largest id that holds it, where all of them stay.  Null text stays null, a text that loses all lines is
    empty.  Rows without id are compared with nothing and stay whole; rows with one id are one document.
    """
    judged, keep = _judged(docs, id, text, limits)
    left = F.when(F.col(keep).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept_lines(line_array(F.col(f"`{text}`")), F.col(keep)), "\n"))
    return judged.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def line_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row, by the rules of :func:`remove_repeated_lines`."""
    judged, keep = _judged(docs.select(field(docs, id, "doc_id"), field(docs, text, "text")), "doc_id", "text", limits)
    parts = judged.select("doc_id", line_array(F.col("text")).alias("_lines"), F.col(keep).alias("_bits"))
    parts = parts.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), kept_lines(F.col("_lines"), F.col("_bits")).alias("_kept"))
    digest = F.sha2(F.array_join("_kept", "\n").cast("binary"), 256)
    return parts.select("doc_id", "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), digest.alias("kept_sha256"))
