"""Language-model scores: stupid backoff over n-grams of words, computed relationally.

Every word and every n-gram up to ``ORDER`` words of all documents is counted; nothing is merged or left out.  Documents are
gathered in blocks of about ``BLOCK`` bytes.  A block lists its different n-grams by their 64-bit keys and sends them, sorted
and packed, to parts of the range of keys.  A part adds the counts of all blocks up and answers each of them with what the
other blocks have, in the order it was asked, so that no key travels back.  With the answers a block scores its texts, and
scores are summed per document.  A frequent n-gram is sent once per block, whatever the number of documents and
occurrences in it.  Texts and numbers are compressed before they travel.

A word scores by the longest context that others have seen: an n-gram's count leaves out the occurrences in the document
scored, and an n-gram nobody else has backs off to ``BACKOFF`` times the score of the shorter one; at last to the word's share
of all words.  Log scores are whole millionths of log10, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, WordHashes, field, id_type

#: Words of the longest n-gram.
ORDER = 3
BACKOFF = 0.4
#: Log scores are summed as whole numbers of this part of one.
UNIT = 1e6
#: Bytes of text of a block; a part of the keys takes the n-grams of twice as much.
BLOCK = 8_000_000
#: The n-gram of no words, which occurs as often as there are words.
EMPTY = 0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Flipped, signed and unsigned numbers have one order.
_SIGN = np.uint64(1 << 63)


def _longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams that are one word longer."""
    x = keys * _ODD + words
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Block:
    """The n-grams of some texts.

    ``keys`` and ``counts`` are the different n-grams, sorted by key.  ``at[k]`` numbers the n-gram of ``k + 1`` words that ends at
    each word and ``inside[k]`` says whether it lies in one text.
    """

    def __init__(self, texts: list[str | None], order: int):
        hashes = WordHashes()
        own = [hashes.array(WORD.findall(t)) if t else np.empty(0, np.uint64) for t in texts]
        self.lengths = np.array([len(x) for x in own], np.int64)
        words = np.concatenate([np.empty(0, np.uint64), *own])
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        grams, self.inside = [words], [np.ones(len(words), bool)]
        for k in range(1, order):
            keys = np.zeros(len(words), np.uint64)
            keys[1:] = _longer(grams[-1][:-1], words[1:])
            grams.append(keys)
            self.inside.append(place >= k)
        found = np.concatenate([g[i] for g, i in zip(grams, self.inside, strict=True)])
        self.keys, numbers, self.counts = np.unique(found.view(np.int64), return_inverse=True, return_counts=True)
        self.at, start = [], 0
        for i in self.inside:
            at = np.zeros(len(words), np.int64)
            at[i] = numbers[start : (start := start + int(i.sum()))]
            self.at.append(at)

    def scores(self, totals: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Log score and number of words that back off, for each text; ``totals`` are the counts of ``keys`` everywhere."""
        n = len(self.text)
        log, open_, backed = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
        weight = np.ones(n)
        for k in range(len(self.at) - 1, 0, -1):
            inside = np.flatnonzero(self.inside[k])
            _, which, counts = np.unique(self.text[inside] * len(self.keys) + self.at[k][inside], return_inverse=True, return_counts=True)
            own = np.zeros(n, np.int64)
            own[inside] = counts[which]
            here = inside[open_[inside]]
            others = totals[self.at[k][here]] - own[here]
            seen = others > 0
            at_seen = here[seen]
            log[at_seen] = np.rint(UNIT * np.log10(weight[at_seen] * others[seen] / totals[self.at[k - 1][at_seen - 1]]))
            open_[at_seen] = False
            weight[here[~seen]] *= BACKOFF
            backed[here[~seen]] = 1
        left = np.flatnonzero(open_)
        log[left] = np.rint(UNIT * np.log10(weight[left] * totals[self.at[0][left]] / max(words, 1)))
        sums, off = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64)
        np.add.at(sums, self.text, log)
        np.add.at(off, self.text, backed)
        return sums, off


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers with their bytes of equal place side by side, compressed."""
    return pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * size, "zstd", asbytes=True), np.uint8)
    return planes.reshape(8, size).T.copy().view("<u8").reshape(size)


def _texts(rows: pa.Table) -> pa.Table:
    """``id, text`` of one block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["rows"]])


def _asked(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block, ``EMPTY`` too, as unsigned numbers in rising order, and their counts in it."""
    at = np.searchsorted(block.keys, EMPTY)
    keys = np.insert(block.keys, at, EMPTY).view(np.uint64) ^ _SIGN
    return keys, np.insert(block.counts, at, block.lengths.sum())


_GRAMS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_OTHERS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("others", pa.binary())])


def _explode(order: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _asked(Block(_texts(rows)["text"].to_pylist(), order))
        part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        stops = np.append(starts[1:], len(keys))
        number = rows["block"][0].as_py()
        columns = zip(*[
            (int(part[a]), number, int(b - a), packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counts[a:b]))
            for a, b in zip(starts, stops, strict=True)
        ], strict=True)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GRAMS, strict=True)], schema=_GRAMS)

    return run


def _unpacked_grams(rows: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of packed rows, their keys and their counts."""
    sizes = rows["size"].to_pylist()
    keys = [np.cumsum(unpacked(x.as_py(), n), dtype=np.uint64) for x, n in zip(rows["keys"], sizes, strict=True)]
    counts = [unpacked(x.as_py(), n) for x, n in zip(rows["counts"], sizes, strict=True)]
    return sizes, np.concatenate(keys), np.concatenate(counts).astype(np.int64)


def _answer(rows: pa.Table) -> pa.Table:
    sizes, keys, counts = _unpacked_grams(rows)
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    others = np.empty(len(keys), np.int64)
    others[order] = np.repeat(np.add.reduceat(counts[order], heads), np.diff(heads, append=len(keys)))
    others -= counts
    blobs = [packed(x) for x in np.split(others, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([rows["part"], rows["block"], rows["size"], pa.chunked_array([pa.array(blobs, pa.binary())])], schema=_OTHERS)


def _listed(rows: pa.Table) -> pa.Table:
    sizes, keys, counts = _unpacked_grams(rows)
    names = [pa.field(c, pa.int64(), nullable=False) for c in ("key", "block", "n")]
    columns = (keys ^ _SIGN).view(np.int64), np.repeat(rows["block"].to_numpy(), sizes), counts
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=pa.schema(names))


def _score(order: int, out: pa.Schema):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            raise ValueError("the documents came in other blocks when they were read again")
        texts, answers = _texts(rows), answers.sort_by("part")
        block = Block(texts["text"].to_pylist(), order)
        others = [unpacked(x.as_py(), n) for x, n in zip(answers["others"], answers["size"].to_pylist(), strict=True)]
        others = np.concatenate(others).astype(np.int64)
        at = int(np.searchsorted(block.keys, EMPTY))
        words = int(block.lengths.sum() + others[at])
        sums, backed = block.scores(block.counts + np.delete(others, at), words)
        return pa.Table.from_arrays([texts["id"].combine_chunks(), pa.array(block.lengths), pa.array(sums), pa.array(backed)], schema=out)

    return run


def gram_parts(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """``part, block, size, keys, counts``: the different n-grams of each block, packed by parts of the range of keys."""
    return blocks.groupBy("block").applyInArrow(_explode(order, parts), "part long, block long, size long, keys binary, counts binary")


def gram_rows(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, block, n``: the different n-grams of each block; ``EMPTY`` counts its words."""
    return gram_parts(blocks, order, 1).groupBy("block").applyInArrow(_listed, "key long not null, block long not null, n long not null")


def replies(grams: DataFrame) -> DataFrame:
    """``part, block, size, others``: how often other blocks have each n-gram of a packed row, in its order.

    Keys are spread evenly and a block has a key once, so a part's size is bounded by that of the texts per part.
    """
    return grams.groupBy("part").applyInArrow(_answer, "part long, block long, size long, others binary")


def in_blocks(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """``block, rows``: rows that follow each other in a partition, of ``size`` bytes of text or one row more, compressed.

    A block is named by its content and place, so if a task is repeated and meets other rows, the names tell.
    """
    rows = docs.select(field(docs, id, "id"), field(docs, text, "text"))
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_, blocks = [], 0, 0

        def given() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            blob = sink.getvalue().to_pybytes()
            name = xxhash.xxh3_64_intdigest(blob, (TaskContext.get().partitionId() << 32) + blocks) - (1 << 63)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], schema=schema)

        for batch in batches:
            # a row counts one byte more than its text, so that empty ones fill blocks too
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1)
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + size - bytes_)) + 1)
                held.append(batch.slice(start, stop - start))
                bytes_ += int(ends[stop - 1]) - before
                start = stop
                if bytes_ >= size:
                    yield given()
                    held, bytes_, blocks = [], 0, blocks + 1
        if held:
            yield given()

    return rows.mapInArrow(run, "block long, rows binary")


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, and one for each row."""
    return docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(field(docs, text, "text")), F.lit(0)) + 1), F.lit(0))).first()[0]


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score, mean_log_score``; one row per document id.

    A word is scored by the ``order - 1`` words before it, as far as the text has them; ``n_backed_off`` counts the words scored by
    fewer.  Null and empty texts have no words, score 0 and a null mean.  Rows with equal ids (null is an id) are parts
    of one document: their words and scores add up, and only the row's own occurrences are left out of an n-gram's count.
    The result does not depend on ``block_bytes``.
    """
    import pyspark.sql.pandas.types as arrow_types

    blocks = in_blocks(docs, id, text, block_bytes)
    parts = max(1, -(-text_bytes(docs, text) // (2 * block_bytes)))
    out = StructType([StructField("id", id_type(docs, id))] + [StructField(c, LongType()) for c in ("n_words", "sum", "backed")])
    answered = replies(gram_parts(blocks, order, parts)).groupBy("block")
    scored = blocks.groupBy("block").cogroup(answered).applyInArrow(_score(order, arrow_types.to_arrow_schema(out)), out)
    summed = scored.groupBy("id").agg(F.sum("n_words").alias("n_words"), F.sum("backed").alias("n_backed_off"), F.sum("sum").alias("total"))
    total = F.col("total") / F.lit(UNIT)
    return summed.select(
        F.col("id").alias("doc_id"), "n_words", "n_backed_off", total.alias("log_score"), (total / F.nullif("n_words", F.lit(0))).alias("mean_log_score")
    )
