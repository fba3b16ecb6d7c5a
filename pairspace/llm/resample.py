"""Importance resampling of documents towards a target text collection, by hashed n-gram features."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.numbering import dense_ids
from pairspace.plans.storage import materialise

from .decontaminate import WORD_BYTES
from .rows import col, map_rows

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = (10, 100)
SEED = 2024
# words whose automaton is kept from slice to slice; beyond, the next slice starts anew
WORDS_KEPT, BYTES_KEPT = 100_000, 1_000_000

_POLYNOMIAL = 0xEDB88320
FEATURES = T.StructType().add("n_words", "long").add("buckets", T.ArrayType(T.IntegerType()))


def _one_zero_bit(column: np.ndarray) -> np.ndarray:
    return (column >> np.uint32(1)) ^ np.where(column & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))


def _zero_bytes(doublings: int) -> list[np.ndarray]:
    """Tables that move a checksum over 1, 2, 4 ... zero bytes, one 4 x 256 table for each power of two."""
    image = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        image = _one_zero_bit(image)
    tables = []
    for _ in range(doublings):
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                table[byte, np.arange(256) >> bit & 1 == 1] ^= image[8 * byte + bit]
        tables.append(table)
        image = _moved(table, image)
    return tables


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


_TABLES = _zero_bytes(31)


def joined_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """Checksums of concatenations, from the checksums of both parts and the length of the second."""
    out = first.astype(np.uint32)
    for k, table in enumerate(_TABLES):
        moves = np.flatnonzero(second_bytes >> k & 1)
        if len(moves):
            out[moves] = _moved(table, out[moves])
        if not (second_bytes >> (k + 1)).any():
            break
    return out ^ second.astype(np.uint32)


class WordScanner:
    """An automaton over the distinct words of the texts, each between two blanks, with the checksum and length of each.

    The texts of a slice are scanned in one go. A word that is not yet in the automaton has the automaton built
    again, with the slice's words added; one of over ``kept`` words (or ``kept_bytes``) is given up for the slice's own.
    """

    def __init__(self, kept: int = WORDS_KEPT, kept_bytes: int = BYTES_KEPT):
        self.kept, self.kept_bytes = kept, kept_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.crcs, self.lengths, self.bytes = [], [], 0
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def _learn(self, words: set[bytes]) -> None:
        new = words - self.known.keys()
        if not new:
            return
        if len(self.known) + len(new) > self.kept or self.bytes + sum(map(len, new)) > self.kept_bytes:
            self._forget()
            new = words
        for word in new:
            number = self.known[word] = len(self.crcs)
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
            self.crcs.append(zlib.crc32(word))
            self.lengths.append(len(word))
            self.bytes += len(word)
        self.automaton.make_automaton()
        self.crc, self.length = np.array(self.crcs, np.uint32), np.array(self.lengths, np.int64)

    def payloads(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and checksum and length of every word in order."""
        split = [t.translate(WORD_BYTES).split() if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        if not counts.any():
            return counts, np.empty(0, np.uint32), np.empty(0, np.int64)
        self._learn(set().union(*split))
        line = " " + b" ".join(b" ".join(w) for w in split if w).decode("latin-1") + " "
        found = np.fromiter((n for _, n in self.automaton.iter(line)), np.int64, int(counts.sum()))
        return counts, self.crc[found], self.length[found]


_BLANK = zlib.crc32(b" ")


def feature_buckets(counts: np.ndarray, crc: np.ndarray, length: np.ndarray, largest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of 1 to ``largest`` adjacent words, text by text, and the number of each text's runs."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    blank, one = np.full(len(crc), _BLANK, np.uint32), np.ones(len(crc), np.int64)
    spaced, spaced_length = joined_crc(blank, crc, length), length + one
    run, texts, found = crc, [text_of], [crc % np.uint32(buckets)]
    for n in range(2, largest + 1):
        run = joined_crc(run[:-1], spaced[n - 1 :], spaced_length[n - 1 :])
        inside = text_of[: len(run)] == text_of[n - 1 :]
        texts.append(text_of[: len(run)][inside])
        found.append((run % np.uint32(buckets))[inside])
    text_of, found = np.concatenate(texts), np.concatenate(found)
    order = np.argsort(text_of, kind="stable") if largest > 1 else slice(None)
    return found[order].astype(np.int32), np.bincount(text_of, minlength=len(counts)).astype(np.int64)


def features(df: DataFrame, text: str, largest: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` with ``n_words`` and ``buckets``, one entry for each run of words of the text."""

    def start() -> Callable[..., list]:
        scanner = WordScanner()

        def work(texts: list) -> list:
            counts, crc, length = scanner.payloads(texts)
            found, sizes = feature_buckets(counts, crc, length, largest, buckets)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return [counts, pa.ListArray.from_arrays(pa.array(ends), pa.array(found))]

        return work

    return map_rows(df, [text], FEATURES, start, list(keep), rows_at_once=10_000)


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` of all rows; a task sends one row for each bucket that it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log-ratio of the smoothed shares of each bucket."""
    b = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    # one row for each bucket at most: ``buckets`` bounds what the driver gets
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def _gumbel(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, doc_id: str, text: str, target: DataFrame, target_text: str, largest: int = 1, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``, ``rank`` only of the drawn ones.

    Features are all runs of 1 to ``largest`` words; a bucket's gain compares its smoothed share in ``target`` with that
    in ``docs``. The weight of a document is the floored mean gain of its features (0 without any), its score the weight
    and a Gumbel term of its id and ``seed``, so that taking the highest scores is drawing without replacement by
    weight. Of N documents with ``min_words`` words, ``floor(share * N)`` are drawn, ties by the smaller id.

    Null and empty texts have no words, features or rank; an empty ``target`` has no counts, an empty ``docs`` gives no
    rows. Repeated rows are documents of their own with equal scores; of rows with a null id the term is that of an
    empty id, and they come first among equal scores. Other columns of either table are not read. A very long text is scanned whole, in one
    slice.

    Each text is scanned once; its buckets are stored. Only counts of ``buckets`` numbers pass through the driver and
    are sent to the tasks. The one shuffle sorts five numbers a document by score, in ranges.
    """
    spark = docs.sparkSession
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    found = materialise(features(own, "text", largest, buckets, ("doc_id",)), "resample-features")
    wanted = features(target.select(col(target_text).alias("text")), "text", largest, buckets)
    source, aim = _collected(bucket_counts(found, buckets), buckets), _collected(bucket_counts(wanted, buckets), buckets)
    table = spark.sparkContext.broadcast(gains(source, aim))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            sums = np.zeros(len(sizes), np.int64)
            gain = table.value[lists.flatten().to_numpy(zero_copy_only=False)]
            some = sizes > 0
            if len(gain):
                starts = (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[some]
                sums[some] = np.add.reduceat(gain, starts)
            weight = np.where(some, sums // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    scored = found.select("doc_id", "n_words", "buckets").mapInArrow(weigh, schema).withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed))
    late = (F.col("n_words") < min_words).alias("late")
    ranked = dense_ids(scored.withColumn("late", late), ["late", F.col("score").desc(), "doc_id", "n_features", "weight"], "place")
    counted = found.agg(F.floor(F.count(F.when(F.col("n_words") >= min_words, 1)) * share[0] / share[1]).alias("n")).first()
    rank = F.when(F.col("place") <= counted["n"], F.col("place")).alias("rank")
    return ranked.select("doc_id", "n_features", "weight", "score", rank)
