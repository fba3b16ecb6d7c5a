"""Passages of benchmark items in documents, found by an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.storage import materialise

from .rows import col, map_rows

WINDOW = 10
# windows of one automaton, about 65 bytes each; a larger benchmark is scanned for in several passes
WINDOWS_AT_ONCE = 400_000

# Fixed values of the contract: ASCII letters are lowered, words are digits, ASCII letters and everything beyond ASCII.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

HITS = T.StructType().add("first", "integer").add("last", "integer").add("item", "string")


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(WORD_BYTES).split()


def item_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """``win, items``: every run of ``window`` words of an item (all words of a shorter one) and the items that have it."""

    def start() -> Callable[..., list[list]]:
        def windows(texts: list) -> list[list]:
            found = []
            for text in texts:
                w = [x.decode() for x in words_of(text)]
                found.append([" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else [])
            return [found]

        return windows

    added = T.StructType().add("wins", T.ArrayType(T.StringType()))
    made = map_rows(items.select(col(item_id).cast("string").alias("item"), col(text).alias("text")), ["text"], added, start, ["item"])
    return (
        made.filter(F.col("item").isNotNull())
        .select(F.explode(F.array_distinct("wins")).alias("win"), "item")
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _automaton(windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Over bytes read as Latin-1, with a blank on both sides of every word."""
    found = ahocorasick.Automaton()
    for win, items in windows:
        found.add_word(f" {win.encode().decode('latin-1')} ", (win.count(" ") + 1, items))
    found.make_automaton()
    return found


def _scan(docs: DataFrame, text: str, windows: list[tuple[str, list[str]]], last: bool) -> DataFrame:
    """One pass with one automaton; earlier hits come in column ``_hits`` and are added to."""
    share = docs.sparkSession.sparkContext.broadcast(windows)

    def start() -> Callable[..., list[list]]:
        automaton = _automaton(share.value) if share.value else None

        def hits_of(joined: bytes) -> list[tuple[int, int, str]]:
            found = []
            if automaton is None:
                return found
            matches = list(automaton.iter(joined.decode("latin-1")))
            if matches:
                # words that end before each place
                before = np.cumsum(np.frombuffer(joined, np.uint8) == 0x20)
                for end, (n, items) in matches:
                    stop = int(before[end]) - 1
                    found += [(stop - n, stop, item) for item in items]
            return found

        def scan(texts: list, earlier: list) -> list[list]:
            hits = []
            for text, had in zip(texts, earlier, strict=True):
                joined = b" " + b" ".join(words_of(text)) + b" "
                hits.append([(h["first"], h["last"], h["item"]) for h in had or []] + hits_of(joined))
            return [[[dict(zip(("first", "last", "item"), h, strict=True)) for h in x] for x in hits]]

        def finish(texts: list, earlier: list) -> list[list]:
            n_words, n_hit, n_items, sha, dirty, spans, items_out = [], [], [], [], [], [], []
            for text, had in zip(texts, earlier, strict=True):
                joined = b" ".join(words_of(text))
                total = joined.count(b" ") + 1 if joined else 0
                hits = [(h["first"], h["last"], h["item"]) for h in had or []] + hits_of(b" " + joined + b" ")
                runs: list[list[int]] = []
                for a, b in sorted({(a, b) for a, b, _ in hits}):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                names = sorted({i for _, _, i in hits})
                n_words.append(total)
                n_hit.append(sum(b - a for a, b in runs))
                n_items.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                dirty.append(bool(runs))
                items_out.append(names)
                places = [m.span() for m in WORD.finditer(lower_ascii(text.decode()))] if runs else []
                spans.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs])
            return [n_words, n_hit, n_items, sha, dirty, items_out, spans]

        return finish if last else scan

    if not last:
        return map_rows(docs, [text, "_hits"], T.StructType().add("_hits", T.ArrayType(HITS)), start)
    return map_rows(docs, [text, "_hits"], RESULT, start, [c for c in docs.columns if c != "_hits"])


SPAN = T.StructType().add("start", "integer").add("end", "integer")
RESULT = (
    T.StructType()
    .add("n_words", "long")
    .add("n_hit", "long")
    .add("n_items", "long")
    .add("items_sha256", "string")
    .add("contaminated", "boolean")
    .add("items", T.ArrayType(T.StringType()))
    .add("hit_spans", T.ArrayType(SPAN))
)
LOWER = {i: i + 32 for i in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.translate(LOWER)


def find_benchmark(
    docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW,
    windows_at_once: int = WINDOWS_AT_ONCE,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans``.

    ``hit_spans`` are the runs of hit words as code points of the original text. Null and empty texts have
    no words and no hits, as have texts when no item has words; an item without id is ignored, repeated items are one.
    Rows are scanned one by one, repeated ones again; nothing of the documents is shuffled. Input columns of the
    added names are replaced.

    The windows are stored and sent to the tasks in shares of at most about ``windows_at_once``; for each share the
    documents pass through one automaton, so memory is bounded for benchmarks of any size.
    """
    found = materialise(item_windows(items, item_id, item_text, window), "item-windows")
    shares = max(1, -(-found.count() // windows_at_once))
    docs = docs.drop("_hits").withColumn("_hits", F.lit(None).cast(T.ArrayType(HITS)))
    for i in range(shares):
        share = found if shares == 1 else found.filter(F.pmod(F.xxhash64("win"), F.lit(shares)) == i)
        docs = _scan(docs, text, [(r["win"], r["items"]) for r in share.collect()], i == shares - 1)
    return docs
