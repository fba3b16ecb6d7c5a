"""Personal data: patterns for the entities, corpus co-occurrence for the terms that reveal them.

Entities (mail addresses, IP addresses, card and phone numbers) are found by
patterns. A term near an entity may give it away without being one itself. How
strongly term t discloses entity c is the information t gives about c, relative to all there is:
``log2(P(c, t) / (P(c) P(t))) / -log2 P(c)``, estimated from all texts; 1 means that t never occurs without c.
Identical contexts weigh once in all three, and P(c, t) is discounted by the chance that all contexts of a pair are accidents.
Terms at or over ``generalise_at`` are replaced by the kind of what they reveal, from ``remove_at`` on they are removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.storage import materialise

from .rows import col, map_rows

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 5
# how likely a single context is an accident; k different ones all are with the k-th power
CHANCE = 2 / 3
GENERALISE_AT = 0.9
REMOVE_AT = 0.97
# terms of one pass; more are looked for in several passes
TERMS_AT_ONCE = 500_000
# rows whose words are counted together before Spark sums them up
ROWS_COUNTED = 1_000

# Fixed values of the contract: the patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
# kinds of rows that count a term's occurrences
NEARBY, WITHIN = -1, -2

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, in linear time: from one @ to the next."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of all entities, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(map(small_part, m.group().split("."))):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def coded(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def short_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def free_terms(text: str, spans: list[Span]) -> tuple[list[tuple[int, str]], list[str]]:
    """``(start, term)`` of the terms that touch no entity, and the terms that do."""
    covered: list[list[int]] = []
    for a, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    free, inside, i = [], [], 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i < len(covered) and covered[i][0] < b:
            inside.append(m.group().lower())
        else:
            free.append((a, m.group().lower()))
    return free, inside


def contexts(text: str, near: int) -> list[tuple[str, int, int, int]]:
    """``(term, entity, kind, context)`` for every term within ``near`` terms of an entity.

    The context of a term is that of all entities it is near to. Kind ``NEARBY`` stands for one occurrence of the term near any entities,
    kind ``WITHIN`` for one inside an entity.
    """
    spans = base_spans(text)
    if not spans:
        return []
    free, inside = free_terms(text, spans)
    starts = [a for a, _ in free]
    out = [(t, 0, WITHIN, 0) for t in inside]
    around: dict[int, set[tuple[int, int, int]]] = {}
    for a, b, k in spans:
        first, last = max(0, bisect_left(starts, a) - near), bisect_left(starts, b) + near
        terms = [t for _, t in free[first:last]]
        value = text[a:b].lower() if k == 0 else NO_DIGIT.sub("", text[a:b]) if k > 1 else text[a:b]
        entity, place = short_hash(f"{KINDS[k]}:{value}"), short_hash(" ".join(terms))
        # the empty term stands for the occurrence itself
        out.append(("", entity, k, place))
        for i in range(first, first + len(terms)):
            around.setdefault(i, set()).add((entity, k, place))
    for i, every in around.items():
        term, place = free[i][1], short_hash(repr(sorted(every)))
        out += [(term, entity, k, place) for entity, k in {(e, k) for e, k, _ in every}]
        out.append((term, 0, NEARBY, place))
    return out


PAIR = T.StructType().add("term", "string").add("entity", "long").add("kind", "integer").add("place", "long")
COUNT = T.StructType().add("term", "string").add("n", "long")


def revealing_terms(
    docs: DataFrame, text: str, near: int = NEAR, chance: float = CHANCE, generalise_at: float = GENERALISE_AT
) -> DataFrame:
    """``term, kind, disclosure`` of the terms that disclose an entity at or over ``generalise_at``.

    All texts count. Identical contexts (the terms within ``near`` terms, and the entity) weigh once, so that copies of one
    passage are no evidence; occurrences far from any entity weigh one each, those inside an entity nothing. A term
    needs no number of contexts: the joint count k of term and entity is taken as ``k * (1 - chance ** k)``.
    Terms are runs of three or more letters in lower case; an entity is a value, not a kind.
    ``kind`` is that of the most strongly disclosed entity (of equals the first of ``KINDS``).
    """
    texts = docs.select(col(text).alias("text"))

    def start_pairs() -> Callable[..., list[list]]:
        def work(batch: list) -> list[list]:
            rows = [[] if t is None else contexts(t.decode(), near) for t in batch]
            return [[[dict(zip(("term", "entity", "kind", "place"), x, strict=True)) for x in r] for r in rows]]

        return work

    seen = map_rows(texts, ["text"], T.StructType().add("pairs", T.ArrayType(PAIR)), start_pairs, [])
    seen = seen.select(F.explode("pairs").alias("p")).select("p.*")
    seen = materialise(seen.groupBy("term", "entity", "kind", "place").agg(F.count("*").alias("n")), "pii-contexts")
    entities = seen.filter("term = ''").groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = seen.filter("term <> '' and kind >= 0").groupBy("term", "entity", "kind").agg(F.count("*").alias("joint"))
    pairs = materialise(pairs.join(entities, "entity"), "pii-pairs")
    # what all occurrences of a term count too much
    surplus = F.sum(F.when(F.col("kind") == NEARBY, F.col("n") - 1).otherwise(F.col("n"))).alias("surplus")
    surpluses = seen.filter("kind < 0").groupBy("term").agg(surplus)

    def start_counts() -> Callable[..., list[list]]:
        def work(batch: list) -> list[list]:
            out: list = []
            for i in range(0, len(batch), ROWS_COUNTED):
                counts: Counter[str] = Counter()
                for t in batch[i : i + ROWS_COUNTED]:
                    if t is not None:
                        counts.update(TERM.findall(t.decode()))
                lower: Counter[str] = Counter()
                for w, n in counts.items():
                    lower[w.lower()] += n
                # one row carries the counts of several; the sum of all words goes under the empty term
                said = [{"term": w, "n": n} for w, n in lower.items()] + [{"term": "", "n": counts.total()}]
                out += [said] + [[] for _ in batch[i + 1 : i + ROWS_COUNTED]]
            return [out]

        return work

    counts = map_rows(texts, ["text"], T.StructType().add("counts", T.ArrayType(COUNT)), start_counts, [])
    counts = counts.select(F.explode("counts").alias("c")).select("c.*")
    wanted = pairs.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    totals = materialise(counts.groupBy("term").agg(F.sum("n").alias("n")).join(wanted, "term", "left_semi"), "pii-terms")
    # scalars of one row
    words = totals.filter("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).collect()[0]["words"]
    words -= surpluses.agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("words")).collect()[0]["words"]
    information = -F.log2(F.col("n_entity") / F.lit(max(words, 1)))
    joint = F.col("joint") * (1 - F.pow(F.lit(chance), F.col("joint")))
    disclosed = (information + F.log2(F.least(F.lit(1.0), joint / (F.col("n") - F.col("surplus"))))) / information
    scored = pairs.join(totals, "term").join(surpluses, "term").withColumn("disclosure", F.when(information > 0, disclosed).otherwise(F.lit(0.0)))
    best = F.max(F.struct("disclosure", (-F.col("kind")).alias("kind")))
    return (
        scored.filter(F.col("disclosure") >= generalise_at)
        .groupBy("term")
        .agg(best.alias("best"))
        .select("term", (-F.col("best.kind")).alias("kind"), F.col("best.disclosure").alias("disclosure"))
    )


RESULT = T.StructType()
for _kind in KINDS[:4]:
    RESULT = RESULT.add(f"n_{_kind}", "long")
RESULT = RESULT.add("base_sha256", "string").add("spans", "string")


def sanitise(
    docs: DataFrame, text: str, terms: DataFrame | None = None, remove_at: float = REMOVE_AT, rewrite: bool = True,
    terms_at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """``docs`` with counts per base kind, ``base_sha256``, all ``spans`` and, with ``rewrite``, ``clean_text``.

    ``terms`` come from ``revealing_terms`` (over the same texts when left out). In ``clean_text`` an entity is replaced by
    its kind in brackets, a revealing term by the kind it reveals, or by nothing from ``remove_at`` on;
    of overlapping spans the first stays. Offsets are code points, ends are exclusive.

    A null text counts as an empty one: no spans, ``clean_text`` null. Repeated rows give the same result each; an
    empty table stays empty; input columns of the added names are replaced. Rows are not shuffled; terms are sent to the
    tasks in shares of at most about ``terms_at_once``, each share in a pass of its own.
    """
    terms = materialise(revealing_terms(docs, text) if terms is None else terms, "pii-revealing")
    shares = max(1, -(-terms.count() // terms_at_once))
    added = T.StructType([*RESULT, T.StructField("clean_text", T.StringType())]) if rewrite else RESULT
    docs = docs.drop("_terms").withColumn("_terms", F.lit(None).cast("array<string>"))
    kept = [c for c in docs.columns if c != "_terms"]
    for i in range(shares):
        share = terms if shares == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(shares)) == i)
        listed = {r["term"]: (r["kind"], r["disclosure"]) for r in share.collect()}
        sent = docs.sparkSession.sparkContext.broadcast(listed)
        docs = _pass(docs, text, sent, i == shares - 1, added, kept, remove_at)
    return docs


def _pass(docs: DataFrame, text: str, sent: object, last: bool, added: T.StructType, kept: list[str], remove_at: float) -> DataFrame:
    def start() -> Callable[..., list[list]]:
        terms = sent.value

        def places(t: str) -> list[tuple[int, int, int, float]]:
            if not terms:
                return []
            hits = ((m.span(), terms.get(m.group().lower())) for m in TERM.finditer(t))
            return [(a, b, hit[0], hit[1]) for (a, b), hit in hits if hit]

        def collect(texts: list, had: list) -> list[list]:
            return [[(h or []) + [f"{a}:{b}:{k}:{d!r}" for a, b, k, d in places((t or b"").decode())] for t, h in zip(texts, had, strict=True)]]

        def finish(texts: list, had: list) -> list[list]:
            out: list[list] = [[] for _ in added]
            for raw, h in zip(texts, had, strict=True):
                t = (raw or b"").decode()
                base = base_spans(t)
                near = [(int(a), int(b), int(k), float(d)) for a, b, k, d in (x.split(":") for x in h or [])] + places(t)
                covered = [(a, b) for a, b, _ in base]
                near = [x for x in near if not any(a < x[1] and x[0] < b for a, b in covered)]
                every = sorted(base + [(a, b, 4) for a, b, _, _ in near], key=lambda s: (s[0], s[2], s[1]))
                row = [sum(k == kind for _, _, k in base) for kind in range(4)]
                row += [hashlib.sha256(coded(base).encode()).hexdigest(), coded(every)]
                if len(added) > len(row):
                    row.append(None if raw is None else rewritten(t, base, near))
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return out

        def rewritten(t: str, base: list[Span], near: list[tuple[int, int, int, float]]) -> str:
            swaps = [(a, b, f"[{KINDS[k]}]") for a, b, k in base]
            swaps += [(a, b, "" if d >= remove_at else f"[{KINDS[k]}]") for a, b, k, d in near]
            parts, at = [], 0
            for a, b, new in sorted(swaps):
                if a >= at:
                    parts += [t[at:a], new]
                    at = b
            return "".join(parts) + t[at:]

        return finish if last else collect

    if not last:
        return map_rows(docs, [text, "_terms"], T.StructType().add("_terms", T.ArrayType(T.StringType())), start)
    return map_rows(docs, [text, "_terms"], added, start, kept)
