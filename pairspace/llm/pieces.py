"""SentencePiece encoding and decoding by a Viterbi search over shared prefixes.

Distinct marked words of a batch are sorted, which lines them up as the depth-first
walk through their trie; the forward states of a prefix that two neighbours
share are kept and only the rest of a word is searched.

A forward state of a prefix is the last piece of its best segmentation. For a unigram
model it is the one with the highest sum of scores. For a BPE model scores are merge
ranks and must not be added: there the best segmentation is the one that merging gives, a step
from piece to piece is allowed exactly if merging would leave the two apart,
and just one allowed segmentation exists for every prefix. Both run through the same lattice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import map_rows

MARK = "▁"
# words remembered by a task, so that its memory is bounded
REMEMBERED = 220_000
UNIGRAM, BPE = 1, 2


@dataclass
class Vocabulary:
    """What encoding needs of a model: normal pieces, byte pieces and the model's kind."""

    kind: int
    surface: list[bytes]
    ids: dict[str, int]
    scores: list[float]
    bytes_at: list[int]
    unknown: int
    # of a piece that merging makes: its last merge
    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    # normal pieces and all their endings (-1: an ending only)
    endings: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file; raises ValueError for models whose normal pieces join words or that change text."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name != "identity" or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can be used here")
        model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        bytes_at = [-1] * 256
        surface = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(pieces[i][3:5], 16)
                bytes_at[value], surface[i] = i, bytes([value])
        for i in plain:
            surface[i] = pieces[i].replace(MARK, " ").encode()
        surface[model.unk_id()] = " ⁇ ".encode()
        found = Vocabulary(proto.trainer_spec.model_type, surface, {pieces[i]: i for i in plain}, [model.get_score(i) for i in range(n)], bytes_at, model.unk_id())
        return found.prepared()

    def prepared(self) -> Vocabulary:
        if any(MARK in p[1:] and set(p) != {MARK} for p in self.ids):
            raise ValueError("a piece goes beyond a word")
        if self.kind == BPE and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a letter of a piece is no piece")
        reached = {}
        for piece, i in self.ids.items():
            if self.kind == UNIGRAM or len(piece) == 1 or set(piece) == {MARK}:
                reached[piece] = i
            else:
                parts, last = merge(piece, self)
                if len(parts) == 1:
                    reached[piece] = i
                    self.split[i] = last
        for piece, i in reached.items():
            if set(piece) == {MARK} and len(piece) > 1:
                continue  # runs of blanks are merged by themselves
            self.endings[piece] = i
            for at in range(1, len(piece)):
                self.endings.setdefault(piece[at:], -1)
        return self


def merge(text: str, v: Vocabulary) -> tuple[list[str], tuple[int, int] | None]:
    """The pieces of a short text by merging the best pair until none is left, and the last merge."""
    parts, last = list(text), None
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            joined = v.ids.get(parts[i] + parts[i + 1])
            if joined is not None and (best is None or v.scores[joined] > best):
                best, at = v.scores[joined], i
        if at < 0:
            return parts, last
        last = (v.ids[parts[at]], v.ids[parts[at + 1]])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes texts with one vocabulary; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.v = vocabulary
        self.names = {i: p for p, i in vocabulary.ids.items()}
        self.words: dict[str, bytes] = {}
        # by both ids in one number, which needs half the memory of a tuple
        self.pairs: dict[int, bool] = {}
        self.blanks: dict[int, bytes] = {}
        self.remembered = remembered

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces ``a`` and ``b`` side by side.

        Undoes merges from the last one back; at each state the pair across the border
        must not have been a better merge than the one that comes next.
        """
        v, names, split = self.v, self.names, self.v.split
        x, y = a, b
        across = v.ids.get(names[x] + names[y])
        if across is not None:
            return False
        while True:
            sx = v.scores[x] if x in split else None
            sy = v.scores[y] if y in split else None
            if sx is None and sy is None:
                return True
            # the lower score was merged later; of equals, the left one is merged first
            if sx is not None and (sy is None or sx < sy):
                x = split[x][1]
                across = v.ids.get(names[x] + names[y])
                if across is not None and v.scores[across] > sx:
                    return False
            else:
                y = split[y][0]
                across = v.ids.get(names[x] + names[y])
                if across is not None and v.scores[across] >= sy:
                    return False

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words, given without their mark, in one walk through their trie."""
        v, endings, scores, pairs = self.v, self.v.endings, self.v.scores, self.pairs
        bpe = v.kind == BPE
        lowest = min(scores) - 10
        before = ""
        # per prefix length: last piece (-1: a letter that is no piece, -2: none), where it begins, best sum
        last, begin, total = [-2], [0], [0.0]
        for word in sorted(words):
            s = MARK + word
            keep = 0
            top = min(len(s), len(before))
            while keep < top and s[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], begin[keep + 1 :], total[keep + 1 :]
            before = s
            for i in range(keep + 1, len(s) + 1):
                found, start, best = -1, i - 1, (0.0 if bpe else total[i - 1] + lowest)
                j = i - 1
                while j >= 0:
                    piece = endings.get(s[j:i])
                    if piece is None:
                        break
                    if piece >= 0:
                        if bpe:
                            prev = last[j]
                            if prev < 0:
                                ok = True
                            else:
                                pair = prev << 32 | piece
                                ok = pairs.get(pair)
                                if ok is None:
                                    ok = pairs[pair] = self.apart(prev, piece)
                            if ok:
                                found, start = piece, j
                                break
                        elif total[j] + scores[piece] > best or found < 0:
                            found, start, best = piece, j, total[j] + scores[piece]
                    j -= 1
                last.append(found)
                begin.append(start)
                total.append(best)
            out: list[int] = []
            at = len(s)
            while at > 0:
                if last[at] >= 0:
                    out.append(last[at])
                else:
                    out += [x if x >= 0 else v.unknown for x in (v.bytes_at[b] for b in reversed(s[begin[at] : at].encode()))]
                at = begin[at]
            self.words[word] = np.array(out[::-1], np.int32).tobytes()

    def run(self, n: int) -> bytes:
        """``n`` blanks in a row."""
        if n not in self.blanks:
            if self.v.kind == BPE:
                parts = merge_blanks(n, self.v)
            else:
                parts = best_blanks(n, self.v)
            self.blanks[n] = np.array(parts, np.int32).tobytes()
        return self.blanks[n]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text; None stays None and an empty text has none."""
        split = [None if t is None else t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        if len(self.words) > self.remembered:
            self.words.clear()
        if len(self.pairs) > 3 * self.remembered:
            self.pairs.clear()
        self.learn({w for words in split if words for w in words if w} - self.words.keys())
        return [None if w is None else np.frombuffer(self._join(w), np.int32) for w in split]

    def _join(self, words: list[str]) -> bytes:
        if "" not in words:
            return b"".join(map(self.words.__getitem__, words))
        mark = self.v.ids[MARK].to_bytes(4, "little")
        out, blanks = [], 0
        for word in words:
            blanks += 1
            if word:
                coded = self.words[word]
                if blanks > 1:
                    if coded[:4] == mark:
                        coded = self.run(blanks) + coded[4:]
                    else:
                        coded = self.run(blanks - 1) + coded
                out.append(coded)
                blanks = 0
        if blanks:
            out.append(self.run(blanks))
        return b"".join(out)


def merge_blanks(n: int, v: Vocabulary) -> list[int]:
    """Merge ``n`` blanks: best pair first, of equals the leftmost."""
    import heapq

    size, nxt, prv = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (piece := v.ids.get(MARK * (size[i] + size[j]))) is not None:
            heapq.heappush(heap, (-v.scores[piece], i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j], nxt[i] = a + b, 0, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out, i = [], 0
    while i < n:
        out.append(v.ids[MARK * size[i]])
        i = nxt[i]
    return out


def best_blanks(n: int, v: Vocabulary) -> list[int]:
    """The runs of blanks with the highest sum of scores."""
    runs = {len(p): i for p, i in v.ids.items() if set(p) == {MARK}}
    best = [(0.0, 0)]
    for i in range(1, n + 1):
        best.append(max(((best[i - k][0] + v.scores[p], k) for k, p in runs.items() if k <= i), default=(float("-inf"), 1)))
    out = []
    while n:
        out.append(runs[best[n][1]])
        n -= best[n][1]
    return out[::-1]


def decode(ids: np.ndarray | list[int] | None, v: Vocabulary) -> str | None:
    """The text of piece ids; the blank that encoding puts before a text is taken away."""
    if ids is None:
        return None
    raw = b"".join(map(v.surface.__getitem__, ids))
    return raw.decode("utf-8", errors="replace").removeprefix(" ")


IDS = T.StructType().add("piece_ids", T.ArrayType(T.IntegerType()))


def encode_texts(docs: DataFrame, text: str, model_path: str, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``piece_ids``, the ids of each whole text.

    Null texts give null, empty ones no ids; every row is encoded by itself, so repeated rows repeat, and an empty
    table stays empty. Texts without the mark character decode to themselves. An input column ``piece_ids`` is replaced.
    The vocabulary, whose size does not depend on the data, is sent to the tasks; nothing is shuffled. A task remembers
    about ``remembered`` words.
    """
    share = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(model_path)))

    def start() -> Callable[..., list[list]]:
        encoder = Encoder(Vocabulary(**share.value), remembered)

        def work(texts: list) -> list[list]:
            out: list = []
            # a few hundred texts at a time keep the words of a batch few enough to hold
            for i in range(0, len(texts), 500):
                out += encoder.encode([None if t is None else t.decode() for t in texts[i : i + 500]])
            return [out]

        return work

    return map_rows(docs, [text], IDS, start)


def decode_ids(docs: DataFrame, ids: str, model_path: str, name: str = "decoded") -> DataFrame:
    """``docs`` with the texts of the piece ids in column ``name``; null stays null, no ids are an empty text."""
    share = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path).surface)

    def start() -> Callable[..., list[list]]:
        surface = share.value
        v = Vocabulary(BPE, surface, {}, [], [], 0)
        return lambda given: [[decode(x, v) for x in given]]

    return map_rows(docs, [ids], T.StructType().add(name, "string"), start)


def check_round_trip(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """Encode and decode in one pass: ``n_pieces``, ``ids_sha256`` (ids joined by commas) and ``same`` per row.

    ``same`` says that the decoded text is the text; both are null for a null text. Other rules as for ``encode_texts``.
    """
    share = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(model_path)))
    added = T.StructType().add("n_pieces", "long").add("ids_sha256", "string").add("same", "boolean")

    def start() -> Callable[..., list[list]]:
        encoder = Encoder(Vocabulary(**share.value))

        def work(texts: list) -> list[list]:
            counts, digests, same = [], [], []
            for i in range(0, len(texts), 500):
                said = [None if t is None else t.decode() for t in texts[i : i + 500]]
                for t, ids in zip(said, encoder.encode(said), strict=True):
                    counts.append(None if ids is None else len(ids))
                    digests.append(None if ids is None else hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                    same.append(None if ids is None else decode(ids, encoder.v) == t)
            return [counts, digests, same]

        return work

    return map_rows(docs, [text], added, start)


