"""Prefix trie of conversations: ternary search trees in range shards, merged at the shards' borders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairspace.plans.storage import materialise

from .rows import col

# turns of one tree; a conversation longer than that is a tree of its own
SHARD_TURNS = 200_000
# bytes of joined ids that one row carries
IDS_AT_ONCE = 1_000_000
SPAN, OPENINGS = 100, 6
NOBODY = hashlib.sha256(b"").hexdigest()

SEQUENCE = T.StructType().add("keys", T.ArrayType(T.StringType())).add("sizes", T.ArrayType(T.IntegerType()))
CHUNK = T.StructType().add("whole", "string").add("conv_id", "long").add("n", "long").add("ids", "string")
CHUNK = T.StructType([*CHUNK, *SEQUENCE])
DISTINCT = T.StructType([*SEQUENCE]).add("n", "long").add("conv_id", "long").add("ends", "string")
NODE = (
    T.StructType().add("shard", "long").add("hash", "binary").add("parent_hash", "binary").add("depth", "long").add("conv_id", "long")
    .add("parent_conv_id", "long").add("n_convs", "long").add("n_children", "long").add("n_leaves", "long").add("saved_tokens", "long")
    .add("ends_sha256", "string").add("length", "long").add("on_first", "boolean").add("on_last", "boolean").add("first_length", "long")
)


def conversations(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, keys, sizes``: digest and code points of every turn, in order. A text goes no further than this."""
    said, by = F.coalesce(col(text).cast("string"), F.lit("")), F.coalesce(col(role).cast("string"), F.lit(""))
    # the length keeps role and text apart
    key = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    turns = turns.filter(col(conv_id).isNotNull())
    one = turns.select(
        col(conv_id).cast("long").alias("conv_id"),
        F.struct(col(turn).alias("turn"), by.alias("role"), key.alias("key"), F.length(said).alias("size")).alias("t"),
    )
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "t.key", "t.size").toDF("conv_id", "keys", "sizes")


def share_openings(convs: DataFrame, span: int = SPAN, openings: int = OPENINGS) -> DataFrame:
    """Every conversation c with its first ``crc32(c) % openings`` turns taken from conversation ``c - c % span``.

    The remainder has the sign of c. At most ``2 * span - 1`` conversations ask for one opening of fewer than ``openings`` turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % span
    opening = [F.slice(c, 1, openings - 1).alias(f"base_{c}") for c in ("keys", "sizes")]
    bases = convs.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), *opening)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    asked = convs.withColumns({"base": base, "h": taken.cast("int")}).join(bases, "base", "left")

    def rebuilt(c: str, kind: str) -> F.Column:
        given = F.slice(F.coalesce(f"base_{c}", F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        own = F.slice(c, F.col("h") + 1, F.size(c))
        return F.concat(given, own).alias(c)

    return asked.select("conv_id", rebuilt("keys", "string"), rebuilt("sizes", "int"))


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``whole, conv_id``: joined ids of every run of one sequence, in pieces of bounded length."""
    schema = to_arrow_schema(CHUNK)
    run: dict = {}
    ids: list[str] = []
    length = 0
    out: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["whole"] != run.get("whole") or length > IDS_AT_ONCE:
                if ids:
                    out.append(run | {"n": len(ids), "ids": ",".join(ids)})
                run, ids, length = r, [], 0
            ids.append(str(r["conv_id"]))
            length += len(ids[-1]) + 1
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    if ids:
        yield pa.RecordBatch.from_pylist([run | {"n": len(ids), "ids": ",".join(ids)}], schema=schema)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of ``whole, conv_id``: one row for each sequence, with the digest of all its ids."""
    schema = to_arrow_schema(DISTINCT)
    row: dict = {}
    digest = hashlib.sha256()
    out: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["whole"] == row.get("whole"):
                digest.update(b"," + r["ids"].encode())
                row["n"] += r["n"]
                continue
            if row:
                out.append(row | {"ends": digest.hexdigest()})
            row, digest = r, hashlib.sha256(r["ids"].encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    if row:
        yield pa.RecordBatch.from_pylist([row | {"ends": digest.hexdigest()}], schema=schema)


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """``keys, sizes, n, conv_id, ends``: each sequence once, with its members' number, smallest id and digest of ids.

    Members are sorted by range of ``whole, conv_id``, so copies of one sequence are dealt to many tasks; what is brought together are
    runs of joined ids, and a task streams over them.
    """
    keyed = rebuilt.withColumn("whole", F.md5(F.array_join("keys", "")))
    sorted_rows = keyed.repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id").select("whole", "conv_id", "keys", "sizes")
    chunks = sorted_rows.mapInArrow(_id_chunks, CHUNK)
    return chunks.repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(_joined_ids, DISTINCT)


class TernaryTree:
    """Distinct sequences of turn codes; node 0 is the root, whose siblings' trees hang on ``child``."""

    def __init__(self) -> None:
        self.code, self.less, self.more, self.child, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _added(self, code: int, parent: int) -> int:
        self.code.append(code)
        for links in (self.less, self.more, self.child):
            links.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.code) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node of the whole sequence."""
        code, less, more, child = self.code, self.less, self.more, self.child
        node = 0
        for c in sequence:
            links, at, here = child, node, child[node]
            while here >= 0 and code[here] != c:
                links, at = (less, here) if c < code[here] else (more, here)
                here = links[at]
            if here < 0:
                here = self._added(c, node)
                links[at] = here
            node = here
        return node

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """Medians first, so that the siblings' trees are balanced; the end node of each sequence."""
        ends = [0] * len(sequences)
        waiting = [(0, len(sequences))]
        for low, high in waiting:
            if low < high:
                middle = (low + high) // 2
                ends[middle] = self.insert(sequences[middle])
                waiting += [(low, middle), (middle + 1, high)]
        return ends

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        found = []
        while node >= 0:
            found.append(node)
            node = self.parent[node]
        return found[::-1]


def shard_nodes(rows: list[dict], shard: int) -> dict[str, list]:
    """All nodes of the distinct sequences of one shard, which come sorted.

    Nodes on the way to the first or the last sequence may go on in other shards: they carry the digest of their prefix, and their
    numbers are this shard's part of the whole.
    """
    by_code = sorted({k for r in rows for k in r["keys"]})
    codes = {k: i for i, k in enumerate(by_code)}
    sizes = [0] * len(codes)
    for r in rows:
        for k, n in zip(r["keys"], r["sizes"], strict=True):
            sizes[codes[k]] = n
    tree = TernaryTree()
    ends = tree.insert_sorted([[codes[k] for k in r["keys"]] for r in rows])
    count = len(tree.code)
    members, least, children, leaves, saved = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    digest: list[str | None] = [None] * count
    for end, r in zip(ends, rows, strict=True):
        members[end], least[end], digest[end] = r["n"], r["conv_id"], r["ends"]
    # a node is made after its parent: backwards, every node is complete when its turn comes
    for node in range(count - 1, -1, -1):
        if children[node] == 0:
            leaves[node] = 1
        if node:
            saved[node] += (members[node] - 1) * sizes[tree.code[node]]
            up = tree.parent[node]
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    first, last = tree.path(ends[0]), tree.path(ends[-1])
    hashes: dict[int, bytes] = {}
    for way in (first, last):
        for node in way:
            if node not in hashes:
                hashes[node] = hashlib.md5(hashes[tree.parent[node]] + by_code[tree.code[node]].encode()).digest() if node else bytes(16)
    first_length, total = {}, 0
    for node in first:
        total += sizes[tree.code[node]] if node else 0
        first_length[node] = total
    on_last = set(last)
    inner = range(count)
    return {
        "shard": [shard] * count,
        "hash": [hashes.get(i) for i in inner],
        "parent_hash": [hashes.get(tree.parent[i]) for i in inner],
        "depth": tree.depth,
        "conv_id": least,
        "parent_conv_id": [least[tree.parent[i]] if i else None for i in inner],
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "ends_sha256": digest,
        "length": [sizes[c] if c >= 0 else 0 for c in tree.code],
        "on_first": [i in first_length for i in inner],
        "on_last": [i in on_last for i in inner],
        "first_length": [first_length.get(i) for i in inner],
    }


def _builder(shard_turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One tree for about every ``shard_turns`` turns of a sorted partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(NODE)
        shard = TaskContext.get().partitionId() << 32
        rows: list[dict] = []
        held = 0

        def made() -> pa.RecordBatch:
            nodes = shard_nodes(rows, shard)
            return pa.RecordBatch.from_arrays([pa.array(nodes[f.name], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if rows and held + len(r["keys"]) > shard_turns:
                    yield made()
                    rows, held, shard = [], 0, shard + 1
                rows.append(r)
                held += len(r["keys"]) + 1
        if rows:
            yield made()

    return build


def _border_nodes(border: DataFrame) -> DataFrame:
    """Nodes that several shards may share, whole.

    A node belongs to the first shard that has it. How far the first sequence of a shard runs along with the last one of the shard
    before says which of its nodes do not, and whether the one before goes on and is no leaf; corrected by that, all numbers just add up.
    """
    # one row for each shard
    shards = border.filter("depth = 0").select("shard", F.row_number().over(Window.orderBy("shard")).alias("number"))
    first = border.filter("on_first").join(shards, "shard").select("number", "hash", "depth", "first_length")
    last = border.filter("on_last").join(shards, "shard")
    lasts = last.select((F.col("number") + 1).alias("number"), "hash")
    common = first.join(lasts, ["number", "hash"]).groupBy("number").agg(F.max("depth").alias("common"), F.max("first_length").alias("common_length"))
    lengths = last.groupBy((F.col("number") + 1).alias("number")).agg(F.max("depth").alias("last_depth"))
    goes_on = common.join(lengths, "number").filter("common = last_depth").select((F.col("number") - 1).alias("number"), F.lit(1).alias("goes_on"))
    known = materialise(shards.join(common, "number", "left").join(goes_on, "number", "left").drop("number"), "trie-shards")

    both = border.join(known, "shard")
    foreign = F.col("on_first") & (F.col("depth") <= F.col("common"))
    before = F.col("first_length") - F.col("length")
    fixed = both.select(
        "hash", "parent_hash", "depth", "conv_id", "n_convs", "ends_sha256",
        (F.col("n_children") - F.when(foreign & (F.col("depth") < F.col("common")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & F.col("goes_on").isNotNull(), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(foreign, F.col("common_length") - before).otherwise(0)).alias("saved_tokens"),
    )
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return fixed.groupBy("hash", "parent_hash", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *summed)


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``conv_id, keys, sizes``.

    Per node ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. The distinct sequences are sorted by range; a shard is a run of them with at most
    ``shard_turns`` turns, so an opening that a third of all conversations share is dealt to many trees.
    """
    sequences = materialise(distinct_sequences(convs), "trie-sequences")
    built = sequences.repartitionByRange("keys").sortWithinPartitions("keys").mapInArrow(_builder(shard_turns), NODE)
    nodes = materialise(built, "trie-nodes")
    border = nodes.filter("hash is not null")
    merged = materialise(_border_nodes(border), "trie-borders")

    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = merged.select(F.col("hash").alias("parent_hash"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("hash is null and parent_hash is not null").drop("parent_conv_id")
    out = (
        nodes.filter("hash is null and parent_hash is null").select(*result)
        .unionByName(below.join(parents, "parent_hash").select(*result))
        .unionByName(merged.filter("parent_hash is not null").join(parents, "parent_hash").select(*result))
        .unionByName(merged.filter("parent_hash is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result))
    )
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def conversation_trie(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    span: int = SPAN, openings: int = OPENINGS, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """Trie of the conversations rebuilt by :func:`share_openings`, as :func:`prefix_trie` gives it.

    Turns are ordered by ``turn`` (null first), ties by role and then by the digest of role and text; repeated rows are turns of their
    own. A null role or text is empty; rows without ``conv_id`` belong to no conversation. An empty table gives no nodes. Other
    columns are not read. A conversation is one row, as a document is: all its digests (not its texts) are held
    together. The digest of the ids that end at a node is one SHA-256 over all of them, so the joined ids of one sequence run through
    one task, as a stream.
    """
    convs = materialise(conversations(turns, conv_id, turn, role, text), "trie-conversations")
    return prefix_trie(share_openings(convs, span, openings), shard_turns)
