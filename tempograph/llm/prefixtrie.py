"""Operator 11: the prefix trie of conversations, by distributed MSD radix partitioning.

A turn is its role and text. A dictionary gives each distinct turn an id, and a
conversation becomes the sequence of its turns' ids. Equal sequences are put
together first, with their number and smallest conversation. Then buckets of
sequences that share their first turns are split by the id of the next turn:

* a bucket with more turns than a task should hold is split by Spark. What its
  sequences have in common beyond the known prefix (the common prefix of the
  smallest and the largest one) is skipped at once, so a round always branches;
* any smaller bucket is finished in one task by multikey quicksort, whose
  recursion into the middle part is a node of the trie.

Fewer buckets are large than the turns of all sequences are times that limit,
so they alone are broadcast; their nodes' sums over subtrees come from one
grouping of the tops of small buckets by the large ones above them. The ids of
the conversations that end at a node are hashed in order as a stream: sorted
stretches of them are joined to pieces of text first, and the pieces hashed in
turn, so no group of copies is held in memory.

Turns stand in the order of ``turn`` (null first); equal turns of a conversation
stand by role and then by a digest of role and text. Null roles and texts are
empty; repeated rows are turns of their own. Rows with a null conv_id belong to
no conversation and are left out. An empty table gives no nodes. Very long texts
are only hashed and measured; one conversation's ids must fit into memory.
Texts with equal digests (128 bits of SHA-256) count as equal. Columns other
than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import cut, join_classes, slices, stored

#: Turns of a bucket that one task finishes in any case, and at most.
LEAST, MOST = 1024, 1 << 20
#: Bytes of a piece of joined conversation ids, and nodes of a batch.
PIECE, NODES = 1 << 16, 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, digest of role and text, and bytes of the text, for each row that has a conversation."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8")
    return rows.where("conv_id is not null").select("conv_id", "turn", "role", F.substring(F.sha2(named, 256), 1, 32).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, ids and sizes (bytes) of each conversation's turns in order; rows as turns() gives them."""
    rows = stored(rows, "turns")
    dictionary = cut(rows.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    coded = join_classes(rows, dictionary, "digest", "conv_id", rows.count())
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "id", "bytes"))).alias("t"))
    return ordered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.bytes").alias("sizes"))


def shared_starts(convs: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Every conversation rebuilt: the first h turns of the one that its group starts with, then its own after its first h; h is the checksum of its number, modulo most + 1."""
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    met = convs.withColumn("head", first).withColumn("h", h).join(heads, "head", "left")

    def rebuilt(c: str) -> Column:
        none = F.array().cast("array<bigint>")
        return F.concat(F.coalesce(F.slice(f"head_{c}", 1, F.col("h")), none), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1))))

    return met.select("conv_id", rebuilt("ids").alias("ids"), rebuilt("sizes").alias("sizes"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the sorted ids of a class to pieces of text."""
    names = ["key", "first", "piece"]
    key, first, ids, size = None, 0, [], 0
    out: list[tuple] = []
    for b in batches:
        for k, c in zip(b["key"].to_pylist(), b["conv_id"].to_pylist()):
            if k != key or size >= PIECE:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            text = str(c)
            ids.append(text)
            size += len(text) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, first, ",".join(ids))], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the sorted pieces of each class in turn."""
    key, state = None, None
    for b in batches:
        out: list[tuple] = []
        for k, piece in zip(b["key"].to_pylist(), b["piece"]):
            text = piece.as_py().encode()
            if k == key:
                state.update(b"," + text)
                continue
            if state:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])


def classes(convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence: ids, sizes, n (conversations), conv (the smallest) and ends (the digest of all their numbers)."""
    keyed = stored(convs.withColumn("key", F.substring(F.sha2(F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).cast("binary"), 256), 1, 32)), "sequences")
    distinct = keyed.groupBy("key", "ids", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    pieces = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key string, first long, piece string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends string")
    return distinct.join(ends, "key").drop("key")


def branch(items: list[tuple], depth: int) -> list[list]:
    """The nodes of the trie of items (conv, n, ids, sizes, ends), distinct sequences that share their first depth ids, from their common node on.

    A node is conv, depth, place of its parent, n, children, leaves, saved bytes, ends.
    """

    def node(part: list[tuple], d: int, parent: int) -> list:
        n = sum(x[1] for x in part)
        return [min(x[0] for x in part), d, parent, n, 0, 0, (n - 1) * part[0][3][d - 1] if d else 0, NO_ENDS]

    nodes = [node(items, depth, -1)]
    todo = [(items, depth, 0)]
    while todo:
        part, d, parent = todo.pop()
        if len(part) == 1:
            for k in range(d + 1, len(part[0][2]) + 1):
                nodes.append(node(part, k, parent))
                parent = len(nodes) - 1
            nodes[parent][7] = part[0][4]
            continue
        keys = [x[2][d] if d < len(x[2]) else -1 for x in part]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [x for x, k in zip(part, keys) if k < pivot]
        more = [x for x, k in zip(part, keys) if k > pivot]
        same = [x for x, k in zip(part, keys) if k == pivot]
        todo += [(p, d, parent) for p in (less, more) if p]
        if pivot < 0:
            nodes[parent][7] = same[0][4]
        else:
            nodes.append(node(same, d + 1, parent))
            todo.append((same, d + 1, len(nodes) - 1))
    for below in reversed(nodes):
        below[5] = below[5] or 1
        if below[2] >= 0:
            above = nodes[below[2]]
            above[4] += 1
            above[5] += below[5]
            above[6] += below[6]
    return nodes


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ABOVE = "array<struct<label:bigint,top:int>>"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each small bucket; its top carries the large buckets above it."""
    names = [c.split()[0] for c in _NODE.split(", ")] + ["above"]
    above_type = pa.list_(pa.struct([("label", pa.int64()), ("top", pa.int32())]))
    types = [pa.int64()] * 7 + [pa.string(), above_type]
    out: list[tuple] = []

    def emit(key: tuple, above: list, items: list[tuple]) -> None:
        nodes = branch(items, key[0])
        for x in nodes:
            top = x[2] < 0
            out.append((x[0], x[1], key[1] if top else nodes[x[2]][0], *x[3:8], above if top else None))

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        out.clear()
        return made

    key, above, items = None, [], []
    for b in batches:
        for s in slices([b]):
            columns = [s[c].to_pylist() for c in ("depth", "label", "next", "above", "conv", "n", "ids", "sizes", "ends")]
            for depth, label, nxt, up, *item in zip(*columns):
                if (depth, label, nxt) != key:
                    if items:
                        emit(key, above, items)
                        if len(out) >= NODES:
                            yield batch()
                    key, above, items = (depth, label, nxt), up, []
                items.append(tuple(item))
    if items:
        emit(key, above, items)
    if out:
        yield batch()


def trie(convs: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, ids, sizes); limit: turns of a bucket that one task finishes."""
    spark = convs.sparkSession
    some = stored(classes(convs), "classes")
    whole = some.agg(F.min("conv").alias("label"), F.sum(F.size("ids")).alias("turns")).first()
    if limit is None:
        limit = min(MOST, max(LEAST, (whole["turns"] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # Large buckets: their first conversation and the depth they start at; above: the large ones over them.
    active = some.withColumn("label", F.lit(whole["label"]).cast("long")).withColumn("top", F.lit(0)).withColumn("above", F.array().cast(_ABOVE))
    large, ended, small = [], [], []
    more = whole["label"] is not None
    while more:
        found = active.groupBy("label", "top").agg(F.sum("n").alias("n"), F.min("ids").alias("low"), F.max("ids").alias("high"), F.min(F.struct("conv", "sizes", "above")).alias("first"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False).cast("int")
        # A single sequence, as the root may have, is a bucket that ends where it does.
        found = cut(found.select("label", "top", "n", F.when(differ > 0, differ - 1).otherwise(F.size("low")).alias("at"), F.col("first.sizes").alias("sizes"), F.col("first.above").alias("above")))
        within = active.drop("above").join(F.broadcast(found.select("label", "top", "at", F.concat("above", F.array(F.struct("label", "top"))).cast(_ABOVE).alias("above"))), ["label", "top"])
        within = within.withColumn("next", F.get("ids", F.col("at")))
        children = cut(within.groupBy("label", "top", "next").agg(F.count("*").alias("m"), F.sum(F.size("ids")).alias("turns"), F.min("conv").alias("child"), F.min("ends").alias("ends")))
        split = children.where((F.col("m") > 1) & (F.col("turns") > limit) & F.col("next").isNotNull())
        large.append(found.join(children.groupBy("label", "top").agg(F.count("next").alias("n_children")), ["label", "top"]))
        ended.append(children.where("next is null").select("label", "top", "ends"))
        marked = cut(within.where("next is not null").join(F.broadcast(split.select("label", "top", "next", "child")), ["label", "top", "next"], "left"))
        small.append(marked.where("child is null").select((F.col("at") + 1).alias("depth"), "label", "next", "above", "conv", "n", "ids", "sizes", "ends"))
        active = marked.where("child is not null").select("conv", "n", "ids", "sizes", "ends", F.col("child").alias("label"), (F.col("at") + 1).alias("top"), "above")
        more = bool(split.take(1))
    if not large:
        return spark.createDataFrame([], _NODE)
    keys = ["depth", "label", "next"]
    locals_ = _union(small).repartition(*keys).sortWithinPartitions(*keys)
    finished = stored(locals_.mapInArrow(_finish, f"{_NODE}, above {_ABOVE}"), "nodes")
    return finished.drop("above").unionByName(_large_nodes(_union(large), _union(ended), finished))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _large_nodes(large: DataFrame, ended: DataFrame, finished: DataFrame) -> DataFrame:
    """The nodes along the common prefixes of large buckets; finished: nodes of the small ones, with above at their tops."""
    places = F.sequence(F.greatest("top", F.lit(1)), F.greatest("at", F.lit(1)))
    cost = F.when(F.col("at") > 0, F.aggregate(places, F.lit(0).cast("long"), lambda s, d: s + F.get("sizes", d - 1) * (F.col("n") - 1))).otherwise(F.lit(0))
    costs = large.withColumn("cost", cost)
    tops = finished.where("above is not null").select(F.explode("above").alias("b"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    inner = costs.select(F.explode("above").alias("b"), F.lit(0).cast("long").alias("leaves"), F.col("cost").alias("saved"))
    sums = tops.unionByName(inner).groupBy(F.col("b.label").alias("label"), F.col("b.top").alias("top")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    known = large.join(sums, ["label", "top"], "left").join(ended, ["label", "top"], "left")
    nodes = known.withColumn("depth", F.explode(F.sequence("top", "at")))
    rest = F.when(F.col("at") > 0, F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest("at", F.lit(1))), lambda d: d >= F.col("depth")), F.lit(0).cast("long"), lambda s, d: s + F.get("sizes", d - 1) * (F.col("n") - 1))).otherwise(F.lit(0))
    last = F.col("depth") == F.col("at")
    parent = F.when(F.col("depth") > F.col("top"), F.col("label")).otherwise(F.element_at(F.col("above"), -1)["label"])
    return nodes.select(
        F.col("label").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + rest).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op11(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(shared_starts(sequences(turns(conversations))), limit)
