"""The trie of conversation beginnings, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. It is named by its smallest member and its depth, which no other node
shares. Turns travel as two 64-bit hashes and a word count, never as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import Scratch, bounded_batches

WORD = r"[^\x20\x09-\x0D]+"
COMPONENT = 2048  # components of at most so many nodes are rolled up inside a task
ENDS_PER_ROW = 4096
NODE = ["rep", "depth"]


def light_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, words``: a turn's role and text, null counting as empty, as hashes and a count of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("turn"), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def _scan(df: DataFrame, order: list[str], running: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows of each ``conv_id`` in order: ``place`` counts them from 1, each column of ``running`` becomes its running XOR.

    Rows are sorted by range over all tasks, so a conversation may spread over many of them. What earlier partitions
    hold of a conversation is added afterwards: at most one row a partition, the only thing broadcast.
    """
    columns = [c for c in df.columns if c not in running]
    ordered = df.select(*columns, *running).repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    at = columns.index("conv_id")

    def run(batches):
        part = TaskContext.get().partitionId()
        last, count, carried = None, 0, [np.int64(0)] * len(running)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at).to_numpy()
            new = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            rows = np.arange(n)
            start = np.maximum.accumulate(np.where(new, rows, -1))  # -1: goes on from the batch before
            place = np.where(start >= 0, rows - start + 1, count + rows + 1)
            out = []
            for k in range(len(running)):
                summed = np.bitwise_xor.accumulate(batch.column(len(columns) + k).to_numpy())
                before = np.where(start > 0, summed[np.maximum(start, 1) - 1], np.where(start < 0, carried[k], 0))
                out.append(summed ^ before)
            last, count, carried = keys[-1], place[-1], [x[-1] for x in out]
            added = [pa.array(x) for x in (*out, place, np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *added], [*columns, *running, "place", "part"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, *running]) + ", place long, part int"
    local = scratch.table(ordered.mapInArrow(run, schema), name)
    ends = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("place", *running), "place").alias("end"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum("end.place").over(earlier).alias("place"), *(F.bit_xor(f"end.{c}").over(earlier).alias(c) for c in running)]
    carried = ends.select("conv_id", "part", F.struct(*sums).alias("carried")).filter("carried.place IS NOT NULL")
    carried = scratch.table(carried, f"{name}-carried")
    none = F.lit(0).cast("long")
    joined = local.join(F.broadcast(carried), ["conv_id", "part"], "left")
    whole = [F.col(c).bitwiseXOR(F.coalesce(f"carried.{c}", none)).alias(c) for c in running]
    return joined.select(*columns, *whole, (F.col("place") + F.coalesce("carried.place", none)).alias("place"))


def in_order(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, place, a, b, words`` of every turn. A null turn comes first; ties are in the order of their hashes."""
    scanned = _scan(light_turns(conversations), ["turn", "a", "b"], [], scratch, "in-order")
    return scanned.select("conv_id", "place", "a", "b", "words")


def grafted(turns: DataFrame, scratch: Scratch, step: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first turns of each become those of another.

    The first ``h`` turns of conversation ``c - c % step`` (all if it has fewer, none if it is not there), then ``c``'s own
    turns after its first ``h``, with ``h`` the CRC-32 of the decimal ``c`` modulo ``heads``. Gives ``conv_id, length`` of
    every conversation, also those left without turns, and ``conv_id, length, place, a, b, words`` of their turns.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    known = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    known = scratch.table(known.select("*", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base")), "known")
    bases = known.filter(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("base_own"))
    convs = known.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0).cast("long"))))
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.table(convs.select("conv_id", "base", "h", "head", "length"), "convs")
    own = turns.filter(F.col("place") > taken).join(convs, "conv_id")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    first = turns.filter((F.col("conv_id") % step == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    front = convs.join(first, "base").filter("place <= head")
    columns = ["conv_id", "length", "place", "a", "b", "words"]
    return convs.select("conv_id", "length"), own.select(columns).unionByName(front.select(columns))


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, length, words, x, y, px, py``: the beginning that ends with each turn, and the one before it.

    A beginning's two hashes are the XOR of those of its turns, each mixed with its place.
    """
    own = [F.xxhash64("place", "a"), F.xxhash64(F.lit("place"), "place", "b")]
    named = turns.select("conv_id", F.col("place").alias("depth"), "length", "words", own[0].alias("x"), own[1].alias("y"))
    named = named.withColumns({"own_x": F.col("x"), "own_y": F.col("y")})
    scanned = _scan(named, ["depth"], ["x", "y"], scratch, "prefixes")
    before = [F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"p{c}") for c in ("x", "y")]
    return scratch.table(scanned.select("conv_id", "depth", "length", "words", "x", "y", *before), "begun")


def _nodes(convs: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, depth, parent, x, y, n_convs, n_children, words, weight`` of every node; the root has no parent.

    ``weight`` counts members by the turns they have from here on. It is the sum over the subtree of all members' visits, and
    comes out of the grouping itself.
    """
    below = prefixes.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("rep"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.min("px").alias("px"),
        F.min("py").alias("py"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(
        zero.alias("depth"),
        zero.alias("x"),
        zero.alias("y"),
        F.min("conv_id").alias("rep"),
        F.count(F.lit(1)).alias("n_convs"),
        zero.alias("words"),
        F.sum(F.col("length") + 1).alias("weight"),
        F.lit(None).cast("long").alias("px"),
        F.lit(None).cast("long").alias("py"),
    )
    every = scratch.table(below.unionByName(root.filter("rep IS NOT NULL")), "nodes")
    children = every.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("px").alias("x"), F.col("py").alias("y"), "n_children")
    parents = every.select(F.col("rep").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    whole = every.join(parents, ["px", "py"], "left").join(children, ["x", "y"], "left")
    return scratch.table(whole.fillna({"n_children": 0}).drop("px", "py"), "family")


def _paths(nodes: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, at, node, parent``: for each conversation that names a node, the node at every depth of it."""
    placed = prefixes.join(nodes.select("depth", "x", "y", F.col("rep").alias("node"), "parent"), ["depth", "x", "y"])
    named = placed.filter((F.col("depth") == F.col("length")) & (F.col("conv_id") == F.col("node"))).select("conv_id")
    kept = placed.join(named, "conv_id", "left_semi")
    return scratch.table(kept.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), "node", "parent"), "paths")


def _root(nodes: DataFrame) -> Column:
    """The name of the root, which is one row at most."""
    found = nodes.filter("depth = 0").select("rep").head()
    return F.lit(None if found is None else found[0]).cast("long")


def _roll_up_small(parts: DataFrame, values: list[str]) -> DataFrame:
    """Add up whole components, several at a time, inside a task: ``rep, depth`` and ``values``."""
    columns = ["top", "top_depth", "rep", "depth", "parent", *(f"own_{v}" for v in values), *values]
    dealt = parts.select(columns).repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", F.desc("depth"))

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        top, top_depth, rep, depth = (rows.column(c).to_pylist() for c in columns[:4])
        parent = rows.column("parent").to_pylist()
        sums = [rows.column(f"own_{v}").to_pylist() for v in values]
        place = {(r, d): n for n, (r, d) in enumerate(zip(rep, depth, strict=True))}
        for n in range(len(rep)):  # deepest first inside each component
            if (rep[n], depth[n]) != (top[n], top_depth[n]):
                up = place[parent[n], depth[n] - 1]
                for s in sums:
                    s[up] += s[n]
        out = [np.array(s, np.int64) + rows.column(v).to_numpy() for s, v in zip(sums, values, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, depth, *out)], [*NODE, *values])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tops = [batch.column(n).to_numpy() for n in (0, 1)]
            starts = np.flatnonzero((tops[0][1:] != tops[0][:-1]) | (tops[1][1:] != tops[1][:-1])) + 1
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (tops[0][0], tops[1][0]):
                starts = np.concatenate([[0], starts])
            done = 0
            for start in starts.tolist():
                if count + start - done >= COMPONENT:  # a bundle ends where a component does
                    held.append(batch.slice(done, start - done))
                    yield finish(held)
                    held, count, done = [], 0, start
            if done < batch.num_rows:
                held.append(batch.slice(done))
                count += batch.num_rows - done
        if held:
            yield finish(held)

    return dealt.mapInArrow(run, "rep long, depth long, " + ", ".join(f"{v} long" for v in values))


def roll_up(nodes: DataFrame, paths: DataFrame, values: list[str], scratch: Scratch, component: int = COMPONENT) -> DataFrame:
    """Sums over subtrees: ``rep, depth`` and each of ``values``, given as columns of ``nodes``.

    Centroid decomposition. The nodes of a component whose subtree weighs more than half of it are a path from its top down
    to the centroid, the lowest of them. The total of what hangs at the centroid is added along that path; the
    centroid is then finished, each child of it begins a component of its own, and the weights on the path lose
    the centroid's, so no weight is ever worked out anew. Every component weighs at most half of the one it came from: the
    rounds follow the logarithm of the weight, however deep or wide the trie is. Components of at most ``component`` nodes
    are added up inside tasks.
    """
    own = {f"own_{v}": F.col(v) for v in values}
    zero = F.lit(0).cast("long")
    root = _root(nodes)
    start = nodes.select(*NODE, "parent", "weight", *(c.alias(k) for k, c in own.items()), *(zero.alias(v) for v in values))
    state = scratch.table(start.withColumns({"top": root, "top_depth": zero}), "state-0")
    small, done, level = None, None, 0
    comp = ["top", "top_depth"]
    while True:
        level += 1
        is_top = (F.col("rep") == F.col("top")) & (F.col("depth") == F.col("top_depth"))
        sizes = state.groupBy(*comp).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(is_top, F.col("weight"))).alias("total"))
        sized = scratch.table(state.join(sizes, comp), f"sized-{level}")
        scratch.drop(f"state-{level - 1}")
        part = sized.filter(F.col("n") <= component).drop("n", "total")
        small = part if small is None else small.unionByName(part)
        big = sized.filter(F.col("n") > component).drop("n")
        if big.isEmpty():
            break
        heavy = 2 * F.col("weight") > F.col("total")
        lowest = F.max_by(F.struct(F.col("rep").alias("rep"), F.col("depth").alias("depth"), "weight"), "depth").alias("c")
        centroids = scratch.table(big.filter(heavy).groupBy(*comp).agg(lowest), f"centroids-{level}")
        found = big.join(centroids, comp)
        # Below the centroid's depth a node's own beginning says which child of the centroid it is under, if any.
        deep = found.filter(F.col("depth") > F.col("c.depth")).withColumn("at", F.col("c.depth") + 1)
        on_path = paths.withColumnRenamed("parent", "node_parent")
        deep = deep.join(on_path, ["rep", "at"]).withColumn("child", F.when(F.col("node_parent") == F.col("c.rep"), F.col("node")))
        flat = found.filter(F.col("depth") <= F.col("c.depth")).withColumn("child", F.lit(None).cast("long"))
        here = (F.col("rep") == F.col("c.rep")) & (F.col("depth") == F.col("c.depth"))
        placed = deep.drop("at", "node", "node_parent").unionByName(flat).withColumn("here", here)
        placed = scratch.table(placed, f"placed-{level}")
        hanging = placed.filter("here OR child IS NOT NULL").groupBy(*comp)
        hanging = hanging.agg(*(F.sum(f"own_{v}").alias(f"more_{v}") for v in values))
        added = placed.join(scratch.table(hanging, f"hanging-{level}"), comp)
        above = F.col("child").isNull() & (2 * F.col("weight") > F.col("total"))
        columns = {v: F.col(v) + F.when(above, F.col(f"more_{v}")).otherwise(zero) for v in values}
        columns["weight"] = F.col("weight") - F.when(above, F.col("c.weight")).otherwise(zero)
        added = added.withColumns(columns)
        ready = scratch.table(added.filter("here").select(*NODE, *values), f"done-{level}")
        done = ready if done is None else done.unionByName(ready)
        split = {
            "top": F.coalesce("child", "top"),
            "top_depth": F.when(F.col("child").isNotNull(), F.col("c.depth") + 1).otherwise(F.col("top_depth")),
        }
        state = scratch.table(added.filter("NOT here").withColumns(split).select(state.columns), f"state-{level}")
        scratch.drop(f"centroids-{level}", f"placed-{level}", f"hanging-{level}")
    rolled = _roll_up_small(small, values)
    return rolled if done is None else rolled.unionByName(done)


def _end_digests(ends: DataFrame) -> DataFrame:
    """``rep, depth, ends_sha256``: SHA-256 of each node's ``conv_id``, ascending, in decimal and joined by commas.

    Ids are sorted by range over all tasks and joined to rows of some thousand first; a hash runs over those rows as
    a stream, so a node where very many conversations end is neither sorted nor held in one task.
    """
    keys = [*NODE, "conv_id"]
    ordered = ends.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def join(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, depth, ids = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero((rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])) + 1
            cut = np.unique(np.concatenate([[0], cut, np.arange(0, len(rep), ENDS_PER_ROW)]))
            texts = [",".join(map(str, x.tolist())) for x in np.split(ids, cut[1:])]
            arrays = [pa.array(rep[cut]), pa.array(depth[cut]), pa.array(ids[cut]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "ids"])

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for rep, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last == (rep, depth):
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (rep, depth), hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        if last is not None:
            yield _digest_rows([(*last, state.hexdigest())])

    joined = ordered.mapInArrow(join, "rep long, depth long, conv_id long, ids string")
    dealt = joined.repartition(*NODE).sortWithinPartitions(*keys)
    return dealt.mapInArrow(digest, "rep long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rep, depth, text = zip(*rows, strict=True) if rows else ((), (), ())
    arrays = [pa.array(rep, pa.int64()), pa.array(depth, pa.int64()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*NODE, "ends_sha256"])


def trie(convs: DataFrame, turns: DataFrame, scratch: Scratch, component: int = COMPONENT) -> DataFrame:
    """The nodes of the trie with what their subtrees hold, one row a node.

    ``convs(conv_id, length)`` and ``turns(conv_id, length, place, a, b, words)`` are as :func:`grafted` gives them.
    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. No conversation at all gives no node, not even the root.
    """
    prefixes = _prefixes(turns, scratch)
    nodes = _nodes(convs, prefixes, scratch)
    values = {
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }
    valued = nodes.withColumns(values)
    sums = roll_up(valued, _paths(nodes, prefixes, scratch), list(values), scratch, component)
    at_end = prefixes.filter("depth = length").join(nodes.select("depth", "x", "y", "rep"), ["depth", "x", "y"])
    turnless = convs.filter("length = 0").select(_root(nodes).alias("rep"), F.lit(0).cast("long").alias("depth"), "conv_id")
    ends = scratch.table(at_end.select(*NODE, "conv_id").unionByName(turnless.select(*NODE, "conv_id")), "ends")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(sums, NODE).join(_end_digests(ends), NODE, "left")
    return whole.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, component: int = COMPONENT) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are."""
    scratch = Scratch(bounded_batches(conversations.sparkSession), "trie")
    turns = scratch.table(in_order(conversations, scratch), "turns")
    convs = scratch.table(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "convs")
    return trie(convs, turns.join(convs, "conv_id"), scratch, component)


def grafted_trie(conversations: DataFrame, step: int = 20, heads: int = 4, component: int = COMPONENT) -> DataFrame:
    """The trie after :func:`grafted` has given conversations common beginnings.

    Rows with a null ``conv_id`` belong to no conversation. Null roles and texts count as empty, a null turn comes first,
    turns of one number are in the order of their hashes, so repeated rows are turns of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    scratch = Scratch(bounded_batches(conversations.sparkSession), "trie")
    turns = scratch.table(in_order(conversations, scratch), "turns")
    convs, rebuilt = grafted(turns, scratch, step, heads)
    return trie(convs, rebuilt, scratch, component)

