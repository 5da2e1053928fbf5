"""The prefix trie of conversations, by Patricia construction.

Conversations are cut into segments of at most SEGMENT turns, so that no row
grows with a conversation. A turn's prefix has a 128-bit key, the sum of hashes
of all turns up to it with their places; a segment is the list of its turns'
keys behind that of what precedes it. Equal segments are counted together,
then all are sorted. Sorted neighbours share what they have in common, so one
pass with a stack of at most SEGMENT open nodes creates the points of the
compressed tree: where segments branch or end, and the nodes that a part of the
sort shares with its neighbours, whose sums are joined by their keys.

Aggregates are computed on points only. A conversation saves the bytes that a
smaller one has already: those before the node from which on it is the smallest
member. These are sums over the points below a point, which pointers that
double their reach each round collect in as many rounds as the logarithm of the
tree's height. At last the unary nodes of each edge come back, by the sums of
the bytes at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import union
from .common import python_ready, table, written

#: Turns of a segment.
SEGMENT = 16
#: Ids that one row of the text to hash holds.
CHUNK = 4096
#: Fixed values of the rebuilt conversations: a group's conversations share up to HEADS - 1 first turns of the group's first.
GROUP, HEADS = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)

_POINT = "id binary, depth long, parent binary, parent_depth long, n long, least long, bytes array<long>"


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the running sums, modulo 2^64, of long columns within each group; ``sums`` is {new column: column}.

    ``group`` is a long without nulls. Rows are sorted by ranges, so a large
    group lies in many tasks; what a task's first group brings along from the
    tasks before it is added afterwards, from one row a task.
    """
    python_ready(df.sparkSession)
    names = df.columns
    at, of = names.index(group), [names.index(c) for c in sums.values()]
    fields = [*df.schema.fields, *(T.StructField(c, T.LongType()) for c in sums), T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType())]

    def run(batches):
        part, last, carried, nth = TaskContext.get().partitionId(), None, np.zeros(len(of), np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(at).to_numpy()
            first = np.flatnonzero(np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]]))
            run_of = np.searchsorted(first, np.arange(n), "right")  # 0: goes on with the batch before
            out = []
            for k, i in enumerate(of):
                total = np.cumsum(b.column(i).to_numpy().astype(np.int64))
                before = np.concatenate([[-carried[k]], np.concatenate([[0], total])[first]])
                out.append(total - before[run_of])
            count = np.arange(n) - np.concatenate([[-nth], first])[run_of] + 1
            last, carried, nth = g[-1], np.array([x[-1] for x in out]), int(count[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(n, part, np.int32)), pa.array(count)], [*names, *sums, "_part", "_nth"])

    rows = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, T.StructType(fields)), "running")
    ends = rows.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(F.array(*sums), F.struct(group, "_nth")).alias("sums")).orderBy("_part").collect()  # a row a task
    brought, carry, owner = [], np.zeros(len(sums), np.int64), None
    for r in ends:
        if r["first"] == owner:
            brought.append((r["_part"], r["first"], *carry.tolist()))
        else:
            carry = np.zeros(len(sums), np.int64)
        own = np.array(r["sums"], np.int64)
        carry, owner = (carry + own if r["first"] == r["last"] else own), r["last"]
    if brought:
        more = df.sparkSession.createDataFrame(brought, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField(group, T.LongType()), *(T.StructField(f"_{c}", T.LongType()) for c in sums)]))
        rows = rows.join(F.broadcast(more), ["_part", group], "left")  # at most a row a task
        rows = rows.withColumns({c: _wrapped(F.col(c), F.coalesce(f"_{c}", F.lit(0).cast("long"))) for c in sums})
    return rows.select(*names, *sums)


def _wrapped(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, without an error where it doesn't fit: bit by bit of the halves."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): each conversation's turns, numbered from 1 by turn, nulls first; ties by the turn's digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row"))
    return running(rows, "conv_id", ["turn", "digest", "row"], {"pos": "one"}).select("conv_id", "pos", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) of each conversation and (conv_id, depth, digest, bytes) of its rebuilt turns.

    A conversation c gets the first h turns of conversation c - c % GROUP in
    place of its own first h, with h = crc32(c) % HEADS.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    c = F.col("conv_id")
    base = convs.filter(c % GROUP == 0).select(c.alias("base"), F.least("len", F.lit(HEADS - 1)).alias("has"))
    h = F.crc32(c.cast("string")) % HEADS
    convs = convs.select("conv_id", "len", (c - c % GROUP).alias("base"), h.alias("h")).join(base, "base", "left")
    taken = F.least("h", F.coalesce("has", F.lit(0).cast("long")))
    convs = written(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "rebuilt")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes")
    heads = turns.filter((c % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.select("conv_id", "base", "taken"), "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "total"), union(own, lent)


def _key(a: Column, b: Column) -> Column:
    """16 bytes of two longs."""
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _segments(paths: DataFrame) -> DataFrame:
    """(key, j, bytes, n, least): distinct segments with the key of what precedes them; bytes up to each place, the start's first."""
    j = F.floor((F.col("depth") - 1) / SEGMENT).cast("long")
    turns = F.array_sort(F.collect_list(F.struct("depth", _key(F.col("a"), F.col("b")).alias("key"), _key(F.col("a0"), F.col("b0")).alias("before"), "to", F.col("bytes").alias("own"))))  # SEGMENT rows at most
    rows = paths.groupBy("conv_id", j.alias("j")).agg(turns.alias("t"))
    start = F.col("t")[0]
    whole = F.aggregate("t", start["before"], lambda x, t: F.concat(x, t["key"]))
    upto = F.concat(F.array(start["to"] - start["own"]), F.transform("t", lambda t: t["to"]))
    return rows.select(whole.alias("key"), "j", upto.alias("bytes"), "conv_id").groupBy("key").agg(F.first("j").alias("j"), F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))


class _Open:
    """An open node of the stack: conversations so far, whether it's surely a point, and its only child until there are two."""

    __slots__ = ("n", "least", "sure", "child", "children")

    def __init__(self, sure: bool):
        self.n, self.least, self.sure, self.child, self.children = 0, None, sure, None, 0


def points_of_sorted(rows: Iterator[tuple[bytes, int, list[int], int, int]]) -> Iterator[tuple]:
    """Points (id, depth, parent, parent_depth, n, least, bytes) of sorted segments (key, j, bytes, n, least).

    Nodes on the path of the first and of the last segment are points always,
    as other tasks may have more of them.
    """
    path: list[bytes] = []
    stack: list[_Open] = []
    upto: list[int] = []
    j = 0

    def hand(point: tuple, at: int) -> Iterator[tuple]:
        """To the open node ``at``; its first child waits until the node is known to be a point."""
        node = stack[at]
        node.children += 1
        if node.sure or node.children > 1:
            for p in (node.child, point):
                if p is not None:
                    key, depth, n, least, sizes = p
                    yield key, j * SEGMENT + depth, path[at], j * SEGMENT + at, n, least, sizes[at : depth + 1]
            node.child, node.sure = None, True
        else:
            node.child = point

    def close(down_to: int) -> Iterator[tuple]:
        while len(stack) > down_to:
            at = len(stack) - 1
            node = stack[at]
            if at:
                above = stack[at - 1]
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
                point = (path[at], at, node.n, node.least, upto) if node.sure else node.child
                yield from hand(point, at - 1)
            elif j == 0:
                yield path[0], 0, None, None, node.n, node.least, [0]
            stack.pop()

    first = True
    for key, number, sizes, n, least in rows:
        keys = [key[i : i + 16] for i in range(0, len(key), 16)]
        same = 0
        while same < min(len(path), len(keys)) and path[same] == keys[same]:
            same += 1
        yield from close(same)
        path, upto, j = keys, sizes, number
        while len(stack) < len(keys):
            stack.append(_Open(first or not stack))
        stack[-1].n, stack[-1].least, stack[-1].sure = n, least, True
        first = False
    for node_at in range(len(stack)):  # what is open at the end
        if not stack[node_at].sure:
            node = stack[node_at]
            waiting, node.sure, node.child = node.child, True, None
            if waiting is not None:
                node.children -= 1
                yield from hand(waiting, node_at)
    yield from close(0)


def _points(segments: DataFrame) -> DataFrame:
    """The points of the compressed tree, each once."""
    python_ready(segments.sparkSession)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        found: list[tuple] = []
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["id", "depth", "parent", "parent_depth", "n", "least", "bytes"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds, strict=True)], names)
        for p in points_of_sorted(rows):
            found.append(p)
            if len(found) == 10_000:
                yield batch()
                found.clear()
        if found:
            yield batch()

    parts = segments.select("key", "j", "bytes", "n", "least").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _POINT)
    once = [F.first(c).alias(c) for c in ("depth", "parent", "parent_depth", "bytes")]
    return parts.groupBy("id").agg(*once, F.sum("n").alias("n"), F.min("least").alias("least"))


def _ends(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256, n_ends, least_end) of (id, conv_id): the ids that end at a node, hashed in order.

    Ids are gathered in texts of CHUNK ids where they're sorted, in as many
    tasks as their number asks for; the hash itself can't be split, so one
    task takes a node's texts one after the other and holds one of them.
    """
    python_ready(rows.sparkSession)

    def gather(batches):
        key, ids = None, []
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == CHUNK):
                    out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if out:
                yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["id", "first", "n", "ids"])
        if ids:
            yield _batch([(key, ids[0], len(ids), ",".join(map(str, ids)))], [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["id", "first", "n", "ids"])

    def digest(batches):
        key, state, n, least = None, None, 0, None
        kinds, names = [pa.binary(), pa.string(), pa.int64(), pa.int64()], ["id", "ends_sha256", "n_ends", "least_end"]
        for b in batches:
            out = []
            for k, first, count, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest(), n, least))
                    key, state, n, least = k, hashlib.sha256(), 0, first
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += count
            if out:
                yield _batch(out, kinds, names)
        if state is not None:
            yield _batch([(key, state.hexdigest(), n, least)], kinds, names)

    texts = rows.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(gather, "id binary, first long, n long, ids string")
    return texts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id binary, ends_sha256 string, n_ends long, least_end long")


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def subtree_sums(points: DataFrame, values: list[str]) -> DataFrame:
    """(id, values): the sums of long columns over all points (id, parent, values) below each point, itself included.

    Each round a point knows the sums as far down as its pointer reaches up;
    what hangs at the pointers' ends is added, and pointers reach twice as
    far. Points whose pointer has passed the root take no further part in it.
    """
    far = written(points.select("id", F.col("parent").alias("up")).filter("up is not null"), "up")
    sums = written(points.select("id", *values), "sums")
    while far.head(1):
        more = far.join(sums, "id").groupBy(F.col("up").alias("id")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        sums = written(sums.join(more, "id", "left").select("id", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "sums")
        far = written(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")), "up")
    return sums


def prefix_trie(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, total) with turns (conv_id, depth, digest, bytes), depths from 1 to total.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) for each distinct sequence of first turns.
    conv_id is the smallest member. Without conversations there are no nodes,
    not even a root. Equal digests are equal turns.
    """
    hashed = paths.withColumns({"x": F.xxhash64("digest", "depth"), "y": F.xxhash64("depth", "digest")})
    upto = running(hashed, "conv_id", ["depth"], {"a": "x", "b": "y", "to": "bytes"})
    upto = upto.withColumns({"a0": _wrapped(F.col("a"), _negative(F.col("x"))), "b0": _wrapped(F.col("b"), _negative(F.col("y")))})
    turnless = convs.filter("total = 0")
    last = upto.groupBy("conv_id").agg(F.max_by(_key(F.col("a"), F.col("b")), "depth").alias("id")).select("id", "conv_id")
    root = F.lit(bytearray(ROOT))
    ends = _ends(union(last, turnless.select(root.alias("id"), "conv_id")))
    none = turnless.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).filter("n > 0")  # one row
    only = none.select(root.alias("id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_depth"), F.array(F.lit(0).cast("long")).alias("bytes"), "n", "least")
    points = union(_points(_segments(upto)), only).groupBy("id").agg(*(F.first(c).alias(c) for c in ("depth", "parent", "parent_depth", "bytes")), F.sum("n").alias("n"), F.min("least").alias("least"))
    points = written(points.join(ends, "id", "left"), "points")
    children = points.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    above = points.select(F.col("id").alias("parent"), F.col("least").alias("parent_least"))
    points = points.join(children, "id", "left").join(above, "parent", "left")
    to, start = F.element_at("bytes", -1), F.col("bytes")[0]
    more = F.coalesce(F.col("n_ends") - (F.col("least_end") == F.col("least")).cast("long"), F.lit(0))
    points = written(points.withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "leaf": F.col("n_children").isNull().cast("long"),
        "own": F.when(F.col("least") != F.col("parent_least"), start).otherwise(0).cast("long"), "ended": (more * to).cast("long"),
    }), "valued")
    sums = subtree_sums(points.select("id", "parent", "leaf", (F.col("own") + F.col("ended")).alias("saved")), ["leaf", "saved"])
    nodes = points.drop("leaf").join(sums, "id")
    # an edge's nodes from its upper end, which is another point, on; the root has no edge
    last_at = F.size("bytes") - 1
    each = nodes.withColumn("i", F.explode(F.sequence(F.least(F.lit(1), last_at), last_at)))
    point = F.col("i") == last_at
    before = F.when(F.col("parent").isNull(), 0).otherwise(F.get("bytes", F.col("i") - 1))
    return each.select(
        F.col("least").alias("conv_id"), (F.coalesce("parent_depth", F.lit(0).cast("long")) + F.col("i")).alias("depth"),
        F.when(F.col("i") > 1, F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(point, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaf").alias("n_leaves"),
        (F.col("saved") - F.col("own") - (F.col("n") - 1) * before).cast("long").alias("saved_tokens"), F.when(point, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def _negative(x: Column) -> Column:
    """-x modulo 2^64; the smallest long is its own."""
    return _wrapped(F.bitwise_not(x), F.lit(1).cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    Null roles and texts are empty. Turns without a conv_id belong to no
    conversation. Turns of the same number are put in the order of their
    digests, as no other is given; repeated rows are turns of their own. An
    empty table has no nodes. Other columns aren't read.
    """
    convs, paths = rebuilt(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie(convs, paths)


OP12_SQL = f"""
with t as (select conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) g, strlen(coalesce(text, '')) b from conversations where conv_id is not null),
     o as (select *, row_number() over (partition by conv_id order by turn nulls first, g) p from t),
     c as (select distinct conv_id c, conv_id - conv_id % {GROUP} base,
           xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % {HEADS} h from o),
     k as (select c.c, base, h, (select count(*) from o where conv_id = base and p <= h) m from c),
     r as (select c, p d, g, b from k join o on o.conv_id = base and p <= h union all select c, m + p - h, g, b from k join o on o.conv_id = c and p > h),
     q as (select c, d, b, string_agg(g, '') over (partition by c order by d) x from r union all select c, 0, 0, '' from k),
     e as (select c, max(d) d from q group by c),
     n as (select x, any_value(d) d, any_value(b) b, min(c) conv_id, count(*) n from q group by x),
     u as (select distinct a.x, z.x y, z.d from q a join q z on a.c = z.c and z.d >= a.d),
     s as (select u.x, sum((n.n - 1) * n.b)::bigint saved, count(*) filter (not exists (select 1 from n w where w.d = n.d + 1 and w.x[:32 * n.d] = n.x)) leaves, count(*) filter (u.d = length(u.x) // 32 + 1) children from u join n on n.x = u.y group by u.x),
     f as (select q.x, sha256(string_agg(c::varchar, ',' order by c)) h from q join e using (c, d) group by q.x)
select n.conv_id, n.d::bigint depth, w.conv_id parent_conv_id, n.n::bigint n_convs, children::bigint n_children, leaves::bigint n_leaves, saved saved_tokens, coalesce(f.h, sha256('')) ends_sha256
from n join s using (x) left join f using (x) left join n w on w.d = n.d - 1 and w.x = n.x[:32 * (n.d - 1)]
"""
