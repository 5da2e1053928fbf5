"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric. Two sets link if their distance is at most a
radius. The join narrows regions until each fits a task, then compares there:

1. Equal sets are one point. A point's shingles are dealt to parts by hash;
   sets within the radius differ in few parts, so both hold an equal part
   among their first few in a common order. Points without such a part in
   common can't link; what equal parts connect is a region.
2. A region over the size limit gets pivots. Each point belongs to the cell of
   its nearest pivot (a Voronoi region) and is copied into every cell whose
   pivot is at most twice the radius further away: by the triangle inequality
   a linked pair then meets in the cell of either. Cells over the limit are
   divided again.
3. A cell that pivots don't divide, as its points are too close together, is
   joined in pairs of blocks.

Distances between unrelated texts are all 1, where no pivot tells them apart;
so the regions of step 1 come first, and pivots act within them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import union
from .common import append_column, fresh, may_be_among, python_ready, table, written
from .components import components

SHINGLE = 4
#: Similarity in per cent: sets link if 100 * intersection >= SIMILAR * union.
SIMILAR = 85
#: Points, and shingles in all, of a cell that one task joins. Half the shingles at most are shared, so its bits take up to 2048 * 1,000,000 / 8 bytes, 256 MB.
CELL_POINTS, CELL_SHINGLES = 2048, 2_000_000
#: Pivots a cell, and times that it's divided at most before blocks are paired.
PIVOTS, DEPTH = 8, 3
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 100_000

#: A part's key has 48 bits: keys that clash only add a tie between regions, and two bytes less are shuffled.
PART_KEY = np.uint64((1 << 48) - 1)

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

POINT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType())),
])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words make one."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total) * _A + h[k : k + len(total)]
    return np.unique(mixed(total))


def most_changes(n: int, similar: int) -> int:
    """The size of the symmetric difference that a set of n and one linked with it can have at most."""
    return (100 - similar) * n // similar


def parts_of(points: np.ndarray, similar: int = SIMILAR) -> list[int]:
    """Keys of which two linked, different sets have at least one in common.

    Sets of a size between two powers of two use the same number of parts; a
    set that could link with one beyond the next power uses that one's too. Of
    the nonempty parts at most ``most_changes`` differ from the other set's, so
    in any order common to both sets the first equal one is among the first
    ``most_changes`` + 1 of either. The order puts parts with more shingles
    first: they are rarely equal by chance. There are 1.8 parts for each
    change that the largest set allows, so that enough are nonempty; that they
    aren't is as likely as that 64-bit hashes clash.
    """
    n = len(points)
    changes = most_changes(n, similar)
    if not changes:
        return []
    level = n.bit_length() - 1
    keys = []
    for lv in (level, level + 1) if 100 * n // similar >> (level + 1) else (level,):
        count = np.uint64(4096 if lv < 4 else 64 if lv == 4 else 9 * 2 ** (lv + 1) * (100 - similar) // (5 * similar))
        part = points % count
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[at, n])
        key = mixed(np.add.reduceat(mixed(points[order]), at) + part[at] * _B + np.uint64(lv))
        first = np.lexsort((key, -np.minimum(sizes, 4)))[: changes + 1]
        keys += (key[first] & PART_KEY).view(np.int64).tolist()
    return keys


def describe(texts: list, known: WordHashes, size: int, similar: int) -> list[dict]:
    out = []
    for text in texts:
        points = shingles(text, known, size)
        both = mixed(points + _B)
        out.append({
            "n": len(points), "h1": int(points.sum(dtype=np.uint64).view(np.int64)) if len(points) else 0,
            "h2": int(both.sum(dtype=np.uint64).view(np.int64)) if len(points) else 0, "parts": parts_of(points, similar),
        })
    return out


def joined(ids: list, sets: list[np.ndarray], counted: list[bool], block: list[int], similar: int) -> list[tuple]:
    """All links within a cell: (a, b, 0) rows that connect what is linked, and (a, None, links) rows.

    A pair counts in the cell in which its smaller id is ``counted``, which is
    one cell only. Of two blocks only pairs across them are compared.
    """
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    ids, sets, counted, block = ([x[i] for i in order] for x in (ids, sets, counted, block))
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    on = times[column] > 1
    row, column = row[on], shared[column[on]]
    bits = np.zeros((len(sets), (int(shared[-1]) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    at, mine, side = np.array(ids), np.array(counted), np.array(block)
    across = side.min() != side.max()
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, out = np.zeros(len(ids), np.int64), []
    for i in range(1, len(ids)):
        low = int(np.searchsorted(sizes, -(-similar * sizes[i] // 100)))
        if low >= i:
            continue
        inner = np.bitwise_count(bits[low:i] & bits[i]).sum(axis=1, dtype=np.int64)
        hit = 100 * inner >= similar * (sizes[low:i] + sizes[i] - inner)
        hit &= np.where(at[low:i] < at[i], mine[low:i], mine[i])
        if across:
            hit &= side[low:i] != side[i]
        for j in (np.flatnonzero(hit) + low).tolist():
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((ids[i], ids[j], 0))
    return out + [(ids[i], None, int(n)) for i, n in enumerate(links) if n]


def _join_cells(batches, similar: int):
    """Batches sorted by (cell, low, high), of cell, low, high, id, counted, block, points: links as Arrow batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    cell, rows = None, []

    def done():
        links = joined(*(list(x) for x in zip(*rows, strict=True)), similar) if len(rows) > 1 else []
        return pa.RecordBatch.from_pylist([{"a": a, "b": b, "links": n} for a, b, n in links], schema=schema)

    for batch in batches:
        x = {c: batch.column(c) for c in batch.schema.names}
        flat, ends = x["points"].flatten().to_numpy().view(np.uint64), np.cumsum(np.r_[0, x["points"].value_lengths().to_numpy()])
        names = list(zip(*(x[c].to_pylist() for c in ("cell", "low", "high", "id", "counted", "block")), strict=True))
        for k, (*here, i, counted, block) in enumerate(names):
            if here != cell:
                if rows:
                    yield done()
                cell, rows = here, []
            rows.append((i, flat[ends[k] : ends[k + 1]].copy(), counted, block))
    if rows:
        yield done()


def _join_texts(batches, similar: int, shingle: int):
    """Batches sorted by cell, of cell, id, text: links within whole cells. Texts take less room on their way here than their points."""
    known = WordHashes()

    def described(batch):
        n = batch.num_rows
        points = pa.array([shingles(t, known, shingle).view(np.int64) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
        zero, all_count = pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool))
        return pa.RecordBatch.from_arrays([batch.column(0), zero, zero, batch.column(1), all_count, zero, points], ["cell", "low", "high", "id", "counted", "block", "points"])

    yield from _join_cells(map(described, batches), similar)


def _ties(batches):
    """Batches sorted by part, of part, id: each id with the first of its part, but for that itself."""
    last = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[part[0] != last, part[1:] != part[:-1]]  # nothing equals None
        start = np.maximum.accumulate(np.where(new, np.arange(len(part)), -1))
        firsts = np.where(start < 0, at[0] if first is None else first, at[start])
        tied = firsts != at
        last, first = part[-1], firsts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(firsts[tied]), pa.array(at[tied])], ["a", "b"])


def _sized(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.count("*").alias("points_in"), F.sum("n").alias("shingles_in"))


def _blocks(points: int, shingles_in: int):
    return F.greatest(F.ceil(F.col("points_in") / F.lit(points // 2)), F.ceil(F.col("shingles_in") / F.lit(shingles_in // 2))).cast("int")


def _voronoi(large: DataFrame, depth: int, radius: float) -> DataFrame:
    """Rows of ``large`` with their distances to the cell's pivots: ``to`` (pivot ids) and ``away``."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    order = F.struct(F.xxhash64("id", F.lit(depth)).alias("h"), "id", "points")
    # the pivots are those with the least hashes: the least of each of 64 parts of the cell, then of these
    least = large.select("cell", "id", "points").withColumn("s", salt).groupBy("cell", "s").agg(F.min_by(F.struct("id", "points"), order["h"]).alias("p"), F.min(order["h"]).alias("h"))
    pivots = least.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "p"))), 1, PIVOTS).alias("pivots"))
    inner = lambda p: F.size(F.array_intersect("points", p["p"]["points"]))
    away = F.transform("pivots", lambda p: 1 - inner(p) / (F.size("points") + F.size(p["p"]["points"]) - inner(p)))
    out = large.join(pivots, "cell").withColumn("away", away).withColumn("to", F.transform("pivots", lambda p: p["p"]["id"])).drop("pivots")
    return out.withColumn("home", F.array_position("away", F.array_min("away")).cast("int") - 1)


def divided(cells: DataFrame, similar: int = SIMILAR, points: int = CELL_POINTS, shingles_in: int = CELL_SHINGLES) -> DataFrame:
    """Cells of at most the given size, of (cell, id, n, points): with low, high, counted and block."""
    radius = 1 - similar / 100
    whole = F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"))
    now, out = cells.withColumn("counted", F.lit(True)), []
    cols = ["cell", "id", "n", "points", "counted"]
    for depth in range(DEPTH + 1):
        size = written(_sized(now), "cell-sizes")
        over = size.filter((F.col("points_in") > points) | (F.col("shingles_in") > shingles_in))
        small = now.join(over, "cell", "left_anti")
        out.append(small.select(*cols, whole.alias("at")))
        if not over.head(1):
            break
        large = now.join(over, "cell")
        stuck = large
        if depth < DEPTH:
            seen = written(_voronoi(large, depth, radius), "distances")
            cell = F.explode(F.filter(F.sequence(F.lit(0), F.size("away") - 1), lambda j: F.expr("away")[j] <= F.array_min("away") + F.lit(2 * radius + 1e-9)))
            child = seen.select("cell", "points_in", "home", "to", "n", "id", "counted", "points", cell.alias("j"))
            # worth it if the largest child is clearly smaller and copies stay few
            sizes = seen.select("cell", "points_in", cell.alias("j")).groupBy("cell", "points_in", "j").count()
            use = written(sizes.groupBy("cell", "points_in").agg(F.max("count").alias("m"), F.sum("count").alias("s")).select("cell", (F.col("m") < 0.7 * F.col("points_in")).alias("a"), (F.col("s") < 3 * F.col("points_in")).alias("b")).filter("a and b").select("cell"), "divisible")
            stuck = large.join(use, "cell", "left_anti")
            parts = child.join(use, "cell", "left_semi")
            now = parts.select(F.xxhash64("cell", F.col("to")[F.col("j")], F.lit(depth)).alias("cell"), "id", "n", "points", (F.col("counted") & (F.col("j") == F.col("home"))).alias("counted"))
            now = written(now, "cells")
        else:
            now = now.limit(0)
        k = _blocks(points, shingles_in)
        block = F.pmod(F.xxhash64("id", F.lit("block")), k).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(F.least(j, F.col("b")).alias("low"), F.greatest(j, F.col("b")).alias("high"), F.col("b").alias("block")))
        out.append(stuck.withColumn("b", block).withColumn("at", F.explode(pairs)).select(*cols, "at"))
    return union(*out).select("cell", "at.low", "at.high", "id", "counted", "at.block", "points")


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR,
    points: int = CELL_POINTS, shingles_in: int = CELL_SHINGLES,
) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of ``docs``.

    component_id is the smallest id that links reach, the row's own included,
    and null if they reach null ids only; n_links counts the different shingle
    sets that the row's set links with. Null and empty texts, and those of
    white space only, have no shingles and link with nothing. Equal sets share
    a component and aren't compared. Ids may be null or repeat, and have any
    type that sorts: only texts link. Other columns of ``docs`` aren't read; an
    empty table gives no rows.
    """
    found = _matched(docs.select(id_col, text_col), id_col, text_col, shingle, similar, points, shingles_in)
    component = F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _matched(docs: DataFrame, id_col: str, text_col: str, shingle: int, similar: int, points: int, shingles_in: int) -> DataFrame:
    """(id, th, rh, n, least, n_links) for each row; least is the first (none, id, th, rh) of its component, null ids last.

    th is the text's hash, rh that of all columns. A class of equal sets is a
    point, whatever the ids of its rows, which only say which row comes first.
    """
    spark = docs.sparkSession
    python_ready(spark)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _row_hash(docs).alias("rh"), F.col(text_col).alias("text"))
    known = append_column(source, "point", POINT, lambda: lambda texts, k=WordHashes(): describe(texts, k, shingle, similar), ["text"])
    known = written(known.select("id", "th", "rh", "point.*").withColumn("row", F.monotonically_increasing_id()), "points")  # small numbers take less room in the shuffles than hashes
    key = ["n", "h1", "h2"]
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th", "rh")
    classes = written(known.filter("n > 0").groupBy(key).agg(F.min(first).alias("least"), F.min("row").alias("own")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    # parts are shuffled once, by themselves; only rows that may be copies meet the classes first
    deal = lambda rows: rows.select(F.explode("parts").alias("part"), F.col("row").alias("id"))
    copies = written(known.filter("n > 0").select(*key, "row").join(classes.select(*key, "own"), key).filter("row <> own").select("row"), "copies")
    some, others = may_be_among(known.filter("n > 0").select("row", "parts"), "row", copies)
    dealt = union(deal(others), deal(some.join(copies, "row", "left_anti")))
    ties = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_ties, "a long, b long")
    regions = components(ties)
    regions = regions.select(F.col("id").alias("own"), F.xxhash64("component").alias("cell")).join(classes.select("own", "rep", "n", F.col("least.th").alias("th"), F.col("least.rh").alias("rh")), "own").drop("own")
    regions = written(regions, "regions")
    over = written(_sized(regions).filter((F.col("points_in") > points) | (F.col("shingles_in") > shingles_in)).select("cell"), "large-regions")
    # the class's first row gives the text; by sorting at any size
    again, _ = may_be_among(source.select("th", "rh", "text"), "th", regions.select("th"))
    again = again.join(regions.drop("n").hint("merge"), ["th", "rh"]).dropDuplicates(["th", "rh"]).select("cell", F.col("rep").alias("id"), "text")
    some_large = bool(over.head(1))
    if some_large:
        again = written(again, "texts")
    small = again.join(over, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell")
    links = small.mapInArrow(lambda batches: _join_texts(batches, similar, shingle), "a long, b long, links long")
    if some_large:
        large = again.join(over, "cell", "left_semi")
        sets = append_column(large, "points", T.ArrayType(T.LongType()), lambda: lambda texts, k=WordHashes(): [shingles(t, k, shingle).view(np.int64).tolist() for t in texts], ["text"])
        cells = written(sets.select("cell", "id", F.size("points").alias("n"), "points"), "sets")
        ready = divided(cells, similar, points, shingles_in).repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
        links = union(links, ready.mapInArrow(lambda batches: _join_cells(batches, similar), "a long, b long, links long"))
    links = written(links, "links")
    groups = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    linked = written(groups.join(classes.select("rep", "least"), "rep"), "linked")
    reached = linked.groupBy("component").agg(F.min("least").alias("reached"))
    reached = linked.join(reached, "component").select("rep", "reached")
    degree = links.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = classes.join(reached, "rep", "left").join(degree, "rep", "left").select(*key, F.coalesce("reached", "least").alias("least"), "n_links")
    return known.select("id", "th", "rh", *key).join(classes, key, "left")


def _row_hash(df: DataFrame) -> Column:
    """Of all columns; maps count by their entries."""
    return F.xxhash64(*(F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields))


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR,
    points: int = CELL_POINTS, shingles_in: int = CELL_SHINGLES,
) -> DataFrame:
    """The first row of each component: by id, null ids last, then by the hashes of the text and of the whole row.

    Rows with the same id or none stay if their texts don't link. Null and
    empty texts, and those of white space only, link with nothing and stay,
    with all that their rows say. Rows that are equal in all columns count as
    one. Columns pass through. What goes is decided without texts; of these
    only those that may go, or have an equal, are shuffled to meet the decision.
    """
    found = _matched(docs, id_col, text_col, shingle, similar, points, shingles_in)
    first = (F.col("least.th") == F.col("th")) & (F.col("least.rh") == F.col("rh"))
    th, rh = fresh(docs, "_th", "_rh")
    gone = F.max((F.col("n") > 0) & ~first).alias("gone")
    # rows that stay and have no equal aren't shuffled
    told = written(found.groupBy(F.col("th").alias(th), F.col("rh").alias(rh)).agg(gone, F.count("*").alias("rows")).filter("gone or rows > 1").drop("rows"), "told")
    rows = docs.withColumns({th: F.xxhash64(text_col), rh: _row_hash(docs)})
    some, others = may_be_among(rows, rh, told.select(rh))
    kept = some.join(told.filter("gone").drop("gone"), [th, rh], "left_anti").dropDuplicates([th, rh])
    return union(others.select(rows.columns), kept.select(rows.columns)).drop(th, rh)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its set's size, its component and how many other sets it links with; see ``similar_documents`` for nulls, empty texts and repeats."""
    return similar_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_SQL_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"

OP5_SQL = f"""
with recursive d as (select doc_id, {_SQL_WORDS} w from documents),
     s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
                  else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) x from d),
     e as (select doc_id, len(x) n, unnest(x) g from s),
     p as (select a.doc_id a, b.doc_id b, any_value(a.n) m, any_value(b.n) n, count(*) k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
           and a.n * 100 >= b.n * {SIMILAR} and b.n * 100 >= a.n * {SIMILAR} group by 1, 2),
     l as (select a, b, (select list_sort(x) from s where doc_id = a) = (select list_sort(x) from s where doc_id = b) same from p where 100 * k >= {SIMILAR} * (m + n - k)),
     r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a),
     c as (select a doc_id, min(b) component_id from r group by a),
     k as (select a doc_id, count(distinct (select list_sort(x) from s where doc_id = b)) n_links from l where not same group by a)
select doc_id, cast(len(x) as bigint) n_shingles, component_id, coalesce(n_links, 0) n_links from s join c using (doc_id) left join k using (doc_id)
"""
