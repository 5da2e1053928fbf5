"""The prefix trie against brute force and SQL: long, short, equal, empty and turnless conversations, ties, nulls."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import trie
from siltstone.llm.trie import OP12_SQL, op12_prefix_trie, ordered_turns, points_of_sorted, prefix_trie, rebuilt, running, subtree_sums

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Nodes of {conv: [(role, text)]}."""
    members, children = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[x] for x in children.get(p, ())) or 1
        saved[p] = own + sum(saved[x] for x in children.get(p, ()))
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p], digest(p)) for p, m in members.items())


def rebuilt_by_hand(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def conversations(spark, turns, more=()):
    rows = [(c, k, r, t, "extra") for c, x in turns.items() for k, (r, t) in enumerate(x)] + list(more)
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")


def nodes(spark, df):
    convs, paths = rebuilt(ordered_turns(df))
    out = prefix_trie(convs, paths)
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    return sorted(tuple(r) for r in out.collect())


def random_turns(seed, convs, longest, kinds=2):
    rng = random.Random(seed)
    some = lambda: (rng.choice(["user", "assistant"][:kinds]), rng.choice(["", "é", "ab", "a long text", "x" * 300][: kinds + 1]))
    out = {}
    for c in range(convs):
        n = rng.choice([1, 2, 3, rng.randint(1, longest)])
        start = out[rng.randrange(c)][: rng.randint(0, longest)] if c and rng.random() < 0.7 else []
        out[c] = start + [some() for _ in range(n)]
    return out


@pytest.mark.parametrize("seed, convs, longest", [(1, 60, 8), (2, 40, 70), (3, 150, 20)])
def test_by_brute_force(spark, seed, convs, longest):
    turns = {c * 3 - 20: t for c, t in random_turns(seed, convs, longest).items()}
    assert nodes(spark, conversations(spark, turns)) == brute(rebuilt_by_hand(turns))


def test_copies_and_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rng = random.Random(4)
    long = [("user", f"turn {k} {rng.random()}") for k in range(3000)]
    turns = {0: long, 5: long[:1500], 10: [*long[:1499], ("user", "other")], 15: [*long, ("user", "more")]}
    turns |= {c: [("user", "hi"), ("assistant", "hello")] for c in range(20, 620, 5)}
    assert nodes(spark, conversations(spark, turns)) == brute(rebuilt_by_hand(turns))


def test_odd_rows(spark):
    turns = {c: [("user", f"t{k}") for k in range(9)] for c in (0, 5, 2**40)}
    few = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # its own turns all go, and no base is there
    turns = {c - few + c % 5 if c == few - few % 5 else c: t for c, t in turns.items()}
    more = [(few + 1000 * 5, 0, None, None, "x"), (None, 0, "user", "lost", "x"), (7, None, "user", "first", "x"), (7, None, "user", "first", "x"), (7, 3, "a", "tie", "x"), (7, 3, "b", "tie", "x"), (7, 3, "a", "tie", "x")]
    df = conversations(spark, turns, more)
    known = dict(turns)
    known[few + 5000] = [("", "")]
    g = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    known[7] = [("user", "first")] * 2 + sorted([("a", "tie"), ("b", "tie"), ("a", "tie")], key=lambda x: g(*x))
    want = brute(rebuilt_by_hand(known))
    assert nodes(spark, df) == want
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == sorted(want, key=str)
    assert nodes(spark, df.limit(0)) == []
    turnless = df.filter(F.col("conv_id") == few + 5000)
    only = nodes(spark, turnless)
    assert only == brute(rebuilt_by_hand({few + 5000: [("", "")]}))


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    assert sorted(map(tuple, op12_prefix_trie(spark, SF).collect()), key=str) == sorted(con.execute(OP12_SQL).fetchall(), key=str)


def test_running_sums_over_tasks(spark):
    rng = random.Random(5)
    rows = [(g, k, rng.randint(-(2**63), 2**63 - 1)) for g, n in ((1, 3), (2, 5000), (3, 1), (9, 40)) for k in range(n)]
    got = running(spark.createDataFrame(rows, "g long, k long, x long").repartition(8), "g", ["k"], {"s": "x"}).orderBy("g", "k").collect()
    at = {}
    for r in got:
        at[r["g"]] = (at.get(r["g"], 0) + r["x"] + 2**63) % 2**64 - 2**63
        assert r["s"] == at[r["g"]]
    assert len(got) == len(rows)


def test_parts_of_the_sort_agree():
    """Wherever the sorted segments are cut into tasks, the joined points expand to the same nodes."""
    rng = random.Random(6)
    texts = {"r" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)}
    key = lambda t: b"".join(hashlib.md5(t[: i + 1].encode()).digest() if i else bytes(16) for i in range(len(t)))
    rows = sorted((key(t), 0, [*range(len(t))], rng.randint(1, 3), rng.randrange(1000)) for t in texts)

    def expanded(cuts):
        points = {}
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            for i, depth, up, up_depth, n, least, _ in points_of_sorted(iter(rows[a:b])):
                old = points.get(i, (depth, up, up_depth, 0, least))
                assert old[:3] == (depth, up, up_depth)
                points[i] = (depth, up, up_depth, old[3] + n, min(old[4], least))
        return sorted((d, n, least) for depth, _, up, n, least in points.values() for d in range(0 if up is None else up + 1, depth + 1))

    counts = {}
    for k, _, _, n, least in rows:
        for i in range(0, len(k), 16):
            old = counts.get((i // 16, k[i : i + 16]), (0, least))
            counts[i // 16, k[i : i + 16]] = (old[0] + n, min(old[1], least))
    want = sorted((d, n, least) for (d, _), (n, least) in counts.items())
    for cuts in ([], [1], [60], [len(rows) - 1], [10, 11, 12, 90], sorted(rng.sample(range(1, len(rows)), 30)), list(range(1, len(rows)))):
        assert expanded(cuts) == want, cuts


def test_subtree_sums(spark):
    rng = random.Random(7)
    parent = {0: None} | {k: rng.randrange(max(0, k - 3), k) for k in range(1, 400)}
    rows = [(bytes([k // 256, k % 256]), None if p is None else bytes([p // 256, p % 256]), k) for k, p in parent.items()]
    got = {int.from_bytes(r["id"]): r["v"] for r in subtree_sums(spark.createDataFrame(rows, "id binary, parent binary, v long"), ["v"]).collect()}
    want = dict(zip(parent, parent))
    for k in reversed(parent):
        if parent[k] is not None:
            want[parent[k]] += want[k]
    assert got == want
