"""The engine's queries against DuckDB, and its parts against plain models."""

import pathlib
import random
import re
import subprocess
import sys
from uuid import UUID

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratalog import catalog
from stratalog.functions import encodings as E
from stratalog.operators import bounds, graphs, intervals
from stratalog.operators import revisions as V
from stratalog.plans import checker
from stratalog.engine import Engine
from stratalog.sources.store import Conflict, Store, overlapping
from stratalog.streaming import journal as J

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TIMELINE = {"a": ((1, 4, 9), ()), "b": ((3, 9), ()), "c": ((3,), (5,)), "d": ((3, 5), (4,)), "e": ((4, 8), ()), "f": ((5, 8), ()), "g": ((1, 6, 9), (3,)), "h": ((2, 4, 6, 9), (5,)), "i": ((2, 5, 6, 8), ()), "j": ((2, 4, 6, 8), (1, 3, 5, 7, 9)), "k": ((8,), ()), "l": (tuple(range(1, 10)), ())}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def test_entry():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def timeline(spark):
    rows = [(k.encode().hex().upper(), t, 0, t in deletes) for k, (puts, deletes) in TIMELINE.items() for t in (*puts, *deletes)]
    return spark.createDataFrame(rows, "key string, ts long, tie long, is_tombstone boolean").coalesce(1)


def keys(rows):
    return [(bytes.fromhex(r.key).decode(), r.ts) for r in rows]


def test_snapshots(timeline):
    at5 = V.snapshot(timeline, 5, V.KeyRange("62", "6500")).orderBy("key").collect()
    assert keys(at5) == [("b", 3), ("d", 5), ("e", 4)]
    assert keys(V.snapshot(timeline, 4).orderBy("key").collect()) == [("a", 4), ("b", 3), ("c", 3), ("e", 4), ("h", 4), ("i", 2), ("j", 4), ("l", 4)]


@pytest.mark.parametrize("direction,limit", [("asc", 1), ("asc", 3), ("desc", 2), ("desc", 5)])
def test_pages_join_to_the_snapshot(timeline, direction, limit):
    found = [r for page in V.scan_pages(timeline, 5, direction=direction, limit=limit) for r in keys(page.rows.orderBy("key", ascending=direction == "asc").collect())]
    whole = keys(V.snapshot(timeline, 5).orderBy("key").collect())
    assert found == (whole if direction == "asc" else whole[::-1])


def test_prefixes():
    assert V.successor("00FF") == "01" and V.successor("FF") is None and V.successor(b"a\xff") == b"b" and V.successor("") is None


def test_bounds_agree_with_keys(spark):
    kinds = [("BeforeAll", ""), ("Before", "01"), ("After", "01"), ("AfterPrefix", "01"), ("AfterPrefix", "FF"), ("AfterAll", "")]
    cuts = spark.createDataFrame(kinds, "kind string, k string").select("kind", "k", bounds.bound(F.col("kind"), F.col("k")).alias("b"))
    key = spark.createDataFrame([(x,) for x in ("", "00", "01", "0100", "01FF", "02", "FF", "FF00")], "key string")
    for r in cuts.crossJoin(key).select("kind", "k", "key", (bounds.key_place(F.col("key")) < F.col("b")).alias("below")).collect():
        wanted = {"BeforeAll": False, "AfterAll": True, "Before": r.key < r.k, "After": r.key <= r.k, "AfterPrefix": r.key < r.k or r.key.startswith(r.k)}[r.kind]
        assert r.below == wanted, r


def test_encodings_keep_order():
    numbers = sorted({x + d for i in range(1, 10) for x in [2 ** (7 * i)] for d in (-1, 0, 1) if x + d < 2**64} | {0, 1, 2**64 - 1})
    coded = [E.encode_u64(n) for n in numbers]
    assert coded == sorted(coded) and [E.decode_u64(c) for c in coded] == [(n, len(c)) for n, c in zip(numbers, coded)]
    strings = sorted({bytes([a, b][:n]) + tail for a in (0, 1, 127, 255) for b in (0, 128) for n in (0, 1, 2) for tail in (b"", b"\xff" * 9)})
    coded = [E.encode_bytes(s) for s in strings]
    assert coded == sorted(coded) and [E.decode_bytes(c + b"x")[0] for c in coded] == strings
    assert E.encode_tuple(1, b"a", 2) < E.encode_tuple(1, b"a", 3) < E.encode_tuple(1, b"b", 0)
    assert E.front_decoded(E.front_coded(strings)) == strings
    ident = UUID(int=7 << 64 | 9)
    for values in ((5,), (1, b"a"), (b"", ident, 2**40), (b"x\0", 0, ident, b"y")):
        kinds = tuple(type(v) for v in values)
        assert E.decode_tuple(E.encode_tuple(*values), kinds) == values
        assert E.decode_tuple(E.encode_tuple(*values) + b"\x05", kinds, prefix=True) == values
        with pytest.raises(ValueError):
            E.decode_tuple(E.encode_tuple(*values) + b"\x05", kinds)


# Pairs of keys and the key between them.
BETWEEN = [("aaaaaa", "cccccc", "b"), ("aaaaaa", "aacccc", "aab"), ("", "\xff", "\x7f"), ("", "\x01", "\x00"), ("", "", None), ("", "\x00", None), ("\x00", "\xff", "\x7f"), ("\x15\x52", "\x15\x53", "\x15\x52\x7f"), ("\x05\x80\xff", "\x05\xff", "\x05\xbf")]


def test_shortest_between(spark):
    raw = lambda x: None if x is None else x.encode("latin-1")
    cases = [(raw(a), raw(b), raw(k)) for a, b, k in BETWEEN]
    for a, b, k in cases:
        assert E.shortest_between(a, b) == k == E.shortest_between(b, a)
    rng = random.Random(3)
    key = lambda: bytes(rng.choice((0, 1, 2, 127, 254, 255)) for _ in range(rng.randrange(4)))
    cases += [(a, b, E.shortest_between(a, b)) for a, b in ((key(), key()) for _ in range(2000))]
    assert all(k is None or min(a, b) < k < max(a, b) for a, b, k in cases)
    frame = spark.createDataFrame([(a.hex().upper(), b.hex().upper(), k and k.hex().upper()) for a, b, k in cases], "a string, b string, k string")
    assert frame.where(~E.shortest_between_hex(F.col("a"), F.col("b")).eqNullSafe(F.col("k"))).count() == 0


def test_coded_columns(spark):
    strings = [bytes([a, b][:n]) + tail for a in (0, 1, 127, 255) for b in (0, 128) for n in (0, 1, 2) for tail in (b"", b"\xff" * 9)]
    frame = spark.createDataFrame([(s.hex().upper(), E.encode_bytes(s).hex().upper()) for s in strings], "raw string, coded string")
    assert frame.where(E.bytes_hex(F.col("raw")) != F.col("coded")).count() == 0
    numbers = [0, 1, 127, 128, 2**14 - 1, 2**14, 2**35, 2**56 - 1, 2**56, 2**62]
    frame = spark.createDataFrame([(n, E.encode_u64(n).hex().upper()) for n in numbers], "n long, coded string")
    tail = F.concat("coded", F.lit("0102"))
    assert frame.where((E.u64_hex(F.col("n")) != F.col("coded")) | (E.u64_from_hex(tail) != F.col("n")) | (E.u64_length(tail) != F.length("coded"))).count() == 0


def test_range_sets(spark):
    """Unions, differences, overlaps and maps against sets of whole numbers."""
    rng = random.Random(9)
    draw = lambda n: [(a, a + rng.randrange(0, 30)) for a in (rng.randrange(600) for _ in range(n))]
    cells = lambda rs: {x for a, b in rs for x in range(a, b)}

    def islands(points):
        out, start = [], None
        for x in sorted(points):
            if x - 1 not in points:
                start = x
            if x + 1 not in points:
                out.append((start, x + 1))
        return out

    for n in (1, 40, 150):
        a, b = draw(n), draw(n)
        fa, fb = (spark.createDataFrame(r, "lo long, hi long").repartition(3) for r in (a, b))
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(intervals.union(fa)) == islands(cells(a))
        assert rows(intervals.union(intervals.intersection(intervals.union(fa), intervals.union(fb)))) == islands(cells(a) & cells(b))
        assert rows(intervals.union(intervals.difference(fa, fb))) == islands(cells(a) - cells(b))
        assert rows(intervals.overlaps(fa, fb)) == sorted((*x, *y) for x in a for y in b if max(x[0], y[0]) < min(x[1], y[1]))
        points = spark.createDataFrame([(p,) for p in range(0, 640, 7)], "p long")
        assert rows(intervals.containing(points, fa, "p").select("p", "lo", "hi")) == sorted((p, *x) for p in range(0, 640, 7) for x in a if x[0] <= p < x[1])
        held = {x: i for i, r in enumerate(a) for x in range(*r)}
        got = intervals.overlay(spark.createDataFrame([(lo, hi, i, i) for i, (lo, hi) in enumerate(a)], "lo long, hi long, seq long, value long")).collect()
        assert {x: r.value for r in got for x in range(r.lo, r.hi)} == held
    open_ = intervals.union(spark.createDataFrame([(None, 5), (3, 9), (9, 12), (20, None), (30, 40)], "lo long, hi long"))
    assert set(map(tuple, open_.collect())) == {(None, 12), (20, None)} and set(map(tuple, intervals.complement(open_).collect())) == {(12, 20)}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    write = lambda rows: spark.createDataFrame(rows, "key string, value string")
    first = store.commit(write([("61", "x"), ("62", "y")]))
    second = store.commit(write([("61", None), ("63", "z")]), spark.createDataFrame([("61", first)], "key string, since long"))
    with pytest.raises(Conflict):
        store.commit(write([("61", "late")]), spark.createDataFrame([("61", first)], "key string, since long"))
    live = lambda **k: sorted((r.key, r.value) for r in store.snapshot(**k).collect())
    assert live(at=first) == [("61", "x"), ("62", "y")] and live(at=second) == [("62", "y"), ("63", "z")]
    store.compact()
    assert live(at=first) == [("61", "x"), ("62", "y")] and len(store.manifest()) == 1
    store.compact(horizon=second)
    assert live() == [("62", "y"), ("63", "z")] and live(version=1) == [("61", "x"), ("62", "y")]


def test_store_publishes_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.commit(spark.createDataFrame([("61", "x")], "key string, value string"))
    with pytest.raises(Conflict):
        store._publish(1, [])
    assert len(store.manifest(1)) == 1 and sorted(p.name for p in (tmp_path / "t/manifest").iterdir() if p.suffix == ".json") == ["v1.json"]


def test_levels(spark, tmp_path):
    """Whatever is compacted, every read stays what it was; levels stay disjoint."""
    store, model = Store(spark, str(tmp_path / "t")), {}
    rng, states = random.Random(5), {}
    for _ in range(6):
        write = {f"{rng.randrange(40):02X}": rng.choice([None, f"v{rng.random()}"]) for _ in range(12)}
        at = store.commit(spark.createDataFrame(list(write.items()), "key string, value string"))
        model |= write
        states[at] = {k: v for k, v in model.items() if v is not None}

    def check():
        for at, wanted in states.items():
            assert {r.key: r.value for r in store.snapshot(at=at).collect()} == wanted
        for level in {r.level for r in store.manifest()} - {0}:
            assert not overlapping([r for r in store.manifest() if r.level == level])

    store.flush()
    assert {r.level for r in store.manifest()} == {1}
    check()
    store.split_runs(("10", "20"))
    assert not any(r.lower < b <= r.upper for r in store.manifest() for b in ("10", "20")) and len(store.manifest()) == 3
    check()
    store.push_down(1)
    assert sorted(r.level for r in store.manifest()) == [1, 1, 2]
    check()
    store.commit(spark.createDataFrame([("05", None), ("FF", "x")], "key string, value string"))
    store.maintain(level0=1, level1=30)
    sizes = {n: sum(r.rows for r in store.manifest() if r.level == n) for n in (0, 1)}
    assert sizes[0] == 0 and sizes[1] <= 30
    check()
    last = max(r.level for r in store.manifest())
    newest = max(states)
    store.merge(lambda runs: runs, last, horizon=newest)
    assert {r.key: r.value for r in store.snapshot(at=newest).collect()} == states[newest]


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    frame = lambda rows, more="value string": spark.createDataFrame(rows, f"keyspace long, key string, {more}")
    with pytest.raises(ValueError):
        engine.create_keyspace(7, 1)
    with pytest.raises(ValueError):
        engine.create_group(1, ["20", "10"])
    engine.create_group(1, ["10", "20"])
    engine.create_keyspace(7, 1)
    engine.create_keyspace(8, 1)
    with pytest.raises(Conflict):
        engine.create_keyspace(7, 1)
    first = engine.write(frame([(7, "11", "a"), (7, "22", "b"), (8, "11", "other")]))
    second = engine.write(frame([(7, "11", None), (7, "33", "c")]), frame([(7, "22", first)], "since long"))
    for bad, error in ((frame([(9, "11", "x")]), ValueError), (frame([(7, "1", "x"), (7, "1", "y")]), ValueError), (frame([]), ValueError)):
        with pytest.raises(error):
            engine.write(bad)
    with pytest.raises(Conflict):
        engine.write(frame([(7, "44", "x")]), frame([(7, "11", first)], "since long"))
    rows = lambda df: [(r.key, r.value) for r in df.collect()]
    assert rows(engine.get(7, ["33", "11", "22"]).orderBy("pos")) == [("33", "c"), ("11", None), ("22", "b")]
    assert rows(engine.get(7, ["11"], at=first)) == [("11", "a")] and engine.get_latest(7, ["22"])[1] == first and engine.get_latest(7, ["99"])[1] == second
    page, left = engine.scan(7, limit=2)
    assert rows(page) == [("22", "b")]  # the delete counts towards the limit
    page, left = engine.scan(7, left[0], left[1], limit=2)
    assert rows(page) == [("33", "c")]
    assert rows(engine.scan(7, direction="desc")[0]) == [("33", "c"), ("22", "b")]
    assert [(r.value, r.is_tombstone) for r in engine.history(7, "11").collect()] == [("a", False), (None, True)]


PUSHED = ("get_at", "get_multi_at", "scan_full_snapshot", "scan_prefix", "scan_clipped_to_tablet", "history_asc", "history_since", "history_between", "scan_page_desc", "get_multi_positional")


@pytest.mark.parametrize("name", PUSHED)
def test_reads_push_filters(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", plan)[1]
    number, time = ("o_custkey", "o_orderdate") if name == "scan_prefix" else ("user_id", "ts")
    assert re.search(rf"(EqualTo|In|GreaterThanOrEqual|LessThan)\({number},", pushed), pushed
    assert name in ("scan_prefix", "history_asc") or re.search(rf"(GreaterThanOrEqual|LessThanOrEqual)\({time},", pushed), pushed


def test_stream_accepts_as_batch(spark, tmp_path):
    rows = [(1, i + 1, f"n{i % 2}", i * 10, "acquire" if i % 3 == 0 else "append", i * 10 + 25, "k", "put") for i in range(12)]
    journal = spark.createDataFrame(rows, J.ENTRY)
    journal.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = J.accepted_stream(spark.readStream.schema(J.ENTRY).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = sorted((r.seq, r.accepted) for r in spark.table("accepted").collect())
    assert got == sorted((r.seq, r.accepted) for r in J.accepted_proposals(journal).collect()) and any(a for _, a in got) and not all(a for _, a in got)


def test_change_stream(spark, tmp_path):
    schema = "key string, ts long, value string, is_tombstone boolean"
    spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = J.apply_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted((r.key, r.value) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()) == [("a", "y"), ("b", "z")]


# A small graph with three components.
EDGES = [(0, 1), (1, 2), (1, 4), (1, 6), (2, 3), (3, 2), (3, 4), (3, 5), (4, 5), (5, 4), (6, 0), (6, 2)]


def test_small_graph(spark):
    graph = spark.createDataFrame(EDGES, "src long, dst long")
    assert {(r.v, r.component) for r in graphs.strong_components(graph).collect()} == {(0, 0), (1, 0), (6, 0), (2, 2), (3, 2), (4, 4), (5, 4)}
    assert graphs.shortest_cycle(graph, 0) == 3 and graphs.cycle_path(graph, 0) == [(0, 1), (1, 6), (6, 0)] and graphs.cycle_path(graph, 2) == [(2, 3), (3, 2)]


def test_explained_cycle(spark):
    sf = "/root/testdata/sf0.001"
    path = catalog.QUERIES["explain_cycle"](spark, sf).orderBy("place").collect()
    edges = {(r.src, r.dst, r.kind) for r in checker.dependencies(spark, sf).collect()}
    assert all((r.src, r.dst, r.kind) in edges for r in path) and path
    assert all(a.dst == b.src for a, b in zip(path, [*path[1:], path[0]]))
    assert len(path) == catalog.QUERIES["shortest_cycle_len"](spark, sf).first()["length"]


def test_asof_in_slices(spark):
    """Hot keys, ties and times on both sides: the sliced join equals the plain one and a loop."""
    rng = random.Random(8)
    log = [(rng.choice("ab"), rng.randrange(60), i) for i in range(400)] + [("c", 5, 1000)]
    asks = [(rng.choice("abcd"), rng.randrange(-5, 70), i) for i in range(300)]
    frame = spark.createDataFrame(log, "key string, ts long, tie long").repartition(3)
    requests = spark.createDataFrame(asks, "key string, at long, id long")
    for strict in (False, True):
        wanted = {i: max(((t, x) for k2, t, x in log if k2 == k and (t < at if strict else t <= at)), default=(None, None)) for k, at, i in asks}
        for hot in (False, True):
            assert {r.id: (r.ts, r.tie) for r in V.asof_join(requests, frame, "id", strict=strict, hot=hot).collect()} == wanted


def test_cycles(spark):
    line = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert graphs.strong_components(line).collect() == [] and graphs.shortest_cycle(line, 1) is None


def test_long_cycle(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 66) for i in range(66)] + [(5, 4)], "src long, dst long")
    assert graphs.shortest_cycle(ring, 0) == 66 and graphs.shortest_cycle(ring, 4) == 2


FIRST = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = entry.queries()["round_robin_placement"](spark, "/root/testdata/sf0.001").orderBy("user_id").collect()
assert rows and [r.shard for r in rows] == [i % 3 for i in range(len(rows))]
"""


def test_numbered_first_in_a_session():
    """Expression ids are lowest in a session's first query, where the optimizer set a filter that lacked its column."""
    done = subprocess.run([sys.executable, "-c", FIRST], cwd=pathlib.Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_slices(spark):
    """Each value's slice is the number of cuts that aren't above it; null is in the first."""
    values = [None, -3, 0, 1, 2, 5, 7, 8, 9, 100]
    for cuts in ([], [2], [0, 5], [0, 2, 8], list(range(-2, 61))):
        rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", intervals.slice_of(F.col("v"), cuts).alias("s")).collect()
        assert {r.v: r.s for r in rows} == {v: 0 if v is None else sum(v >= c for c in cuts) for v in values}


def test_number_bytes(spark):
    """First bytes by length as in the reference: five ones before six bytes, from 2^35 to below 2^42."""
    wanted = {(1 << 35) - 1: "F7FFFFFFFF", 1 << 35: "F80800000000", 253287530496: "F83AF91D0000", 3999999999999: "FBA352943FFF", (1 << 42) - 1: "FBFFFFFFFFFF", 1 << 42: "FC040000000000"}
    rows = spark.createDataFrame([(v,) for v in wanted], "v long").select("v", E.u64_hex(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == wanted == {v: E.encode_u64(v).hex().upper() for v in wanted}


def plain_components(edges):
    """Vertex to the smallest one that it reaches and that reaches it, for components of two and more."""
    reach = {v: {b for a, b in edges if a == v} for v in {x for e in edges for x in e}}
    for k in reach:
        for v in reach:
            if k in reach[v]:
                reach[v] |= reach[k]
    parts = {v: {w for w in reach[v] if v in reach[w]} | {v} for v in reach}
    return {v: min(p) for v, p in parts.items() if len(p) > 1}


def test_local_components():
    rng = random.Random(3)
    graphs_ = [[], [(1, 2)], [(i, (i + 8) % 5000 - 7) for i in range(-7, 4993)], EDGES]
    graphs_ += [[(rng.randrange(-5, 25), rng.randrange(-5, 25)) for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    for edges in graphs_:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        v, component = graphs.local_components(pairs[:, 0], pairs[:, 1])
        wanted = dict.fromkeys(range(-7, 4993), -7) if len(edges) == 5000 else plain_components([e for e in edges if e[0] != e[1]])
        assert dict(zip(v.tolist(), component.tolist())) == wanted and len(v) == len(wanted)


def test_groups_over_batches():
    """Groups that end inside, at the end of and after several batches."""
    rng = random.Random(5)
    rows = [(g, 100 * g + rng.randrange(9), 100 * g + rng.randrange(9)) for g, n in enumerate((1, 30, 4, 12, 12, 1, 20)) for _ in range(n)]
    wanted = plain_components([(a, b) for _, a, b in rows if a != b])
    for size in (1, 3, 4, 12, 35, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], ["_group", "src", "dst"]) for i in range(0, len(rows), size)]
        found = [(r["v"], r["component"]) for b in graphs._components_of_groups(iter(batches)) for r in b.to_pylist()]
        assert dict(found) == wanted and len(found) == len(wanted)


def test_grouped_components(spark):
    """Closed groups, a null group, and a component over three groups that share vertices."""
    rows = [("a", 1, 2), ("a", 2, 1), (None, 3, 4), (None, 4, 3), ("b", 10, 11), ("c", 11, 12), ("d", 12, 10), ("d", 12, 13), ("e", 20, 20), ("e", 21, 22)]
    frame = spark.createDataFrame(rows, "g string, src long, dst long")
    found = graphs.grouped_components(frame, "g").collect()
    assert {r.v: r.component for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10, 12: 10} and len(found) == 7


def test_scc_takes_no_rounds(spark, sf):
    """A fixed number of jobs, however long the cycles; rounds over the whole graph took hundreds."""
    spark.sparkContext.setJobGroup("scc-jobs", "")
    catalog.QUERIES["scc"](spark, sf).count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("scc-jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 40


def test_scc_with_repeated_orders(spark, tmp_path):
    """Order keys on several lists tie their lists together; customers may be null."""
    rng = random.Random(11)
    rows = [(rng.randrange(70), rng.choice([None, *range(9)]), rng.choice("POF"), rng.randrange(40)) for _ in range(110)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, day int")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frame.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "CAST(date_add(DATE'2020-01-01', day) AS timestamp_ntz) AS o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("scc", "shortest_cycle_len"):
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
        assert got and got == sorted(c.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_cycle_is_sought_inside_its_component(spark, sf, monkeypatch):
    """The search writes and reads the edges of one component, not all."""
    handed, search = [], graphs.cycle_path
    monkeypatch.setattr(graphs, "cycle_path", lambda edges, start: handed.append(edges) or search(edges, start))
    path = catalog.QUERIES["explain_cycle"](spark, sf).collect()
    part = {r.component: set() for r in catalog.QUERIES["scc"](spark, sf).collect()}
    for r in catalog.QUERIES["scc"](spark, sf).collect():
        part[r.component].add(r.v)
    edges = {(r.src, r.dst) for r in handed[0].collect()}
    least = part[min(part, key=lambda c: (len(part[c]), c))]
    assert path and edges == {(r.src, r.dst) for r in checker.dependencies(spark, sf).collect() if r.src in least and r.dst in least}


def test_shortest_cycle_takes_few_jobs(spark, sf):
    """Jobs for the steps of one short cycle, none for those of reachability."""
    spark.sparkContext.setJobGroup("cycle-jobs", "")
    catalog.QUERIES["shortest_cycle_len"](spark, sf).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("cycle-jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 120
