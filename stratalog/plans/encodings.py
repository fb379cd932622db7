"""Encodings and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..operators import transactions as X
from ..sources import views
from ..sources.views import with_views
from .registry import query

U64_SQL = """CASE WHEN v < 128 THEN lpad(hex(v), 2, '0') WHEN v < 16384 THEN lpad(hex(v + 32768), 4, '0') WHEN v < 2097152 THEN lpad(hex(v + 12582912), 6, '0')
WHEN v < 268435456 THEN lpad(hex(v + 3758096384), 8, '0') WHEN v < 34359738368 THEN lpad(hex(v + 1030792151040), 10, '0') ELSE lpad(hex(v + 277076930199552), 12, '0') END"""
V_SQL = "V AS (SELECT DISTINCT l_orderkey * l_orderkey * (1 + l_orderkey % 97) % 4000000000000 AS v FROM lineitem)"


def numbers(spark, sf):
    k = F.col("l_orderkey")
    return views.table(spark, sf, "lineitem").select((k * k * (1 + k % 97) % 4_000_000_000_000).alias("v")).distinct()


@query(f"WITH {V_SQL} SELECT v, {U64_SQL} AS encoded FROM V")
def tuple_u64_encode(spark, sf):
    return numbers(spark, sf).select("v", E.u64_hex(F.col("v")).alias("encoded"))


@query(f"WITH {V_SQL} SELECT v % 1000 AS part, v, row_number() OVER (PARTITION BY v % 1000 ORDER BY v) AS pos FROM V")
def tuple_sort_order(spark, sf):
    """Positions by the encoding are positions by the number."""
    place = F.row_number().over(Window.partitionBy(F.col("v") % 1000).orderBy(E.u64_hex(F.col("v"))))
    return numbers(spark, sf).select((F.col("v") % 1000).alias("part"), "v", place.cast("long").alias("pos"))


# Seven bits a byte with a one behind, then a zero byte.
BYTES_SQL = """CASE WHEN length({0}) = 0 THEN '00' ELSE array_to_string(list_transform(range(1, (length({0}) * 8 + 6) // 7 + 1), lambda i: lpad(hex(CAST(list_sum(list_transform(range(1, 8),
  lambda j: CASE WHEN substr(rpad(array_to_string(list_transform(range(1, length({0}) + 1), lambda k: lpad(bin(ascii(substr({0}, k, 1))), 8, '0')), ''), CAST((length({0}) * 8 + 6) // 7 * 7 AS INTEGER), '0'), 7 * (i - 1) + j, 1) = '1'
  THEN 1 << (8 - j) ELSE 0 END)) + 1 AS BIGINT)), 2, '0')), '') || '00' END"""


@query("SELECT p_partkey AS id, " + BYTES_SQL.format("p_name") + " AS encoded FROM part")
def tuple_bytes_encode(spark, sf):
    """Byte strings by seven bits; the tests hold their order and the way back."""
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), E.bytes_hex(F.hex(F.col("p_name").cast("binary"))).alias("encoded"))


@query("SELECT l_orderkey AS a, l_linenumber AS b, " + U64_SQL.replace("v", "l_orderkey") + " || " + BYTES_SQL.format("l_returnflag") + " || " + U64_SQL.replace("v", "l_linenumber") + " AS encoded FROM lineitem")
def tuple_encode(spark, sf):
    """Tuples of a number, a byte string and a number."""
    coded = F.concat(E.u64_hex(F.col("l_orderkey")), E.bytes_hex(F.hex(F.col("l_returnflag").cast("binary"))), E.u64_hex(F.col("l_linenumber").cast("long")))
    return views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), coded.alias("encoded"))


@query("SELECT l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def tuple_decode_prefix(spark, sf):
    """The number in front of a tuple and the one behind it, read back from the encoding."""
    rows = views.table(spark, sf, "lineitem").select(F.concat(E.u64_hex(F.col("l_orderkey")), E.u64_hex(F.col("l_linenumber").cast("long"))).alias("t"))
    rows = rows.select(E.u64_from_hex(F.col("t")).alias("a"), F.substr("t", E.u64_length(F.col("t")) + 1).alias("rest"))
    return rows.select("a", E.u64_from_hex(F.col("rest")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_suppkey AS shard, l_partkey AS tablet, lpad(hex(l_suppkey), 8, '0') || lpad(hex(l_partkey), 16, '0') AS encoded FROM lineitem")
def tablet_id_encode(spark, sf):
    """A shard in four bytes and a tablet in eight, big-endian, so that a shard is a prefix of its tablets."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shard"), F.col("l_partkey").alias("tablet")).distinct()
    return rows.select("shard", "tablet", F.concat(F.lpad(F.hex("shard"), 8, "0"), F.lpad(F.hex("tablet"), 16, "0")).alias("encoded"))


@query("SELECT event_id, upper(replace(u, '-', '')) AS encoded FROM (SELECT event_id, CAST(CAST(md5(CAST(event_id AS VARCHAR)) AS UUID) AS VARCHAR) AS u FROM events)")
def uuid_encode(spark, sf):
    """UUIDs as their sixteen bytes, big-endian."""
    md5 = F.md5(F.col("event_id").cast("string"))
    text = F.concat_ws("-", F.substr(md5, F.lit(1), F.lit(8)), F.substr(md5, F.lit(9), F.lit(4)), F.substr(md5, F.lit(13), F.lit(4)), F.substr(md5, F.lit(17), F.lit(4)), F.substr(md5, F.lit(21), F.lit(12)))
    return views.table(spark, sf, "events").select("event_id", F.hex(F.unhex(F.replace(text, F.lit("-"), F.lit("")))).alias("encoded"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, lpad(hex(o_custkey % 16), 8, '0') || lpad(hex(epoch_us(o_orderdate)), 16, '0') || lpad(hex(o_orderkey), 32, '0') AS txid FROM orders")
def txid_encode(spark, sf):
    rows = views.table(spark, sf, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), X.txid(views.micros("o_orderdate"), F.hex("o_orderkey"), F.col("o_custkey") % 16).alias("txid"))


# Keyspaces: 24 bits of the part's number under one of the four types.
KEYSPACE_SQL = "K AS (SELECT p_partkey % 16777216 + CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 16777216 WHEN 2 THEN 33554432 ELSE 4278190080 END AS id FROM part)"


@query(f"WITH {KEYSPACE_SQL} SELECT id, CASE id >> 24 WHEN 0 THEN 'data' WHEN 1 THEN 'pending' WHEN 2 THEN 'precond' WHEN 255 THEN 'meta' END AS type, CASE WHEN id >> 24 < 3 THEN id & 16777215 END AS data, CASE WHEN id >> 24 = 0 THEN id + 16777216 END AS pending, CASE WHEN id >> 24 = 0 THEN id + 33554432 END AS precond FROM K")
def keyspace_type(spark, sf):
    kind = F.shiftright("id", 24)
    name = F.when(kind == 0, "data").when(kind == 1, "pending").when(kind == 2, "precond").when(kind == 255, "meta")
    top = F.when(F.col("p_size") % 4 == 3, 255).otherwise(F.col("p_size") % 4).cast("long")
    rows = views.table(spark, sf, "part").select((F.col("p_partkey") % (1 << 24) + F.shiftleft(top, 24)).alias("id"))
    return rows.select("id", name.alias("type"), F.when(kind < 3, F.col("id").bitwiseAND(0xFFFFFF)).alias("data"), F.when(kind == 0, F.col("id") + (1 << 24)).alias("pending"), F.when(kind == 0, F.col("id") + (2 << 24)).alias("precond"))


# Nodes: an address, a port and an id out of each supplier; every seventh lacks the port.
NODE_SQL = "N AS (SELECT s_suppkey AS id, '[10.' || s_nationkey || '.' || s_suppkey % 256 || '.1]' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE ':' || (7000 + s_suppkey % 1000) END || '/4f1c9a52-5a0e-7c3b-8d11-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS text FROM supplier)"
NODE = r"^\[([^\]]+)\]:(\d+)/([0-9a-f-]{36})$"


@query(f"WITH {NODE_SQL} SELECT text, nullif(regexp_extract(text, '{NODE}', 1), '') AS addr, TRY_CAST(nullif(regexp_extract(text, '{NODE}', 2), '') AS INTEGER) AS port, nullif(regexp_extract(text, '{NODE}', 3), '') AS node FROM N")
def node_id_parse(spark, sf):
    """The text form ``[address]:port/id`` of a node, taken apart; other texts give nothing."""
    key = F.col("s_suppkey")
    port = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(":"), (7000 + key % 1000).cast("string")))
    text = F.concat(F.lit("[10."), F.col("s_nationkey").cast("string"), F.lit("."), (key % 256).cast("string"), F.lit(".1]"), port, F.lit("/4f1c9a52-5a0e-7c3b-8d11-"), F.lpad(key.cast("string"), 12, "0"))
    part = lambda i: F.nullif(F.regexp_extract("text", NODE, i), F.lit(""))
    return views.table(spark, sf, "supplier").select(text.alias("text")).select("text", part(1).alias("addr"), part(2).cast("int").alias("port"), part(3).alias("node"))


@query("SELECT c_custkey AS id, lower(hex(encode(c_name))) AS hex FROM customer")
def bytes_hex(spark, sf):
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.hex(F.col("c_name").cast("binary"))).alias("hex"))


@query("WITH P AS (SELECT p_partkey AS id, upper(hex(encode(p_name))) AS a, upper(hex(encode(p_type))) AS b FROM part) SELECT id, CAST((SELECT count(*) FROM range(1, 200) t(n) WHERE 2 * n <= least(length(a), length(b)) AND left(a, 2 * n) = left(b, 2 * n)) AS INTEGER) AS shared FROM P")
def shared_prefix_len(spark, sf):
    rows = views.table(spark, sf, "part")
    h = lambda c: F.hex(F.col(c).cast("binary"))
    return rows.select(F.col("p_partkey").alias("id"), E.shared_prefix_bytes(h("p_name"), h("p_type")).alias("shared"))


@query(f"WITH {V_SQL} SELECT v, CAST(greatest(1, ceil(length(ltrim(hex(v), '0')) / 2.0)) AS INTEGER) AS width FROM V")
def byte_width(spark, sf):
    return numbers(spark, sf).select("v", E.byte_width(F.col("v")).alias("width"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def ts_micros(spark, sf):
    return views.table(spark, sf, "events").select("event_id", views.micros("ts").alias("micros"))


@query("SELECT event_id, greatest(0, epoch_us(ts) - 1705276800000000) AS saturating, CASE WHEN epoch_us(ts) >= 1705276800000000 THEN epoch_us(ts) - 1705276800000000 END AS checked FROM events")
def ts_saturating_diff(spark, sf):
    gap = views.micros("ts") - 1_705_276_800_000_000
    return views.table(spark, sf, "events").select("event_id", F.greatest(F.lit(0), gap).alias("saturating"), F.when(gap >= 0, gap).alias("checked"))


@query(with_views(", K AS (SELECT DISTINCT user_id % 4 AS keyspace, key FROM R), C AS (SELECT *, lag(key) OVER (PARTITION BY keyspace ORDER BY key) AS before FROM K), S AS (SELECT keyspace, key, coalesce((SELECT max(n) FROM range(0, 9) t(n) WHERE left(key, 2 * n) = left(before, 2 * n)), 0) AS shared FROM C) SELECT keyspace, key, CAST(shared AS INTEGER) AS shared, substr(key, 2 * shared + 1) AS rest, count(*) OVER (PARTITION BY keyspace) AS popularity FROM S", "R"))
def keyset_compress(spark, sf):
    """Front coding: each key as the bytes shared with the key before and the rest; key spaces with how often they occur."""
    keys = views.events(spark, sf).select((F.col("user_id") % 4).alias("keyspace"), "key").distinct()
    order = Window.partitionBy("keyspace").orderBy("key")
    shared = F.coalesce(E.shared_prefix_bytes(F.col("key"), F.lag("key").over(order)), F.lit(0))
    rows = keys.withColumn("shared", shared).withColumn("popularity", F.count("*").over(Window.partitionBy("keyspace")))
    return rows.select("keyspace", "key", "shared", F.substr("key", 2 * F.col("shared") + 1).alias("rest"), "popularity")


# Pairs of keys (hex) with hard cases: an ordinary byte between, prefixes, equal keys, nothing between, neighbouring bytes, reversed order.
PAIRS = [("616161616161", "636363636363"), ("616161616161", "616163636363"), ("", "FF"), ("", "01"), ("", ""), ("", "00"), ("00", "FF"), ("1552", "1553"), ("0580FF", "05FF"), ("63", "61"), ("05", "0501"), ("05", "0500")]
PAIR_SQL = "P AS (SELECT upper(hex(encode(p_name))) AS a, upper(hex(encode(p_type))) AS b FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") V(a, b))"
#: What lies strictly between lo and hi (hex), over a relation with both and the bytes they share.
BETWEEN_SQL = """CASE WHEN lo = hi THEN NULL
  WHEN length(lo) = 2 * shared THEN CASE WHEN substr(hi, 2 * shared + 1, 2) <> '00' THEN lo || lpad(hex(CAST('0x' || substr(hi, 2 * shared + 1, 2) AS BIGINT) // 2), 2, '0') END
  WHEN CAST('0x' || substr(hi, 2 * shared + 1, 2) AS BIGINT) - CAST('0x' || substr(lo, 2 * shared + 1, 2) AS BIGINT) = 1 THEN lo || '7F'
  ELSE left(lo, 2 * shared) || lpad(hex((CAST('0x' || substr(hi, 2 * shared + 1, 2) AS BIGINT) + CAST('0x' || substr(lo, 2 * shared + 1, 2) AS BIGINT)) // 2), 2, '0') END"""
SHARED_SQL = "coalesce(list_max(list_filter(range(0, 200), lambda n: 2 * n <= least(length(lo), length(hi)) AND left(lo, 2 * n) = left(hi, 2 * n))), 0)"


@query(f"WITH {PAIR_SQL}, L AS (SELECT a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM P), S AS (SELECT *, {SHARED_SQL} AS shared FROM L) SELECT a, b, {BETWEEN_SQL} AS split FROM S")
def shortest_between(spark, sf):
    """A short key strictly between two, in whichever order they come."""
    pairs = views.table(spark, sf, "part").select(F.hex(F.col("p_name").cast("binary")).alias("a"), F.hex(F.col("p_type").cast("binary")).alias("b"))
    pairs = pairs.unionByName(spark.createDataFrame(PAIRS, "a string, b string"))
    return pairs.select("a", "b", E.shortest_between_hex(F.col("a"), F.col("b")).alias("split"))
