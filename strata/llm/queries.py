"""Queries of the eight problems and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import distinct, heavy, leaks, quantiles, seen, sentences, tokens

Query = Callable[[SparkSession, str], DataFrame]

#: Groups of problems 1 and 5.
GROUPS = ("day", "type", "stage")
BY = tuple(f"by_{g}" for g in GROUPS)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def telemetry(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "telemetry_event").select(F.to_date("time").alias("day"), "type", "stage", *columns)


def _distinct(spark, d, hash):
    cells = distinct.registers(telemetry(spark, d, "key"), "key", GROUPS, hash=hash)
    return distinct.estimate(distinct.cube(cells, GROUPS, ("day",)), (*GROUPS, *BY))


def p1_distinct(spark, d):
    """Distinct keys per day, type, stage and each combination, by registers of xxhash64 ranks."""
    return _distinct(spark, d, "xxhash64")


def p1_distinct_portable(spark, d):
    """The same operator on md5 bits, which other engines can repeat exactly."""
    return _distinct(spark, d, "md5")


def p1_weekly_merge(spark, d):
    """Distinct keys per week and type, merged from the registers of days and stages."""
    cells = distinct.registers(telemetry(spark, d, "key"), "key", GROUPS, hash="md5")
    weeks = cells.where("day IS NOT NULL").withColumn("week", F.date_trunc("week", "day").cast("date"))
    return distinct.estimate(distinct.merge(weeks, ("week", "type")), ("week", "type"))


def p1_registers(spark, d):
    """The mergeable partial result of the finest groups: registers per day, type and stage."""
    return distinct.registers(telemetry(spark, d, "key"), "key", GROUPS, hash="md5")


def p1_error_check(spark, d):
    """Of each combination of day, type and stage, how many groups have their exact count within two standard errors."""
    rows = telemetry(spark, d, "key")
    est = distinct.estimate(distinct.cube(distinct.registers(rows, "key", GROUPS, hash="md5"), GROUPS, ("day",)), (*GROUPS, *BY))
    exact = _cube(rows.distinct(), "key").groupBy(*GROUPS, *BY).agg(F.count("key").alias("n_exact"))
    both = _beside(est, exact)
    inside = F.col("n_exact").between(F.col("low"), F.col("high"))
    return both.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(inside, 1)).alias("n_inside"))


def _cube(rows, *columns):
    """Distinct values of columns in every combination of the groups, with n, the rows, and by_<group>; a null day is no group."""
    sets = [[*(g for i, g in enumerate(GROUPS) if mask >> i & 1), *columns] for mask in range(1 << len(GROUPS))]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*GROUPS, *columns)])
    out = out.agg(F.sum("n") if "n" in rows.columns else F.count(F.lit(1)), *[(F.grouping(g) == 0).alias(b) for g, b in zip(GROUPS, BY)])
    return out.toDF(*GROUPS, *columns, "n", *BY).where("NOT by_day OR day IS NOT NULL")


def _beside(a, b):
    """Rows of a and b of the same group; groups may be null."""
    names = (*GROUPS, *BY)
    b = b.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return a.join(b, on).drop(*[f"_{c}" for c in names])


def _keys(spark, d):
    """Keys of both tables as bytes."""
    names = ("telemetry_event", "change_log")
    a, b = [table(spark, d, n).select(F.lit(n).alias("table_name"), F.col("key").cast("binary").alias("key")) for n in names]
    return a.unionByName(b)


def p2_found(spark, d):
    """Keys with at least 1 % of the rows of their table that have a key, by group testing."""
    return heavy.frequent(_keys(spark, d), "key", "table_name").select("table_name", F.hex("key").alias("key_hex"))


def p2_heavy_counts(spark, d):
    """The keys of p2_found with their exact count and the rows with a key."""
    found = heavy.frequent(_keys(spark, d), "key", "table_name")
    return found.select("table_name", F.hex("key").alias("key_hex"), "n", "n_rows", (F.col("approx") >= F.col("n")).alias("approx_is_bound"))


def p2_approximate_counts(spark, d):
    """The same keys with the count of the sketch, an upper bound, beside the exact one."""
    found = heavy.frequent(_keys(spark, d), "key", "table_name")
    return found.select("table_name", F.hex("key").alias("key_hex"), "approx", "n")


def _seen(spark, d):
    return seen.classify(spark, f"{d}/change_log.parquet", f"{d}/incoming_record.parquet")


def p4_found(spark, d):
    """Incoming records whose key occurred before, by seen flags in a streaming state store."""
    return _seen(spark, d).where("is_repeat").select("rec_id")


def p4_wrong_rate(spark, d):
    """Records, repeats and wrong answers of the state store against a batch recount."""
    return seen.wrong_rate(_seen(spark, d), table(spark, d, "change_log"), table(spark, d, "incoming_record"))


def p5_percentiles(spark, d):
    """Median and other percentiles of duration_ms per day, type, stage and each combination."""
    cells = quantiles.digests(telemetry(spark, d, "duration_ms"), "duration_ms", GROUPS)
    return quantiles.quantiles(quantiles.cube(cells, GROUPS, ("day",)), (*GROUPS, *BY))


def p5_digests(spark, d):
    """The mergeable partial result of the finest groups: counted tree nodes per day, type and stage."""
    return quantiles.digests(telemetry(spark, d, "duration_ms"), "duration_ms", GROUPS)


def p5_rank_check(spark, d):
    """Whether each answer of p5_percentiles, of every combination, keeps its bound against the ranks of the values as they stand.

    An answer stands for the values of its code: itself below 2,048, at most a 1,024th more beyond.
    """
    q = p5_percentiles(spark, d)
    rows = telemetry(spark, d, "duration_ms").where("duration_ms IS NOT NULL")
    exact = _cube(rows.groupBy(*GROUPS, "duration_ms").agg(F.count(F.lit(1)).alias("n")), "duration_ms").withColumnRenamed("n", "c")
    wide = _beside(exact, q)
    shares = (("p50", "0.5"), ("p90", "0.9"), ("p99", "0.99"))
    v, sums = F.col("duration_ms"), []
    for p, _ in shares:
        more = F.expr(f"IF(abs({p}) < 2048, 0, abs({p}) div 1024)")
        low, high = F.when(F.col(p) < 0, F.col(p) - more).otherwise(F.col(p)), F.when(F.col(p) < 0, F.col(p)).otherwise(F.col(p) + more)
        sums += [F.sum(F.when(v <= high, F.col("c")).otherwise(0)).alias(f"to_{p}"), F.sum(F.when(v < low, F.col("c")).otherwise(0)).alias(f"under_{p}")]
    ranks = wide.groupBy(*GROUPS, *BY, "n", "max_rank_error").agg(*sums)
    ok = F.lit(True)
    for p, share in shares:
        target = F.ceil(F.lit(Decimal(share)) * F.col("n"))
        ok = ok & (F.col(f"to_{p}") >= target) & (F.col(f"under_{p}") <= target + F.col("max_rank_error"))
    return ranks.select(*GROUPS, *BY, "n", ok.alias("in_bound"))


def p6_ids(spark, d):
    """Token ids of each document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"))


def p7_found(spark, d):
    """Documents that hold a stretch of an item's passage, with the item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), every=False).select("doc_id", "item_id")


def p7_leaked_items(spark, d):
    """Documents and longest stretch of each item that leaked."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), every=False)
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("size").alias("longest"))


def p7_clean(spark, d):
    """Texts without the leaked stretches."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return leaks.without_leaks(docs, leaks.leaks(docs, table(spark, d, "eval_item")))


def p8_found(spark, d):
    """Place of each sentence unit of each document."""
    return sentences.sentences(table(spark, d, "documents"), sentence=False).select("doc_id", "start_pos", "end_pos")


def p8_sentences(spark, d):
    """The sentence units of each document with their text."""
    return sentences.sentences(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_distinct": p1_distinct,
    "p1_distinct_portable": p1_distinct_portable,
    "p1_weekly_merge": p1_weekly_merge,
    "p1_registers": p1_registers,
    "p1_error_check": p1_error_check,
    "p2_found": p2_found,
    "p2_heavy_counts": p2_heavy_counts,
    "p2_approximate_counts": p2_approximate_counts,
    "p4_found": p4_found,
    "p4_wrong_rate": p4_wrong_rate,
    "p5_percentiles": p5_percentiles,
    "p5_digests": p5_digests,
    "p5_rank_check": p5_rank_check,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_sentences": p8_sentences,
}

_REST = distinct.BITS - distinct.P
_M = 1 << distinct.P
_SIGMA = "x + " + " + ".join(f"pow(x, {float(1 << k)}) * {float(1 << (k - 1))}" for k in range(1, distinct.TERMS))
_E = distinct.standard_error()
#: Registers of the finest groups, as rows of day, type, stage, bucket, rank.
_CELLS = f"""h AS (SELECT CAST(time AS DATE) AS day, type, stage, CASE WHEN key IS NOT NULL THEN CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) END AS h FROM telemetry_event),
cells AS (SELECT day, type, stage, h >> {_REST} AS bucket, CASE WHEN h IS NULL THEN 0 WHEN h % {1 << _REST} = 0 THEN {_REST + 1} ELSE {_REST + 1} - length(ltrim(bin(h % {1 << _REST}), '0')) END AS rank FROM h)"""


def _estimate_sql(source: str, columns: str, then: str = "SELECT * FROM answer") -> str:
    return f"""state AS (SELECT {columns}, sum(CASE WHEN bucket IS NOT NULL THEN pow(2.0, -rank) END) AS s, count(bucket) AS used FROM {source} GROUP BY ALL),
est AS (SELECT {columns}, CAST(CASE WHEN used = 0 THEN 0 ELSE round({_M}::DOUBLE * {_M} / (2 * ln(2)) / (s + {_M} * ({_SIGMA}))) END AS BIGINT) AS n_distinct FROM (SELECT *, 1.0::DOUBLE - used / {_M}::DOUBLE AS x FROM state) q),
answer AS (SELECT {columns}, n_distinct, {round(_E, 6)}::DOUBLE AS rel_std_error, CAST(floor(n_distinct * {1 - 2 * _E!r}::DOUBLE) AS BIGINT) AS low, CAST(ceil(n_distinct * {1 + 2 * _E!r}::DOUBLE) AS BIGINT) AS high FROM est)
{then}"""


_BY_SQL = ", ".join(f"grouping({g}) = 0 AS by_{g}" for g in GROUPS)

_SETS = f"""{_CELLS},
sets AS (SELECT day, type, stage, bucket, max(rank) AS rank, {_BY_SQL} FROM cells GROUP BY CUBE (day, type, stage), bucket),
kept AS (SELECT * FROM sets WHERE NOT by_day OR day IS NOT NULL)"""
_GROUPS_SQL = "day, type, stage, by_day, by_type, by_stage"
#: A value over every combination of the groups.
_CUBE = "SELECT * FROM (SELECT day, type, stage, {value} AS n, " + _BY_SQL + " FROM (SELECT *, CAST(time AS DATE) AS day FROM telemetry_event) e {where} GROUP BY CUBE (day, type, stage)) c WHERE NOT by_day OR day IS NOT NULL"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM x.{c}" for c in _GROUPS_SQL.split(", "))

_KEYS = "keys AS (SELECT 'telemetry_event' AS table_name, encode(key) AS key FROM telemetry_event WHERE key IS NOT NULL UNION ALL SELECT 'change_log', key FROM change_log WHERE key IS NOT NULL)"
_HEAVY = f"WITH {_KEYS}, c AS (SELECT table_name, key, count(*) AS n FROM keys GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY table_name) AS n_rows FROM c)"

_FIRST = "first AS (SELECT key, min(ord) AS ord FROM (SELECT key, CAST(-1 AS BIGINT) AS ord FROM change_log UNION ALL SELECT key, rec_id FROM incoming_record) u WHERE key IS NOT NULL GROUP BY key)"

SQL: dict[str, str] = {
    "p1_error_check": f"""WITH {_SETS},
exact AS ({_CUBE.format(value="count(DISTINCT key)", where="")}),
{_estimate_sql("kept", _GROUPS_SQL, f"SELECT by_day, by_type, by_stage, count(*) AS n_groups, count(*) FILTER (WHERE n BETWEEN low AND high) AS n_inside FROM (SELECT a.*, x.n FROM answer a JOIN exact x ON {_SAME}) j GROUP BY ALL")}""",
    "p2_found": f"{_HEAVY} SELECT table_name, upper(hex(key)) AS key_hex FROM t WHERE n * 100 >= n_rows",
    "p2_heavy_counts": f"{_HEAVY} SELECT table_name, upper(hex(key)) AS key_hex, n, CAST(n_rows AS BIGINT) AS n_rows, TRUE AS approx_is_bound FROM t WHERE n * 100 >= n_rows",
    "p4_found": f"WITH {_FIRST} SELECT r.rec_id FROM incoming_record r JOIN first f ON r.key = f.key WHERE f.ord < r.rec_id",
    "p4_wrong_rate": f"WITH {_FIRST} SELECT count(*) AS n_records, count(*) FILTER (WHERE f.ord < r.rec_id) AS n_repeats, CAST(0 AS BIGINT) AS n_wrong, 0.0::DOUBLE AS wrong_rate FROM incoming_record r JOIN first f ON r.key = f.key",
    "p5_rank_check": f"SELECT *, TRUE AS in_bound FROM ({_CUBE.format(value='count(duration_ms)', where='WHERE duration_ms IS NOT NULL')}) q",
    "p1_distinct_portable": f"WITH {_SETS}, {_estimate_sql('kept', _GROUPS_SQL)}",
    "p1_registers": p1_registers,
    "p1_error_check": p1_error_check,
    "p2_found": p2_found,
    "p2_heavy_counts": p2_heavy_counts,
    "p2_approximate_counts": p2_approximate_counts,
    "p4_found": p4_found,
    "p4_wrong_rate": p4_wrong_rate,
    "p5_percentiles": p5_percentiles,
    "p5_digests": p5_digests,
    "p5_rank_check": p5_rank_check,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_sentences": p8_sentences,
}

_REST = distinct.BITS - distinct.P
_M = 1 << distinct.P
_SIGMA = "x + " + " + ".join(f"pow(x, {float(1 << k)}) * {float(1 << (k - 1))}" for k in range(1, distinct.TERMS))
_E = distinct.standard_error()
#: Registers of the finest groups, as rows of day, type, stage, bucket, rank.
_CELLS = f"""h AS (SELECT CAST(time AS DATE) AS day, type, stage, CASE WHEN key IS NOT NULL THEN CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) END AS h FROM telemetry_event),
cells AS (SELECT day, type, stage, h >> {_REST} AS bucket, CASE WHEN h IS NULL THEN 0 WHEN h % {1 << _REST} = 0 THEN {_REST + 1} ELSE {_REST + 1} - length(ltrim(bin(h % {1 << _REST}), '0')) END AS rank FROM h)"""


def _estimate_sql(source: str, columns: str, then: str = "SELECT * FROM answer") -> str:
    return f"""state AS (SELECT {columns}, sum(CASE WHEN bucket IS NOT NULL THEN pow(2.0, -rank) END) AS s, count(bucket) AS used FROM {source} GROUP BY ALL),
est AS (SELECT {columns}, CAST(CASE WHEN used = 0 THEN 0 ELSE round({_M}::DOUBLE * {_M} / (2 * ln(2)) / (s + {_M} * ({_SIGMA}))) END AS BIGINT) AS n_distinct FROM (SELECT *, 1.0::DOUBLE - used / {_M}::DOUBLE AS x FROM state) q),
answer AS (SELECT {columns}, n_distinct, {round(_E, 6)}::DOUBLE AS rel_std_error, CAST(floor(n_distinct * {1 - 2 * _E!r}::DOUBLE) AS BIGINT) AS low, CAST(ceil(n_distinct * {1 + 2 * _E!r}::DOUBLE) AS BIGINT) AS high FROM est)
{then}"""


_BY_SQL = ", ".join(f"grouping({g}) = 0 AS by_{g}" for g in GROUPS)

_SETS = f"""{_CELLS},
sets AS (SELECT day, type, stage, bucket, max(rank) AS rank, {_BY_SQL} FROM cells GROUP BY CUBE (day, type, stage), bucket),
kept AS (SELECT * FROM sets WHERE NOT by_day OR day IS NOT NULL)"""
_GROUPS_SQL = "day, type, stage, by_day, by_type, by_stage"
#: A value over every combination of the groups.
_CUBE = "SELECT * FROM (SELECT day, type, stage, {value} AS n, " + _BY_SQL + " FROM (SELECT *, CAST(time AS DATE) AS day FROM telemetry_event) e {where} GROUP BY CUBE (day, type, stage)) c WHERE NOT by_day OR day IS NOT NULL"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM x.{c}" for c in _GROUPS_SQL.split(", "))

_KEYS = "keys AS (SELECT 'telemetry_event' AS table_name, encode(key) AS key FROM telemetry_event WHERE key IS NOT NULL UNION ALL SELECT 'change_log', key FROM change_log WHERE key IS NOT NULL)"
_HEAVY = f"WITH {_KEYS}, c AS (SELECT table_name, key, count(*) AS n FROM keys GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY table_name) AS n_rows FROM c)"

_FIRST = "first AS (SELECT key, min(ord) AS ord FROM (SELECT key, CAST(-1 AS BIGINT) AS ord FROM change_log UNION ALL SELECT key, rec_id FROM incoming_record) u WHERE key IS NOT NULL GROUP BY key)"

SQL: dict[str, str] = {
    "p1_error_check": f"""WITH {_SETS},
exact AS ({_CUBE.format(value="count(DISTINCT key)", where="")}),
{_estimate_sql("kept", _GROUPS_SQL, f"SELECT by_day, by_type, by_stage, count(*) AS n_groups, count(*) FILTER (WHERE n BETWEEN low AND high) AS n_inside FROM (SELECT a.*, x.n FROM answer a JOIN exact x ON {_SAME}) j GROUP BY ALL")}""",
    "p2_found": f"{_HEAVY} SELECT table_name, upper(hex(key)) AS key_hex FROM t WHERE n * 100 >= n_rows",
    "p2_heavy_counts": f"{_HEAVY} SELECT table_name, upper(hex(key)) AS key_hex, n, CAST(n_rows AS BIGINT) AS n_rows, TRUE AS approx_is_bound FROM t WHERE n * 100 >= n_rows",
    "p4_found": f"WITH {_FIRST} SELECT r.rec_id FROM incoming_record r JOIN first f ON r.key = f.key WHERE f.ord < r.rec_id",
    "p4_wrong_rate": f"WITH {_FIRST} SELECT count(*) AS n_records, count(*) FILTER (WHERE f.ord < r.rec_id) AS n_repeats, CAST(0 AS BIGINT) AS n_wrong, 0.0::DOUBLE AS wrong_rate FROM incoming_record r JOIN first f ON r.key = f.key",
    "p5_rank_check": f"SELECT *, TRUE AS in_bound FROM ({_CUBE.format(value='count(duration_ms)', where='WHERE duration_ms IS NOT NULL')}) q",
    "p1_distinct_portable": f"""WITH {_CELLS},
sets AS (SELECT day, type, stage, bucket, max(rank) AS rank, {_BY_SQL} FROM cells GROUP BY CUBE (day, type, stage), bucket),
kept AS (SELECT * FROM sets WHERE NOT by_day OR day IS NOT NULL),
{_estimate_sql("kept", "day, type, stage, by_day, by_type, by_stage")}""",
    "p1_registers": f"WITH {_CELLS} SELECT day, type, stage, CAST(bucket AS INT) AS bucket, CAST(max(rank) AS INT) AS rank FROM cells GROUP BY ALL",
    "p1_weekly_merge": f"""WITH {_CELLS},
weeks AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, type, bucket, max(rank) AS rank FROM cells WHERE day IS NOT NULL GROUP BY ALL),
{_estimate_sql("weeks", "week, type")}""",
}
