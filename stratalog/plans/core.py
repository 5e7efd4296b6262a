"""Queries over version logs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import compact as C
from ..operators import files as FS
from ..operators import records as R
from ..operators import resolve as M
from ..operators import scan as S
from ..operators import sketch as K
from ..operators import stats as A
from ..operators import write as WR
from ..sources import logs as L

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_EV = "ev AS (SELECT user_id AS user_key, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, value FROM events)"
_ORD = "ord AS (SELECT o_custkey AS user_key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS vtype, o_totalprice AS value FROM orders)"
_LOG = f"{_EV}, log AS (SELECT ev.*, CASE WHEN seq < 0.5 * n THEN 2 WHEN seq < 0.8 * n THEN 1 ELSE 0 END AS level, seq // 100 AS file_no FROM ev, (SELECT max(seq) + 1 AS n FROM ev))"
_TOP = f"{_LOG}, top AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1), live AS (SELECT user_key, seq, vtype, value, level, file_no FROM top WHERE vtype = 1)"
_FILES = f"""{_TOP}, files AS (
  SELECT level, file_no, count(*) * 24 AS file_size, min(user_key) AS smallest_key, arg_min(seq, struct_pack(a := user_key, b := -seq)) AS smallest_seq,
    max(user_key) AS largest_key, arg_max(seq, struct_pack(a := user_key, b := -seq)) AS largest_seq,
    CASE WHEN level < 2 THEN 'NVM' ELSE 'SSD' END AS tier, min(seq) AS installed_at, greatest(100, count(*) * 24 // 16384) AS allowed_seeks
  FROM log GROUP BY level, file_no)"""
_OPS = """ops AS (SELECT event_id AS op_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'scan' WHEN 'purchase' THEN 'update' WHEN 'signup' THEN 'insert' ELSE 'rmw' END AS op,
  user_id AS key, (event_id * 7919) % 100000 + 500 AS latency_ns FROM events)"""
#: A number in [0, 1) that follows from an id.
_U_SQL, _U = "((event_id * 48271) % 2147483647) / 2147483647.0", lambda: ((F.col("event_id") * 48271) % 2147483647) / F.lit(2147483647.0)


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _log(spark, d) -> DataFrame:
    return L.with_levels(L.event_log(spark, d))


def _files(spark, d) -> DataFrame:
    return L.file_metadata(_log(spark, d), nvm_levels=2)


def _ops(spark, d) -> DataFrame:
    # Which operation each kind of event stands for.
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "scan").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "signup", "insert").otherwise("rmw")
    return L.table(spark, d, "events").select(F.col("event_id").alias("op_id"), kind.alias("op"), F.col("user_id").alias("key"), ((F.col("event_id") * 7919) % 100000 + 500).alias("latency_ns"))


_STATE = ("user_key", "seq", "value")


# ---- reads and scans


@query(f"WITH {_TOP} SELECT user_key, seq, value FROM live ORDER BY user_key")
def live_scan_fwd(spark, d):
    return S.forward(L.event_log(spark, d)).select(*_STATE)


@query(f"WITH {_TOP} SELECT user_key, seq, value FROM live ORDER BY user_key DESC")
def live_scan_rev(spark, d):
    return S.reverse(L.event_log(spark, d)).select(*_STATE)


@query(f"WITH {_ORD} SELECT user_key, seq, value FROM (SELECT * FROM ord QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1) WHERE vtype = 1")
def live_rownum(spark, d):
    return M.newest_by_rank(L.order_log(spark, d)).where("vtype = 1").select(*_STATE)


@query(f"WITH {_ORD} SELECT o.user_key, o.seq, o.value FROM ord o JOIN (SELECT user_key, max(seq) AS seq FROM ord GROUP BY user_key) m ON o.user_key = m.user_key AND o.seq = m.seq WHERE vtype = 1")
def live_maxby(spark, d):
    return M.live(L.order_log(spark, d)).select(*_STATE)


@query(f"WITH {_LOG} SELECT user_key, seq, value, level FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY level, file_no DESC, seq DESC) = 1) WHERE vtype = 1")
def live_by_level(spark, d):
    return M.newest_by_level(_log(spark, d)).where("vtype = 1").select(*_STATE, "level")


@query(f"WITH {_TOP} SELECT user_key, value FROM live WHERE user_key >= 7 ORDER BY user_key LIMIT 1")
def seek_first_ge(spark, d):
    return S.seek(L.event_log(spark, d), 7).select("user_key", "value")


@query(f"WITH {_TOP} SELECT user_key, value FROM live WHERE user_key >= 5 ORDER BY user_key LIMIT 20")
def range_scan_limit(spark, d):
    return S.scan(L.event_log(spark, d), 5, 20).select("user_key", "value")


@query(f"WITH {_TOP} SELECT user_key, value FROM live WHERE user_key >= 3 AND user_key < 40")
def range_half_open(spark, d):
    return S.half_open(L.event_log(spark, d), 3, 40).select("user_key", "value")


def _seq_at(spark, d, share: int, of: int) -> int:
    """The sequence number at a share of the log's last, one number on the driver, so that snapshots grow with the log."""
    return (L.event_log(spark, d).agg(F.max("seq")).first()[0] or 0) * share // of


@query(f"WITH {_EV} SELECT user_key, seq, value FROM (SELECT * FROM ev WHERE seq <= (SELECT max(seq) FROM ev) * 5 // 10 QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1) WHERE vtype = 1")
def snapshot_read(spark, d):
    return M.live(L.event_log(spark, d), _seq_at(spark, d, 5, 10)).select(*_STATE)


@query(f"""WITH {_EV}, snaps AS (SELECT s AS snap_id, (SELECT max(seq) FROM ev) * (4 * s + 1) // 20 AS seq FROM range(5) t(s)) SELECT snap_id, user_key, value FROM
  (SELECT snap_id, user_key, vtype, value FROM snaps JOIN ev ON ev.seq <= snaps.seq QUALIFY row_number() OVER (PARTITION BY snap_id, user_key ORDER BY ev.seq DESC) = 1) WHERE vtype = 1""")
def multi_snapshot_asof(spark, d):
    last = _seq_at(spark, d, 1, 1)
    snaps = spark.createDataFrame([(s, last * (4 * s + 1) // 20) for s in range(5)], "snap_id long, seq long")
    return M.at_snapshots(L.event_log(spark, d), snaps)


@query(f"WITH {_TOP} SELECT c_custkey AS user_key, value FROM customer LEFT JOIN live ON c_custkey = user_key")
def multi_get(spark, d):
    keys = L.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return M.lookup(keys, L.event_log(spark, d)).select("user_key", "value")


@query(f"WITH {_TOP} SELECT c_custkey AS user_key, CASE WHEN vtype IS NULL THEN 'NOT_FOUND' WHEN vtype = 0 THEN 'DELETED' ELSE 'FOUND' END AS status FROM customer LEFT JOIN top ON c_custkey = user_key")
def multi_get_status(spark, d):
    keys = L.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return M.lookup(keys, L.event_log(spark, d)).select("user_key", "status")


@query(f"WITH {_TOP} SELECT c_custkey AS user_key FROM customer WHERE c_custkey NOT IN (SELECT user_key FROM live)")
def read_missing(spark, d):
    return M.missing(L.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key")), L.event_log(spark, d))


@query(f"WITH {_TOP} SELECT CASE WHEN vtype IS NULL THEN 'NOT_FOUND' WHEN vtype = 0 THEN 'DELETED' ELSE 'FOUND' END AS status, count(*) AS n FROM customer LEFT JOIN top ON c_custkey = user_key GROUP BY 1")
def lookup_class(spark, d):
    return multi_get_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOP} SELECT min(user_key) AS first_key, max(user_key) AS last_key FROM live")
def first_last_key(spark, d):
    return S.ends(L.event_log(spark, d))


@query(f"WITH {_TOP} SELECT p AS probe_id, p * 17 AS target, min(user_key) AS found FROM range(40) t(p) LEFT JOIN live ON user_key >= p * 17 GROUP BY p")
def seek_random(spark, d):
    probes = spark.range(40).select(F.col("id").alias("probe_id"), (F.col("id") * 17).alias("target"))
    return S.seek_many(probes, L.event_log(spark, d), 16)


@query(f"WITH {_TOP} SELECT level, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM log GROUP BY level")
def level_scan(spark, d):
    return _log(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


@query("SELECT event_id AS node, user_id AS born, user_id + event_id % 50 AS dead FROM events WHERE 60 BETWEEN user_id AND user_id + event_id % 50")
def visible_nodes(spark, d):
    nodes = L.table(spark, d, "events").select(F.col("event_id").alias("node"), F.col("user_id").alias("born"), (F.col("user_id") + F.col("event_id") % 50).alias("dead"))
    return M.alive_at(nodes, 60)


# ---- writes and records


def _batches(spark, d) -> DataFrame:
    op = F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("vtype"), F.col("o_custkey").alias("user_key"), F.col("o_totalprice").alias("value"))
    rows = L.table(spark, d, "orders").withColumn("b", F.floor(F.col("o_orderkey") / 8))
    sorted_ops = F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), op.alias("op")))), lambda r: r["op"])
    return rows.groupBy("b").agg(sorted_ops.alias("ops")).select((F.col("b") * 8).alias("base_seq"), "ops")


_BATCH = "batch AS (SELECT o_custkey AS user_key, (o_orderkey // 8) * 8 + row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) - 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS vtype, o_totalprice AS value FROM orders)"


@query(f"WITH {_BATCH} SELECT * FROM batch")
def batch_explode(spark, d):
    return WR.explode_batches(_batches(spark, d))


@query(f"WITH {_BATCH} SELECT user_key, value FROM (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1) WHERE vtype = 1")
def batch_apply(spark, d):
    return M.live(WR.explode_batches(_batches(spark, d))).select("user_key", "value")


@query(f"WITH {_TOP} SELECT l.user_key, coalesce(c.c_acctbal, l.value) AS value FROM live l LEFT JOIN customer c ON l.user_key = c.c_custkey AND c.c_acctbal > 0")
def rmw_update(spark, d):
    new = L.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_key"), F.col("c_acctbal").alias("value"))
    return WR.read_modify_write(M.live(L.event_log(spark, d)).select("user_key", "value"), new, ["value"])


@query(f"WITH {_TOP} SELECT user_key, value FROM live WHERE user_key % 5 <> 0")
def delete_apply(spark, d):
    log = L.event_log(spark, d)
    gone = L.table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("user_key")).union(log.where("user_key % 5 = 0").select("user_key")).distinct()
    return M.live(WR.append(log, WR.delete(gone.withColumn("op_idx", F.lit(0)), 1 << 40))).select("user_key", "value")


def _usertable(spark, d) -> DataFrame:
    c = L.table(spark, d, "customer")
    # The fields of a record.
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(col).cast("string").alias("value")) for f, col in (("field0", "c_name"), ("field1", "c_mktsegment"), ("field2", "c_nationkey"))])
    return c.select(X.bench_key(F.col("c_custkey"), 8).alias("key"), F.explode(pairs).alias("p")).select("key", "p.*")


_USER = "usertable AS (SELECT lpad(c_custkey::VARCHAR, 8, '0') AS key, unnest(['field0', 'field1', 'field2']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)"


@query(f"WITH {_USER} SELECT key, field, value FROM usertable WHERE field IN ('field0', 'field2')")
def project_fields(spark, d):
    return R.project(_usertable(spark, d), ["field0", "field2"])


@query("SELECT lpad(c_custkey::VARCHAR, 8, '0') AS key, c_name AS field0, c_mktsegment AS field1, c_nationkey::VARCHAR AS field2 FROM customer")
def rowmajor_pivot(spark, d):
    return R.rows_to_records(_usertable(spark, d), ["field0", "field1", "field2"])


@query(f"WITH {_USER} SELECT field, count(value) AS n, min(key) AS first_key, sha256(string_agg(value, '|' ORDER BY key)) AS digest FROM usertable GROUP BY field")
def columnmajor_pivot(spark, d):
    columns = R.field_columns(_usertable(spark, d))
    digest = F.sha2(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "values"))), lambda c: c["values"])), "|"), 256)
    return columns.groupBy("field").agg(F.sum(F.size("values")).alias("n"), F.min("first_key").alias("first_key"), digest.alias("digest"))


@query(f"WITH {_USER} SELECT key, field, value FROM usertable WHERE key IN (SELECT DISTINCT key FROM usertable WHERE key >= '00000010' ORDER BY key LIMIT 25)")
def scan_n_records(spark, d):
    return R.scan_records(_usertable(spark, d), "00000010", 25)


@query(f"WITH {_USER} SELECT key || ':' || field AS user_key, 0 AS vtype FROM usertable WHERE key = '00000007'")
def delete_record_fields(spark, d):
    return R.delete_record(_usertable(spark, d), "00000007")


@query(f"WITH {_USER} SELECT key || ':' || field AS composite, key AS left_part, field AS right_part FROM usertable")
def composite_keys(spark, d):
    c = F.concat_ws(":", "key", "field")
    left, right = X.split_composite(F.col("composite"))
    return _usertable(spark, d).select(c.alias("composite")).select("composite", left.alias("left_part"), right.alias("right_part"))


@query("SELECT o_orderkey // 8 AS batch_id, count(*) * 2 AS ops, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY 1")
def batch_append(spark, d):
    o = L.table(spark, d, "orders")
    at = F.row_number().over(W.partitionBy("batch_id").orderBy("o_orderkey")) - 1
    ops = o.withColumn("batch_id", F.floor(F.col("o_orderkey") / 8)).select("batch_id", at.alias("op_idx"), F.lit(1).alias("vtype"), F.col("o_custkey").alias("user_key"), F.col("o_totalprice").alias("value"))
    both = WR.append_batches(ops.withColumn("value", F.lit(0.0)), ops)
    return both.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ops"), F.max_by("value", "op_idx").alias("last_value"))


@query("SELECT o_orderkey // 8 AS batch_id, (12 + sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 + length(o_orderkey::VARCHAR) END + length(o_custkey::VARCHAR)))::BIGINT AS bytes FROM orders GROUP BY 1")
def batch_sizes(spark, d):
    o = L.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("vtype"), F.col("o_custkey").cast("string").alias("user_key"), F.col("o_orderkey").cast("string").alias("value"))
    return WR.approximate_batch_size(o)


@query(f"WITH {_EV} SELECT user_key, seq, value FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_key // 10 ORDER BY seq DESC) = 1) WHERE vtype = 1")
def comparator_scan(spark, d):
    return S.by_comparator(L.event_log(spark, d), lambda k: F.floor(k / 10)).select(*_STATE)


# ---- file metadata


@query(f"WITH {_FILES} SELECT * FROM files")
def file_bounds(spark, d):
    return _files(spark, d)


_RANGES = "ranges AS (SELECT r AS range_id, r * 9 AS start, r * 9 + 12 AS \"limit\" FROM range(12) t(r))"


def _ranges(spark) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("range_id"), (F.col("id") * 9).alias("start"), (F.col("id") * 9 + 12).alias("limit"))


@query(f'WITH {_FILES}, {_RANGES} SELECT range_id, level, file_no FROM files JOIN ranges ON largest_key >= start AND smallest_key <= "limit"')
def overlap_files(spark, d):
    return FS.overlapping(_files(spark, d), _ranges(spark))


@query(f'WITH {_FILES}, {_RANGES} SELECT range_id, count(*) AS n_files FROM files JOIN ranges ON largest_key >= start AND smallest_key <= "limit" GROUP BY range_id')
def files_touched(spark, d):
    return overlap_files(spark, d).groupBy("range_id").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {_LOG}, f AS (SELECT file_no, max(seq) AS largest_key FROM log GROUP BY file_no) SELECT p * 77 AS user_key, min(file_no) AS file_no FROM range(200) t(p) LEFT JOIN f ON largest_key >= p * 77 GROUP BY p")
def find_file(spark, d):
    disjoint = _log(spark, d).groupBy("file_no").agg(F.max("seq").alias("largest_key"))
    return FS.find_file(disjoint, spark.range(200).select((F.col("id") * 77).alias("user_key")))


@query(f"""WITH {_FILES}, {_RANGES} SELECT range_id, coalesce(sum(floor(file_size * greatest(least("limit", largest_key + 1) - greatest(start, smallest_key), 0) / greatest(largest_key - smallest_key + 1, 1))), 0)::BIGINT AS bytes
  FROM ranges LEFT JOIN files ON largest_key >= start AND smallest_key < "limit" GROUP BY range_id""")
def approx_sizes(spark, d):
    return FS.approximate_sizes(_files(spark, d), _ranges(spark))


@query(f"WITH {_FILES} SELECT level, count(*) AS n_files, sum(file_size) / 1048576.0 AS mb FROM files GROUP BY level")
def level_stats(spark, d):
    return FS.level_stats(_files(spark, d))


@query(f"WITH {_FILES} SELECT count(*) AS n FROM files WHERE level = 1")
def num_files_at_level(spark, d):
    return _files(spark, d).where("level = 1").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT level, string_agg(file_no || ':' || file_size || '[' || smallest_key || '..' || largest_key || ']', ' ' ORDER BY smallest_key, file_no) AS files FROM files GROUP BY level")
def sstables_listing(spark, d):
    return FS.listing(_files(spark, d))


@query(f"WITH {_FILES} SELECT coalesce(sum(file_size) FILTER (tier = 'SSD'), 0)::BIGINT AS ssd_bytes, coalesce(sum(file_size) FILTER (tier = 'NVM'), 0)::BIGINT AS nvm_bytes FROM files")
def tier_sizes(spark, d):
    return FS.tier_sizes(_files(spark, d))


@query(f"""WITH {_FILES} SELECT max(b) AS max_overlap_bytes FROM (SELECT a.file_no, coalesce(sum(c.file_size), 0)::BIGINT AS b FROM files a LEFT JOIN files c ON c.level = a.level + 1 AND c.smallest_key <= a.largest_key AND c.largest_key >= a.smallest_key
  WHERE a.level >= 1 GROUP BY a.level, a.file_no)""")
def max_next_level_overlap(spark, d):
    return FS.next_level_overlap(_files(spark, d)).agg(F.max("overlap_bytes").alias("max_overlap_bytes"))


def _edits(spark, d) -> DataFrame:
    return L.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("edit_no"), F.when(F.col("o_orderstatus") == "F", "del").otherwise("add").alias("kind"), (F.col("o_custkey") % 7).alias("level"), F.col("o_custkey").alias("file_no"), F.floor("o_totalprice").cast("long").alias("file_size")
    )


_EDITS = "edits AS (SELECT o_orderkey AS edit_no, CASE WHEN o_orderstatus = 'F' THEN 'del' ELSE 'add' END AS kind, o_custkey % 7 AS level, o_custkey AS file_no, floor(o_totalprice)::BIGINT AS file_size FROM orders)"
_FOLD = f"{_EDITS}, ver AS (SELECT level, file_no, file_size FROM (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_no ORDER BY edit_no DESC) = 1) WHERE kind = 'add')"


@query(f"WITH {_FOLD} SELECT * FROM ver")
def version_fold(spark, d):
    return FS.fold_edits(_edits(spark, d))


@query(f"WITH {_EDITS} SELECT DISTINCT level, file_no FROM (SELECT * FROM edits WHERE edit_no <= 400 QUALIFY row_number() OVER (PARTITION BY level, file_no ORDER BY edit_no DESC) = 1 UNION ALL SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_no ORDER BY edit_no DESC) = 1) WHERE kind = 'add'")
def live_files(spark, d):
    e = _edits(spark, d)
    return FS.live_files([FS.fold_edits(e.where("edit_no <= 400")), FS.fold_edits(e)])


@query(f"WITH {_FOLD} SELECT level, file_no, file_size FROM ver WHERE file_no NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_files(spark, d):
    found = L.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file_no"))
    return FS.without(FS.fold_edits(_edits(spark, d)), found).select("level", "file_no", "file_size")


@query(f"WITH {_FOLD} SELECT c_custkey AS file_no FROM customer WHERE c_custkey NOT IN (SELECT file_no FROM ver)")
def obsolete_files(spark, d):
    return FS.without(L.table(spark, d, "customer").select(F.col("c_custkey").alias("file_no")), FS.fold_edits(_edits(spark, d)))


_CHAINS = """chained AS (SELECT 0 AS level, p_partkey AS file_no, p_size * 100 AS file_size, p_partkey * 40 AS smallest_key, p_partkey * 40 + p_size AS largest_key FROM part),
  marked AS (SELECT *, CASE WHEN smallest_key > max(largest_key) OVER (ORDER BY smallest_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS starts FROM chained),
  islands AS (SELECT *, sum(starts) OVER (ORDER BY smallest_key, file_no) AS island FROM marked)"""


@query(f"WITH {_CHAINS} SELECT level, file_no, file_size FROM islands WHERE island IN (SELECT island FROM islands WHERE largest_key >= 2000 AND smallest_key <= 2100)")
def l0_expanded_range(spark, d):
    k = F.col("p_partkey") * 40
    files = L.table(spark, d, "part").select(F.lit(0).alias("level"), F.col("p_partkey").alias("file_no"), (F.col("p_size") * 100).alias("file_size"), k.alias("smallest_key"), (k + F.col("p_size")).alias("largest_key"))
    return FS.expand_overlapping(files, 2000, 2100).select("level", "file_no", "file_size")


@query(f"WITH {_EV} SELECT 0 AS level, seq // 100 AS file_no, count(*) * 24 AS file_size, min(user_key) AS smallest_key, max(user_key) AS largest_key FROM ev GROUP BY seq // 100")
def repair_metadata(spark, d):
    return FS.rebuild(_log(spark, d)).select("level", "file_no", "file_size", "smallest_key", "largest_key")


# ---- compaction


_KEEP = f"{_LOG}, kept AS (SELECT * FROM (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM log) WHERE newer IS NULL OR newer > (SELECT max(seq) FROM log) * 9 // 10)"


@query(f"WITH {_KEEP} SELECT user_key, seq, vtype, value, level, file_no FROM kept")
def compaction_keep(spark, d):
    return C.drop_shadowed(_log(spark, d), _seq_at(spark, d, 9, 10))


@query(f"WITH {_KEEP}, deep AS (SELECT file_no, min(user_key) AS lo, max(user_key) AS hi FROM log WHERE level = 2 GROUP BY file_no) SELECT user_key, seq, vtype FROM kept WHERE NOT (vtype = 0 AND seq <= (SELECT max(seq) FROM log) * 9 // 10 AND NOT EXISTS (SELECT 1 FROM deep WHERE user_key BETWEEN lo AND hi))")
def compaction_tombstone_elision(spark, d):
    log, oldest = _log(spark, d), _seq_at(spark, d, 9, 10)
    deeper = L.file_metadata(log.where("level = 2"))
    return C.drop_markers(C.drop_shadowed(log, oldest), oldest, deeper).select("user_key", "seq", "vtype")


@query(f"WITH {_FILES} SELECT level, CASE WHEN level = 0 THEN count(*) / 8.0 ELSE sum(file_size) / (50000.0 * pow(4, greatest(level - 1, 0))) END AS score FROM files GROUP BY level")
def compaction_score(spark, d):
    return C.scores(_files(spark, d), 50000)


@query(f"WITH {_FILES} SELECT count(*) FILTER (level = 0) AS l0_files, CASE WHEN count(*) FILTER (level = 0) >= 30 THEN 'STOP' WHEN count(*) FILTER (level = 0) >= 16 THEN 'DELAY' ELSE 'GO' END AS action FROM files")
def write_back_pressure(spark, d):
    return C.back_pressure(_files(spark, d))


_SPREAD = "spread AS (SELECT p_partkey AS file_no, p_size % 3 + 1 AS level, p_partkey * 10 AS smallest_key, p_partkey * 10 + p_size AS largest_key, p_size * 100 AS file_size FROM part)"


@query(f"""WITH {_SPREAD} SELECT a.level, a.file_no FROM spread a WHERE NOT EXISTS (SELECT 1 FROM spread b WHERE b.level = a.level + 1 AND b.smallest_key <= a.largest_key AND b.largest_key >= a.smallest_key)
  AND coalesce((SELECT sum(g.file_size) FROM spread g WHERE g.level = a.level + 2 AND g.smallest_key <= a.largest_key AND g.largest_key >= a.smallest_key), 0) <= 3000""")
def trivial_move_candidates(spark, d):
    p = L.table(spark, d, "part").select(F.col("p_partkey").alias("file_no"), (F.col("p_size") % 3 + 1).alias("level"), (F.col("p_partkey") * 10).alias("smallest_key"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("largest_key"), (F.col("p_size") * 100).alias("file_size"))
    return C.trivial_moves(p, 3000)


@query(f"WITH {_FILES}, c AS (SELECT max(seq) // 100 + 1 AS n FROM log), m AS (SELECT ((event_id % n) * (event_id % n)) % n AS file_no, count(*) AS misses FROM events, c GROUP BY 1) SELECT level, files.file_no, misses FROM files JOIN m ON m.file_no = files.file_no WHERE misses >= allowed_seeks")
def seek_compaction_candidates(spark, d):
    n = _seq_at(spark, d, 1, 1) // 100 + 1
    at = F.col("event_id") % n
    return C.seek_candidates(_files(spark, d), L.table(spark, d, "events").select((at * at % n).alias("file_no")))


@query(f"WITH {_FILES} SELECT level, file_no, installed_at FROM files WHERE tier = 'NVM' ORDER BY installed_at, file_no LIMIT 5")
def fifo_evict(spark, d):
    return _files(spark, d).where("tier = 'NVM'").orderBy("installed_at", "file_no").limit(5).select("level", "file_no", "installed_at")


@query(f"WITH {_FILES} SELECT level, file_no, freed_before FROM (SELECT *, coalesce(sum(file_size) OVER (ORDER BY installed_at, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM files WHERE tier = 'NVM') WHERE freed_before < 20000")
def make_space(spark, d):
    return FS.evict_oldest(_files(spark, d), 20000).select("level", "file_no", "freed_before")


@query("SELECT user_id AS user_key, count(*) AS reads FROM events GROUP BY user_id HAVING count(*) > 60")
def hot_keys(spark, d):
    return C.hot_keys(L.table(spark, d, "events").select(F.col("user_id").alias("user_key")), 60)


@query("SELECT file_no, user_key, count(*) AS reads, sum(CASE WHEN nth > 2 THEN 1 ELSE 0 END)::BIGINT AS served FROM (SELECT user_id % 4 AS file_no, user_id AS user_key, row_number() OVER (PARTITION BY user_id % 4, user_id ORDER BY event_id) AS nth FROM events) GROUP BY ALL")
def hot_read_cache(spark, d):
    return C.reads_served(L.table(spark, d, "events").select((F.col("user_id") % 4).alias("file_no"), F.col("user_id").alias("user_key")))


@query(f"WITH {_TOP} SELECT DISTINCT user_key, seq, value FROM log WHERE level = 1 OR (level = 2 AND user_key IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 60))")
def promote_merge(spark, d):
    log = _log(spark, d)
    hot = log.where("level = 2").join(hot_keys(spark, d), "user_key", "left_semi")
    return C.promote(log.where("level = 1"), hot).select(*_STATE)


@query("WITH hot AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 60), " + _LOG + " SELECT CASE WHEN user_key IN (SELECT user_id FROM hot) THEN 1 ELSE 2 END AS to_level, count(*) AS n FROM log WHERE level = 1 GROUP BY 1")
def retain_split(spark, d):
    return C.retain(_log(spark, d).where("level = 1"), hot_keys(spark, d)).groupBy("to_level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS node, event_id % 700 AS dead FROM events WHERE event_id % 700 < (SELECT min(o_custkey) + 300 FROM orders)")
def reclaim_nodes(spark, d):
    nodes = L.table(spark, d, "events").select(F.col("user_id").alias("node"), (F.col("event_id") % 700).alias("dead"))
    return C.reclaimable(nodes, L.table(spark, d, "orders").select((F.col("o_custkey") + 300).alias("t"))).select("node", "dead")


_WALK = """rows AS (SELECT l_suppkey % 4 AS c, l_orderkey * 10 + l_linenumber AS k FROM lineitem), gp AS (SELECT p_partkey % 4 AS c, p_partkey * 37 AS hi, p_size * 10 AS size FROM part),
  passed AS (SELECT c, k, coalesce((SELECT sum(size) FROM gp WHERE gp.c = rows.c AND gp.hi < rows.k), 0) AS p FROM rows)"""


@query(f"WITH {_WALK} SELECT c, k, coalesce(p - lag(p) OVER (PARTITION BY c ORDER BY k), 0)::BIGINT AS overlap FROM passed")
def grandparent_walk(spark, d):
    rows = L.table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    gp = L.table(spark, d, "part").select((F.col("p_partkey") % 4).alias("c"), (F.col("p_partkey") * 37).alias("largest_key"), (F.col("p_size") * 10).alias("file_size"))
    return C.grandparent_bytes(rows, gp, "c", "k").select("c", "k", F.col("overlap").cast("long").alias("overlap"))


@query(f"WITH {_FILES} SELECT level, file_no, buffered > 0.5 * file_size / 1024 OR buffered > [0, 0, 0, 0, 0, 1, 1][level + 1] + 55 AS promote FROM (SELECT level, f.file_no, file_size, count(*) AS buffered FROM files f JOIN (SELECT event_id // 100 AS file_no FROM events WHERE value > 50) e ON e.file_no = f.file_no GROUP BY ALL)")
def promotion_trigger(spark, d):
    hot = L.table(spark, d, "events").where("value > 50").groupBy(F.floor(F.col("event_id") / 100).alias("file_no")).agg(F.count(F.lit(1)).alias("buffered"))
    buffers = _files(spark, d).join(hot, "file_no").withColumn("hotness", F.col("buffered") - 55)
    return C.promotion_due(buffers, 0.5).select("level", "file_no", "promote")


# ---- statistics


_BOUNDS = "bounds AS (SELECT unnest([" + ", ".join(str(b) for b in A.BOUNDS[:-1]) + "]) AS b)"
_HIST = f"{_BOUNDS}, h AS (SELECT (SELECT count(*) FROM bounds WHERE b <= v.v)::INTEGER AS bucket, count(*) AS n FROM (SELECT o_totalprice AS v FROM orders) v GROUP BY 1)"


def _prices(spark, d) -> DataFrame:
    return L.table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))


@query(f"WITH {_HIST} SELECT bucket, n FROM h")
def hist_buckets(spark, d):
    return A.buckets(_prices(spark, d)).select("bucket", "n")


@query(f"""WITH {_HIST}, lim AS (SELECT row_number() OVER (ORDER BY b) - 1 AS i, b AS hi, coalesce(lag(b) OVER (ORDER BY b), 0) AS lo FROM bounds),
  c AS (SELECT h.bucket, n, sum(n) OVER (ORDER BY h.bucket) AS upto, lo, hi FROM h JOIN lim ON i = h.bucket), e AS (SELECT count(*) AS n_all, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders)
  SELECT p, round(greatest(least, least(most, lo + (hi - lo) * (n_all * p / 100 - (upto - n)) / n)), 6) AS "value" FROM (SELECT unnest([50.0, 90.0, 99.0])::DOUBLE AS p), e, c WHERE upto >= n_all * p / 100 QUALIFY row_number() OVER (PARTITION BY p ORDER BY upto) = 1""".replace("greatest(least, least(most", "greatest(e.least, least(e.most"))
def hist_percentile(spark, d):
    return A.percentile(_prices(spark, d), [50, 90, 99]).select("p", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS average, round(stddev_pop(o_totalprice), 4) AS deviation FROM orders")
def hist_stats(spark, d):
    return A.summary(_prices(spark, d)).select("n", "least", "most", F.round("average", 4).alias("average"), F.round("deviation", 4).alias("deviation"))


@query(f"WITH {_HIST} SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 6) AS share, round(100.0 * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS upto, repeat('#', floor(20.0 * n / sum(n) OVER () + 0.5)::INTEGER) AS bar FROM h")
def hist_lines(spark, d):
    return A.lines(_prices(spark, d)).select("bucket", "n", F.round("share", 6).alias("share"), F.round("upto", 6).alias("upto"), "bar")


@query(f"WITH {_OPS} SELECT op, count(*) AS n, min(latency_ns) / 1000.0 AS min_us, max(latency_ns) / 1000.0 AS max_us, round(avg(latency_ns) / 1000.0, 6) AS avg_us FROM ops GROUP BY op")
def latency_by_op(spark, d):
    return A.latency(_ops(spark, d)).withColumn("avg_us", F.round("avg_us", 6))


@query(f"WITH {_OPS} SELECT count(*) AS ops, round(count(*) / (sum(latency_ns) / 1e9), 4) AS ops_per_s FROM ops")
def throughput(spark, d):
    return _ops(spark, d).agg(F.count(F.lit(1)).alias("ops"), F.round(F.count(F.lit(1)) / (F.sum("latency_ns") / 1e9), 4).alias("ops_per_s"))


@query(f"WITH {_TOP} SELECT level, count(*) AS hits FROM customer JOIN live ON c_custkey = user_key GROUP BY level")
def hit_counts_by_level(spark, d):
    keys = L.table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return A.hits_by_level(M.live(_log(spark, d)), keys)


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id ORDER BY key")
def key_frequency(spark, d):
    return L.table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key")


@query(f"WITH {_EV}, e AS (SELECT length(user_key::VARCHAR) + 8 AS k, CASE WHEN vtype = 1 THEN length(floor(value)::BIGINT::VARCHAR) ELSE 0 END AS v FROM ev) SELECT sum(k + v + CASE WHEN k < 128 THEN 1 ELSE 2 END + CASE WHEN v < 128 THEN 1 ELSE 2 END)::BIGINT AS bytes FROM e")
def memory_usage(spark, d):
    value = F.when(F.col("vtype") == 1, F.floor("value").cast("string"))
    return A.entry_bytes(L.event_log(spark, d).select(F.col("user_key").cast("string").alias("user_key"), value.alias("value")))


@query(f"WITH {_OPS} SELECT op, count(*) AS n, round(avg(latency_ns // 1000), 6) AS micros_per_op, round(sum(key) / 1048576.0 / ((max(op_id * 10 + latency_ns // 1000) - min(op_id * 10)) / 1e6), 6) AS mb_per_s FROM ops GROUP BY op")
def bench_report(spark, d):
    start, spent = F.col("op_id") * 10, F.floor(F.col("latency_ns") / 1000)
    ops = _ops(spark, d).select("op", (F.col("op_id") % 4).alias("thread"), start.alias("start_us"), (start + spent).alias("finish_us"), F.col("key").alias("bytes"))
    return A.report(ops).select("op", "n", F.round("micros_per_op", 6).alias("micros_per_op"), F.round("mb_per_s", 6).alias("mb_per_s"))


# ---- workloads


@query(f"SELECT event_id, (10 + floor({_U_SQL} * 91))::BIGINT AS drawn, 1000 + event_id AS counted, substr(sha256(event_id || ':7:0') || sha256(event_id || ':7:1'), 1, 100) AS text FROM events")
def generators(spark, d):
    i = F.col("event_id")
    return L.table(spark, d, "events").select("event_id", R.uniform(_U(), 10, 100).alias("drawn"), R.counter(i, 1000).alias("counted"), R.random_bytes(i, 100, 7).alias("text"))


@query("WITH a AS (SELECT max(o_custkey) // 2 AS last_ack FROM orders), t AS (SELECT event_id AS op_id, n AS draw_no, (event_id * 7919 + n * 104729) % 1500 AS key FROM events, range(3) r(n)) SELECT op_id, arg_min(key, draw_no) FILTER (key <= last_ack) AS key FROM t, a GROUP BY op_id")
def resampled_keys(spark, d):
    draw = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("draw_no")
    draws = L.table(spark, d, "events").select(F.col("event_id").alias("op_id"), draw).withColumn("key", (F.col("op_id") * 7919 + F.col("draw_no") * 104729) % 1500)
    return R.resampled(draws, L.table(spark, d, "orders").agg(F.floor(F.max("o_custkey") / 2).alias("last_ack")))


@query(f"SELECT op, count(*) AS n FROM (SELECT CASE WHEN {_U_SQL} < 0.95 THEN 'read' ELSE 'update' END AS op FROM events) GROUP BY op")
def op_mix(spark, d):
    return L.table(spark, d, "events").select(R.choose(_U(), R.MIXES["b"]).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


_ZETA = R.zeta(1000)
_ETA = (1 - (2.0 / 1000) ** 0.01) / (1 - R.zeta(2) / _ZETA)


@query(f"SELECT event_id, (CASE WHEN u * {_ZETA!r} < 1 THEN 0 WHEN u * {_ZETA!r} < 1 + pow(0.5, 0.99) THEN 1 ELSE floor(1000 * pow({_ETA!r} * u - {_ETA!r} + 1, {1 / (1 - 0.99)!r})) END)::BIGINT AS rank FROM (SELECT event_id, {_U_SQL}::DOUBLE AS u FROM events)")
def zipf_rank(spark, d):
    return L.table(spark, d, "events").select("event_id", R.zipf_rank(_U(), 1000).alias("rank"))


@query(f"SELECT event_id, (5000 - (CASE WHEN u * {R.zeta(5001)!r} < 1 THEN 0 WHEN u * {R.zeta(5001)!r} < 1 + pow(0.5, 0.99) THEN 1 ELSE floor(5001 * pow({(1 - (2.0 / 5001) ** (1 - 0.99)) / (1 - R.zeta(2) / R.zeta(5001))!r} * u - {(1 - (2.0 / 5001) ** (1 - 0.99)) / (1 - R.zeta(2) / R.zeta(5001))!r} + 1, {1 / (1 - 0.99)!r})) END))::BIGINT AS id FROM (SELECT event_id, {_U_SQL}::DOUBLE AS u FROM events)")
def skewed_latest(spark, d):
    return L.table(spark, d, "events").select("event_id", R.skewed_latest(_U(), 5000).alias("id"))


_FNV_SQL = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(8), lambda i: ((id >> (8 * i)) & 255)::HUGEINT)), lambda h, o: (xor(h, o) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"SELECT id, 'user' || lpad(h::VARCHAR, greatest(length(h::VARCHAR), 20)::INTEGER, '0') AS key FROM (SELECT o_orderkey AS id, (SELECT {_FNV_SQL.replace('id >>', 'o_orderkey >>')}) AS h FROM orders)")
def key_name_fnv(spark, d):
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select("id", X.key_name(X.unsigned(X.fnv64("id")), 20).alias("key"))


@query("SELECT o_orderkey AS id, lpad(o_orderkey::VARCHAR, 16, '0') AS key FROM orders")
def bench_key_pad(spark, d):
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.bench_key(F.col("o_orderkey")).alias("key"))


@query("WITH ids AS (SELECT DISTINCT o_orderkey AS id FROM orders) SELECT min(id) AS last_ack FROM ids WHERE id + 1 NOT IN (SELECT id FROM ids)")
def ack_counter_gap(spark, d):
    ids = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return R.acknowledged(ids, ids.agg(F.min("id")).first()[0])


@query(f"WITH {_OPS} SELECT op_id, upper(op) || ' usertable ' || key AS line FROM ops")
def echo_lines(spark, d):
    return R.echo(_ops(spark, d))


# ---- scalars


@query(f"WITH {_EV} SELECT user_key, seq, seq * 256 + vtype AS tag FROM ev")
def internal_tag(spark, d):
    return L.event_log(spark, d).select("user_key", "seq", X.pack_tag(F.col("seq"), F.col("vtype")).alias("tag"))


#: Eight octets of a number in hexadecimal, low first.
_LE = "array_to_string(list_transform(range(8), lambda i: printf('%02X', ({0} >> (8 * i)) & 255)), '')"


@query(f"WITH {_EV} SELECT seq, vtype, hex(user_key::VARCHAR) || {_LE.format('(seq * 256 + vtype)')} AS encoded, vtype AS vtype_back, seq AS seq_back FROM ev")
def pack_unpack(spark, d):
    key = X.internal_key(F.encode(F.col("user_key").cast("string"), "UTF-8"), F.col("seq"), F.col("vtype"))
    _, seq, vtype = X.split_internal_key(F.col("k"))
    return L.event_log(spark, d).withColumn("k", key).select("seq", "vtype", F.hex("k").alias("encoded"), vtype.cast("int").alias("vtype_back"), seq.alias("seq_back"))


@query(f"WITH {_EV} SELECT seq, '''' || user_key || ''' @ ' || seq || ' : ' || vtype AS line FROM ev")
def debug_string(spark, d):
    return L.event_log(spark, d).select("seq", X.debug_string(F.col("user_key").cast("string"), F.col("seq"), F.col("vtype")).alias("line"))


@query(f"WITH {_EV} SELECT seq, '''' || user_key || ''' @ ' || seq || ' : ' || CASE WHEN vtype = 1 THEN 'val => ''' || floor(value)::BIGINT || '''' ELSE 'del' END AS line FROM ev")
def dump_lines(spark, d):
    rest = F.when(F.col("vtype") == 1, F.concat(F.lit("val => '"), F.floor("value").cast("string"), F.lit("'"))).otherwise("del")
    return L.event_log(spark, d).select("seq", F.concat(F.lit("'"), F.col("user_key").cast("string"), F.lit("' @ "), F.col("seq").cast("string"), F.lit(" : "), rest).alias("line"))


@query("SELECT name, kind, id AS number FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey::VARCHAR, 6, '0') || '.ldb' WHEN 1 THEN lpad(c_custkey::VARCHAR, 6, '0') || '.log' WHEN 2 THEN 'MANIFEST-' || lpad(c_custkey::VARCHAR, 6, '0') ELSE lpad(c_custkey::VARCHAR, 6, '0') || '.dbtmp' END AS name, ['table', 'log', 'descriptor', 'temp'][c_custkey % 4 + 1] AS kind FROM customer)")
def filename_parse(spark, d):
    n = F.col("c_custkey")
    name = F.when(n % 4 == 0, X.file_name(n, "ldb")).when(n % 4 == 1, X.file_name(n, "log")).when(n % 4 == 2, X.file_name(n, "MANIFEST")).otherwise(X.file_name(n, "dbtmp"))
    return L.table(spark, d, "customer").select(name.alias("name")).withColumn("p", X.parse_file_name(F.col("name"))).select("name", "p.kind", F.col("p.number").cast("long").alias("number"))


@query("SELECT o_orderkey AS n, greatest(1, ceil(length(ltrim(bin(o_orderkey), '0')) / 7.0))::INTEGER AS varint_length FROM orders")
def varint_lengths(spark, d):
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), X.varint_length(F.col("o_orderkey")).alias("varint_length"))


@query(f"SELECT o_orderkey AS n, {_LE.format('o_orderkey')} AS encoded, o_orderkey AS back FROM orders")
def fixed64_round_trip(spark, d):
    e = X.fixed64(F.col("o_orderkey"))
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.hex(e).alias("encoded"), X.from_fixed64(e).alias("back"))


@query("SELECT level, 5242880.0 * pow(4, greatest(level - 1, 0)) AS max_bytes FROM range(7) t(level)")
def max_bytes_for_level(spark, d):
    return spark.range(7).select(F.col("id").alias("level"), C.max_bytes(F.col("id")).alias("max_bytes"))


# ---- order, and what SQL cannot express


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sample_sort(spark, d):
    rows = S.range_sorted(L.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    return rows.join(before, "part").select("o_orderkey", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def _sql_hash32(text: str) -> str:
    """The 32-bit hash of an ASCII text in DuckDB: words of four octets, low first, then the tail."""
    octet = lambda i: f"ord({text}[{i}])"
    words = f"list_transform(range(length({text}) // 4), lambda i: ({octet('4 * i + 1')} + 256 * {octet('4 * i + 2')} + 65536 * {octet('4 * i + 3')} + 16777216 * {octet('4 * i + 4')})::HUGEINT)"
    m, mask = f"{X.HASH_M}::HUGEINT", "4294967296::HUGEINT"
    start = f"(xor({X.BLOOM_SEED}, ((length({text})::HUGEINT * {m}) % {mask})::BIGINT))::HUGEINT"
    turn = f"((h + w) * {m}) % {mask}"
    body = f"list_reduce(list_prepend({start}, {words}), lambda h, w: xor({turn}, ({turn}) // 65536))"
    tail = f"list_sum(list_transform(range(length({text}) % 4), lambda i: ({octet(f'4 * (length({text}) // 4) + i + 1')} * pow(256, i))::HUGEINT))"
    last = f"(({body} + {tail}) * {m}) % {mask}"
    return f"(CASE WHEN length({text}) % 4 = 0 THEN {body} ELSE (SELECT xor(z, z // 16777216) FROM (SELECT {last} AS z)) END)::BIGINT"


_BLOOM = f"""WITH keys AS (SELECT o_custkey % 16 AS part, o_orderkey::VARCHAR AS k FROM orders), sizes AS (SELECT part, ceil(greatest(64, count(*) * 10) / 8)::BIGINT * 8 AS bits FROM keys GROUP BY part),
  asked AS (SELECT part, k, true AS there FROM keys UNION ALL SELECT part, 'x' || k, false FROM keys), hashed AS (SELECT part, there, row_number() OVER () AS id, {_sql_hash32('k')} AS h FROM asked),
  places AS (SELECT part, there, id, ((h + ((h >> 17) | ((h << 15) & 4294967295)) * i) % 4294967296) % bits AS place FROM hashed JOIN sizes USING (part), range(6) t(i)),
  held AS (SELECT DISTINCT part, place FROM places WHERE there)
  SELECT there, avg((found = 6)::INTEGER) AS match_rate, count(*) AS n FROM (SELECT there, id, count(held.place) AS found FROM places LEFT JOIN held ON held.part = places.part AND held.place = places.place GROUP BY there, id) GROUP BY there"""


@query(_BLOOM)
def bloom_false_positive_rate(spark, d):
    keys = L.table(spark, d, "orders").select((F.col("o_custkey") % 16).alias("part"), F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("user_key"))
    probes = keys.withColumn("user_key", F.concat(F.lit(b"x"), "user_key"))
    asked = keys.withColumn("there", F.lit(True)).union(probes.withColumn("there", F.lit(False)))
    found = F.coalesce("match", F.lit(False)).cast("int")
    return K.probed(asked, K.build_filters(keys, "part", few_groups=True), "part", few_groups=True).groupBy("there").agg(F.avg(found).alias("match_rate"), F.count(F.lit(1)).alias("n"))


_CMS = f"""WITH u AS (SELECT user_id, count(*) AS exact, any_value((SELECT {_FNV_SQL.replace('id >>', 'user_id >>')})) AS h FROM events GROUP BY user_id),
  w AS (SELECT *, ((h // 131072) | ((h * 32768) % 18446744073709551616::HUGEINT)) AS s FROM u),
  v AS (SELECT user_id, exact, h - CASE WHEN h >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END AS h, s - CASE WHEN s >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END AS s FROM w),
  cells AS (SELECT user_id, exact, i, (((h + s * i) % 500) + 500) % 500 AS cell FROM v, range(2) t(i)), counts AS (SELECT i, cell, sum(exact) AS n FROM cells GROUP BY i, cell)
  SELECT user_id, any_value(({_FNV_SQL.replace('id >>', 'user_id >>')}) - CASE WHEN ({_FNV_SQL.replace('id >>', 'user_id >>')}) >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS h, any_value(exact) AS exact, min(n)::BIGINT AS estimate, min(n) > 1 AS hot FROM cells JOIN counts USING (i, cell) GROUP BY user_id"""


@query(_CMS)
def cms_estimate(spark, d):
    keys = L.table(spark, d, "events").select("user_id", X.fnv64("user_id").alias("h"))
    return K.estimates(keys.groupBy("user_id", "h").agg(F.count(F.lit(1)).alias("exact")), K.sketch_counts(keys))


@query("WITH t AS (SELECT o_orderkey AS n, greatest(1, ceil(length(ltrim(bin(o_orderkey), '0')) / 7.0))::BIGINT AS l FROM orders) SELECT n, array_to_string(list_transform(range(l), lambda i: printf('%02X', ((n >> (7 * i)) & 127) + CASE WHEN i + 1 < l THEN 128 ELSE 0 END)), '') AS encoded FROM t")
def varint(spark, d):
    return L.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.hex(X.varint("o_orderkey")).alias("encoded"))


_CRC_STEP = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, {X.CRC_POLYNOMIAL}) ELSE x // 2 END)"


@query(f"SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(c_name)), lambda i: ord(c_name[i + 1])::BIGINT)), lambda c, b: {_CRC_STEP}), 4294967295) AS crc FROM customer")
def crc32c(spark, d):
    return L.table(spark, d, "customer").select("c_custkey", X.crc32c(F.encode("c_name", "UTF-8")).alias("crc"))


@query(f"SELECT c_custkey, {_sql_hash32('c_name')} AS h FROM customer")
def hash32(spark, d):
    return L.table(spark, d, "customer").select("c_custkey", X.hash32(F.encode("c_name", "UTF-8"), F.lit(X.BLOOM_SEED)).alias("h"))


@query("""WITH t AS (SELECT c_custkey, c_name AS a, c_mktsegment AS b, list_filter(range(least(length(c_name), length(c_mktsegment))), lambda i: c_name[i + 1] <> c_mktsegment[i + 1])[1] AS d FROM customer)
  SELECT c_custkey, chr(ord(a[1]) + 1) AS successor, CASE WHEN d IS NOT NULL AND ord(a[d + 1]) + 1 < ord(b[d + 1]) THEN a[1:d] || chr(ord(a[d + 1]) + 1) ELSE a END AS separator FROM t""")
def short_keys(spark, d):
    name = F.encode("c_name", "UTF-8")
    return L.table(spark, d, "customer").select("c_custkey", X.escape(X.successor(name)).alias("successor"), X.escape(X.separator(name, F.encode("c_mktsegment", "UTF-8"))).alias("separator"))


@query("""WITH RECURSIVE w AS (SELECT o_custkey % 8 AS queue, o_orderkey AS op_idx, floor(o_totalprice)::BIGINT AS size, o_orderstatus = 'P' AS sync, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS r FROM orders),
  f AS (SELECT queue, op_idx, size, sync, r, 0 AS commit_group, size AS total, CASE WHEN size <= 131072 THEN size + 131072 ELSE 1048576 END AS most, sync AS leads FROM w WHERE r = 1
    UNION ALL SELECT queue, op_idx, size, sync, r, commit_group + n::INTEGER, CASE WHEN n THEN size ELSE total + size END, CASE WHEN n THEN CASE WHEN size <= 131072 THEN size + 131072 ELSE 1048576 END ELSE most END, CASE WHEN n THEN sync ELSE leads END
    FROM (SELECT w.*, f.commit_group, f.total, f.most, f.leads, f.total + w.size > f.most OR (w.sync AND NOT f.leads) AS n FROM f JOIN w ON w.queue = f.queue AND w.r = f.r + 1))
  SELECT queue, op_idx, size, sync, commit_group::BIGINT AS commit_group FROM f""")
def group_commit(spark, d):
    writes = L.table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("queue"), F.col("o_orderkey").alias("op_idx"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") == "P").alias("sync"))
    return WR.group_commit(writes)


@query(f"WITH {_LOG} SELECT level, user_key, seq, 24 AS bytes, (row_number() OVER (PARTITION BY level ORDER BY user_key, seq) - 1) // 171 AS output FROM log WHERE level > 0")
def compaction_outputs(spark, d):
    rows = _log(spark, d).where("level > 0").select("level", "user_key", "seq", F.lit(L.RECORD_BYTES).cast("long").alias("bytes"))
    return C.split_by_size(rows, "level", ["user_key", "seq"], "bytes", 4096)


_S_ETA = (1 - (2.0 / R.SCRAMBLED_ITEMS) ** (1 - R.THETA)) / (1 - R.zeta(2) / R.SCRAMBLED_ZETA)


@query(f"""WITH r AS (SELECT event_id, (CASE WHEN u * {R.SCRAMBLED_ZETA!r} < 1 THEN 0 WHEN u * {R.SCRAMBLED_ZETA!r} < 1 + pow(0.5, 0.99) THEN 1 ELSE floor({R.SCRAMBLED_ITEMS} * pow({_S_ETA!r} * u - {_S_ETA!r} + 1, {1 / (1 - R.THETA)!r})) END)::BIGINT AS id
  FROM (SELECT event_id, {_U_SQL}::DOUBLE AS u FROM events)) SELECT event_id, ((SELECT {_FNV_SQL}) % 1000)::BIGINT AS item FROM r""")
def scrambled_zipf(spark, d):
    return L.table(spark, d, "events").select("event_id", _U().alias("u")).select("event_id", R.scrambled(F.col("u"), 1000).cast("long").alias("item"))
