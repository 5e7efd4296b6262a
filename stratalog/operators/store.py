"""A versioned table on Parquet with the calls of an embedded key-value store, each over many keys at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import file_metadata
from . import compact as C
from . import files as FS
from . import resolve as M
from . import scan as S
from . import stats as A

SHAPE = "user_key binary, seq long, vtype int, value binary, level int, file_no long"


class VersionedTable:
    """One writer appends; readers see a sequence number.

    The folder holds generations of rows, each a folder of batches named by their first sequence number, and pointers
    CURRENT-<n>. A pointer tells the generation in use, the last sequence number and the last file number; it is written
    under another name and then renamed to a number that is not taken, so it is there whole or not at all, and the highest
    counts. Readers take the batches up to its sequence number: a batch is seen whole, once its pointer is. A writer that
    fails in between leaves a batch that nobody reads and that the next write of the same number replaces. Sequence numbers
    are never used again, whatever compaction drops.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.snapshots: dict[int, int] = {}
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs, self._at = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path
        if not self._pointers():
            if self._names("gen="):
                raise ValueError(f"{path} has rows but no pointer to them; repair() can make one")
            self._point({"generation": 0, "last_seq": 0, "last_file": 0})

    def _names(self, prefix: str, folder: str = "") -> list[str]:
        where = self._at(f"{self.path}/{folder}")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return [n.removeprefix(prefix) for n in (s.getPath().getName() for s in found) if n.startswith(prefix)]

    def _pointers(self) -> list[int]:
        return sorted(int(n) for n in self._names("CURRENT-"))

    def _point(self, state: dict) -> None:
        n = max(self._pointers(), default=0) + 1
        draft = self._at(f"{self.path}/draft-{n}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"{self.path}/CURRENT-{n:020d}")):
            raise OSError(f"another writer has set pointer {n}")
        for old in self._pointers()[:-2]:
            self._fs.delete(self._at(f"{self.path}/CURRENT-{old:020d}"), False)

    def _state(self) -> dict:
        newest = self._pointers()[-1]
        text = self.spark.read.text(f"{self.path}/CURRENT-{newest:020d}", wholetext=True).first()[0]
        return json.loads(text)

    def log(self) -> DataFrame:
        state = self._state()
        gen = f"gen={state['generation']}"
        batches = [b for b in self._names("from=", gen) if int(b) <= state["last_seq"]]
        if not batches:
            return self.spark.createDataFrame([], SHAPE)
        return self.spark.read.schema(SHAPE).parquet(*[f"{self.path}/{gen}/from={b}" for b in batches])

    def last_seq(self) -> int:
        return self._state()["last_seq"]

    def write(self, ops: DataFrame) -> None:
        """A batch (op_idx from 0, vtype, user_key, value): atomic, op i taking the next sequence number plus i. One job that
        writes the rows and counts them; no other row is read."""
        state, seen = self._state(), Observation()
        base = state["last_seq"] + 1
        value = F.when(F.col("vtype") == 1, F.col("value")).alias("value")
        told = ops.observe(seen, F.max("op_idx").cast("long").alias("last"))
        file_no = F.lit(state["last_file"] + 1).cast("long").alias("file_no")
        rows = told.select("user_key", (F.col("op_idx") + base).alias("seq"), "vtype", value, F.lit(0).alias("level"), file_no)
        where = f"{self.path}/gen={state['generation']}/from={base:020d}"
        rows.sortWithinPartitions("user_key", F.desc("seq")).write.mode("overwrite").parquet(where)
        last = seen.get["last"]
        if last is not None:
            self._point(state | {"last_seq": base + last, "last_file": state["last_file"] + 1})

    def put(self, key: bytes, value: bytes) -> None:
        self.write(self.spark.createDataFrame([(0, 1, key, value)], "op_idx int, vtype int, user_key binary, value binary"))

    def delete(self, key: bytes) -> None:
        self.write(self.spark.createDataFrame([(0, 0, key, None)], "op_idx int, vtype int, user_key binary, value binary"))

    def snapshot(self) -> int:
        """An id that pins the present state until it is released."""
        ident = max(self.snapshots, default=0) + 1
        self.snapshots[ident] = self.last_seq()
        return ident

    def release(self, snapshot: int) -> None:
        self.snapshots.pop(snapshot, None)

    def _seq(self, snapshot: int | None) -> int | None:
        return None if snapshot is None else self.snapshots[snapshot]

    def get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return M.lookup(keys, self.log(), self._seq(snapshot))

    def scan(self, start: bytes = b"", limit: bytes | None = None, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
        rows = self.log().where(F.col("user_key") >= F.lit(start))
        rows = rows if limit is None else rows.where(F.col("user_key") < F.lit(limit))
        return (S.reverse if reverse else S.forward)(rows, self._seq(snapshot)).select("user_key", "value")

    def files(self) -> DataFrame:
        return file_metadata(self.log())

    def property(self, name: str) -> DataFrame:
        """stats, sstables, num-files-at-level<N>, approximate-memory-usage."""
        files = self.files()
        if name == "stats":
            return FS.level_stats(files)
        if name == "sstables":
            text = files.withColumn("smallest_key", F.hex("smallest_key")).withColumn("largest_key", F.hex("largest_key"))
            return text.groupBy("level").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%d:%d[%s..%s]", "file_no", "file_size", "smallest_key", "largest_key"))), " ").alias("files"))
        if name.startswith("num-files-at-level"):
            return files.where(F.col("level") == int(name.removeprefix("num-files-at-level"))).agg(F.count(F.lit(1)).alias("n"))
        if name == "approximate-memory-usage":
            return self.log().agg(F.coalesce(F.sum(F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))
        raise ValueError(f"no property {name}")

    def approximate_sizes(self, ranges: DataFrame) -> DataFrame:
        """(range_id, bytes) of the rows in [start, limit), deleted and old versions included. Ranges are a small table: it is
        sent to the rows, if small enough, and these meet it once."""
        size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
        met = ranges.join(self.log(), (F.col("user_key") >= F.col("start")) & (F.col("user_key") < F.col("limit")), "left")
        return met.groupBy("range_id").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))

    def compact(self, start: bytes | None = None, limit: bytes | None = None, level: int = 1) -> None:
        """Rewrite the versions of a key range to `level` without what no snapshot can see; other rows stay as they are. A key
        that a snapshot sees as deleted may be told as never there afterwards, but never with a later value."""
        log = self.log()
        oldest = min(self.snapshots.values(), default=self.last_seq())
        inside = (F.lit(True) if start is None else F.col("user_key") >= F.lit(start)) & (F.lit(True) if limit is None else F.col("user_key") < F.lit(limit))
        kept = C.drop_shadowed(log.where(inside), oldest).where(~((F.col("vtype") == 0) & (F.col("seq") <= oldest)))
        state = self._state()
        moved = kept.withColumn("level", F.lit(level)).withColumn("file_no", F.lit(state["last_file"] + 1).cast("long"))
        now = state["generation"] + 1
        whole = moved.unionByName(log.where(~inside)).repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq"))
        whole.write.mode("overwrite").parquet(f"{self.path}/gen={now}/from={0:020d}")
        self._point(state | {"generation": now, "last_file": state["last_file"] + 1})
        self._fs.delete(self._at(f"{self.path}/gen={now - 1}"), True)

    def hits(self, keys: DataFrame) -> DataFrame:
        return A.hits_by_level(M.live(self.log()), keys)

    def repair(self) -> None:
        """Point to the generation that was written to last, with all of its batches that are whole: of two, that is the one
        with the highest batch, as a compaction that failed gets no further ones; without any, the one before compaction."""
        whole = lambda g, b: self._fs.exists(self._at(f"{self.path}/gen={g}/from={b}/_SUCCESS"))
        found = {int(g): [b for b in self._names("from=", f"gen={g}") if whole(g, b)] for g in self._names("gen=")}
        newest = max((g for g, bs in found.items() if bs), key=lambda g: (max(map(int, found[g])), -g), default=0)
        rows = [f"{self.path}/gen={newest}/from={b}" for b in found.get(newest, [])]
        told = self._state() if self._pointers() else {"last_seq": 0, "last_file": 0}
        seq = file_no = 0
        if rows:
            log = self.spark.read.schema(SHAPE).parquet(*rows)
            seq, file_no = log.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("file_no"), F.lit(0))).first()
        self._point({"generation": newest, "last_seq": max(seq, told["last_seq"]), "last_file": max(file_no, told["last_file"])})

    def destroy(self) -> None:
        self._fs.delete(self._at(self.path), True)
