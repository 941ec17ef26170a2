"""A table with a row index that is kept while rows are appended."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.numeric import quoted
from flowspark.operators.order import PART, POS, OrderedRows, order_rows
from flowspark.schemas import require_columns
from flowspark.session import path_exists, remove_path, small_table

_FILE = "_file"


class IndexedTable:
    """Rows below ``path`` in the total order ``order`` (a unique tuple without nulls), with their position in it.

    Rows lie in folders that each hold a stretch of the order, sorted, with their place in the stretch. A small table of
    folders (first and last key, number of rows) is all that connects them, so a row's index is the number of rows in the
    folders before its own plus its place. Rows appended after everything else are sorted alone and become new folders;
    late ones rewrite only the folders they fall into. No other file is touched or read.

    An append counts once its table of folders is written, which is its last step but for the removal of what it
    replaced. One append at a time; each makes at least one folder, so append by the hour or day. The table of folders
    goes to the driver: one row per folder.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], partitions: int | None = None):
        self.spark, self.path, self.order, self.partitions = spark, path.rstrip("/"), list(order), partitions

    # -- the table of folders ----------------------------------------------------------------------
    def _versions(self) -> list[int]:
        home = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/folders")
        files = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(home):
            return []
        names = [s.getPath().getName() for s in files.listStatus(home)]
        return sorted(int(n) for n in names if path_exists(self.spark, f"{self.path}/folders/{n}/_SUCCESS"))

    def _folders(self) -> tuple[int, list]:
        """The last version and its folders, in order."""
        versions = self._versions()
        if not versions:
            return -1, []
        rows = self.spark.read.parquet(f"{self.path}/folders/{versions[-1]}").collect()
        return versions[-1], sorted(rows, key=lambda r: r["ordinal"])

    def count(self) -> int:
        return sum(r["n"] for r in self._folders()[1])

    def rows(self, idx: str = "idx") -> DataFrame:
        """All rows with their index, counted from 0."""
        _, folders = self._folders()
        if not folders:
            raise ValueError(f"nothing was appended to {self.path}")
        ends = accumulate(r["n"] for r in folders)
        starts = small_table(self.spark, [(r["folder"], e - r["n"]) for r, e in zip(folders, ends)], f"{_FILE} STRING, _first BIGINT")
        placed = self._read([r["folder"] for r in folders])
        joined = placed.join(F.broadcast(starts), _FILE)
        return joined.withColumn(idx, F.col("_first") + F.col("_at")).drop(_FILE, "_first", "_at")

    def _read(self, folders: list[str]) -> DataFrame:
        # a folder's name says which append wrote it
        paths = [f"{self.path}/rows/{name.split('-')[0]}/{_FILE}={name}" for name in folders]
        schema = T.StructType.fromDDL(self._schema())
        found = self.spark.read.schema(schema).parquet(*paths)
        where = F.regexp_extract(F.col("_metadata.file_path"), f"{_FILE}=([^/]+)/[^/]+$", 1)
        return found.select("*", where.alias(_FILE))

    def _schema(self) -> str:
        return self.spark.read.text(f"{self.path}/schema", wholetext=True).first()["value"].strip()

    # -- appending ------------------------------------------------------------------------------------
    def append(self, rows: DataFrame) -> None:
        require_columns(rows, self.order)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", `_at` bigint"
        version, folders = self._folders()
        if version < 0:
            small_table(self.spark, [(ddl,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        elif self._schema() != ddl:
            raise ValueError("appended rows have other columns")
        version += 1
        home = f"{self.path}/rows/{version}"
        remove_path(self.spark, home)
        placed, searched = self._placed(rows, folders)
        keys = F.struct(*[quoted(c) for c in self.order])
        with placed:
            sorted_rows = placed.rows.withColumn(_FILE, F.concat_ws("-", F.lit(version), "_stretch", PART))
            stretches = sorted_rows.groupBy(_FILE, "_stretch", PART).agg(
                F.count("*").alias("n"), F.min(POS).alias("_start"), F.min(keys).alias("first"), F.max(keys).alias("last")
            )
            found = stretches.collect()  # one row per new folder
            starts = small_table(self.spark, [(r[_FILE], r["_start"]) for r in found], f"{_FILE} STRING, _start BIGINT")
            out = sorted_rows.join(F.broadcast(starts), _FILE).withColumn("_at", F.col(POS) - F.col("_start"))
            names = [quoted(c) for c in rows.columns]
            out.select(*names, "_at", _FILE).write.partitionBy(_FILE).parquet(home)
        if searched is not None:
            searched.release()
        touched = {r["_stretch"] for r in found}
        kept = [(r["ordinal"], -1, r["folder"], r["n"], r["first"], r["last"]) for r in folders if r["ordinal"] not in touched]
        new = [(r["_stretch"], r[PART], r[_FILE], r["n"], r["first"], r["last"]) for r in found]
        listed = sorted(kept + new, key=lambda r: r[:2])
        key_type = T.StructType([f for c in self.order for f in rows.schema.fields if f.name == c])
        schema = T.StructType([
            T.StructField("ordinal", T.LongType()), T.StructField("folder", T.StringType()), T.StructField("n", T.LongType()),
            T.StructField("first", key_type), T.StructField("last", key_type),
        ])
        table = self.spark.createDataFrame([(i, *r[2:]) for i, r in enumerate(listed)], schema)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folders/{version}")
        for r in folders:
            if r["ordinal"] in touched:
                remove_path(self.spark, f"{self.path}/rows/{r['folder'].split('-')[0]}/{_FILE}={r['folder']}")
        remove_path(self.spark, f"{self.path}/folders/{version - 1}")

    def _placed(self, rows: DataFrame, folders: list) -> tuple[OrderedRows, OrderedRows | None]:
        """The new rows, and those of the folders that late ones fall into, sorted; ``_stretch`` is the ordinal of the
        folder they belong to, one beyond the last for rows after everything else. And the sorted late rows."""
        if not folders:
            first = rows.withColumn("_stretch", F.lit(0).cast("bigint"))
            return order_rows(first, ["_stretch", *self.order], self.partitions), None
        routed, searched = self._routed(rows, folders)
        touched = [r[0] for r in routed.filter(F.col("_stretch") < len(folders)).select("_stretch").distinct().collect()]
        if touched:
            by_name = small_table(self.spark, [(folders[o]["folder"], o) for o in touched], f"{_FILE} STRING, _stretch BIGINT")
            old = self._read([folders[o]["folder"] for o in touched]).join(F.broadcast(by_name), _FILE).drop(_FILE, "_at")
            routed = routed.unionByName(old)
        return order_rows(routed, ["_stretch", *self.order], self.partitions), searched

    def _routed(self, rows: DataFrame, folders: list) -> tuple[DataFrame, OrderedRows]:
        """``_stretch`` of new rows. Rows after the last key need no search; the late ones are sorted together with the
        first keys of the folders, and each takes the last folder that begins before it."""
        order = [quoted(c) for c in self.order]
        schema = T.StructType([f for c in self.order for f in rows.schema.fields if f.name == c])
        last = F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(folders[-1]["last"], schema.fields)])
        after = F.struct(*order) > last
        new = rows.filter(after).withColumn("_stretch", F.lit(len(folders)).cast("bigint"))
        late = rows.filter(~after)
        marks = self.spark.createDataFrame([(*r["first"], r["ordinal"]) for r in folders], schema.add("_mark", T.LongType()))
        both = late.withColumn("_late", F.lit(True)).unionByName(marks.withColumn("_late", F.lit(False)), allowMissingColumns=True)
        found = order_rows(both, [*self.order, "_late"], self.partitions, per_part=[F.max("_mark").alias("_mark")])
        tops, before = -1, {}
        for part in sorted(found.per_part):
            before[part] = max(tops, 0)  # before the first key: the first folder
            tops = max(tops, found.per_part[part]["_mark"] if found.per_part[part]["_mark"] is not None else -1)
        upto = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
        lookup = found.part_table(before, "_before", "BIGINT")
        placed = found.rows.withColumn("_here", F.max("_mark").over(upto)).join(F.broadcast(lookup), PART)
        placed = placed.filter("_late").withColumn("_stretch", F.coalesce("_here", "_before"))
        return new.unionByName(placed.select(*[quoted(c) for c in new.columns])), found
