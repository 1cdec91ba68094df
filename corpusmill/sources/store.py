"""Tables of a document store on Parquet: append, replace by document, upsert by key, delete with everything that hangs on a document, ordered reads.

A table's rows lie in parts, each with a folder for every organization and bucket of document ids, and a numbered
pointer lists the folders that count. A change writes new folders and then the next pointer, so readers never see half
a change and a failed job leaves the table as it was. An append writes its own rows alone; an upsert, replacement or
deletion rewrites only the folders of the organizations and buckets that it touches, by anti-joins on the keys. Two
writers that start from the same pointer can't both write the next one: the second takes its turn anew.

Rows of different organizations never replace or delete each other, as an id says nothing about its organization.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import SCHEMAS, seed_acronyms
from .staging import staged

TENANT = "organization_id"
#: Tables that lose rows with a document, and the column that names it.
DEPENDENTS = {"chunks": ("document_id",), "pages": ("document_id",), "extracted_tables": ("document_id",), "quality_reports": ("document_id",), "processing_jobs": ("document_id",), "document_relationships": ("source_document_id", "target_document_id")}
#: By table, the column whose hash gives a row's bucket.
BUCKETED = {"documents": "id"} | {table: columns[0] for table, columns in DEPENDENTS.items()}
BUCKETS, TRIES = 16, 20


def _matches(keys: list[str], prefix: str = "__cm_") -> Column:
    """Equal keys, nulls equal too; the other side's columns have the prefix."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def _named(frame: DataFrame, keys: list[str], prefix: str = "__cm_") -> DataFrame:
    return frame.select(*[F.col(k).alias(prefix + k) for k in keys]).distinct()


def kept(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new doesn't have."""
    return old.join(_named(new, keys), _matches(keys), "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(kept(old, new, keys), allowMissingColumns=True)


def document_keys(old: DataFrame, new: DataFrame, document_col: str = "document_id") -> list[str]:
    """What names a document: its id, within its organization where both tables tell it."""
    return [*([TENANT] if TENANT in old.columns and TENANT in new.columns else []), document_col]


def replaced(old: DataFrame, new: DataFrame, document_col: str = "document_id") -> DataFrame:
    """All rows of a document that new touches give way to those of new."""
    return upserted(old, new, document_keys(old, new, document_col))


def inserted_if_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key is neither there nor given before."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))
    fresh = kept(new.withColumn("__cm_first", first).where("__cm_first = 1").drop("__cm_first"), old, keys)
    return old.unionByName(fresh, allowMissingColumns=True)


def without(frame: DataFrame, gone: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows none of whose columns holds a value of gone(id), of the same organization if gone(id, organization_id) tells it."""
    same = TENANT in gone.columns and TENANT in frame.columns
    names = gone.select(F.col("id").alias("__cm_gone"), *([F.col(TENANT).alias("__cm_" + TENANT)] if same else [])).distinct()
    for c in columns:
        frame = frame.join(names, (F.col(c) == F.col("__cm_gone")) & (_matches([TENANT]) if same else F.lit(True)), "left_anti")
    return frame


def latest(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return frame.withColumn("__cm_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__cm_n = 1").drop("__cm_n")


def page_of(frame: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The state of each job from its events(job_id, ts, status, ...): started_at at the first processing, completed_at at the last completed or failed."""
    done = F.col("status").isin("completed", "failed")
    return events.groupBy(key).agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"), F.max(F.when(done, F.col("ts"))).alias("completed_at"), F.count("*").alias("transitions")
    )


class WriteConflict(RuntimeError):
    """Others kept changing the table while this change was tried."""


class Store:
    """Tables under one folder. buckets: folders of an organization's rows, by document; the same for a store's life."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def _current(self, table: str) -> tuple[int, dict] | None:
        """The number and content of the last pointer."""
        numbers = [int(n[8:-5]) for n in self._names(f"{self.root}/{table}") if n.startswith("pointer-")]
        if not numbers:
            return None
        for _ in range(50):  # its writer may not have closed it yet
            text = self.spark.read.text(f"{self.root}/{table}/pointer-{max(numbers):012d}.json", wholetext=True).collect()
            if text and text[0][0]:
                return max(numbers), json.loads(text[0][0])
            time.sleep(0.1)
        raise WriteConflict(f"the last pointer of {table} is empty")

    def _commit(self, table: str, number: int, content: dict) -> bool:
        """Write pointer `number`; False if someone else has. The file system must create files exclusively, as HDFS does."""
        try:
            out = self._fs().create(self._path(f"{self.root}/{table}/pointer-{number:012d}.json"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def _change(self, table: str, change: Callable[[dict | None], dict | None]) -> None:
        """Apply change to the current pointer's content until it is the one that follows; None changes nothing."""
        for _ in range(TRIES):
            now = self._current(table)
            content = change(now[1] if now else None)
            if content is None or self._commit(table, now[0] + 1 if now else 0, content):
                return
        raise WriteConflict(f"{table} was changed by others {TRIES} times")

    def _parted(self, table: str, frame: DataFrame, column: str | None = None) -> tuple[DataFrame, list[str]]:
        """frame with its bucket, and the columns that make folders."""
        folders = [TENANT] if TENANT in frame.columns else []
        column = column or BUCKETED.get(table)
        if column in frame.columns:
            return frame.withColumn("bucket", F.pmod(F.hash(F.col(column).cast("string")), F.lit(self.buckets))), [*folders, "bucket"]
        return frame, folders

    def _written(self, table: str, frame: DataFrame, column: str | None = None) -> list[str]:
        """Write frame as a new part: its folders, below the table's."""
        frame, folders = self._parted(table, frame, column)
        part = f"part=v-{uuid.uuid4().hex}"
        (frame.repartition(*folders).write.partitionBy(*folders) if folders else frame.write).parquet(f"{self.root}/{table}/{part}")
        found = [part]
        for name in folders:
            found = [f"{f}/{n}" for f in found for n in self._names(f"{self.root}/{table}/{f}") if n.startswith(f"{name}=")]
        return found if folders else [f for f in found if any(n.startswith("part-") for n in self._names(f"{self.root}/{table}/{f}"))]

    def _frame(self, table: str, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def _typed(self, rows: DataFrame, schema: StructType | None) -> tuple[DataFrame, StructType]:
        """rows with the types that the table has, and the table's schema with the columns that rows add."""
        if schema is None:
            return rows, rows.schema
        rows = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) if c in schema.names else F.col(c) for c in rows.columns])
        return rows, StructType([*schema.fields, *[f for f in rows.schema.fields if f.name not in schema.names]])

    @staticmethod
    def _place(folder: str) -> str:
        return folder.partition("/")[2]

    def read(self, table: str) -> DataFrame:
        """The current rows; none of a table that was never written."""
        current = self._current(table)
        if current is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self._frame(table, StructType.fromJson(current[1]["schema"]), current[1]["folders"])

    def write(self, table: str, frame: DataFrame) -> None:
        """Make frame the table's rows."""
        folders = self._written(table, frame)
        self._change(table, lambda now: {"schema": frame.schema.jsonValue(), "folders": folders})

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; what is there isn't touched."""
        now = self._current(table)
        rows, _ = self._typed(rows, StructType.fromJson(now[1]["schema"]) if now else None)
        folders = self._written(table, rows)

        def change(old: dict | None) -> dict:
            schema = self._typed(rows, StructType.fromJson(old["schema"]) if old else None)[1]
            return {"schema": schema.jsonValue(), "folders": [*(old["folders"] if old else []), *folders]}

        self._change(table, change)

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Add rows in place of those with their keys. Keys that span organizations or documents rewrite all folders."""
        now = self._current(table)
        rows, _ = self._typed(rows, StructType.fromJson(now[1]["schema"]) if now else None)
        folders = self._written(table, rows)
        new = self._frame(table, rows.schema, folders)
        narrow = all(c in keys for c in self._parted(table, rows)[1] if c != "bucket") and BUCKETED.get(table) in keys
        places = {self._place(f) for f in folders}

        def change(old: dict | None) -> dict:
            if old is None:
                return {"schema": rows.schema.jsonValue(), "folders": folders}
            schema = StructType.fromJson(old["schema"])
            touched = [f for f in old["folders"] if not narrow or self._place(f) in places]
            left = self._written(table, kept(self._frame(table, schema, touched), new, keys)) if touched else []
            return {"schema": self._typed(rows, schema)[1].jsonValue(), "folders": [*[f for f in old["folders"] if f not in touched], *folders, *left]}

        self._change(table, change)

    def replace(self, table: str, rows: DataFrame, document_col: str = "document_id") -> None:
        """Rows take the place of all rows of their documents, within their organizations."""
        self.upsert(table, rows, document_keys(self.read(table), rows, document_col))

    def bootstrap(self) -> None:
        """Create the tables that don't exist, and the acronyms that a store begins with."""
        for table, schema in SCHEMAS.items():
            if self._current(table) is None:
                self.write(table, self.spark.createDataFrame([], schema))
        seed = seed_acronyms(self.spark).withColumn(TENANT, F.lit(None).cast("string"))
        keys = [TENANT, "acronym", "domain", "expansion"]
        self.write("acronyms", staged(inserted_if_new(self.read("acronyms"), seed, keys), "acronyms"))

    def delete_documents(self, gone: DataFrame) -> None:
        """Delete documents(id, organization_id) and all rows that hang on them; without organization_id those of every organization."""
        gone = staged(gone.distinct(), "gone")
        scratch, folders = self._parted("gone", gone, "id")
        places = {"/".join(f"{c}={r[c]}" for c in folders if c == "bucket") for r in scratch.select("bucket").distinct().collect()}  # at most the buckets
        for table, columns in (*DEPENDENTS.items(), ("documents", ("id",))):
            # Edges to a document lie in the bucket of their other end.
            within = None if len(columns) > 1 else places

            def change(old: dict | None, table=table, columns=columns, within=within) -> dict | None:
                if old is None:
                    return None
                touched = [f for f in old["folders"] if within is None or f.rsplit("/", 1)[-1] in within or "bucket=" not in f]
                if not touched:
                    return None
                left = self._written(table, without(self._frame(table, StructType.fromJson(old["schema"]), touched), gone, columns))
                return {"schema": old["schema"], "folders": [*[f for f in old["folders"] if f not in touched], *left]}

            self._change(table, change)

    def mark_indexed(self, table: str, ids: DataFrame, columns: tuple[str, ...] = ("is_indexed",)) -> None:
        """Set flags of the rows of ids(id), of ids(id, organization_id) where that is given."""
        keys = ["id", *([TENANT] if TENANT in ids.columns else [])]
        hits = _named(ids, keys).withColumn("__cm_hit", F.lit(True))

        def change(old: dict | None) -> dict | None:
            if old is None:
                return None
            rows = self._frame(table, StructType.fromJson(old["schema"]), old["folders"]).join(hits, _matches(keys), "left")
            marked = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce("__cm_hit", F.lit(False)) for c in columns})
            return {"schema": old["schema"], "folders": self._written(table, marked.select(*StructType.fromJson(old["schema"]).names))}

        self._change(table, change)

    def update(self, table: str, key: str, organization: str | None, values: dict[str, Column]) -> None:
        """Set columns of the row with this id in this organization; other rows stay as they are."""
        here = (F.col("id") == key) & F.col(TENANT).eqNullSafe(F.lit(organization))
        rows = self.read(table).where(here)  # one row, whose place in the table stays
        self.upsert(table, staged(rows.withColumns(values), "update"), list(dict.fromkeys([TENANT, BUCKETED.get(table, "id"), "id"])))

    def version(self, table: str) -> int:
        """A number that grows with every change; -1 for a table that was never written."""
        now = self._current(table)
        return now[0] if now else -1

    def vacuum(self, table: str) -> int:
        """Delete parts that the current pointer doesn't list, and older pointers; call it when nothing reads or writes the table. How many parts went."""
        now = self._current(table)
        if now is None:
            return 0
        used = {f.split("/")[0] for f in now[1]["folders"]}
        old = [n for n in self._names(f"{self.root}/{table}") if n.startswith("part=") and n not in used]
        pointers = [n for n in self._names(f"{self.root}/{table}") if n.startswith("pointer-") and int(n[8:-5]) < now[0]]
        for name in (*old, *pointers):
            self._fs().delete(self._path(f"{self.root}/{table}/{name}"), True)
        return len(old)
