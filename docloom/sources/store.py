"""Tables of the index as Parquet on any file system that Spark reads: upsert, replace by file, append, delete, clear.

Tables that grow with the index are dealt out to buckets by a hash of the file path, and a change writes only the buckets it
touches; logs are appended to. A table is a folder of written parts and a manifest that lists those that hold; a change writes
its parts in full and then replaces the manifest by an atomic rename, so readers see the old or the new table and a failed
write leaves nothing behind. One writer at a time. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.text import basename
from docloom.operators.learning import Params
from docloom.operators.retrieval import latest
from docloom.operators.statistics import file_rollup

#: Buckets of a table that grows with the index.
BUCKETS = 64
#: Parts of a log after which an append writes it anew as one.
MOST_PARTS = 200


def _file_of(name: str) -> Column | None:
    """What a row's bucket is the hash of; other tables have one bucket."""
    if name in ("chunks", "documents_idx"):
        return F.col("file_path")
    if name == "content_metadata":
        return F.regexp_replace("chunk_id", r":[^:]*\z", "")
    return None


def bucket_of(name: str) -> Column:
    file = _file_of(name)
    return F.lit(0) if file is None else F.coalesce(F.pmod(F.xxhash64(file), F.lit(BUCKETS)), F.lit(0)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _path(self, p: str):
        return self._jvm.Path(p)

    def _manifest(self, name: str) -> dict:
        p = self._path(f"{self.root}/{name}/MANIFEST.json")
        if not self._fs.exists(p):
            return {"buckets": {}, "retired": []}
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _hold(self, name: str, buckets: dict[str, list[str]], old: dict) -> None:
        """Makes buckets the table; parts that the manifest before the last one listed are deleted."""
        gone = sorted({p for ps in old["buckets"].values() for p in ps} - {p for ps in buckets.values() for p in ps})
        folder = f"{self.root}/{name}"
        new, at = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/MANIFEST.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps({"buckets": buckets, "retired": gone}).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        options[0] = self._jvm.Options.Rename.OVERWRITE
        self._jvm.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(new, at, options)
        for part in old["retired"]:
            self._fs.delete(self._path(f"{folder}/{part}"), True)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/MANIFEST.json"))

    def size(self) -> int:
        """Bytes of all tables."""
        return self._fs.getContentSummary(self._path(self.root)).getLength()

    def read(self, name: str, buckets: set[str] | None = None) -> DataFrame:
        """The table, or its given buckets."""
        schema = schemas.struct(schemas.TABLES[name])
        held = self._manifest(name)["buckets"]
        parts = [f"{self.root}/{name}/{p}" for k, ps in held.items() if buckets is None or k in buckets for p in ps]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _parts(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        """Writes rows and returns the parts by bucket."""
        schema = schemas.struct(schemas.TABLES[name])
        part = f"p-{uuid.uuid4().hex}"
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_bucket", bucket_of(name))
        # small buckets are written together, one that holds a large file by several tasks
        out = out.hint("rebalance", F.col("_bucket")) if _file_of(name) is not None else out
        out.write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{part}")
        found = self._fs.listStatus(self._path(f"{self.root}/{name}/{part}"))
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return {n.split("=")[1]: [f"{part}/{n}"] for n in names if n.startswith("_bucket=")}

    def write(self, name: str, df: DataFrame) -> None:
        """df as the whole table."""
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        old = self._manifest(name)
        self._hold(name, self._parts(name, df), old)

    def _replace(self, name: str, df: DataFrame, touched: set[str]) -> None:
        """df as the rows of the touched buckets; the others stay as they are."""
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        old = self._manifest(name)
        rest = {k: ps for k, ps in old["buckets"].items() if k not in touched}
        self._hold(name, rest | self._parts(name, df), old)

    def _touched(self, name: str, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(bucket_of(name)).distinct().collect()}  # BUCKETS at most

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """rows in place of those of the same keys, which must lie in the same buckets."""
        touched = self._touched(name, rows)
        self._replace(name, upsert(self.read(name, touched), rows, keys), touched)

    def append(self, name: str, rows: DataFrame) -> None:
        """Further rows; nothing of the table is read or written anew, but after MOST_PARTS appends."""
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        old = self._manifest(name)
        if any(len(ps) >= MOST_PARTS for ps in old["buckets"].values()):
            return self.write(name, self.read(name).unionByName(rows.select(*self.read(name).columns)))
        new = self._parts(name, rows)
        self._hold(name, {k: old["buckets"].get(k, []) + new.get(k, []) for k in {**old["buckets"], **new}}, old)
        return None

    def delete(self, name: str, where: Column, path: str | None = None) -> int:
        """Deletes the rows for which where is true, those of one file if path is given; returns how many."""
        touched = None if path is None else self._touched(name, self.spark.createDataFrame([(path, f"{path}:0")], "file_path string, chunk_id string"))
        old = self.read(name, touched)
        hit = F.coalesce(where, F.lit(False))
        n = old.where(hit).count()
        if n:
            self._replace(name, old.where(~hit), touched) if touched is not None else self.write(name, old.where(~hit))
        return n

    def clear(self, name: str) -> int:
        n = self.read(name).count()
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        self._hold(name, {}, self._manifest(name))
        return n

    def store_chunks(self, chunks: DataFrame) -> int:
        """Replaces the files of chunks in the chunk and document tables; returns the number of chunks stored."""
        fresh = chunks.persist()
        try:
            files = fresh.select("file_path").distinct()
            touched = self._touched("chunks", files)
            old = self.read("chunks", touched)
            self._replace("chunks", old.join(files, "file_path", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns)), touched)
            docs = file_rollup(fresh).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
            self.upsert("documents_idx", docs, ["file_path"])
            return fresh.count()
        finally:
            fresh.unpersist()

    def delete_file(self, path: str) -> int:
        """Deletes a file's chunks, metadata and document row; returns the number of chunks."""
        self.delete("content_metadata", F.regexp_replace("chunk_id", r":[^:]*\z", "") == path, path)
        n = self.delete("chunks", F.col("file_path") == path, path)
        self.delete("documents_idx", F.col("file_path") == path, path)
        return n

    # ---- recommendations and learning

    def store_recommendations(self, rows: DataFrame) -> None:
        """Appends recommendations with an id of their own: rec_, milliseconds, nine hexadecimal digits."""
        ident = F.concat(F.lit("rec_"), F.unix_millis(F.current_timestamp()), F.lit("_"), F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 9))
        self.append("search_recommendations", rows.withColumn("id", ident))

    def record_effectiveness(self, recommendation_id: str, was_used: bool, score: float, original_count: int, improved_results: bool | None = None, improved_count: int | None = None, usage_time=None) -> None:
        """Appends a row; an improved count of 0 is stored as null, as unknown is."""
        n = (self.read("recommendation_effectiveness").agg(F.max("id")).first()[0] or 0) + 1
        row = (n, recommendation_id, was_used, improved_results, usage_time, float(score), original_count, improved_count or None)
        self.append("recommendation_effectiveness", self.spark.createDataFrame([row], schemas.EFFECTIVENESS))

    def clear_recommendations(self) -> int:
        """Clears recommendations and their effectiveness; the learning parameters stay."""
        n = self.clear("search_recommendations")
        self.clear("recommendation_effectiveness")
        return n

    def learning_parameters(self) -> DataFrame:
        """The one row of parameters; the defaults where there is none."""
        if not self.exists("learning_parameters") or not self.read("learning_parameters").take(1):
            self.update_learning_parameters(Params())
        return self.read("learning_parameters")

    def current_parameters(self) -> Params:
        r = self.learning_parameters().first()
        return Params(r["current_tfidf_threshold"], r["learning_rate"], dict(r["strategy_weights"]), list(r["effectiveness_history"]))

    def update_learning_parameters(self, p: Params) -> None:
        row = self.spark.createDataFrame([(p.threshold, p.history, p.weights, None, p.rate)], schemas.LEARNING).withColumn("last_updated", F.current_timestamp())
        self.write("learning_parameters", row)


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows in place of those of the same keys; of several rows of one key the newest by created_at or updated_at,
    where there is one, else any."""
    by = next((c for c in ("updated_at", "created_at", "generated_at") if c in rows.columns), keys[0])
    new = latest(rows.select(*old.columns), keys, by)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def insert_missing(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows whose keys it lacks."""
    return old.unionByName(rows.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def as_documents(chunks: DataFrame) -> DataFrame:
    return file_rollup(chunks).withColumn("file_name", basename(F.col("file_path")))
