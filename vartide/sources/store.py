"""A content-addressed store of forecasts: rows keyed by a digest of what they were made from.

    <path>/data/<name>/...            Parquet rows of one commit
    <path>/manifest/<batch>.json      names the folder of a commit; its creation is the commit

A batch is named by the digest of its keys, so the same rows have the same name whoever writes them. Rows are written first,
under a fresh name; then the manifest is created, which only one writer can do: the others delete what they wrote.
Readers see committed folders only. A key in several batches is read once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.operators import ranks

#: What a forecast is made from; `context` is an array of its returns.
PARTS = ("model", "revision", "context", "pos", "n_samples", "seed")
SCHEMA = "key string, model string, revision string, pos long, n_samples int, seed long, output array<double>, size long, stored timestamp"


def key() -> Column:
    """The digest of PARTS; returns count as 32-bit floats, as models see them."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    context = F.sha2(F.array_join(F.transform("context", lambda x: F.hex(F.coalesce(x.cast("float"), F.lit(float("nan"))).cast("string").cast("binary"))), ",").cast("binary"), 256)
    return F.sha2(F.concat_ws("|", *[context if c == "context" else F.concat(F.length(said(c)).cast("string"), F.lit(":"), said(c)) for c in PARTS]).cast("binary"), 256)


class ForecastStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> dict[str, dict]:
        """Commits by name."""
        folder, out = self._at("manifest"), {}
        if not self._fs.exists(folder):
            return out
        for f in self._fs.listStatus(folder):
            name = f.getPath().getName()
            if name.endswith(".json"):
                rows = self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).collect()
                if rows and rows[0].value:  # an empty one is being written
                    out[name[:-5]] = json.loads(rows[0].value)
        return out

    def entries(self) -> DataFrame:
        """All committed rows, each key once."""
        folders = [f"{self.path}/data/{b['folder']}" for b in self.batches().values()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders).dropDuplicates(["key"])

    def _commit(self, rows: DataFrame, batch: str | None = None) -> str | None:
        """Write rows and create their manifest; None where there is nothing or another writer was first."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        there = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{folder}")
        n, mixed, total, models = there.agg(F.count("*"), F.bit_xor(F.xxhash64("key")), F.sum(F.xxhash64(F.lit(1), "key").cast("decimal(38,0)")), F.array_sort(F.collect_set("model"))).first()
        batch = batch or f"{n}-{mixed or 0:x}-{int(total or 0):x}"
        target = self._at(f"manifest/{batch}.json")
        if n:
            try:
                out = self._fs.create(target, False)  # fails if it is there
            except Exception as error:
                if not self._fs.exists(target):
                    raise error
            else:
                out.write(bytearray(json.dumps({"folder": folder, "rows": n, "models": models}), "utf-8"))
                out.close()
                return batch
        self._fs.delete(self._at(f"data/{folder}"), True)
        return None

    def put(self, rows: DataFrame) -> str | None:
        """Commit forecasts (PARTS and output, an array) that the store lacks; the name of the commit, or None where all are
        there. The same rows again, or from two writers at once, make one commit."""
        keyed = rows.withColumn("key", key()).dropDuplicates(["key"])
        size = F.size("output").cast("long") * 8
        new = keyed.join(self.entries().select("key"), "key", "left_anti").select(
            "key", F.col("model").cast("string").alias("model"), F.col("revision").cast("string").alias("revision"), F.col("pos").cast("long").alias("pos"), F.col("n_samples").cast("int").alias("n_samples"), F.col("seed").cast("long").alias("seed"),
            F.col("output").cast("array<double>").alias("output"), size.alias("size"), F.current_timestamp().alias("stored"),
        )
        return self._commit(new)

    def get(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """wanted (PARTS and more) that the store has, with output; and those that it has not."""
        keyed = wanted.withColumn("key", key())
        held = self.entries().select("key", "output")
        return keyed.join(held, "key").drop("key"), keyed.join(held.select("key"), "key", "left_anti").drop("key")

    def _drop(self, names: list[str]) -> None:
        known = self.batches()
        for name in names:
            self._fs.delete(self._at(f"manifest/{name}.json"), False)
        for name in names:
            self._fs.delete(self._at(f"data/{known[name]['folder']}"), True)

    def clear(self, model: str | None = None) -> None:
        """Forget everything, or all forecasts of one model."""
        old = self.batches()
        if model is not None:
            old = {k: b for k, b in old.items() if model in b["models"]}
            others = [f"{self.path}/data/{b['folder']}" for b in old.values() if b["models"] != [model]]
            if others:
                self._commit(self.spark.read.schema(SCHEMA).parquet(*others).filter(F.col("model") != model), f"kept-{uuid.uuid4().hex}")
        self._drop(list(old))

    def evict(self, most: int) -> int:
        """Keep the newest forecasts of at most `most` bytes; how many went. What stays is committed before the rest goes, so
        readers miss nothing that stays."""
        old, every = self.batches(), self.entries()
        marked = ranks.cumulated(every.select("key", "size", "stored"), [F.col("stored").desc(), F.col("key").asc()], "size")
        gone = marked.filter(F.col("running") > most).select("key")
        n = gone.count()
        if n:
            self._commit(every.join(gone, "key", "left_anti"), f"kept-{uuid.uuid4().hex}")
            self._drop(list(old))
        return n

