"""Tables in versions: layers of rows, and numbered pointers to them."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.errors import EngineError

#: Layers beyond which, and share of the base's rows in later layers from which, the next write makes a new base.
LAYERS, SHARE = 16, 0.5


class Versions:
    """Rows by `id`, in a base and layers over it. A layer has the rows of the ids that it was written for, and
    those ids, so an id's rows are those of the last layer that names it; a batch writes what it changes and no
    more, until the layers have grown to SHARE of the base and are merged into a new one.

    A version is a pointer of its own, a file named by its number, that names its layers. It is written beside
    and then renamed, which fails if that number is there, so of two writers one is told that it came too late,
    and a crash at any point leaves the last whole version as it was. Readers see the highest number.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        #: How many rows a layer's stored ones are, where `opened` makes several of one.
        self.count = F.count(F.lit(1))

    def _at(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._at(self.path + "/pointers")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def state(self) -> dict[str, Any]:
        """The last pointer: version (0: none yet), layers, and what was kept with it."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "layers": []}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{numbers[-1]}", wholetext=True).first()[0])

    def point(self, state: dict[str, Any]) -> None:
        """Makes a version the last one, if its number is still free."""
        fs, beside = self._at(f"{self.path}/pointers/_{uuid.uuid4()}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{state['version']}"), none)
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise EngineError("checkpoint_conflict", "another writer was first", version=state["version"]) from e
            raise

    def rows(self, layer: dict[str, Any], **how: Any) -> DataFrame:
        return self.opened(self.spark.read.parquet(layer["folder"] + "/rows"), **how)

    def ids(self, layer: dict[str, Any]) -> DataFrame:
        return self.spark.read.parquet(layer["folder"] + "/ids")

    def read(self, state: dict[str, Any] | None = None, **how: Any) -> DataFrame | None:
        """All rows of a version (the last, if none is given), or None if there is none. Filters on columns
        reach the layers' scans, or are given to `opened`, if that takes any."""
        layers = (state or self.state())["layers"]
        if not layers:
            return None
        if len(layers) == 1:
            return self.rows(layers[0], **how)
        touched, out = None, None
        for n, layer in enumerate(layers):
            mine = self.rows(layer, **how).withColumn("_layer", F.lit(n))
            out = mine if out is None else out.unionByName(mine)
            if n:
                own = self.ids(layer).select("id", F.lit(n).alias("_n"))
                touched = own if touched is None else touched.unionByName(own)
        last = touched.groupBy("id").agg(F.max("_n").alias("_last"))
        return out.join(last, "id", "left").where(F.col("_layer") >= F.coalesce("_last", F.lit(0))).drop("_layer", "_last")

    def write(self, df: DataFrame, **kept: Any) -> dict[str, Any]:
        """A new version of these rows alone."""
        return self._point([self._layer(df)], self.state()["version"], kept)

    def _layer(self, df: DataFrame, ids: DataFrame | None = None) -> dict[str, Any]:
        folder, seen = f"{self.path}/{self.name}/{uuid.uuid4()}", Observation()
        df.observe(seen, F.coalesce(self.count, F.lit(0)).alias("rows")).write.option("compression", "zstd").parquet(folder + "/rows")
        if ids is not None:
            ids.write.parquet(folder + "/ids")
        return {"folder": folder, "rows": seen.get["rows"]}

    def _point(self, layers: list[dict[str, Any]], version: int, kept: dict[str, Any]) -> dict[str, Any]:
        state = {"version": version + 1, "layers": layers} | kept
        self.point(state)
        return state

    def append(self, df: DataFrame, ids: DataFrame, **kept: Any) -> dict[str, Any]:
        """A new version, in which the rows of `ids` (id) are those of df. Returns its state, with the layer
        written as `layer` and the state before as `before`."""
        before = self.state()
        layer = self._layer(df, ids)
        layers = [*before["layers"], layer]
        if not before["layers"]:
            layers = [layer]
        elif len(layers) > LAYERS or sum(x["rows"] for x in layers[1:]) > SHARE * layers[0]["rows"]:
            layers = [self._layer(self.arranged(self.read({"layers": layers})))]
        return self._point(layers, before["version"], kept) | {"layer": layer, "before": before}

    def opened(self, df: DataFrame) -> DataFrame:
        """Rows from those that a layer has stored; the same, unless set otherwise."""
        return df

    def arranged(self, df: DataFrame) -> DataFrame:
        """How a base is laid out; as it comes, unless set otherwise."""
        return df

    def drop_old(self) -> None:
        """Removes older pointers, and layers that the last one does not name: none may be reading or writing them."""
        state = self.state()
        kept = {layer["folder"].rsplit("/", 1)[1] for layer in state["layers"]}
        for number in self._numbers()[:-1]:
            fs, at = self._at(f"{self.path}/pointers/{number}")
            fs.delete(at, False)
        fs, at = self._at(f"{self.path}/{self.name}")
        for f in fs.listStatus(at) if fs.exists(at) else ():
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)
