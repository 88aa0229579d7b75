"""Base of fitted stages whose state is a data file, so that saving and loading keeps it."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class StateWriter(MLWriter):
    def __init__(self, instance: "StatefulModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        spark.createDataFrame([(json.dumps(self.instance.state),)], "value string").coalesce(1).write.text(f"{path}/data")
        self.instance._save_parts(path)


class StateReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "StatefulModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.state = json.loads(self.sparkSession.read.text(f"{path}/data").first()[0])
        instance._load_parts(path)
        return instance


class StatefulModel(Model, MLWritable, MLReadable):
    """A model whose fitted values are ``state``, a dict that JSON can hold (bounded by columns and classes).

    Saved as Spark ML metadata and one line of text, both through Spark, so any shared path will do;
    a model made of other models saves those too.
    """

    def __init__(self, state: dict | None = None):
        super().__init__()
        self.state = state or {}

    def write(self) -> MLWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StateReader(cls)

    def _save_parts(self, path: str) -> None:
        pass

    def _load_parts(self, path: str) -> None:
        pass
