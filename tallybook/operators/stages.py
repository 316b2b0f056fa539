"""Column-in, column-out steps as stages of a ``pyspark.ml`` pipeline, which saves and loads them."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators import documents as docs


class ColumnStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that adds one column made from another and leaves all others as they are."""

    def value(self, name: str):
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, target = self.getInputCol(), self.getOutputCol()
        if source not in dataset.columns:
            raise ValueError(f"no column {source!r}")
        if target in dataset.columns:
            raise ValueError(f"column {target!r} is there already")
        return dataset.withColumn(target, self.value(f"`{source}`"))


class ChatMessages(ColumnStage):
    """Text to the system and user message of a chat request; a null text gives a user message without content."""

    instruction = Param(Params._dummy(), "instruction", "what the system message says", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "messages", instruction: str = ""):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="messages", instruction="")
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol: str = "text", outputCol: str = "messages", instruction: str = "") -> ChatMessages:
        return self._set(**self._input_kwargs)

    def value(self, name: str):
        return docs.chat_messages(name, self.getOrDefault(self.instruction))


class CompletionContent(ColumnStage):
    """Chat completions to the typed JSON of the first choice."""

    schema = Param(Params._dummy(), "schema", "fields of the content, as in a table definition", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "completions", outputCol: str = "content", schema: str = ""):
        super().__init__()
        self._setDefault(inputCol="completions", outputCol="content")
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCol: str = "completions", outputCol: str = "content", schema: str = "") -> CompletionContent:
        return self._set(**self._input_kwargs)

    def value(self, name: str):
        return docs.completion_content(F.col(name), self.getOrDefault(self.schema))


class FlattenUpdates(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array of update records to one row each, its fields as columns beside all others."""

    @keyword_only
    def __init__(self, *, inputCol: str = "updates"):
        super().__init__()
        self._setDefault(inputCol="updates")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getInputCol()
        kind = dataset.schema[name].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            raise ValueError(f"column {name!r} is no array of records")
        others = [c for c in dataset.columns if c != name]
        clash = set(others) & set(kind.elementType.names)
        if clash:
            raise ValueError(f"columns there already: {', '.join(sorted(clash))}")
        return dataset.select(*[f"`{c}`" for c in others], F.inline(f"`{name}`"))
