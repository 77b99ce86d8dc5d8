"""Schemas of the files and tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
LINES = _struct(path=S, pos=L, text=S)
STS_PAIR = _struct(sentence_a=S, sentence_b=S, score=D)
TRIPLET = _struct(anchor=S, positive=S, negative=S)
EMBEDDING = _struct(text=S, embedding=T.ArrayType(T.FloatType()))
CACHE = _struct(key=S, value=S)
ITEMS = _struct(id=I, sentence_a=S, sentence_b=S, uncertainty=D, status=S, gold_label=D)
ANNOTATORS = _struct(id=I, name=S, reliability=D)
ANNOTATIONS = _struct(id=I, item_id=I, annotator_id=I, label=D, created_at=T.TimestampType())
METRICS = _struct(branch=S, metric=S, value=D)
