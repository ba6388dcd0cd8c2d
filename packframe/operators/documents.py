"""Documents without a fixed schema: JSON text to wire text and back, a document at a time, in Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packframe.errors import WireError
from packframe.plans import document, graph_text
from packframe.sources import json_text

#: What the functions return: the text, or the code of the error.
RESULT = StructType([StructField("text", StringType()), StructField("error", StringType())])


def _each(values: pd.Series, function) -> pd.DataFrame:
    rows = []
    for v in values:
        try:
            rows.append((None, None) if v is None else (function(v), None))
        except WireError as e:
            rows.append((None, e.code))
    return pd.DataFrame(rows, columns=["text", "error"])


@F.pandas_udf(RESULT)
def _to_wire(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: document.encode(json_text.parse(v)))


@F.pandas_udf(RESULT)
def _to_wire_nested(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: document.encode(json_text.parse(v), flatten=False))


@F.pandas_udf(RESULT)
def _from_wire(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: json_text.serialize(document.decode(v)))


@F.pandas_udf(RESULT)
def _graph_to_wire(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: graph_text.encode_graph(graph_text.Graph.of(json_text.parse(v))))


def _mode(result: Column, mode: str) -> Column:
    if mode == "PERMISSIVE":
        return result
    return F.when(result["error"].isNotNull(), F.raise_error(result["error"]).cast("string")).otherwise(result["text"])


def to_wire(json_col: Column, flatten: bool = True, mode: str = "FAILFAST") -> Column:
    """Wire text of JSON text.  mode PERMISSIVE gives struct<text,error> instead of failing."""
    return _mode((_to_wire if flatten else _to_wire_nested)(json_col), mode)


def from_wire(wire_col: Column, mode: str = "FAILFAST") -> Column:
    """JSON text of wire text, generic or graph."""
    return _mode(_from_wire(wire_col), mode)


def graph_to_wire(json_col: Column, mode: str = "FAILFAST") -> Column:
    """Wire text of the JSON form of one small graph (tool, tokenBudget, tokensUsed, packRoot, symbols, edges); from_wire()
    gives that form back.  For graphs as tables see operators.graph."""
    return _mode(_graph_to_wire(json_col), mode)
