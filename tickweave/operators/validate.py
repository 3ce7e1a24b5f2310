"""Checks of tick tables, feature tables and plans. What depends on the schema alone runs no job."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = {"timestamp": ("bigint", "int", "timestamp", "timestamp_ntz"), "askPrice": ("double", "float"), "bidPrice": ("double", "float")}
OPTIONAL = {"askVolume": ("double", "float"), "bidVolume": ("double", "float")}


@dataclass
class SchemaReport:
    missing: list[str] = field(default_factory=list)
    wrong_type: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    has_volume: bool = False

    @property
    def is_valid(self) -> bool:
        return not self.missing and not self.wrong_type


def schema_report(ticks: DataFrame, strict: bool = True) -> SchemaReport:
    """strict wants floating prices; otherwise any number will do."""
    kinds, numbers = dict(ticks.dtypes), ("double", "float", "bigint", "int", "smallint", "tinyint")
    known = REQUIRED | OPTIONAL
    wrong = [c for c, allowed in known.items() if c in kinds and kinds[c] not in (allowed if strict or c == "timestamp" else numbers) and not (kinds[c].startswith("decimal") and not strict)]
    return SchemaReport([c for c in REQUIRED if c not in kinds], wrong, [c for c in kinds if c not in known], all(c in kinds for c in OPTIONAL))


def require_ticks(ticks: DataFrame) -> None:
    report = schema_report(ticks, strict=False)
    if not report.is_valid:
        raise ValueError(f"no tick table: missing {report.missing}, of another type {report.wrong_type}")


def volume_usable(ticks: DataFrame) -> DataFrame:
    """One row: whether both volumes have values, some of them not 0, and vary."""
    ok = lambda c: (F.count(c) > 0) & (F.coalesce(F.max(F.abs(c)), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_samp(c), F.lit(0.0)) > 0)
    return ticks.agg(ok("bidVolume").alias("bid_usable"), ok("askVolume").alias("ask_usable"), (ok("bidVolume") & ok("askVolume")).alias("usable"))


def feature_report(features: DataFrame, columns: list[str], max_null_share: float = 0.05) -> DataFrame:
    """A row for each column: nulls, infinite values, whether constant, and whether the column may be used. One aggregate."""
    inf = float("inf")
    cells = []
    for c in columns:
        value = F.col(c).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n_rows"),
                F.count_if(value.isNull() | F.isnan(value)).alias("n_null"),
                F.count_if(F.coalesce(F.abs(value) == inf, F.lit(False))).alias("n_inf"),
                (F.coalesce(F.max(value) == F.min(value), F.lit(True)) | (F.coalesce(F.stddev_samp(value), F.lit(0.0)) < 1e-10)).alias("is_constant"),
            )
        )
    rows = features.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
    share = F.coalesce(F.try_divide(F.col("n_null"), F.col("n_rows")), F.lit(0.0))
    return rows.withColumn("is_valid", (share <= max_null_share) & (F.col("n_inf") == 0))


def require_features(features: DataFrame, columns: list[str], max_null_share: float = 0.05) -> None:
    bad = [r["column"] for r in feature_report(features, columns, max_null_share).where("NOT is_valid").collect()]
    if bad:
        raise ValueError(f"features with too many nulls or infinite values: {bad}")


def consistency(train: DataFrame, test: DataFrame) -> dict[str, list]:
    a, b = dict(train.dtypes), dict(test.dtypes)
    return {"missing": sorted(a.keys() - b.keys()), "extra": sorted(b.keys() - a.keys()), "types": sorted((c, a[c], b[c]) for c in a.keys() & b.keys() if a[c] != b[c])}


#: Numbers of seq in a block that temporal_safety walks in order.
SEQ_BLOCK = 1 << 16


def temporal_safety(rows: DataFrame) -> DataFrame:
    """symbol, n_rows, n_repeated (timestamps met before), n_backward (rows before their predecessor by seq), is_safe.

    Neighbours are compared within blocks of seq, and the ends of blocks, one row each, with each other.
    """
    blocked = rows.select("symbol", "timestamp", "seq", F.floor(F.col("seq") / SEQ_BLOCK).alias("_block"))
    back = F.lag("timestamp").over(Window.partitionBy("symbol", "_block").orderBy("seq")) > F.col("timestamp")
    inside = blocked.withColumn("back", F.coalesce(back, F.lit(False)))
    blocks = inside.groupBy("symbol", "_block").agg(F.count_if("back").alias("b"), F.min_by("timestamp", "seq").alias("first"), F.max_by("timestamp", "seq").alias("last"))
    edge = F.lag("last").over(Window.partitionBy("symbol").orderBy("_block")) > F.col("first")
    backward = blocks.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("int")).groupBy("symbol").agg(F.sum(F.col("b") + F.col("edge")).alias("n_backward"))
    times = rows.groupBy("symbol", "timestamp").agg(F.count("*").alias("n"))
    out = times.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated")).withColumnRenamed("symbol", "_s")
    joined = out.join(backward, F.col("_s").eqNullSafe(F.col("symbol"))).select("symbol", "n_rows", "n_repeated", "n_backward")
    return joined.withColumn("is_safe", (F.col("n_repeated") == 0) & (F.col("n_backward") == 0))


#: Window functions whose value depends on how many rows a partition has.
_WHOLE = ("NTile", "PercentRank", "CumeDist")


class _Node:
    """A node of a plan or expression, from Spark's JSON of it: class name, fields, children."""

    def __init__(self, fields: dict):
        self.name, self.fields, self.children = fields["class"].rpartition(".")[2].rstrip("$"), fields, []


def _trees(value) -> Iterator[_Node]:
    """The trees in a JSON value. A tree is a list of its nodes, each before its children; fields hold further trees."""
    if isinstance(value, dict):
        for part in value.values():
            yield from _trees(part)
    elif isinstance(value, list) and value and all(isinstance(x, dict) and "num-children" in x for x in value):
        nodes = [_Node(x) for x in value]
        open_: list[tuple[_Node, int]] = []
        for node in nodes:
            while open_ and len(open_[-1][0].children) == open_[-1][1]:
                open_.pop()
            if open_:
                open_[-1][0].children.append(node)
            open_.append((node, node.fields["num-children"]))
        yield nodes[0]
        for node in nodes:
            yield from _trees(node.fields)
    elif isinstance(value, list):
        for part in value:
            yield from _trees(part)


def _sign(bound: _Node) -> float:
    """Of a frame's bound: below 0 for rows before the current one, above 0 for rows after it or where that can't be told."""
    if bound.name in ("CurrentRow", "UnboundedPreceding", "UnboundedFollowing"):
        return ("UnboundedPreceding", "CurrentRow", "UnboundedFollowing").index(bound.name) - 1.0
    if bound.name == "UnaryMinus":
        return -_sign(bound.children[0])
    if bound.name == "Cast":
        return _sign(bound.children[0])
    text = str(bound.fields.get("value", ""))
    numbers = re.findall(r"-?\d+(?:\.\d+)?", text)
    if bound.name != "Literal" or not numbers:
        return 1.0
    return -1.0 if text.lstrip().startswith(("-", "INTERVAL '-")) else float(any(float(x) for x in numbers))


def _ahead(window: _Node) -> str | None:
    """What of a window expression reads rows after its own, if anything."""
    function, spec = window.children
    name = function.children[0].name if function.name == "AggregateExpression" else function.name
    if name in _WHOLE:
        return f"{name} of the whole partition"
    *keys, frame = spec.children
    order = [k for k in keys if k.name == "SortOrder"]
    if frame.name != "SpecifiedWindowFrame":
        return f"{name} over {frame.name}"
    low, high = (_sign(b) for b in frame.children)
    back = bool(order) and "Descending" in str(order[0].fields.get("direction"))
    if (low < 0 if back else high > 0) or (not order and (low < 0 or high > 0)):
        return f"{name} over a frame that reaches ahead"
    return None


def looks_ahead(df: DataFrame) -> list[str]:
    """What in the analysed plan reads rows after their own, as `column: what` (a window inside an expression has a name of the analyser's): windows with a bound ahead, be it of rows or of a range (`lead` and a
    negative `lag` are such), over descending order with a bound behind, without an order, or with a value that depends on the whole partition.

    All windows of the plan are looked at, those below other operators and in subqueries too. What Python functions, joins and
    tables read from files do is not seen.
    """
    found = []

    def walk(node: _Node, column: str) -> None:
        if node.name == "Alias":
            column = node.fields.get("name", column)
        if node.name == "WindowExpression" and (what := _ahead(node)):
            found.append(f"{column}: {what}")
        for child in node.children:
            walk(child, column)

    for tree in _trees(json.loads(df._jdf.queryExecution().analyzed().toJSON())):
        walk(tree, "?")
    return found
