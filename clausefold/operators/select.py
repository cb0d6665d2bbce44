"""Hierarchical label selection.

Label tables are one DataFrame per level with an ``id`` column and one
column per label dimension.  A filter query (D6) is a nested list
``[level][column] -> accepted values``; an empty list accepts everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausefold.functions import ids as I


def label_predicate(label_cols: list[str], selection: list[list[str]]) -> Column:
    """Conjunction of ``col IN (accepted)``; an empty list accepts all."""
    if len(selection) != len(label_cols):
        raise ValueError(f"filter has {len(selection)} columns, labels have {len(label_cols)}")
    preds = [F.col(c).isin(list(vals)) for c, vals in zip(label_cols, selection) if len(vals) > 0]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def select_labels(labels: DataFrame, label_cols: list[str], selection: list[list[str]],
                  id_col: str = "id") -> DataFrame:
    """P1 on one level."""
    return labels.where(label_predicate(label_cols, selection))


def restrict_to_parents(child: DataFrame, parent: DataFrame, level: int, id_col: str = "id") -> DataFrame:
    """Keep a child iff its ancestor at ``level`` survived.

    The ancestor key is the full id prefix (any depth).  ``left_semi`` never
    duplicates children and AQE splits a skewed parent key.
    """
    keys = parent.select(F.col(id_col).alias("__pid"))
    return child.join(keys, I.id_prefix(F.col(id_col), level) == F.col("__pid"), "left_semi")


def filter_levels(levels: list[DataFrame], label_cols: list[list[str]],
                  selections: list[list[list[str]]], id_col: str = "id") -> list[DataFrame]:
    """P1 on every level, then each level restricted to surviving parents
    (downward only; parents without children stay)."""
    if len(levels) != len(selections) or len(levels) != len(label_cols):
        raise ValueError("selection levels do not match label levels")
    out = [select_labels(l, c, s, id_col) for l, c, s in zip(levels, label_cols, selections)]
    for i in range(1, len(out)):
        out[i] = restrict_to_parents(out[i], out[i - 1], i - 1, id_col)
    return out


def attach_text(labels: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels joined to their text on id (inner)."""
    return labels.join(texts, on=id_col, how="inner")


def merge_granules(data: DataFrame, id_col: str = "id", text_col: str = "text", level: int = 0,
                   extra_cols: list[str] | None = None) -> DataFrame:
    """A1: concatenate child texts into their ancestor at ``level``.

    Children sorted by id string, each text followed by one space (so the
    result ends with a space).  One group is one clause, so the collected
    array is bounded by the clause size; map-side partial aggregation
    applies to ``collect_list``.  ``extra_cols`` are returned as arrays in
    the same child order.
    """
    extra = list(extra_cols or [])
    parent = I.id_prefix(F.col(id_col), level)
    grouped = data.groupBy(parent.alias(id_col)).agg(
        F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("k"), F.col(text_col).alias("t"),
                                             *[F.col(c).alias(c) for c in extra]))).alias("__parts")
    )
    return grouped.select(
        id_col,
        F.concat(F.array_join(F.transform("__parts", lambda p: p["t"]), " "), F.lit(" ")).alias(text_col),
        *[F.col("__parts")[c].alias(c) for c in extra],
    )


def propagate_labels(data: DataFrame, labels: DataFrame, label_col: str,
                     data_level: int, label_level: int, id_col: str = "id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """J3 + J4: give each granule the label of its ancestor at ``label_level``.

    Returns ``(matched, unmatched)``: ``matched`` = (id, text, label);
    ``unmatched`` = granules whose label key is missing (logged and dropped by
    the reference).  A label finer than the data is an error.
    """
    if data_level < label_level:
        raise ValueError("cannot label a coarse granule with a finer label")
    if data_level == label_level:
        key = F.col(id_col)
    else:
        key = I.id_prefix(F.col(id_col), label_level)
    d = data.withColumn("__key", key)
    lab = labels.select(F.col(id_col).alias("__key"), F.col(label_col).alias("label"))
    matched = d.join(lab, on="__key", how="inner").select(id_col, text_col, "label")
    unmatched = d.join(lab, on="__key", how="left_anti").select(id_col, "__key")
    return matched, unmatched


def class_filter(segments: DataFrame, labels: DataFrame, classes: list[str],
                 id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Segments whose label is one of ``classes``."""
    keep = labels.where(F.col(label_col).isin(classes)).select(id_col, label_col)
    return segments.join(keep, on=id_col, how="inner")


def keyword_subset(df: DataFrame, text_col: str, terms: list[str], first_line_only: bool = False) -> DataFrame:
    """Rows whose lower-cased text (or its first line) contains a term."""
    t = F.lower(F.col(text_col))
    if first_line_only:
        t = F.split(t, "\n").getItem(0)
    # an OR of contains (no lambda): the lowered text is computed once
    hit = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x.lower())) for x in terms], F.lit(False))
    return df.where(hit)


def nonblank_of_types(df: DataFrame, text_col: str, type_col: str, types: list[str]) -> DataFrame:
    """P5: non-blank text and type in list."""
    from clausefold.functions.text import strip_ws
    return df.where((strip_ws(F.col(text_col)) != "") & F.col(type_col).isin(types))
