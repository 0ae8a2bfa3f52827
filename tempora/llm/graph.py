"""Connected components of a table of links, label by label on the executors."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tempora.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links(a, b)``; label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so chains shorten by halves.  Defined cases: repeated
    and reversed links count once; a link of a node with itself makes it a node;
    links with a null end are left out; no links give an empty table; other
    columns are not read.
    """
    links = links.filter("a is not null and b is not null")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    edges = written(both.distinct(), "edges")
    held = written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    labels = held
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("other_label"))
        least = edges.join(of_other, "other").groupBy("node").agg(F.min("other_label").alias("near"))
        near = labels.join(least, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        # a label is itself a node with a label, which is never larger
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = written(near.join(jump, "next", "left").select("node", "label", F.least("next", "jump").alias("next")), "labels")
        discard(held)
        labels, held = step.select("node", F.col("next").alias("label")), step
        if step.filter("next <> label").isEmpty():
            discard(edges)
            labels.shared_path = step.shared_path
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more ``links``: only the components that these touch are drawn together."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("of_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("of_b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    drawn = components(between.filter("a <> b"))
    moved = drawn.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    single = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    everyone = labels.select("node", "label").unionByName(single)
    made = written(everyone.join(moved, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), "labels")
    discard(drawn, labels)
    return made
