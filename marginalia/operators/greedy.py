"""Greedy runs over a document's items in order, where a document may have any number of items.

A loop puts a document in one task. But where a run ends depends on its first item alone, so runs are a chain of pointers. Items are cut into
segments of so many neighbours; a task follows the pointers inside one segment, from each item that a run from the segment before could end at.
What is left are pointers from segment to segment, and these are doubled, with the number of runs they pass, until they reach the
end: the rounds grow with the logarithm of a document's segments, and a document of one segment takes none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.shared import kept

#: Items of a segment, at least.
SEGMENT = 4096


def pointers(costs: np.ndarray, most: int, gap: int, least: int) -> np.ndarray:
    """For each item where a run that begins there ends: before the first item, `least` items on at least, that would make it exceed `most`."""
    before = np.concatenate([[0], np.cumsum(costs + gap)])[:-1]
    ends = np.searchsorted(before + costs, most + before, side="right")
    return np.minimum(np.maximum(ends, np.arange(len(costs)) + least), len(costs))


def starts(costs: np.ndarray, most: int, gap: int, least: int) -> list[int]:
    """Where the runs of a whole list begin."""
    follow, at, out = pointers(costs, most, gap, least), 0, []
    while at < len(costs):
        out.append(at)
        at = int(follow[at])
    return out


def _segments(items: DataFrame, size: int, most: int, gap: int, least: int) -> DataFrame:
    """doc, seg, idx, cost, own: each segment's items, and the next one's as far as a run can reach into it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        before = np.concatenate([[0], np.cumsum(pdf["cost"].to_numpy() + gap)])[:-1]
        head = pdf[(before <= most + gap) | (pdf.index < least)]
        head = head[head["seg"] > 0].assign(own=False)
        return pd.concat([pdf.assign(own=True), head.assign(seg=head["seg"] - 1)])[["doc", "seg", "idx", "cost", "own"]]

    cut = items.select("doc", F.floor(F.col("idx") / size).alias("seg"), F.col("idx").cast("long"), F.col("cost").cast("long"))
    return kept(cut.groupBy("doc", "seg").applyInPandas(run, f"doc {items.schema['doc'].dataType.simpleString()}, seg long, idx long, cost long, own boolean"), "segments")


def runs(items: DataFrame, most: int, gap: int = 0, least: int = 1, least_cost: int = 1) -> DataFrame:
    """doc, run, first, last: the greedy runs of items (doc, idx from 0 without holes, cost of least_cost or more).

    A run takes items while their costs, with `gap` between neighbours, come to `most` at most, and `least` items in any case (a document's last run has what is left).
    """
    kind = items.schema["doc"].dataType.simpleString()
    size = max(SEGMENT, most // (least_cost + gap) + least + 2)  # so a run never spans a whole segment but the last
    segments = _segments(items, size, most, gap, least)

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        own, base, costs = int(pdf["own"].sum()), int(pdf["idx"][0]), pdf["cost"].to_numpy()
        follow = pointers(costs, most, gap, least)
        leave, passed = follow.copy(), np.ones(len(costs), np.int64)
        for i in range(own - 1, -1, -1):
            if follow[i] < own:
                leave[i], passed[i] = leave[follow[i]], 1 + passed[follow[i]]
        before = np.concatenate([[0], np.cumsum(costs + gap)])[:-1]
        entry = np.flatnonzero((before[:own] <= most + gap) | (np.arange(own) < least)) if base else np.zeros(1, np.int64)
        beyond = np.where(leave[entry] < len(costs), base + leave[entry], -1)
        return pd.DataFrame({"doc": pdf["doc"][0], "entry": base + entry, "exit": beyond, "passed": passed[entry]})

    nodes = kept(segments.groupBy("doc", "seg").applyInPandas(jumps, f"doc {kind}, entry long, exit long, passed long").filter("exit >= 0"), "pointers")
    reached = items.filter("idx = 0").select("doc", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    while nodes.limit(1).count():
        further = reached.join(nodes, ["doc", "entry"]).select("doc", F.col("exit").alias("entry"), (F.col("before") + F.col("passed")).alias("before"))
        reached = kept(reached.unionByName(further), "reached")
        then = nodes.select("doc", F.col("entry").alias("exit"), F.col("exit").alias("beyond"), F.col("passed").alias("more"))
        nodes = kept(nodes.join(then, ["doc", "exit"]).select("doc", "entry", F.col("beyond").alias("exit"), (F.col("passed") + F.col("more")).alias("passed")), "pointers")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        own, base = int(pdf["own"].sum()), int(pdf["idx"][0])
        follow, at, found = pointers(pdf["cost"].to_numpy(), most, gap, least), int(pdf["entry"][0]) - base, []
        while at < own:
            found.append((pdf["doc"][0], int(pdf["before"][0]) + len(found), base + at, base + int(follow[at]) - 1))
            at = int(follow[at])
        return pd.DataFrame(found, columns=["doc", "run", "first", "last"])

    entries = reached.withColumn("seg", F.floor(F.col("entry") / size))
    return segments.join(entries, ["doc", "seg"]).groupBy("doc", "seg").applyInPandas(walk, f"doc {kind}, run long, first long, last long")


def members(found: DataFrame) -> DataFrame:
    """doc, idx, run of runs()."""
    return found.select("doc", "run", F.explode(F.sequence("first", "last")).alias("idx"))
