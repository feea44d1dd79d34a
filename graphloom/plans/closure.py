"""Transitive closure and reachability over edge tables (s, o).

Recursive CTEs keep duplicates, so cycles need a loop. Small edge sets (at most ``DRIVER_EDGES`` edges closing to at most
``DRIVER_PAIRS`` pairs, as class hierarchies are) are closed in driver memory, which costs no round trips; anything larger runs as
doubling on the executors: round k joins all pairs, of path lengths up to 2^k, with the pairs at exactly 2^k steps, so the number of
rounds is logarithmic in the longest path and a pair of a chain is made once. Each round is written to the shared folder.

Where only some starts are asked for, ``reach_pairs`` doubles their pairs alone: on lists its tables are as long as the input and the answer,
not as the square of the longest list.
"""

from __future__ import annotations

import functools
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import bounded_rows, discard, local_frame, materialize

DRIVER_EDGES = 20_000
DRIVER_PAIRS = 500_000


def close_pairs(edges: list[tuple], most: int) -> set[tuple] | None:
    """All pairs (a, b) with a path of one or more edges; None once there are more than most."""
    nexts = defaultdict(set)
    for a, b in edges:
        nexts[a].add(b)
    out: set[tuple] = set()
    for start in list(nexts):
        seen, todo = set(), list(nexts[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(nexts.get(n, ()))
        out.update((start, n) for n in seen)
        if len(out) > most:
            return None
    return out


def closure(edges: DataFrame, driver_edges: int = DRIVER_EDGES, driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """Distinct (s, o) with a path of one or more edges from s to o."""
    spark = edges.sparkSession
    edges = edges.select("s", "o").distinct()
    rows = bounded_rows(edges, driver_edges) if driver_edges else None
    if rows is not None:
        pairs = close_pairs([(r["s"], r["o"]) for r in rows], driver_pairs)
        if pairs is not None:
            return local_frame(spark, sorted(pairs), ["s", "o"])
    every = jump = materialize(edges, "closure")
    older: list[DataFrame] = []  # jumps that are no part of the result
    while True:
        step = jump.select(F.col("s").alias("m"), "o")
        grown = every.select("s", F.col("o").alias("m")).join(step, "m").select("s", "o").distinct()
        fresh = materialize(grown.join(every, ["s", "o"], "left_anti"), "closure")
        if fresh.isEmpty():
            for done in (fresh, *older):
                discard(done)
            return every
        every = every.unionByName(fresh)  # paths of up to twice the length: as many tables as the depth has binary digits
        jump = materialize(jump.select("s", F.col("o").alias("m")).join(step, "m").select("s", "o").distinct(), "closure")
        for done in older:
            discard(done)
        older = [jump]


def reach_pairs(edges: DataFrame, seeds: DataFrame, driver_edges: int = DRIVER_EDGES, driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """Distinct (s, o) with a path of zero or more edges from a seed s (column n) to o.

    Round k joins the pairs found so far, of paths shorter than 2^k, with the pairs at exactly 2^k steps, and ends once nothing is new.
    Both sides meet the same table in one join. Where every node has at most one edge, as in lists, so has every jump, and none is made twice.
    """
    spark = edges.sparkSession
    edges = edges.select("s", "o").distinct()
    seeds = seeds.select("n").distinct()
    rows = bounded_rows(edges, driver_edges) if driver_edges else None
    starts = bounded_rows(seeds, driver_edges) if rows is not None else None
    if starts is not None:
        nexts = defaultdict(set)
        for r in rows:
            nexts[r["s"]].add(r["o"])
        pairs: list[tuple] = []
        for r in starts:
            seen, todo = {r["n"]}, [r["n"]]
            while todo:
                for n in nexts.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            pairs += [(r["n"], n) for n in seen]
            if len(pairs) > driver_pairs:
                break
        else:
            return local_frame(spark, sorted(pairs), ["s", "o"])
    jump = older = materialize(edges, "jump")
    single = jump.groupBy("s").count().where("count > 1").isEmpty()
    found = [materialize(seeds.select(F.col("n").alias("s"), F.col("n").alias("o")), "reach")]
    while True:
        every = functools.reduce(DataFrame.unionByName, found)
        left = every.withColumn("seeded", F.lit(True)).unionByName(jump.withColumn("seeded", F.lit(False)))
        step = jump.select(F.col("s").alias("m"), F.col("o").alias("to"))
        met = left.withColumnRenamed("o", "m").join(step, "m").select("s", F.col("to").alias("o"), "seeded")
        both = materialize(met if single else met.distinct(), "both")
        fresh = materialize(both.where("seeded").select("s", "o").distinct().join(every, ["s", "o"], "left_anti"), "reach")
        discard(older)
        if fresh.isEmpty():
            discard(both)
            discard(fresh)
            return every
        found.append(fresh)
        older, jump = both, both.where("NOT seeded").select("s", "o")


def reach(edges: DataFrame, seeds: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Distinct nodes (column n) reached from seeds (column n) by one or more edges."""
    spark = edges.sparkSession
    edges = edges.select("s", "o").distinct()
    rows, starts = bounded_rows(edges, driver_edges), bounded_rows(seeds.distinct(), driver_edges)
    if rows is not None and starts is not None:
        nexts = defaultdict(set)
        for r in rows:
            nexts[r["s"]].add(r["o"])
        seen: set = set()
        todo = [n for r in starts for n in nexts.get(r["n"], ())]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(nexts.get(n, ()))
        return local_frame(spark, [(n,) for n in sorted(seen)], ["n"])
    edges = materialize(edges, "edges")
    after = lambda df: df.select(F.col("n").alias("s")).join(edges, "s").select(F.col("o").alias("n")).distinct()
    found = fresh = materialize(after(seeds), "reach")
    while True:
        new = materialize(after(fresh).join(found, "n", "left_anti"), "reach")
        if new.isEmpty():
            for done in (edges, new, *([] if fresh is found else [fresh])):
                discard(done)
            return found
        more = materialize(found.unionByName(new), "reach")
        discard(fresh)
        discard(found)
        found, fresh = more, new
