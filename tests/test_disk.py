"""What is written on disk on the way to a result, and that it goes when nothing reads it any more."""

import glob
import time
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph import lineage
from loomgraph.operators import classify, traverse

from .test_graph import fns, graph, ids, routed


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}


def test_written_tables_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    out = lineage.materialize(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert out.count() == 10 and spark.conf.get(lineage.CLEANUP) != "true"


def labels_of(monkeypatch):
    """The labels of the tables that are written from now on."""
    labels, new = [], lineage.new_dir
    noted = lambda spark, label: labels.append(label) or new(spark, label)
    monkeypatch.setattr(lineage, "new_dir", noted)
    monkeypatch.setattr(traverse, "new_dir", noted)
    return labels


def claimed(spark):
    names = [f"f{k}" for k in range(30)]
    edges = [(names[k], names[j], kind) for k in range(1, 30) for j in (k // 2, k // 3) for kind in ("Calls", "DataFlow") if (k + j) % 5 or kind == "Calls"]
    claims = [(names[k], ("must", "may", "must", None)[k % 4], names[k // 2] if k % 4 < 3 else None, int(k == 9)) for k in range(1, 30)]
    return graph(spark, fns(*names), sorted(set(edges)), claims + [("f4", "unknown", None, 0), ("f6", "may", "f2", 0)])


def test_steps_are_written_once(spark, monkeypatch):
    labels = labels_of(monkeypatch)
    classify.classified_impact(claimed(spark), ids(spark, "f1"))
    assert labels.count("steps") == 1 and "checked" not in labels and "boundaries" not in labels


def test_slices_are_the_whole(spark, monkeypatch):
    """Steps that are made slice by slice are those that are made at once."""
    answers = []
    for size in (lineage.SLICE, 10):
        monkeypatch.setattr(lineage, "SLICE", size)
        labels = labels_of(monkeypatch)
        g = claimed(spark).materialized()
        steps, parts = classify.evidence(g)
        c, b = classify.classified_impact(g, ids(spark, "f1"))
        answers.append([sorted(map(str, df.distinct().collect())) for df in (steps, *parts, c, b)])
    assert labels.count("steps") > 2 and answers[0] == answers[1] and len(answers[0][0]) > 30


def test_searches_keep_no_copy_of_their_steps(spark):
    steps = spark.createDataFrame([(k, k + 1) for k in range(5)], "at long, to long")
    seeds = spark.createDataFrame([(0, 0)], "origin long, node long")
    had = set(Path(lineage.shared_dir(spark).removeprefix("file://"), "loomgraph").glob("steps-*"))
    assert traverse.reach(steps, seeds).count() == 6
    assert set(Path(lineage.shared_dir(spark).removeprefix("file://"), "loomgraph").glob("steps-*")) <= had


def test_routed_steps_in_slices(spark, monkeypatch):
    """Routed steps that are made slice by slice are those that are made at once, and the routes' own table goes."""
    answers = []
    for size in (lineage.SLICE, 1):
        monkeypatch.setattr(lineage, "SLICE", size)
        answers.append(sorted(map(str, traverse.routed_steps(routed(spark, wrapper=True)).collect())))
    assert answers[0] == answers[1] and any("b" in a for a in answers[0])
    left = Path(lineage.shared_dir(spark).removeprefix("file://"), "loomgraph").glob("routes-*")
    assert not list(left)
