import pytest
from pyspark.sql import functions as F

from loomgraph.functions.idents import language
from loomgraph.sources import extract, store
from loomgraph.streaming import delta, watch


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def equal_to_cold(spark, state, now):
    files = spark.createDataFrame([(p, t) for p, t in now.items() if t is not None], "path string, source string")
    cold = extract.build(extract.extract(files.withColumn("lang", language(F.col("path"))))).materialized()
    warm = state.graph().materialized()
    for a, b in ((cold.nodes, warm.nodes), (cold.edges, warm.edges), (cold.claims, warm.claims)):
        assert rows(a, a.columns) == rows(b, a.columns)


def test_a_batch_writes_in_proportion_to_what_changed(spark, tmp_path):
    """Files that call each other in a ring; every state equals a cold build, and few references are resolved again."""
    n = 24
    source = lambda k, own, called: f"def {own}():\n    return {called}() + helper{k}()\n\ndef helper{k}():\n    return {k}\n"
    now = {f"m{k}.py": source(k, f"f{k}", f"f{(k + 1) % n}") for k in range(n)}
    state = delta.DeltaState(spark, f"file://{tmp_path}/d")
    seq = iter(range(1000))

    def apply(changed, batch=None):
        now.update(changed)
        return state.apply(spark.createDataFrame([(next(seq), None, p, t) for p, t in changed.items()], watch.CHANGES), batch)

    first = apply(dict(now), 0)
    assert first["resolved"] == 2 * n
    equal_to_cold(spark, state, now)
    # a body changes: its own two calls only
    assert apply({"m3.py": source(3, "f3", "f9")}, 1)["resolved"] == 2
    # a function is renamed: its file's calls and the calls of its old name
    told = apply({"m5.py": source(5, "g5", "f6")}, 2)
    assert (told["resolved"], told["names"]) == (3, 2) and told["facts"] < first["facts"] / 10
    equal_to_cold(spark, state, now)
    # a second function of a name makes calls of it ambiguous, wherever they are; a file goes; one comes
    assert apply({"m7.py": source(7, "f20", "f8")}, 3)["resolved"] == 2 + 2
    assert apply({"m9.py": None, "deep/m40.py": source(40, "f7", "f5")}, 4)["resolved"] == 2 + 3
    equal_to_cold(spark, state, now)
    assert apply({"m1.py": now["m1.py"]}, 4) == {"skipped": True}
    state.compact()
    assert len(state.state()["generations"]) == 1
    assert apply({"m7.py": source(7, "f7", "f8")}, 5)["resolved"] == 2 + 2
    equal_to_cold(spark, state, now)


def test_a_lost_batch_is_not_seen(spark, tmp_path, monkeypatch):
    state = delta.DeltaState(spark, f"file://{tmp_path}/d")
    change = lambda text: spark.createDataFrame([(1, None, "a.py", text)], watch.CHANGES)
    state.apply(change("def f():\n    pass\n"), 0)
    before = rows(state.graph().nodes, ["path"])
    with monkeypatch.context() as m:
        m.setattr(delta, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply(change("def g():\n    pass\n"), 1)
    assert rows(state.graph().nodes, ["path"]) == before
    state.apply(change("def h():\n    pass\n"), 1)
    assert rows(state.graph().nodes, ["path"]) == ["Row(path='crate::a')", "Row(path='crate::a::h')"]


def test_a_pointer_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    for text in ("one", "two", "three"):
        store.write_text(spark, path, text)
        assert store.read_text(spark, path) == text
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["p"]
