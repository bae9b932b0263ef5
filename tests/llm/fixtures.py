from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("Size", T.StringType()), T.StructField("KEPT", T.StringType())])


def documents(spark, texts, sources=None):
    """Rows with ids, null texts, sources and ids, repeated rows, and columns that clash with results."""
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2] + [(None, "no id at all", None, None, 12, None, None)], SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.1 else "") for _ in range(n))


ODD = [None, "", " \t\n", "one", "a b c d", "x" * 30_000, "a b c " * 4000, prose(60), prose(60), prose(200, 1), "line\nline\nline\n\nother", prose(5000, 2), "\x0bweird\x0cspace\r\nhere", "9" * 40_000, ("1.2.3.4.5 " * 300) + "a@b.c_d@e.f.", "+1 (555) 555-0199 4111 1111 1111 1111, 256.1.1.1 000255.1.1.001", "é@x.y ü+1 23456789 0- a.b@c-d.e.f. " * 30]
