"""The star-schema tables seen as a graph.

Modules are regions, types are nations and parts, functions are customers,
suppliers and orders; orders call their customer and their parts, parts flow to
their suppliers; urgent orders are tests; a line's return flag is the class of
its call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.idents import node_id
from ..graph import Graph
from ..schema import SPAN


#: Lines that one task groups, by order or by part and supplier.
LINES = 400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(*parts):
    return F.concat_ws("::", F.lit("crate"), *parts)


def tag(letter: str, c):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def order_path(c: str = "o_orderkey"):
    return at(F.lit("orders"), tag("o", c))


def part_path(c: str = "p_partkey"):
    return at(F.lit("parts"), tag("p", c))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, home): the path of each nation."""
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", at(tag("r", "n_regionkey"), tag("n", "n_nationkey")).alias("home"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    home = homes(spark, sf_dir)
    none = F.lit(None).cast("string")

    def of(df, kind, name, path, source, file=none, test=F.lit(False)):
        tests = F.when(test, F.create_map(F.lit("is_test"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
        return df.select(node_id(path).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), F.lit("table").alias("language"), file.alias("file"), F.lit(None).cast(SPAN).alias("span"), source.alias("source"), tests.alias("attributes"))

    out = of(t("region"), "Module", F.col("r_name"), at(tag("r", "r_regionkey")), F.col("r_name"))
    out = out.union(of(t("nation"), "Type", F.col("n_name"), at(tag("r", "n_regionkey"), tag("n", "n_nationkey")), F.col("n_name")))
    out = out.union(of(t("part"), "Type", F.col("p_name"), part_path(), F.concat_ws(" ", "p_name", "p_brand", "p_type")))
    c = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.union(of(c, "Function", F.col("c_name"), F.concat_ws("::", "home", tag("c", "c_custkey")), F.col("c_mktsegment"), F.concat(F.lit("market/"), "c_mktsegment")))
    s = t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    out = out.union(of(s, "Function", F.col("s_name"), F.concat_ws("::", "home", tag("s", "s_suppkey")), F.col("s_name"), F.concat(F.lit("supply/"), F.col("s_nationkey").cast("string"))))
    month = F.date_format("o_orderdate", "yyyy-MM")
    return out.union(of(t("orders"), "Function", tag("o", "o_orderkey"), order_path(), F.concat_ws(" ", "o_orderstatus", "o_orderpriority"), month, F.col("o_orderpriority") == "1-URGENT"))


def edges(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    home = homes(spark, sf_dir)
    one = F.lit(1.0)

    def of(df, src, dst, kind, weight=one):
        return df.select(node_id(src).alias("src"), node_id(dst).alias("dst"), F.lit(kind).alias("kind"), weight.cast("float").alias("weight"))

    lines = t("lineitem") if lines is None else lines
    c = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    customer, supplier = F.concat_ws("::", "home", tag("c", "c_custkey")), F.concat_ws("::", "home", tag("s", "s_suppkey"))
    out = of(home, at(tag("r", "n_regionkey")), F.col("home"), "Contains")
    out = out.union(of(c, F.col("home"), customer, "Contains")).union(of(s, F.col("home"), supplier, "Contains"))
    out = out.union(of(t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")), order_path(), customer, "Calls"))
    # dealt by order once: both sums and the parts of an order are in the same task, of as many lines whatever the table's size
    tasks = max(1, -(-t("lineitem").count() // LINES))
    pairs = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    pairs = pairs.withColumn("all_q", F.sum("q").over(Window.partitionBy("l_orderkey")))
    out = out.union(of(pairs, order_path("l_orderkey"), part_path("l_partkey"), "Calls", F.col("q") / F.col("all_q")))
    flows = lines.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.union(of(flows, part_path("l_partkey"), supplier, "DataFlow"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each line: A is must, N is may, R is unknown and has no target. Customers and regions call nothing; suppliers have no evidence."""
    flag = F.col("l_returnflag")
    cls = F.when(flag == "A", "must").when(flag == "N", "may").otherwise("unknown")
    target = node_id(part_path("l_partkey"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("source"))
    n = F.col("l_linenumber").cast("long")
    site = F.struct(n.alias("start_byte"), (n + 1).alias("end_byte"), F.col("l_linenumber").alias("start_row"), F.lit(0).alias("start_col"))
    lines = load(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.select(
        node_id(order_path("l_orderkey")).alias("caller"),
        F.lit(1).alias("version"),
        node_id(F.col("source")).alias("source_fingerprint"),
        F.array().cast("array<string>").alias("assumptions"),
        site.alias("site"),
        cls.alias("class"),
        F.when(flag == "R", F.array().cast("array<bigint>")).otherwise(F.array(target)).alias("targets"),
        F.when(flag == "R", "unproven-call").otherwise("proven-by-flag").alias("reason"),
        ((flag == "R") & (F.col("l_linestatus") == "O")).alias("coverage_gap"),
    )
    idle = nodes(spark, sf_dir).where("kind = 'Module' or startswith(file, 'market/')").select(F.col("path"), "source")
    idle = idle.union(orders.join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(order_path(), "source"))
    none = lambda t: F.lit(None).cast(t)
    idle = idle.select(node_id(F.col("path")), F.lit(1), node_id(F.col("source")), F.array().cast("array<string>"), none(own.schema["site"].dataType), none("string"), F.array().cast("array<bigint>"), none("string"), F.lit(False))
    return own.union(idle)


def star_graph(spark: SparkSession, sf_dir: str, with_claims: bool = False) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), claims(spark, sf_dir) if with_claims else None)


def baseline(spark: SparkSession, sf_dir: str, before: str = "1998-06-30") -> Graph:
    """The graph of the lines shipped before a day."""
    lines = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(before).cast("timestamp"))
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, lines))
