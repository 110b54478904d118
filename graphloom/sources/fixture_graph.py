"""A property graph derived from the star-schema tables, for tests and throughput runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _code(prefix: str, c: str, width: int):
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), width, "0"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, label, name, code)."""
    none = F.lit(None).cast("string").alias("code")
    major = _t(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).select(F.lit("MAJOR").alias("label"), F.col("n_name").alias("name"), _code("7480", "n_nationkey", 3).alias("code"))
    part = _t(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    subject = part.select(F.lit("SUBJECT").alias("label"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), _code("P", "p_partkey", 6).alias("code"))
    skill = part.select(F.explode(F.array("p_brand", "p_type")).alias("name")).distinct().select(F.lit("SKILL").alias("label"), "name", none)
    career = _orders(spark, sf_dir, ["o_orderkey"]).select("career").distinct().select(F.lit("CAREER").alias("label"), F.col("career").alias("name"), none)
    teacher = _t(spark, sf_dir, "supplier", ["s_name"]).select(F.lit("TEACHER").alias("label"), F.col("s_name").alias("name"), none)
    every = reduce(DataFrame.unionByName, [major, subject, skill, career, teacher])
    return every.select(F.concat(F.col("label"), F.lit(":"), F.coalesce("code", "name")).alias("node_id"), "label", "name", "code")


def _orders(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    """Orders with the career their customer and priority stand for."""
    o = _t(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority", *cols])
    c = _t(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("career", F.concat_ws(" ", "c_mktsegment", "o_orderpriority"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src, dst, rel_type, semester, required_type, required_level); edge_id is a digest of the rest, so it needs no global order."""
    line = _t(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"])
    supplier = _t(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    part = _t(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    null = F.lit(None).cast("string")

    def edge(df: DataFrame, src, dst, kind: str, semester=None, required=null, level=null) -> DataFrame:
        sem = F.lit(None).cast("int") if semester is None else semester
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("rel_type"), sem.alias("semester"), required.alias("required_type"), level.alias("required_level"))

    subject = lambda c: F.concat(F.lit("SUBJECT:"), _code("P", c, 6))
    major = lambda c: F.concat(F.lit("MAJOR:"), _code("7480", c, 3))
    career = F.concat(F.lit("CAREER:"), F.col("career"))
    on_supplier = F.col("l_suppkey") == F.col("s_suppkey")
    kept = line.filter("l_linenumber = 1 and l_quantity >= 48 and l_partkey >= 6").join(supplier, on_supplier)
    flag = F.when(F.col("l_returnflag") == "N", "required").otherwise("elective")
    offers = edge(kept, major("s_nationkey"), subject("l_partkey"), "OFFERS", (F.year("l_shipdate") % 8 + 1).cast("int"), flag).distinct()
    # the planted core curriculum: every nation takes parts 0 to 2, the first twenty also 3 to 5 (six parts by a fixed rule)
    nation = _t(spark, sf_dir, "nation", ["n_nationkey"])
    core = nation.withColumn("p_partkey", F.explode(F.when(F.col("n_nationkey") < 20, F.sequence(F.lit(0), F.lit(5))).otherwise(F.sequence(F.lit(0), F.lit(2)))))
    core = core.join(part.select("p_partkey"), "p_partkey", "left_semi")
    planted = edge(core, major("n_nationkey"), subject("p_partkey"), "OFFERS", F.lit(1), F.lit("required"))
    teach = edge(line.filter("l_linenumber = 2 and l_quantity >= 49").join(supplier, on_supplier), F.concat(F.lit("TEACHER:"), F.col("s_name")), subject("l_partkey"), "TEACH").distinct()
    brand = edge(part.filter("p_size <= 10"), subject("p_partkey"), F.concat(F.lit("SKILL:"), F.col("p_brand")), "PROVIDES")
    kind = edge(part.filter("p_size <= 3"), subject("p_partkey"), F.concat(F.lit("SKILL:"), F.col("p_type")), "PROVIDES")
    req = line.filter("l_linenumber = 3 and l_quantity >= 50").join(_orders(spark, sf_dir, ["o_orderkey"]), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    requires = edge(req, career, F.concat(F.lit("SKILL:"), F.col("p_brand")), "REQUIRES", level=F.when(F.col("l_discount") >= 0.07, "advanced").otherwise("basic")).distinct()
    leads = edge(_orders(spark, sf_dir, ["o_totalprice"]).filter("o_totalprice >= 490000"), major("c_nationkey"), career, "LEADS_TO").distinct()
    every = reduce(DataFrame.unionByName, [offers, planted, teach, brand, kind, requires, leads])
    props = ["src", "dst", "rel_type", "semester", "required_type", "required_level"]
    return every.select(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in props])).alias("edge_id"), *props)


#: The same graph for DuckDB, as leading common table expressions.
SQL = """nodes AS (
 SELECT 'MAJOR:'||code node_id,'MAJOR' AS label,name,code FROM (SELECT '7480'||lpad(n_nationkey::varchar,3,'0') code,n_name AS name FROM nation)
 UNION ALL SELECT 'SUBJECT:P'||lpad(p_partkey::varchar,6,'0'),'SUBJECT',p_name||' '||p_partkey,'P'||lpad(p_partkey::varchar,6,'0') FROM part
 UNION ALL SELECT 'SKILL:'||x,'SKILL',x,NULL FROM (SELECT DISTINCT p_brand x FROM part UNION SELECT DISTINCT p_type FROM part)
 UNION ALL SELECT 'CAREER:'||x,'CAREER',x,NULL FROM (SELECT DISTINCT c_mktsegment||' '||o_orderpriority x FROM orders JOIN customer ON o_custkey=c_custkey)
 UNION ALL SELECT 'TEACHER:'||s_name,'TEACHER',s_name,NULL FROM supplier),
edges AS (SELECT row_number() OVER (ORDER BY rel_type,src,dst,semester,required_type,required_level) edge_id,* FROM (
 SELECT DISTINCT 'MAJOR:7480'||lpad(s_nationkey::varchar,3,'0') src,'SUBJECT:P'||lpad(l_partkey::varchar,6,'0') dst,'OFFERS' rel_type,(year(l_shipdate)%8+1)::int semester,CASE l_returnflag WHEN 'N' THEN 'required' ELSE 'elective' END required_type,NULL::varchar required_level
   FROM lineitem JOIN supplier ON l_suppkey=s_suppkey WHERE l_linenumber=1 AND l_quantity>=48 AND l_partkey>=6
 UNION ALL SELECT 'MAJOR:7480'||lpad(n_nationkey::varchar,3,'0'),'SUBJECT:P'||lpad(p_partkey::varchar,6,'0'),'OFFERS',1,'required',NULL FROM nation,part WHERE p_partkey<3 OR (p_partkey<6 AND n_nationkey<20)
 UNION ALL SELECT DISTINCT 'TEACHER:'||s_name,'SUBJECT:P'||lpad(l_partkey::varchar,6,'0'),'TEACH',NULL,NULL,NULL FROM lineitem JOIN supplier ON l_suppkey=s_suppkey WHERE l_linenumber=2 AND l_quantity>=49
 UNION ALL SELECT 'SUBJECT:P'||lpad(p_partkey::varchar,6,'0'),'SKILL:'||p_brand,'PROVIDES',NULL,NULL,NULL FROM part WHERE p_size<=10
 UNION ALL SELECT 'SUBJECT:P'||lpad(p_partkey::varchar,6,'0'),'SKILL:'||p_type,'PROVIDES',NULL,NULL,NULL FROM part WHERE p_size<=3
 UNION ALL SELECT DISTINCT 'CAREER:'||c_mktsegment||' '||o_orderpriority,'SKILL:'||p_brand,'REQUIRES',NULL,NULL,CASE WHEN l_discount>=0.07 THEN 'advanced' ELSE 'basic' END
   FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey WHERE l_linenumber=3 AND l_quantity>=50
 UNION ALL SELECT DISTINCT 'MAJOR:7480'||lpad(c_nationkey::varchar,3,'0'),'CAREER:'||c_mktsegment||' '||o_orderpriority,'LEADS_TO',NULL,NULL,NULL
   FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_totalprice>=490000))"""
