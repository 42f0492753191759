"""Map elements over the star-schema test tables: one definition for Spark and for the SQL that checks it.

Parts are nodes, orders are ways with their line items as refs, customers, nations and regions are relations, and
events are histories and changes. Tags come from rules (position, key, value, condition), which become a tag array in
Spark and a union of long rows in SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.model import Dataset
from mapweave.schema import TAGS

NODES = """
SELECT p_partkey AS id, CAST((p_partkey*7919)%1700001*1000 - 850000000 AS INT) AS lat_e7,
       CAST((p_partkey*104729)%3600001*1000 - 1800000000 AS INT) AS lon_e7 FROM part
"""
REFS = """
SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice)-1 AS INT) AS pos,
       l_partkey AS node_id FROM lineitem
"""
RELATIONS = """
SELECT c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT CAST(10000000+n_nationkey AS BIGINT), n_name FROM nation
UNION ALL SELECT CAST(20000000+r_regionkey AS BIGINT), r_name FROM region
"""
MEMBERS = """
SELECT c_custkey AS rel_id, 'w' AS mtype, o_orderkey AS ref, o_orderpriority AS role FROM orders JOIN customer ON o_custkey=c_custkey
UNION ALL SELECT CAST(10000000+n_nationkey AS BIGINT), 'r', c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT CAST(20000000+r_regionkey AS BIGINT), 'r', CAST(10000000+n_nationkey AS BIGINT), 'subarea' FROM nation JOIN region ON n_regionkey=r_regionkey
"""
#: kind -> (source, id, rules)
TAG_RULES = {
    "n": ("part", "p_partkey", [
        ("brand", "p_brand", "p_size%3<>0"), ("type", "p_type", "p_size%3<>0"), ("size", "CAST(p_size AS STRING)", "p_size%3<>0"),
        ("addr:housenumber", "CAST(1+p_partkey%60 AS STRING)", "p_partkey%5=0"), ("addr:street", "'Street ' || CAST(p_partkey%40 AS STRING)", "p_partkey%5=0"),
    ]),
    "w": ("orders", "o_orderkey", [
        ("highway", "CASE o_orderkey%4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' ELSE 'service' END", "o_orderkey%3<>0"),
        ("name", "'Street ' || CAST(o_orderkey%40 AS STRING)", "o_orderkey%2=0"), ("status", "o_orderstatus", "o_orderkey%5<>0"),
        ("priority", "o_orderpriority", "o_orderkey%10<>0"), ("building", "'yes'", "o_orderkey%11=0"), ("area", "CASE WHEN o_orderkey%2=0 THEN 'yes' ELSE 'no' END", "o_orderkey%7=0"),
    ]),
    "r": (f"({RELATIONS}) AS rels", "id", [
        ("type", "CASE id%3 WHEN 0 THEN 'multipolygon' WHEN 1 THEN 'boundary' ELSE 'route' END", "true"), ("name", "name", "true"),
        ("boundary", "'administrative'", "id%3=1"), ("admin_level", "CAST(2+id%9 AS STRING)", "id%3=1"),
    ]),
}
#: {epoch} is a dialect's whole seconds of events.ts.
HISTORY = """
SELECT 'n' AS kind, user_id%50 AS id, event_id AS seq, event_id AS version, {epoch} AS ts_s, event_type<>'error' AS visible, event_type FROM events
"""
CHANGES = """
SELECT event_id AS seq, CASE WHEN event_type IN ('signup','view') THEN 'create' WHEN event_type IN ('click','purchase') THEN 'modify' ELSE 'delete' END AS action,
       'n' AS kind, CAST((user_id*31 + event_id)%3000 AS BIGINT) AS id, CAST((event_id*7919)%1700001*1000 - 850000000 AS INT) AS lat_e7, CAST((event_id*104729)%3600001*1000 - 1800000000 AS INT) AS lon_e7 FROM events
"""
EPOCH = {"spark": "unix_seconds(CAST(ts AS TIMESTAMP))", "duckdb": "CAST(floor(epoch(ts)) AS BIGINT)"}


def tag_rows_sql() -> str:
    """(kind, id, pos, k, v), a row a tag."""
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS id, {pos} AS pos, '{k}' AS k, {v} AS v FROM {source} WHERE {cond}" for kind, (source, key, rules) in TAG_RULES.items() for pos, (k, v, cond) in enumerate(rules))


#: Common table expressions that every checking query may use.
CTES = {
    "nodes": NODES, "way_refs": REFS, "rel_members": MEMBERS, "rels": RELATIONS, "elem_tags": tag_rows_sql(), "ways": "SELECT o_orderkey AS id FROM orders",
    "elements": "SELECT 'n' AS kind, p_partkey AS id FROM part UNION ALL SELECT 'w', o_orderkey FROM orders UNION ALL SELECT 'r', id FROM rels",
    "history": HISTORY.format(epoch=EPOCH["duckdb"]), "changes": CHANGES,
}


def oracle(body: str, extra: str = "") -> str:
    """A checking query: the views, then the query's own ``extra`` expressions, then its body."""
    head = ", ".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    return f"WITH RECURSIVE {head}{', ' + extra if extra else ''} {body}"


class Graph:
    """The test tables of one folder as a dataset. Nothing is read before a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *tables: str) -> DataFrame:
        """SQL over test tables, bound as arguments, so that no view is left behind."""
        for t in tables:
            text = _named(text, t)
        return self.spark.sql(text, **{t: self.table(t) for t in tables})

    def _tags(self, kind: str) -> str:
        rules = TAG_RULES[kind][2]
        return "CAST(filter(array(" + ", ".join(f"CASE WHEN {cond} THEN named_struct('k','{k}','v',{v}) END" for k, v, cond in rules) + f"), x -> x IS NOT NULL) AS {TAGS}) AS tags"

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(NODES.replace("FROM part", f", {self._tags('n')} FROM part"), "part")

    @cached_property
    def ways(self) -> DataFrame:
        return self.sql(f"SELECT o_orderkey AS id, {self._tags('w')} FROM orders", "orders")

    @cached_property
    def relations(self) -> DataFrame:
        return self.sql(f"SELECT id, {self._tags('r')} FROM ({RELATIONS}) AS rels", "customer", "nation", "region")

    @cached_property
    def refs(self) -> DataFrame:
        return self.sql(REFS, "lineitem")

    @cached_property
    def members(self) -> DataFrame:
        return self.sql(MEMBERS, "orders", "customer", "nation", "region")

    @cached_property
    def dataset(self) -> Dataset:
        return Dataset(self.nodes, self.ways, self.relations, self.refs, self.members)

    @cached_property
    def history(self) -> DataFrame:
        return self.sql(HISTORY.format(epoch=EPOCH["spark"]), "events")

    @cached_property
    def changes(self) -> DataFrame:
        return self.sql(CHANGES, "events")

    @cached_property
    def nested(self) -> Dataset:
        """The dataset with refs and members as arrays in its ways and relations."""
        gather = lambda rows, key, item: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"]).alias("a")).withColumnRenamed(key, "id")
        ways = self.ways.join(gather(self.refs, "way_id", F.col("node_id")), "id", "left").withColumnRenamed("a", "refs")
        member = F.struct(F.col("mtype").alias("type"), "ref", "role")
        numbered = self.members.withColumn("pos", F.struct("mtype", "ref", "role"))
        return Dataset(self.nodes, ways, self.relations.join(gather(numbered, "rel_id", member), "id", "left").withColumnRenamed("a", "members"))


def _named(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
