"""The driver's order tables seen as field-survey data: Spark frames and the same as SQL.

Record = order line, visit = order, taxon = part, place = supplier, parent place = nation,
person = customer. Positions and boxes come from key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import Tables

#: Day the jobs take as today.
AS_OF = "2001-06-15"

FRAMES_SQL = {
    "records": """SELECT l_orderkey * 10 + l_linenumber AS record_id, l_orderkey AS visit_id, l_partkey AS taxon_id,
  l_suppkey AS place_id, l_returnflag AS record_status, l_linestatus AS substatus, CAST(l_shipdate AS DATE) AS seen_on,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
  (l_suppkey * 37) % 1000 AS x, (l_suppkey * 91) % 1000 AS y FROM lineitem""",
    "visits": """SELECT o_orderkey AS visit_id, o_custkey AS user_id, o_orderstatus AS status, o_totalprice AS total,
  CAST(o_orderdate AS DATE) AS date_start, o_orderpriority AS priority, o_custkey % 100 AS place_id,
  (o_orderkey * 37) % 1000 AS x, (o_orderkey * 91) % 1000 AS y FROM orders""",
    "taxa": """SELECT p_partkey AS taxon_id, p_name AS name, p_brand AS family, p_type AS taxon_group,
  p_size AS rank_order, p_retailprice AS price FROM part""",
    "places": """SELECT s_suppkey AS place_id, s_name AS place_name, s_nationkey AS parent_id, s_acctbal AS balance,
  (s_suppkey * 37) % 1000 AS x, (s_suppkey * 91) % 1000 AS y FROM supplier""",
    "parents": "SELECT n_nationkey AS parent_id, n_name AS parent_name, n_regionkey AS region_id FROM nation",
    "people": """SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey AS nation_id, c_acctbal AS balance,
  c_mktsegment AS role, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer""",
    "boxes": """SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS region_name, (n_nationkey % 5) * 200 AS xmin,
  (n_nationkey // 5) * 200 AS ymin, (n_nationkey % 5) * 200 + 250 AS xmax, (n_nationkey // 5) * 200 + 250 AS ymax FROM nation""",
}


class Frames(Tables):
    """Tables of a folder, and the stand-in frames as properties."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)

    @property
    def records(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
            F.col("l_orderkey").alias("visit_id"),
            F.col("l_partkey").alias("taxon_id"),
            F.col("l_suppkey").alias("place_id"),
            F.col("l_returnflag").alias("record_status"),
            F.col("l_linestatus").alias("substatus"),
            F.col("l_shipdate").cast("date").alias("seen_on"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            *_position("l_suppkey"),
        )

    @property
    def visits(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("visit_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("total"),
            F.col("o_orderdate").cast("date").alias("date_start"),
            F.col("o_orderpriority").alias("priority"),
            (F.col("o_custkey") % 100).alias("place_id"),
            *_position("o_orderkey"),
        )

    @property
    def taxa(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("taxon_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("family"),
            F.col("p_type").alias("taxon_group"),
            F.col("p_size").alias("rank_order"),
            F.col("p_retailprice").alias("price"),
        )

    @property
    def places(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("place_id"),
            F.col("s_name").alias("place_name"),
            F.col("s_nationkey").alias("parent_id"),
            F.col("s_acctbal").alias("balance"),
            *_position("s_suppkey"),
        )

    @property
    def parents(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").alias("parent_id"),
            F.col("n_name").alias("parent_name"),
            F.col("n_regionkey").alias("region_id"),
        )

    @property
    def people(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("user_name"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("role"),
            *_position("c_custkey"),
        )

    @property
    def boxes(self) -> DataFrame:
        """Overlapping rectangles, one per nation, with their WKT."""
        key = F.col("n_nationkey")
        x0, y0 = (key % 5) * 200, F.floor(key / 5).cast("int") * 200
        df = self.nation.select(
            key.cast("long").alias("region_id"),
            F.col("n_name").alias("region_name"),
            x0.alias("xmin"),
            y0.alias("ymin"),
            (x0 + 250).alias("xmax"),
            (y0 + 250).alias("ymax"),
        )
        return df.withColumn("wkt", geo.box_wkt("xmin", "ymin", "xmax", "ymax"))

    @property
    def regions(self) -> DataFrame:
        """The rectangles as regions for spatial joins."""
        geom = geo.parts("wkt")
        return self.boxes.select(
            "region_id", "region_name", geo.edges(geom).alias("edges"), geo.bounds(geom).alias("box")
        )

    @property
    def wedges(self) -> DataFrame:
        """Right-angled triangles at the lower left corner of the rectangles, as regions."""
        text = F.format_string(
            "POLYGON((%d %d,%d %d,%d %d,%d %d))", "xmin", "ymin", "xmax", "ymin", "xmin", "ymax", "xmin", "ymin"
        )
        geom = geo.parts(text)
        return self.boxes.select(
            "region_id", "region_name", geo.edges(geom).alias("edges"), geo.bounds(geom).alias("box")
        )


def _position(key: str):
    return ((F.col(key) * 37) % 1000).alias("x"), ((F.col(key) * 91) % 1000).alias("y")
