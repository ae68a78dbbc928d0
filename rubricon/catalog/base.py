"""Registry, table access and the adapters that give the driver tables their roles.

Every adapter exists twice, as a DataFrame function and as the SQL of the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.operators.grouping import spread

# Tables whose rows get costly text or expression work.
_WORKED = ("documents", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Spaces as the engine's tokeniser sees them, in the SQL dialect.
SPACE_SQL = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent, if SQL can say it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


class Tables:
    """Driver tables and adapters of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in _WORKED else table

    def scores(self) -> DataFrame:
        """model, domain, workflow, question, score"""
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderpriority").alias("model"),
                F.col("c_mktsegment").alias("domain"),
                F.col("n_name").alias("workflow"),
                F.col("o_orderkey").alias("question"),
                F.col("o_totalprice").alias("score"),
            )
        )

    def models(self) -> list[str]:
        """The five models; the list is a fixed domain of the column."""
        return ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

    def criteria(self) -> DataFrame:
        """question, pos, tier, fact, met: one row per line item."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("question"),
            F.col("l_linenumber").alias("pos"),
            tier_of("l_returnflag").alias("tier"),
            fact_of_line().alias("fact"),
            (F.col("l_linestatus") == "F").alias("met"),
        )

    def questions(self) -> DataFrame:
        """question, model, category, hallucination: one row per order"""
        return self.orders.select(
            F.col("o_orderkey").alias("question"),
            F.col("o_orderpriority").alias("model"),
            category_of("o_orderpriority").alias("category"),
            (F.col("o_orderstatus") == "P").alias("hallucination"),
        )

    def verdicts(self) -> DataFrame:
        """criteria with model, category and hallucination of the question"""
        return self.criteria().join(self.questions(), "question")

    def facts(self) -> DataFrame:
        """question, category, model, pos, fact: one claim per order"""
        tenths = F.floor(F.round(F.col("o_totalprice") * 100) / 10000).cast("long")
        value = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        year = F.year("o_orderdate").cast("string")
        fact = (
            F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Revenue growth came from "), F.lower("c_mktsegment"), F.lit(" demand")))
            .when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$"), value, F.lit("M revenue in "), year))
            .otherwise(F.concat(F.lit("FY"), year, F.lit(" revenue was $"), value, F.lit("M")))
        )
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("n_name").alias("question"),
                category_of("o_orderpriority").alias("category"),
                F.col("o_orderpriority").alias("model"),
                F.col("o_orderkey").alias("pos"),
                fact.alias("fact"),
            )
        )

    def original(self) -> DataFrame:
        """question, tier, pos, fact: rubric before repair"""
        return self.lineitem.where(F.col("l_tax") > 0.01).select(
            F.col("l_orderkey").alias("question"),
            tier_of("l_returnflag").alias("tier"),
            F.col("l_linenumber").alias("pos"),
            fact_of_line().alias("fact"),
        )

    def repaired(self) -> DataFrame:
        """question, tier, pos, fact: rubric after repair"""
        tier = (
            F.when(F.col("l_linestatus") == "F", "critical")
            .when(F.col("l_quantity") > 25, "important")
            .otherwise("optional")
        )
        return self.lineitem.where(F.col("l_tax") < 0.07).select(
            F.col("l_orderkey").alias("question"),
            tier.alias("tier"),
            F.col("l_linenumber").alias("pos"),
            fact_of_line().alias("fact"),
        )

    def quality(self) -> DataFrame:
        """question, four scores, overall, issue_count, recommendation: one row per part"""
        size, price = F.col("p_size"), F.col("p_partkey")
        score = lambda c: F.round(F.lit(0.5) + c / 100.0, 2)
        return self.part.select(
            F.col("p_partkey").alias("question"),
            score(size % 51).alias("specificity"),
            score((price * 7) % 51).alias("atomicity"),
            F.when(price % 11 > 0, score((price * 3) % 51)).alias("tier_correctness"),
            score((price * 5 + size) % 51).alias("coverage"),
            F.when(price % 13 > 0, score((price * 11) % 51)).alias("overall"),
            (size % 3).cast("int").alias("issue_count"),
            F.element_at(
                F.array(F.lit("stop"), F.lit("enrich"), F.lit("repair"), F.lit(""), F.lit(None).cast("string")),
                (price % 5 + 1).cast("int"),
            ).alias("recommendation"),
        )

    def lines(self) -> DataFrame:
        """doc_id, block_idx, text: document lines, some led by a section line"""
        names = F.array(*[F.lit(s) for s in ("RISK FACTORS", "Business", "DILUTION", "LEGAL PROCEEDINGS")])
        rows = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "line"))
        headed = F.concat(F.element_at(names, ((F.col("doc_id") + F.col("block_idx")) % 4 + 1).cast("int")), F.lit("\n"), F.col("line"))
        return rows.select(
            "doc_id",
            "block_idx",
            F.when(F.col("block_idx") % 5 == 3, headed).otherwise(F.col("line")).alias("text"),
        )

    def filings(self) -> DataFrame:
        """doc_id, form_type, cik, filed_at, text"""
        return self.documents.select(
            "doc_id",
            F.upper("lang").alias("form_type"),
            F.lpad(F.regexp_extract("source", r"(\d+)", 1), 10, "0").alias("cik"),
            F.date_add(F.lit("2024-06-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("filed_at"),
            "text",
        )


def tier_of(column: str):
    c = F.col(column)
    return F.when(c == "A", "critical").when(c == "N", "important").otherwise("optional")


def category_of(column: str):
    c = F.left(F.col(column), F.lit(1))
    return (
        F.when(c == "1", "quantitative").when(c == "2", "disclosure").when(c == "3", "governance")
        .when(c == "4", "forensic").otherwise("modeling")
    )


def fact_of_line():
    return F.concat(
        F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" shipped "),
        F.col("l_quantity").cast("int").cast("string"), F.lit(" units"),
    )


SCORES = """scores AS (SELECT o_orderpriority AS model, c_mktsegment AS domain, n_name AS workflow,
  o_orderkey AS question, o_totalprice AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_TIER = "CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'important' ELSE 'optional' END"
CATEGORY = """CASE left(o_orderpriority, 1) WHEN '1' THEN 'quantitative' WHEN '2' THEN 'disclosure'
  WHEN '3' THEN 'governance' WHEN '4' THEN 'forensic' ELSE 'modeling' END"""
_FACT = "'Part ' || l_partkey || ' shipped ' || CAST(l_quantity AS INT) || ' units'"

CRITERIA = f"""criteria AS (SELECT l_orderkey AS question, l_linenumber AS pos, {_TIER} AS tier,
  {_FACT} AS fact, l_linestatus = 'F' AS met FROM lineitem)"""

VERDICTS = f"""{CRITERIA}, verdicts AS (SELECT c.*, o_orderpriority AS model, {CATEGORY} AS category,
  o_orderstatus = 'P' AS hallucination FROM criteria c JOIN orders ON o_orderkey = question)"""

WEIGHTS = """weights(category, w_c, w_i, w_o, w_h) AS (VALUES ('quantitative', 12.0::DOUBLE, 6.0::DOUBLE, 2.0::DOUBLE, -10.0::DOUBLE),
  ('disclosure', 10.0, 5.0, 2.0, -6.0), ('governance', 10.0, 5.0, 2.0, -6.0), ('forensic', 10.0, 5.0, 2.0, -8.0),
  ('modeling', 10.0, 5.0, 2.0, -8.0), ('comparative', 10.0, 5.0, 2.0, -6.0))"""

FACTS = f"""facts AS (SELECT n_name AS question, {CATEGORY} AS category, o_orderpriority AS model, o_orderkey AS pos,
  CASE WHEN o_orderstatus = 'P' THEN 'Revenue growth came from ' || lower(c_mktsegment) || ' demand'
       WHEN o_orderkey % 2 = 0 THEN '$' || (t // 10) || '.' || (t % 10) || 'M revenue in ' || y
       ELSE 'FY' || y || ' revenue was $' || (t // 10) || '.' || (t % 10) || 'M' END AS fact
  FROM (SELECT *, CAST(floor(round(o_totalprice * 100) / 10000) AS BIGINT) AS t, year(o_orderdate) AS y FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ORIGINAL = f"""original AS (SELECT l_orderkey AS question, {_TIER} AS tier, l_linenumber AS pos, {_FACT} AS fact
  FROM lineitem WHERE l_tax > 0.01)"""

REPAIRED = f"""repaired AS (SELECT l_orderkey AS question,
  CASE WHEN l_linestatus = 'F' THEN 'critical' WHEN l_quantity > 25 THEN 'important' ELSE 'optional' END AS tier,
  l_linenumber AS pos, {_FACT} AS fact FROM lineitem WHERE l_tax < 0.07)"""

QUALITY = """quality AS (SELECT p_partkey AS question,
  round(0.5 + (p_size % 51) / 100.0::DOUBLE, 2) AS specificity,
  round(0.5 + ((p_partkey * 7) % 51) / 100.0::DOUBLE, 2) AS atomicity,
  CASE WHEN p_partkey % 11 > 0 THEN round(0.5 + ((p_partkey * 3) % 51) / 100.0::DOUBLE, 2) END AS tier_correctness,
  round(0.5 + ((p_partkey * 5 + p_size) % 51) / 100.0::DOUBLE, 2) AS coverage,
  CASE WHEN p_partkey % 13 > 0 THEN round(0.5 + ((p_partkey * 11) % 51) / 100.0::DOUBLE, 2) END AS overall,
  p_size % 3 AS issue_count,
  CASE p_partkey % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'enrich' WHEN 2 THEN 'repair' WHEN 3 THEN '' END AS recommendation
  FROM part)"""

LINES = """lines AS (SELECT doc_id, block_idx, CASE WHEN block_idx % 5 = 3 THEN
  ['RISK FACTORS', 'Business', 'DILUTION', 'LEGAL PROCEEDINGS'][CAST((doc_id + block_idx) % 4 + 1 AS INT)] || chr(10) || line
  ELSE line END AS text
  FROM (SELECT doc_id, CAST(i AS INT) AS block_idx, parts[i + 1] AS line FROM
    (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(len(parts))) AS i)))"""

FILINGS = r"""filings AS (SELECT doc_id, upper(lang) AS form_type,
  lpad(regexp_extract(source, '(\d+)', 1), 10, '0') AS cik,
  CAST(DATE '2024-06-01' + CAST(doc_id % 900 AS INT) AS DATE) AS filed_at, text FROM documents)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
