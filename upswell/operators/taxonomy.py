"""Taxonomy projection (H2: S10, P6, J4).

A taxonomy is a lookup table ``(map_name, raw, value)``, read from a path, taken
from any DataFrame, or written out from a ``Taxonomy``. It is turned into one row
for each raw product and one for each raw issue, and joined to the rows by key:
a hash join whose side Catalyst and AQE broadcast only after checking its size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.functions.text import py_strip

MAP_NAMES = ("canonical_products", "product_line", "issue_risk_type", "canonical_issues")
LOOKUP_SCHEMA = T.StructType([T.StructField("map_name", T.StringType()),
                              T.StructField("raw", T.StringType()),
                              T.StructField("value", T.StringType())])
DEFAULT_KEY = "_default"


@dataclass(frozen=True)
class Taxonomy:
    """Four small maps and the defaults of two of them, as program values."""

    canonical_products: dict = field(default_factory=dict)
    product_line: dict = field(default_factory=dict)
    issue_risk_type: dict = field(default_factory=dict)
    canonical_issues: dict = field(default_factory=dict)
    default_line: str = "Other"
    default_risk: str = "other"

    def rows(self) -> list[tuple[str, str, str]]:
        entries = [(name, str(k), str(v)) for name in MAP_NAMES for k, v in getattr(self, name).items() if v is not None]
        return [*entries, ("product_line", DEFAULT_KEY, self.default_line), ("issue_risk_type", DEFAULT_KEY, self.default_risk)]

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), LOOKUP_SCHEMA)

    @staticmethod
    def from_mapping(m: dict) -> "Taxonomy":
        """From a parsed taxonomy document (the four maps, ``_default`` keys)."""
        maps = {name: {str(k): v for k, v in (m.get(name) or {}).items() if str(k) != DEFAULT_KEY} for name in MAP_NAMES}
        default = {name: (m.get(name) or {}).get(DEFAULT_KEY) for name in MAP_NAMES}
        return Taxonomy(**maps, default_line=default["product_line"] or "Other", default_risk=default["issue_risk_type"] or "other")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table from a path: CSV with a header, JSON lines, or Parquet (any other name)."""
    if path.endswith((".csv", ".csv.gz")):
        table = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        table = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return table.select(*[F.col(f.name).cast("string").alias(f.name) for f in LOOKUP_SCHEMA])


def taxonomy_key(col: Column) -> Column:
    """``str(raw).strip()`` with NULL -> ''."""
    return F.coalesce(py_strip(col.cast("string")), F.lit(""))


PRODUCT_MAPS = {"canonical_product": "canonical_products", "product_line": "product_line"}
ISSUE_MAPS = {"risk_type": "issue_risk_type", "canonical_issue": "canonical_issues"}


def _by_raw(taxonomy: Taxonomy | DataFrame, spark: SparkSession, key: str, maps: dict[str, str]) -> DataFrame:
    """One row for each raw value of the maps (column -> map), with a column for each.

    Of a Taxonomy it is a few literal rows; of a lookup table an aggregate, in
    which a raw value with two entries in a map is an error.
    """
    if isinstance(taxonomy, Taxonomy):
        held = [getattr(taxonomy, m) for m in maps.values()]
        rows = [(str(raw), *[m.get(raw) for m in held]) for raw in dict.fromkeys(k for m in held for k in m)]
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in [key, *maps]))
    wanted = F.col("map_name").isin(*maps.values()) & (F.col("raw") != DEFAULT_KEY) & F.col("value").isNotNull()

    def only(name: str) -> Column:
        mine = F.when(F.col("map_name") == name, F.col("value"))
        twice = F.raise_error(F.concat(F.lit(f"taxonomy map {name} has several entries for "), F.col("raw")))
        return F.when(F.count(mine) > 1, twice).otherwise(F.max(mine))

    return taxonomy.where(wanted).groupBy("raw").agg(*[only(m).alias(c) for c, m in maps.items()]).withColumnRenamed("raw", key)


def _default(taxonomy: Taxonomy | DataFrame, name: str, otherwise: str) -> Column:
    if isinstance(taxonomy, Taxonomy):
        return F.lit({"product_line": taxonomy.default_line, "issue_risk_type": taxonomy.default_risk}[name])
    rows = taxonomy.where((F.col("map_name") == name) & (F.col("raw") == DEFAULT_KEY))
    return F.coalesce(rows.agg(F.max("value")).scalar(), F.lit(otherwise))


def apply_taxonomy(df: DataFrame, taxonomy: Taxonomy | DataFrame) -> DataFrame:
    """Add canonical_product, product_line (from ``product``) and risk_type,
    canonical_issue (from ``issue``), in place of columns of these names.

    ``taxonomy`` is a Taxonomy or a lookup table of any size; both are joined by
    the raw value. Keys are trimmed and case-sensitive; an unmapped product is
    'Other', an unmapped issue label its trimmed raw text.
    """
    spark, new = df.sparkSession, {}
    kept = [c for c in df.columns if c not in (*PRODUCT_MAPS, *ISSUE_MAPS)]
    out = df.select(*[F.col(f"`{c}`") for c in kept])
    if "product" in df.columns:
        out = out.withColumn("_product_key", taxonomy_key(F.col("product")))
        out = out.join(_by_raw(taxonomy, spark, "_product_key", PRODUCT_MAPS), "_product_key", "left")
        new |= {"canonical_product": F.coalesce("canonical_product", F.lit("Other")),
                "product_line": F.coalesce(F.col("product_line"), _default(taxonomy, "product_line", "Other"))}
    if "issue" in df.columns:
        out = out.withColumn("_issue_key", taxonomy_key(F.col("issue")))
        out = out.join(_by_raw(taxonomy, spark, "_issue_key", ISSUE_MAPS), "_issue_key", "left")
        new |= {"risk_type": F.coalesce(F.col("risk_type"), _default(taxonomy, "issue_risk_type", "other")),
                "canonical_issue": F.coalesce("canonical_issue", "_issue_key")}
    return out.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in new.items()])


# The complaint taxonomy (raw product / issue -> reporting values).
COMPLAINT_TAXONOMY = Taxonomy(
    canonical_products={
        "Checking or savings account": "Consumer Banking",
        "Bank account or service": "Consumer Banking",
        "Money transfer, virtual currency, or money service": "Consumer Banking",
        "Money transfers": "Consumer Banking",
        "Credit card": "Credit Card",
        "Credit card or prepaid card": "Credit Card",
        "Prepaid card": "Credit Card",
        "Mortgage": "Mortgage",
        "Vehicle loan or lease": "Auto",
        "Consumer Loan": "Personal Lending",
        "Student loan": "Personal Lending",
        "Payday loan, title loan, or personal loan": "Personal Lending",
        "Payday loan, title loan, personal loan, or advance loan": "Personal Lending",
        "Payday loan": "Personal Lending",
        "Debt or credit management": "Personal Lending",
        "Debt collection": "Debt Collection",
        "Credit reporting or other personal consumer reports": "Credit Reporting & Disputes",
        "Credit reporting, credit repair services, or other personal consumer reports": "Credit Reporting & Disputes",
        "Credit reporting": "Credit Reporting & Disputes",
        "Other financial service": "Other",
    },
    product_line={
        "Checking or savings account": "Deposits",
        "Bank account or service": "Deposits",
        "Money transfer, virtual currency, or money service": "Payments / money movement",
        "Money transfers": "Payments / money movement",
        "Credit card": "Card lending",
        "Credit card or prepaid card": "Card lending",
        "Prepaid card": "Prepaid",
        "Mortgage": "Mortgage",
        "Vehicle loan or lease": "Auto",
        "Consumer Loan": "Personal loans",
        "Student loan": "Student lending",
        "Payday loan, title loan, or personal loan": "Personal / title / payday",
        "Payday loan, title loan, personal loan, or advance loan": "Personal / title / payday",
        "Payday loan": "Payday",
        "Debt or credit management": "Debt management",
        "Debt collection": "Debt collection",
        "Credit reporting or other personal consumer reports": "Credit reporting",
        "Credit reporting, credit repair services, or other personal consumer reports": "Credit reporting",
        "Credit reporting": "Credit reporting",
        "Other financial service": "Other",
    },
    issue_risk_type={
        "Incorrect information on your report": "operational",
        "Problem with a company's investigation into an existing problem": "operational",
        "Problem with a credit reporting company's investigation into an existing problem": "operational",
        "Problem with a lender or other company charging your account": "operational",
        "Loan modification,collection,foreclosure": "operational",
        "Account opening, closing, or management": "operational",
        "Deposits and withdrawals": "operational",
        "Problem when making payments": "operational",
        "Trouble during payment process": "operational",
        "Money was not available when promised": "operational",
        "Problem caused by your funds being low": "operational",
        "Problems caused by my funds being low": "operational",
        "Managing an account": "operational",
        "Managing the loan or lease": "operational",
        "Closing an account": "operational",
        "Opening an account": "operational",
        "Applying for a mortgage or refinancing an existing mortgage": "operational",
        "Application, originator, mortgage broker": "operational",
        "Closing on a mortgage": "operational",
        "Repossession": "operational",
        "Took or threatened to take negative or legal action": "operational",
        "Attempts to collect debt not owed": "operational",
        "Improper use of your report": "operational",
        "Problem with fraud alerts or security freezes": "operational",
        "Written notification about debt": "operational",
        "Communication tactics": "operational",
        "Threatened to contact someone or share information improperly": "operational",
        "Other transaction problem": "operational",
        "Fees or interest": "pricing_dispute",
        "Unexpected or other fees": "pricing_dispute",
        "Problem with a purchase shown on your statement": "pricing_dispute",
        "Other features, terms, or problems": "pricing_dispute",
        "Getting a credit card": "pricing_dispute",
        "Struggling to pay your bill": "pricing_dispute",
        "Struggling to pay mortgage": "pricing_dispute",
        "Confusing or misleading advertising or marketing": "pricing_dispute",
        "Dealing with your lender or servicer": "service",
        "Loan servicing, payments, escrow account": "service",
        "Fraud or scam": "fraud",
        "Lost or stolen money order": "fraud",
        "Lost or stolen check": "fraud",
    },
    canonical_issues={
        "Loan modification,collection,foreclosure": "Loan mod / foreclosure",
        "Managing an account": "Account management",
        "Incorrect information on your report": "Incorrect credit report",
        "Loan servicing, payments, escrow account": "Servicing / escrow",
        "Trouble during payment process": "Payment process",
        "Struggling to pay mortgage": "Struggling to pay mortgage",
        "Account opening, closing, or management": "Account open/close",
        "Problem with a lender or other company charging your account": "Unauthorized charges",
        "Improper use of your report": "Improper use of report",
        "Problem caused by your funds being low": "Low funds / overdraft",
        "Fraud or scam": "Fraud or scam",
        "Problem with a purchase shown on your statement": "Purchase on statement",
        "Deposits and withdrawals": "Deposits / withdrawals",
        "Closing an account": "Closing account",
        "Opening an account": "Opening account",
        "Managing the loan or lease": "Managing loan/lease",
        "Applying for a mortgage or refinancing an existing mortgage": "Mortgage application",
        "Application, originator, mortgage broker": "Application / broker",
        "Attempts to collect debt not owed": "Debt not owed",
        "Problem with a credit reporting company's investigation into an existing problem": "CR investigation",
        "Getting a credit card": "Getting credit card",
        "Problems caused by my funds being low": "Low funds",
        "Other features, terms, or problems": "Other terms/problems",
        "Problem with a company's investigation into an existing problem": "Company investigation",
        "Took or threatened to take negative or legal action": "Negative/legal action",
    },
    default_line="Other",
    default_risk="other",
)

# Systemic weight per risk type (unknown types weigh 0.1).
RISK_TYPE_WEIGHTS = {"operational": 0.5, "service": 0.2, "fraud": 0.3, "pricing_dispute": 0.0, "other": 0.1}
DEFAULT_RISK_WEIGHT = 0.1
