"""File sources and sinks: CSV scan (S1), JSON records (S5, S6), CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.operators.ingest import normalize_columns
from upswell.sources.tables import path_exists

# Cell texts a default pandas CSV read turns into missing values.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Types a text column can have, narrowest first, and the texts of each; a text that fits must also parse.
TEXT_TYPES = (
    ("boolean", r"^(?i:true|false)$"),
    ("bigint", r"^[+-]?(?:0|[1-9]\d{0,18})$"),
    ("double", r"^[+-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d{1,3})?$|^[+-]?(?i:inf|infinity)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"),
)


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that holds every text of each text column, by one aggregate over all rows.

    Each task reduces its rows to a flag per column and type, so one row comes
    back however large the table is, and no sample decides. A number with
    leading zeros (a postal code) is text; whole numbers beyond 64 bits are doubles, and dates
    among timestamps are timestamps. A column with no value at all stays text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}

    def fits(name: str, kind: str, pattern: str):
        c = F.col(f"`{name}`")
        return F.bool_and(F.when(c.isNotNull(), c.rlike(pattern) & c.try_cast(kind).isNotNull()))

    found = df.agg(F.array(*[fits(c, *kind) for c in texts for kind in TEXT_TYPES]).alias("fits")).first()["fits"]
    kinds, n = {}, len(TEXT_TYPES)
    for i, c in enumerate(texts):
        kinds[c] = next((kind for (kind, _), ok in zip(TEXT_TYPES, found[i * n:(i + 1) * n]) if ok), "string")
    return kinds


def with_inferred_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the type that ``infer_types`` finds for them."""
    kinds = infer_types(df)
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


def read_complaints_csv(spark: SparkSession, path: str, normalize: bool = True, types: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header; narratives hold line breaks, so ``multiLine`` (each
    file is then one task: land it as Parquet once, then work from Parquet);
    files without line breaks inside a cell can be split with ``multi_line=False``.
    The missing-value tokens become NULL. Every column is read as text, and
    ``complaint_id`` becomes a number when it parses; ``types`` gives every
    column the type that all its texts have, for one more pass over the files."""
    df = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
          .option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    df = df.select(*[F.when(F.col(f"`{c}`").isin(*MISSING_TOKENS), F.lit(None).cast("string"))
                     .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if normalize:
        df = normalize_columns(df)
    if types:
        df = with_inferred_types(df)
    if "complaint_id" in df.columns:
        df = df.withColumn("complaint_id", F.col("complaint_id").try_cast("bigint"))
    return df


def write_records_json(records: DataFrame, path: str) -> None:
    """Records with the run timestamp (S5). Write each run to its own path."""
    records.withColumn("computed_at", F.current_timestamp()).write.mode("overwrite").json(path)


def read_previous_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The previous run's records, or None when there is no such run (S6). Records that exist and can't be read are an error."""
    if not path_exists(spark, path):
        return None
    r = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    return r if "product" in r.columns or "topic_id" in r.columns else None
