"""Reading requests and dimensions, writing the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright import schemas
from screenwright.operators.audit import audit_id
from screenwright.operators.prepare import prepare_requests
from screenwright.plans.screening import Dimensions, Options
from screenwright.plans.screening import audit as audit_of


def read_prompts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Requests with a given schema: no inference pass, and fields a record lacks are null."""
    return spark.read.schema(schemas.PROMPTS).format(fmt).load(path)


def read_prompts_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PROMPTS).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


CORRUPT = "_corrupt_record"


def read_prompts_checked(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests as JSON lines, with ``_corrupt_record``: the line as it came where it is no JSON object of the schema.

    Nothing is dropped: fields that could be read have their value, the others are null.
    """
    reader = (spark.readStream if stream else spark.read).schema(f"{schemas.PROMPTS}, {CORRUPT} string")
    return reader.format("json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(path)


def write_checked(requests: DataFrame, path: str) -> None:
    """Write sound and malformed requests to two sides of one table, in one pass over the input; also per micro-batch."""
    requests.withColumn("malformed", F.col(CORRUPT).isNotNull()).write.mode("append").partitionBy("malformed").parquet(path)


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sound requests, and the malformed lines."""
    rows = spark.read.schema(f"{schemas.PROMPTS}, {CORRUPT} string, malformed boolean").parquet(path)
    return rows.where(~F.col("malformed")).drop(CORRUPT, "malformed"), rows.where("malformed").select(CORRUPT)


def read_dims(spark: SparkSession, path: str) -> Dimensions:
    """Users, organisations and policies from parquet tables below ``path``."""
    return Dimensions(
        users=spark.read.schema(schemas.USERS).parquet(f"{path}/users"),
        organizations=spark.read.schema(schemas.ORGANIZATIONS).parquet(f"{path}/organizations"),
        policies=spark.read.schema(schemas.POLICIES).parquet(f"{path}/policies"),
    )


def read_dims_jdbc(spark: SparkSession, url: str, **options: str) -> Dimensions:
    """The same from a database; needs its driver on the class path."""

    def table(name: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()

    return Dimensions(table("users"), table("organizations"), table("user_keyword_policies"))


def write_dims(dims: Dimensions, path: str, mode: str = "errorifexists") -> None:
    for name in ("users", "organizations", "policies"):
        getattr(dims, name).write.mode(mode).parquet(f"{path}/{name}")


def with_audit_date(audit: DataFrame) -> DataFrame:
    return audit.withColumn("audit_date", F.to_date("created_at"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def absent(rows: DataFrame, path: str) -> DataFrame:
    """Those of ``rows`` whose id the audit table does not hold on the same day.

    Of the table, only ids of days between the first and the last of ``rows`` are read; the two dates are all that is
    fetched. Nothing is joined where the table has no rows in that period.
    """
    spark = rows.sparkSession
    first, last = rows.agg(F.min("audit_date"), F.max("audit_date")).first()
    period = F.col("audit_date").isNull()
    if first is not None:
        period = period | F.col("audit_date").between(F.lit(first), F.lit(last))
    held = spark.read.schema("id string, audit_date date").parquet(path).where(period)
    if held.isEmpty():
        return rows
    held = held.select(F.col("id").alias("_id"), F.col("audit_date").alias("_date"))
    same = (F.col("id") == F.col("_id")) & F.col("audit_date").eqNullSafe(F.col("_date"))
    return rows.join(held, same, "left_anti")


def write_audit(audit: DataFrame, path: str, mode: str = "append", check: bool = True) -> None:
    """Append to the audit table, partitioned by day so that reports over a period read only its days.

    Rows are gathered by day, and adaptive execution splits large days, so a day gets few files. A row whose id the
    table already holds is left out, so that repeating a write adds nothing; ``check=False`` skips that comparison for
    rows known to be new. Rows that share an id within one write are all kept. A folder written by a file stream is
    refused, because its own log hides what others append.
    """
    spark = audit.sparkSession
    rows = with_audit_date(audit)
    if mode == "append" and exists(spark, path):
        if exists(spark, f"{path.rstrip('/')}/_spark_metadata"):
            raise ValueError(f"{path} belongs to a file stream; append to another folder")
        if check:
            rows = absent(rows, path)
    rows.hint("rebalance", "audit_date").write.mode(mode).partitionBy("audit_date").parquet(path)


def unwritten(requests: DataFrame, path: str, options: Options | None = None) -> DataFrame:
    """The requests whose audit row the table does not hold; those it holds need not be screened."""
    if not exists(requests.sparkSession, path):
        return requests
    columns = requests.columns
    whole = requests.withColumn("_request", F.struct(*columns))
    keyed = prepare_requests(whole, (options or Options()).aliases).select(
        audit_id().alias("id"), F.to_date("ts").alias("audit_date"), "_request")
    return absent(keyed, path).select("_request.*")


def append_screened(requests: DataFrame, dims: Dimensions, path: str, options: Options | None = None) -> None:
    """Screen requests and append their audit rows, but for those that the table holds.

    The same rows as of ``write_audit(audit(requests, dims, options), path)``, which would screen what it then leaves out: the
    id of an audit row is known before its request is screened.
    """
    write_audit(audit_of(unwritten(requests, path, options), dims, options), path, check=False)


def read_audit(spark: SparkSession, path: str, schema: str = schemas.AUDIT) -> DataFrame:
    """The audit table. Pass a schema where it was written with times that have no zone."""
    return spark.read.schema(f"{schema}, audit_date date").parquet(path)
