"""The four relational tables, and the views that derive them from the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.session import spread

ADMISSIONS = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("admittime", T.TimestampNTZType()),
])
DIAGNOSES = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("icd9_code", T.StringType()),
])
CODE_DICTIONARY = T.StructType([T.StructField("icd9_code", T.StringType())])
NOTES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("chartdate", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("iserror", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


@dataclass(frozen=True)
class Tables:
    """The relational inputs of every cohort query."""

    admissions: DataFrame
    diagnoses: DataFrame
    dictionary: DataFrame
    notes: DataFrame
    code_order: tuple[str, ...] = ("seq_num",)


def load_clinical_tables(spark: SparkSession, directory: str) -> Tables:
    """The four tables as Parquet in one folder, under their own names."""
    def read(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")

    return Tables(
        read("admissions", ADMISSIONS),
        read("diagnoses_icd", DIAGNOSES),
        read("d_icd_diagnoses", CODE_DICTIONARY),
        read("noteevents", NOTES),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The four tables derived from orders, lineitem, part and documents."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    documents = spread(read_table(spark, sf_dir, "documents"), "doc_id")

    admissions = orders.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
    )
    code = F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("icd9_code")
    diagnoses = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("seq_num"),
            code,
            F.col("l_partkey").alias("tie1"),
            F.col("l_suppkey").alias("tie2"),
        )
    )
    dictionary = part.filter(F.col("p_size") != 50).select(code).distinct()

    day = F.col("o_orderdate").cast("date")
    later = F.date_add(day, (F.col("doc_id") % 9).cast("int"))
    notes = documents.join(orders, F.floor(F.col("doc_id") / 2).cast("bigint") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("doc_id") % 50 != 49, F.col("o_custkey")).alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.date_add(day, (F.col("doc_id") % 3).cast("int")).alias("chartdate"),
        F.when(F.col("doc_id") % 4 == 3, "Nursing").otherwise("Discharge summary").alias("category"),
        F.when(F.col("doc_id") % 10 == 9, 1).alias("iserror"),
        F.concat(
            F.lit("Admission Date:  [**"), day.cast("string"),
            F.lit("**]  Discharge Date:  [**"), later.cast("string"),
            F.lit("**] sex: m\n"), F.col("text"),
        ).alias("text"),
    )
    return Tables(admissions, diagnoses, dictionary, notes, code_order=("seq_num", "tie1", "tie2"))


# The same views as a list of common table expressions, for the SQL twins.
ADAPTER_SQL = """
admissions as (
  select o_custkey as subject_id, o_orderkey as hadm_id, o_orderdate as admittime from orders),
diagnoses_icd as (
  select o.o_custkey as subject_id, l.l_orderkey as hadm_id, l.l_linenumber as seq_num,
         concat(p.p_brand, '.', cast(p.p_size as varchar(10))) as icd9_code,
         l.l_partkey as tie1, l.l_suppkey as tie2
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey),
d_icd_diagnoses as (
  select distinct concat(p_brand, '.', cast(p_size as varchar(10))) as icd9_code from part where p_size <> 50),
noteevents as (
  select d.doc_id as row_id,
         case when d.doc_id % 50 = 49 then null else o.o_custkey end as subject_id,
         o.o_orderkey as hadm_id,
         cast(o.o_orderdate as date) + cast(d.doc_id % 3 as int) as chartdate,
         case when d.doc_id % 4 = 3 then 'Nursing' else 'Discharge summary' end as category,
         case when d.doc_id % 10 = 9 then 1 end as iserror,
         concat('Admission Date:  [**', cast(cast(o.o_orderdate as date) as varchar),
                '**]  Discharge Date:  [**',
                cast(cast(o.o_orderdate as date) + cast(d.doc_id % 9 as int) as varchar),
                '**] sex: m', chr(10), d.text) as text
  from documents d join orders o on cast(floor(d.doc_id / 2) as bigint) = o.o_orderkey)
"""

# The code prefix the test cohort is built on.
TEST_PREFIX = "Brand#25"
