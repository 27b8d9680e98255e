"""The posting record shared by every job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.fixed_values import SOURCE_A

POSTING_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("posted_time", T.TimestampType()),
    T.StructField("seniority_level", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("job_function", T.StringType()),
    T.StructField("industries", T.StringType()),
    T.StructField("required_studies", T.StringType()),
    T.StructField("technologies_required", T.ArrayType(T.StringType())),
    T.StructField("experience_years_needed", T.IntegerType()),
    T.StructField("salary_offered", T.IntegerType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("title_lang", T.StringType()),
    T.StructField("description_lang", T.StringType()),
    T.StructField("date_analyzed", T.TimestampType()),
    T.StructField("easy_apply", T.StringType()),
    T.StructField("source", T.StringType()),
])

# Board B states a salary as text ("min - max type"); it sits beside the number.
SALARY_TEXT = T.StructField("salary_text", T.StringType())

STORED_SCHEMA = T.StructType(POSTING_SCHEMA.fields + [SALARY_TEXT])

POSTING_COLUMNS = POSTING_SCHEMA.fieldNames()

_DEFAULT_BY_NAME = {"easy_apply": "No", "source": SOURCE_A}


def default_for(field: T.StructField):
    """The value a posting has when a field was never filled, as a column."""
    if isinstance(field.dataType, T.TimestampType) or field.name == SALARY_TEXT.name:
        return F.lit(None).cast(field.dataType)
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    if isinstance(field.dataType, T.IntegerType):
        return F.lit(0)
    return F.lit(_DEFAULT_BY_NAME.get(field.name, ""))


def conform(df: DataFrame, beside: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Project to the stored columns in order; absent columns and nulls take defaults.

    Columns named in `beside` follow unchanged.
    """
    present = set(df.columns)

    def filled(field: T.StructField):
        if field.name not in present:
            return default_for(field)
        return F.coalesce(F.col(field.name).cast(field.dataType), default_for(field))

    return df.select(*[filled(f).alias(f.name) for f in STORED_SCHEMA.fields], *beside)
