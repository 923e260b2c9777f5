"""MySQL dump files as typed tables.

Statements are read by their terminator, tuples and fields taken apart by quote-aware patterns whose
quantifiers never give back, so that long literals cost no stack. Values of the insert statements are
used by position; everything else in a dump is passed over. Gzipped dumps are read too (by one task,
then spread).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names and types by position, for the four tables.
SCHEMAS = {
    "page": [("page_id", "long"), ("ns", "int"), ("title", "string"), ("restrictions", "string"), ("counter", "long"), ("is_redirect", "int"), ("is_new", "int"), ("random", "double"), ("touched", "string"), ("latest", "long"), ("len", "long")],
    "redirect": [("rd_from", "long"), ("ns", "int"), ("title", "string"), ("interwiki", "string"), ("fragment", "string")],
    "pagelinks": [("pl_from", "long"), ("ns", "int"), ("title", "string")],
    "categorylinks": [("cl_from", "long"), ("cl_to", "string"), ("sortkey", "string"), ("changed", "string")],
}
QUOTED = r"'(?:[^'\\]++|\\.)*+'"
TUPLE = rf"(?s)\(((?:[^'()]++|{QUOTED})*+)\)"
FIELD = rf"(?s)({QUOTED}|[^,']++)"
LEAD = r"(?s)^(?:\s++|--[^\n]*+\n|/\*.*?\*/;?)*+"


def resolve(spark: SparkSession, path: str) -> str:
    """``path``, or ``path``.gz if only that exists; neither is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in (path, f"{path}.gz"):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(path)


def tuples(statements: DataFrame) -> DataFrame:
    """(fields: array of strings) for each tuple inserted by ``statements`` (value); NULL is null, escapes are undone."""
    body = F.regexp_replace("value", LEAD, "")
    inserts = statements.select(body.alias("s")).where(F.upper(F.substring("s", 1, 1)) == "I")
    # A column list before VALUES is passed over.
    values = F.regexp_replace("s", r"(?is)^insert\s[^'(]*?(?:\([^'()]*\)\s*)?values\s*", "")
    rows = inserts.select(F.explode(F.regexp_extract_all(values, F.lit(TUPLE), F.lit(1))).alias("t"))
    return rows.select(F.transform(F.regexp_extract_all("t", F.lit(FIELD), F.lit(1)), _literal).alias("fields"))


def _literal(raw: Column) -> Column:
    text = F.trim(raw)
    quoted = F.regexp_replace(F.substr(text, F.lit(2), F.length(text) - 2), r"(?s)\\(.)", "$1")
    return F.when(text.startswith("'"), quoted).when(F.upper(text) == "NULL", F.lit(None)).otherwise(text)


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the four tables from its dump. Tuples with fewer fields have nulls at the end."""
    at = resolve(spark, path)
    text = spark.read.text(at, lineSep=";\n")
    if at.endswith(".gz"):
        text = text.repartition(max(2, spark.sparkContext.defaultParallelism))
    cols = [F.try_element_at("fields", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(SCHEMAS[table])]
    return tuples(text).select(cols)


def read_wiki(spark: SparkSession, folder: str, prefix: str = ""):
    """The four tables of a folder of dumps named <prefix><table>.sql or .sql.gz."""
    from ..plans.build import Wiki

    return Wiki(*(read_dump(spark, f"{folder}/{prefix}{t}.sql", t) for t in ("page", "redirect", "pagelinks", "categorylinks")))
