"""JSON artifacts and catalogs, read strictly: a schema, FAILFAST, and required fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import camel, is_iso_date, is_sha256, is_web_url, venue_key

LOC = "struct<part_order:int,part_ix:int,section_ix:int,table_ix:int,row_ix:int,cell_ix:int,para_ix:int,run_ix:int,rel:string>"
SCHEMAS = {
    "rules": "package_id string, revision int, rule_id string, target string, property string, expected string, severity string, repair_level string, confidence decimal(3,2), enabled boolean, needs_confirmation boolean, evidence string",
    "classification": f"doc_id bigint, element_id string, loc {LOC}, path string, kind string, confidence decimal(3,2), status string, text_length int, style_id string",
    "report": f"doc_id bigint, issue_id string, rule_id string, target string, property string, severity string, repair_level string, loc {LOC}, path string, current string, expected string, confidence decimal(5,4), auto_fixable boolean",
    "proposal": "doc_id bigint, group_id string, decision string, risk string, confidence decimal(5,4), depends_on array<string>, rollback string, source_sha256 string",
    "plan": "doc_id bigint, report_id string, directive_id string, group_id string, rule_id string, decision string, risk string, confidence decimal(5,4), level string, requires_confirmation boolean, issue_ids array<string>, depends_on array<string>, source_sha256 string",
}
REQUIRED = {
    "rules": ["package_id", "rule_id", "target", "property", "expected", "severity", "repair_level"], "classification": ["doc_id", "element_id", "kind", "status"], "report": ["doc_id", "issue_id", "rule_id", "severity", "expected"],
    "proposal": ["doc_id", "group_id", "decision", "risk", "confidence", "source_sha256"], "plan": ["doc_id", "directive_id", "group_id", "decision", "level", "source_sha256"],
}


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, whose reading fails on a null in columns."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is required")).cast(df.schema[c].dataType)))
    return df


def read_artifact(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """JSON lines of one kind of artifact; names in camel case, as they are written, or as columns are called."""
    fields = spark.createDataFrame([], SCHEMAS[kind]).schema.fields
    both = ", ".join(dict.fromkeys(f"{name} {f.dataType.simpleString()}" for f in fields for name in (f.name, camel(f.name))))
    rows = spark.read.schema(both).option("mode", "FAILFAST").json(path)
    df = required(rows.select(*[(F.coalesce(f.name, camel(f.name)) if camel(f.name) != f.name else F.col(f.name)).alias(f.name) for f in fields]), REQUIRED[kind])
    if "source_sha256" in df.columns:
        bad = F.raise_error(F.concat(F.lit("not a SHA-256: "), "source_sha256")).cast("string")
        df = df.withColumn("source_sha256", F.when(is_sha256(F.col("source_sha256")), F.col("source_sha256")).otherwise(bad))
    return df


def read_venues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, family) of all names of a venue catalog, and (family, display_name). A name that two families claim is an error
    when the result is read."""
    schema = "schemaVersion string, families array<struct<id:string,displayName:string,aliases:array<string>>>"
    families = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("families").alias("f")).select("f.*")
    names = families.select(F.col("id").alias("family"), F.explode(F.concat(F.array("id", "displayName"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keys = names.select(venue_key(F.col("name")).alias("key"), "family").distinct()
    owners = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("family").alias("family"))
    problem = F.when(F.col("key") == "", "empty alias").when(F.col("n") > 1, F.concat(F.lit("duplicate alias: "), "key"))
    return owners.select(F.when(problem.isNull(), F.col("key")).otherwise(F.raise_error(problem).cast("string")).alias("key"), "family"), families.select(F.col("id").alias("family"), F.col("displayName").alias("display_name"))


def read_templates(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The template registry joined with its files (name, sha256, is_package), with errors: all that is wrong with an entry."""
    schema = """schemaVersion string, templates array<struct<id:string,displayName:string,format:string,rulePolicy:string,
        identity:struct<venue:string,publisherOrSociety:string,yearOrVolume:string,trackOrArticleType:string,submissionStage:string,templateVersion:string>,
        artifact:struct<path:string,sha256:string>,provenance:struct<kind:string,originalFileName:string,sourceUrl:string,receivedOrRetrieved:string>,
        governance:struct<status:string,selectionMode:string,distributionScope:string,licenseStatus:string,requiresOnlineFreshnessCheck:boolean>>>"""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("templates").alias("t")).select("t.*")
    rows = rows.join(files.select(F.col("name").alias("_file"), F.col("sha256").alias("_sha"), "is_package"), F.col("artifact.path") == F.col("_file"), "left")
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("_twice"))
    rows = rows.join(twice, "id", "left")
    extension = F.regexp_extract("artifact.path", r"\.([^.]+)$", 1)
    blank = F.lit(False)
    for f in ("venue", "publisherOrSociety", "yearOrVolume", "trackOrArticleType", "submissionStage", "templateVersion"):
        blank = blank | (F.trim(F.coalesce(F.col(f"identity.{f}"), F.lit(""))) == "")
    no = F.lit(False)
    tests = [
        (~F.coalesce(F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), no), "id"), (F.coalesce("_twice", no), "duplicate_id"), (blank, "identity"), (~F.coalesce(F.col("format").isin("docx", "dotx", "latex-zip"), no), "format"),
        (F.coalesce(F.col("rulePolicy") != "derive-at-runtime", F.lit(True)), "rule_policy"), (~is_sha256(F.col("artifact.sha256")), "sha256"), (F.col("_file").isNull(), "missing_file"), (F.coalesce(F.col("_sha") != F.col("artifact.sha256"), no), "hash_mismatch"),
        (F.coalesce(F.lower(extension) != F.when(F.col("format") == "latex-zip", "zip").otherwise(F.col("format")), no), "extension"), (~F.coalesce("is_package", F.lit(True)), "not_a_package"), (F.col("artifact.path").rlike(r"(^/|(^|/)\.\.(/|$))"), "path_escapes"),
        (~F.coalesce(F.col("provenance.kind").isin("official-download", "user-supplied", "publisher-package", "project-generated"), no), "provenance"), (~is_web_url(F.col("provenance.sourceUrl")), "source_url"), (~is_iso_date(F.col("provenance.receivedOrRetrieved")), "date"),
        (~F.coalesce(F.col("governance.status").isin("validated", "superseded", "disabled"), no), "status"), (~F.coalesce(F.col("governance.selectionMode").isin("exact-identity", "explicit-only"), no), "selection_mode"),
    ]
    errors = F.filter(F.array(*[F.when(c, name) for c, name in tests]), lambda x: x.isNotNull())
    return rows.select(
        F.col("id").alias("template_id"), "format", F.col("identity.venue").alias("venue"), F.col("identity.publisherOrSociety").alias("publisher"), F.col("identity.yearOrVolume").alias("year"), F.col("identity.trackOrArticleType").alias("track"),
        F.col("identity.submissionStage").alias("stage"), F.col("identity.templateVersion").alias("template_version"), F.col("governance.status").alias("status"), F.col("governance.selectionMode").alias("selection_mode"), errors.alias("errors"),
    )
