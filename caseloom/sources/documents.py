"""Typed JSON sources: document batches, evaluation cases, deploys, configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.patterns import first_of, strip
from caseloom.session import cut_lineage


BATCH_SCHEMA = f"{schemas.NORMALIZED_DOCUMENT}, {schemas.MALFORMED} string"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Documents of JSON lines (value), of a table or a stream; blank lines are skipped.

    A line that is no JSON object, or has a field of another type, fails nothing:
    it comes as a row whose ``malformed`` holds the line, for the quarantine.
    Lines are parsed as a whole, whichever columns are read: a JSON source would
    only look at the fields of a query, and find a line broken in one and not in
    another.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.MALFORMED}
    read = F.from_json("value", BATCH_SCHEMA, options)
    return lines.where(strip("value") != "").select(read.alias("d")).select("d.*")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Normalised documents from JSON lines with the declared schema."""
    return parsed_lines(spark.read.text(path))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines are skipped.

    Both dialects are read: ``must_not_claim`` stands in for the forbidden
    terms and ``expected_root_cause`` is kept for reference.
    """
    raw = spark.read.schema(schemas.EVAL_CASE).json(path)
    return raw.where(F.col("id").isNotNull() | F.col("question").isNotNull()).select(
        F.col("id").alias("case_id"), "question", "query_class", "expected_documents",
        "expected_terms", "forbidden_terms", "expected_source_types", "forbidden_source_types",
        "expected_root_cause", "must_not_claim",
    )


def structured_status(content: str = "content", path: str = "path"):
    """How a structured file parses: object, array, scalar, invalid or other format."""
    shape = F.schema_of_variant(F.try_parse_json(F.col(content)))
    return first_of(
        [
            (~F.lower(path).endswith(".json"), "other_format"),
            (shape.isNull(), "invalid"),
            (shape.startswith("OBJECT"), "object"),
            (shape.startswith("ARRAY"), "array"),
        ],
        "scalar",
    )


def config_violations(configs: DataFrame, key: str, config: str) -> DataFrame:
    """Credential-like keys and secret-like values in JSON configs, by dotted path.

    The document is walked level by level with ``variant_explode`` until a level
    is empty, however deep it nests; a branch ends at a leaf or at a
    credential-like key, whose value is not looked into. Each level is written
    once, so the input is read once and plans stay short.
    """
    from caseloom import vocab
    from caseloom.functions.patterns import alternation

    secret_value = "|".join(f"(?:{p})" for p in vocab.SECRET_VALUE_PATTERNS)
    secret_key = alternation(vocab.CREDENTIAL_TOKENS)
    level = configs.select(
        F.col(key), F.lit("").alias("at"), F.try_parse_json(F.col(config)).alias("v")
    )
    found: list[DataFrame] = []
    while True:
        rows = level.sparkSession.sql(
            "SELECT t.*, e.pos, e.key AS k, e.value AS child "
            "FROM {level} t, LATERAL variant_explode(t.v) AS e",
            level=level,
        )
        step = F.coalesce("k", F.col("pos").cast("string"))
        normal = F.replace(F.lower("k"), F.lit("-"), F.lit("_"))
        credential = F.coalesce(
            ~normal.isin(*vocab.ALLOWED_CREDENTIAL_KEYS) & normal.rlike(secret_key), F.lit(False)
        )
        walked = rows.select(
            key,
            F.when(F.col("at") == "", step).otherwise(F.concat_ws(".", "at", step)).alias("at"),
            F.col("child").alias("v"), credential.alias("credential"),
        )
        walked = cut_lineage(walked)
        leaf = F.try_variant_get("v", "$", "string")
        text_leaf = F.schema_of_variant("v") == "STRING"
        found.append(
            walked.where(F.col("credential")).select(
                key, F.concat("at", F.lit(" contains a credential-like key")).alias("violation")
            )
        )
        found.append(
            walked.where(~F.col("credential") & text_leaf & leaf.rlike(secret_value)).select(
                key, F.concat("at", F.lit(" contains secret-like value")).alias("violation")
            )
        )
        level = walked.where(
            ~F.col("credential")
            & (F.schema_of_variant("v").startswith("OBJECT") | F.schema_of_variant("v").startswith("ARRAY"))
        ).select(key, "at", "v")
        if level.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
