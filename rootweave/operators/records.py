"""Rule records of a domain: references into the vocabulary, and bounds of parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By record type, the JSON path of each reference, its field's name, and the kind of word it must be.
REFERENCES = {
    "propagation-template": [
        ("$.edgeType", "edgeType", "edge-type"),
        ("$.trigger.objectType", "trigger.objectType", "object-type"),
        ("$.effect.objectType", "effect.objectType", "object-type"),
        ("$.trigger.alarmType", "trigger.alarmType", "alarm-type"),
        ("$.effect.alarmType", "effect.alarmType", "alarm-type"),
    ],
    "fault-origin-type": [("$.objectType", "objectType", "object-type"), ("$.originAlarmType", "originAlarmType", "alarm-type")],
    "trail-policy": [("$.closureEdgeTypes", "closureEdgeTypes", "edge-type"), ("$.srlgRule.srlgEdgeType", "srlgRule.srlgEdgeType", "edge-type")],
}
PARAMS = "array<struct<key: string, value: string, min: double, max: double>>"


def reference(field: str, word: str) -> Callable[[Column], Column]:
    return lambda term: F.struct(F.lit(field).alias("field"), F.lit(word).alias("kind"), term.alias("term"))


def references(records: DataFrame) -> DataFrame:
    """domain, record_id, field, kind and term: every word that a record refers to; a list refers to each of its words."""
    listed = []
    for kind, paths in REFERENCES.items():
        for path, field, word in paths:
            text = F.get_json_object("payload", path)
            terms = F.coalesce(F.from_json(text, "array<string>"), F.array(text)) if field.endswith("EdgeTypes") else F.array(text)
            listed.append(F.when(F.col("record_type") == kind, F.transform(terms, reference(field, word))))
    none = F.array().cast("array<struct<field:string,kind:string,term:string>>")
    return records.select("domain", "record_id", F.explode(F.flatten(F.array(*[F.coalesce(x, none) for x in listed]))).alias("r")).select("domain", "record_id", "r.*").where("term is not null")


def violations(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """record_id, field and rule: references that the vocabulary (domain, kind, term) lacks, and numbers out of bounds.

    records: domain, record_type, record_id and payload (JSON text).
    """
    unknown = references(records).join(vocabulary, ["domain", "kind", "term"], "left_anti").select("record_id", "field", F.concat("kind", F.lit("-in-vocabulary")).alias("rule"))
    params = records.where("record_type = 'model-params'").select("record_id", F.explode(F.from_json(F.get_json_object("payload", "$.params"), PARAMS)).alias("p"))
    value = F.col("p.value").try_cast("double")
    bounds = params.where((value < F.col("p.min")) | (value > F.col("p.max"))).select("record_id", F.coalesce("p.key", F.lit("<unknown>")).alias("field"), F.lit("param-bounds").alias("rule"))
    return unknown.unionByName(bounds)
