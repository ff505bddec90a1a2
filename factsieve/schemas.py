"""Schemas of the tables that enter and leave the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


FACTS = _strings("fact_id", "fact_group_id", "entity", "entity_type", "attribute", "value", "text")

MESSAGE = _strings("role", "content")

METADATA = T.StructType(
    [
        T.StructField("fact_ids", T.ArrayType(_S)),
        T.StructField("fact_group_ids", T.ArrayType(_S)),
        T.StructField("source_type", _S),
        T.StructField("split", _S),
        T.StructField("entity", _S),
        T.StructField("entity_type", _S),
        T.StructField("attribute", _S),
        T.StructField("direction", _S),
        T.StructField("template", _S),
        T.StructField("mentioned_entities", T.ArrayType(_S)),
        T.StructField("cluster_axis", _S),
    ]
)

EXAMPLES = T.StructType(
    [T.StructField("record_id", _S), T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("metadata", METADATA)]
)

REQUESTS = _strings("request_id", "entity", "attribute")
REQUEST_FILE = T.StructType(
    [T.StructField("entity", _S), T.StructField("attribute", _S), T.StructField("_deprecated", _S)]
)

REVISIONS = T.StructType(
    [
        T.StructField("revision", _L),
        T.StructField("label", _S),
        T.StructField("parent_revision", _L),
        T.StructField("method", _S),
        T.StructField("entity", _S),
        T.StructField("attribute", _S),
        T.StructField("adapter_path", _S),
        T.StructField("base_model", _S),
        T.StructField("lora_config", _S),
        T.StructField("training_args", _S),
        T.StructField("dataset", _S),
        T.StructField("eval_accuracy", _D),
        T.StructField("forget_accuracy_before", _D),
        T.StructField("forget_accuracy_after", _D),
        T.StructField("early_stop_step", _L),
        T.StructField("created_at", T.TimestampType()),
    ]
)

REFERENCE_MODELS = T.StructType(
    [
        T.StructField("entity", _S),
        T.StructField("fact_group_id", _S),
        T.StructField("adapter_path", _S),
        T.StructField("excluded_example_counts_by_source_type", T.MapType(_S, _L)),
        T.StructField("created_at", T.TimestampType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("job_id", _S),
        T.StructField("job_type", _S),
        T.StructField("status", _S),
        T.StructField("request_id", _S),
        T.StructField("method", _S),
        T.StructField("parent_revision", _L),
        T.StructField("max_steps", _L),
        T.StructField("auto_verify", T.BooleanType()),
        T.StructField("revision", _L),
        T.StructField("error", _S),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("log_tail", T.ArrayType(_S)),
    ]
)
