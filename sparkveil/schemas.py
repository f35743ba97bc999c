"""Fixed schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _B, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

SPAN = _struct(start=_I, end=_I, matched_text=_S, identifier_type=_S, confidence=_S)
DETECTION = _struct(entity_type=_S, start=_I, end=_I, score=T.DoubleType())
ITEM = _struct(start=_I, end=_I, entity_type=_S, text=_S, operator=_S)
ENGINE_RESULT = _struct(text=_S, items=T.ArrayType(ITEM))
CONTEXT = _struct(
    operation=_S, tenant_id=_S, user_id=_S, correlation_id=_S, resource_type=_S, resource_id=_S, module_path=_S, file=_S, line=_I,
    contains_pii=_B, contains_phi=_B, security_relevant=_B, pii_types=T.ArrayType(_S),
)
AUDIT_EVENT = _struct(id=_S, timestamp=_TS, event_type=_S, severity=_S, message=_S, context=CONTEXT, metadata=T.MapType(_S, _S))
AUDIT_TABLE = _struct(
    id=_S, timestamp=_TS, event_type=_S, severity=_S, message=_S, operation=_S, tenant_id=_S, user_id=_S, correlation_id=_S, resource_type=_S,
    resource_id=_S, module_path=_S, file=_S, line=_I, contains_pii=_B, contains_phi=_B, security_relevant=_B, metadata=_S, created_at=_TS,
)
METRIC = _struct(name=_S, kind=_S, value=T.DoubleType(), ts=_TS)
THRESHOLD = _struct(metric_name=_S, warning=T.DoubleType(), critical=T.DoubleType(), comparison=_S, cooldown_s=_I, emit_recovery=_B)
VAULT = _struct(session_id=_S, entity_type=_S, original=_S, token=_S)

#: Confidence labels by rank; compare ranks, never labels.
CONFIDENCE = ("low", "medium", "high")
#: Severities by rank.
SEVERITY = ("debug", "info", "warning", "error", "critical")
