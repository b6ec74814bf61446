"""Schemas of the logical tables and of an extraction file."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


PROPERTIES = _fields(chunk_ids=T.ArrayType(_S), stale=T.BooleanType())
CHUNKS = _fields(id=_S, content=_S, embedding=T.ArrayType(T.FloatType()), source_file=_S, line_start=T.IntegerType(), line_end=T.IntegerType(), chunk_type=_S, language=_S, project=_S, checksum=_S, indexed_at=_TS, metadata=_S)
ENTITIES = _fields(id=_S, name=_S, entity_type=_S, description=_S, project=_S, source_file=_S, properties=PROPERTIES, created_at=_TS, updated_at=_TS)
RELATIONS = _fields(id=_S, source_id=_S, target_id=_S, relation_type=_S, weight=_D, evidence=_S, metadata=_S)
OBSERVATIONS = _fields(id=_S, content=_S, embedding=T.ArrayType(T.FloatType()), obs_type=_S, source=_S, project=_S, tags=T.ArrayType(_S), confidence=_D, valid_from=_TS, valid_until=_TS, metadata=_S)
TABLES = {"chunks": CHUNKS, "entities": ENTITIES, "relations": RELATIONS, "observations": OBSERVATIONS}
FILE_EVENTS = _fields(path=_S, action=_S, ts=_TS, seq=T.LongType())
EXTRACTION = _fields(
    entities=T.ArrayType(_fields(name=_S, entity_type=_S, description=_S, source_file=_S, chunk_id=_S)),
    relations=T.ArrayType(_fields(source_name=_S, source_type=_S, target_name=_S, target_type=_S, relation_type=_S, evidence=_S)),
)
