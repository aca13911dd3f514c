"""Explicit schemas of the knowledge-base tables."""

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(),
    "strings": T.MapType(T.StringType(), T.StringType()), "floats": T.ArrayType(T.FloatType()),
}


def _struct(fields: str) -> T.StructType:
    """From ``name kind, ...``, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, fields.split(","))])


OBJECTS = _struct("bucket string, name string, generation long, metadata strings, content binary")
REGISTRY = _struct("id string, filename string, original_path string, processed_path string, generation long, created_at timestamp, status string, error_message string")
CHUNKS = _struct("doc_id string, chunk_index int, text string, embedding floats")
REJECTED = _struct("path string, generation long, reason string")
STATUS = _struct("task_id string, status string, error string, result string, ts timestamp, seq long")
COORDINATES = _struct("chunk_id long, x double, y double, z double")
PAGES = _struct("page int, header string, body string")
PAGE_ARRAY = T.ArrayType(PAGES)
CHATS = _struct("id string, title string, user_id string, created_at timestamp, updated_at timestamp")
MESSAGES = _struct("id string, chat_id string, text string, sender string, timestamp timestamp")
SITE_CONFIG = _struct("site string, rank int, tag string, attr string, value string")
