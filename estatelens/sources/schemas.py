"""Explicit schemas of the inputs; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def strings(names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names.split(), S)


LIST = T.ArrayType(S)
PERSON = struct(name=S, email=S)
NODE = struct(**strings("id label norm_label repo source_file source_location"), community=L, **strings("file_type type _origin local_id"), metadata=struct(kind=S, tickets=LIST, service=S, environment=S, config=T.MapType(S, S)))
LINK = struct(**strings("source target relation confidence"), confidence_score=D, source_file=S, weight=D)
FILE = struct(path=S, additions=L, deletions=L, binary=B)
COMMIT = struct(
    **strings("repository repository_url sha short_sha"), parents=LIST, author_date=S, committer_date=S, author=PERSON, committer=PERSON, refs=LIST, subject=S, body=S, files=T.ArrayType(FILE), file_count=L, additions=L, deletions=L, is_merge=B
)
