"""The fleet's row types. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_KINDS = {"str": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "bool": BooleanType()}


def row(**fields: str | DataType) -> StructType:
    return StructType([StructField(k, _KINDS[v] if isinstance(v, str) else v) for k, v in fields.items()])


CHUNK = row(index="int", peer_id="str", chunk_id="str")
LOCATION = row(peer_id="str", storage_tier="str", storage_path="str", file_size="long", is_chunked="bool", chunk_size="long", chunks=ArrayType(CHUNK))
REPLICAS = StructType([*row(file_path="str", seq="long").fields, *LOCATION.fields])
PEERS = row(
    id="str", address="str", grpc_address="str", nvme_path="str", available_space="long", used_space="long", status="str",
    network_speed_mbps="double", network_latency_ms="double", labels=MapType(StringType(), StringType()),
)
STATE = row(peers=MapType(StringType(), PEERS), files=MapType(StringType(), ArrayType(LOCATION)))
MANIFEST = row(file_path="str", size="long", is_chunked="bool", chunk_count="long")
BENCHMARK = row(run="long", commit="str", read_mbps="double", nvme_share_pct="double", peer_share_pct="double", cloud_share_pct="double")


def with_corrupt(kind: StructType) -> StructType:
    return StructType([*kind.fields, StructField("_corrupt_record", StringType())])
