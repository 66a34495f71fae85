"""Layers of objects for views of a topology."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rootweave.functions.ids import object_type

# The layer of each object type; others are 'other'.
LAYERS = {"Site": "physical", "Node": "physical", "Port": "physical", "FiberSpan": "optical", "Interface": "ip", "IPLink": "ip", "IGPAdjacency": "ip", "LSP": "mpls", "Service": "service"}


def layer_of(kind: Column) -> Column:
    out = F.when(kind == next(iter(LAYERS)), LAYERS[next(iter(LAYERS))])
    for k, layer in list(LAYERS.items())[1:]:
        out = out.when(kind == k, layer)
    return out.otherwise("other")


def edge_layer(src: Column) -> Column:
    return layer_of(object_type(src))


def node_role(i: Column) -> Column:
    """Role of the i-th generated node: every seventh is an edge to customers, the one before it a border, the rest core."""
    return F.when(i % 7 == 6, "edge").when(i % 7 == 5, "border").otherwise("core")


def policy_attribute(key: Column, policy: dict[str, str]) -> Column:
    """What the policy names for a key; null for a key that it doesn't have."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in policy.items() for x in pair]), key)


def site_of(attributes: Column, name: Column) -> Column:
    """name, lat and lon of a site: the name or that in the attributes (JSON text); unreadable coordinates are null."""
    get = lambda k: F.get_json_object(attributes, f"$.{k}")
    return F.struct(F.coalesce(name, get("name")).alias("name"), get("latitude").try_cast("double").alias("lat"), get("longitude").try_cast("double").alias("lon"))
