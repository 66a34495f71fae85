"""Identifiers: typed object ids, trail and incident fingerprints, edge ids, name-based pattern ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a typed object id, and the namespace for name-based ids (the public DNS namespace).
OBJECT_ID = r"^[A-Za-z][A-Za-z0-9]*:[^:]+\z"
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
FIELD = "\u001f"


def is_object_id(moid: Column) -> Column:
    """Whether the id is a type, a colon and a key; null is not."""
    return F.coalesce(moid.rlike(OBJECT_ID), F.lit(False))


def object_type(moid: Column) -> Column:
    """What stands before the first colon."""
    return F.split_part(moid, F.lit(":"), F.lit(1))


def trail_id(domain: Column, snapshot: Column, members: Column) -> Column:
    """'trail-' and 24 hex digits of SHA-256 over domain, snapshot and sorted members."""
    return F.concat(F.lit("trail-"), F.substring(F.sha2(F.concat_ws("|", domain, snapshot, F.array_sort(members)), 256), 1, 24))


def incident_id(trail: Column, source: Column, alarms: Column) -> Column:
    """One id for a trail, a pattern or scenario, and a set of alarms."""
    return F.sha2(F.concat_ws("|", trail, source, F.concat_ws("|", F.array_sort(alarms))), 256)


def edge_id(snapshot: Column, src: Column, relation: Column, dst: Column) -> Column:
    """Reversible URL-safe id of an edge."""
    text = F.concat_ws(FIELD, snapshot, src, relation, dst)
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def edge_parts(edge: Column) -> Column:
    """snapshot, src, relation and dst of an edge id as a struct; null if it is malformed."""
    plain = F.translate(edge, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    fields = F.split(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), FIELD)
    return F.when(F.size(fields) == 4, F.struct(*[F.get(fields, i).alias(n) for i, n in enumerate(("snapshot", "src", "relation", "dst"))]))


def edge_rank(src: Column, relation: Column, dst: Column) -> Column:
    """Deterministic non-negative rank."""
    return F.xxhash64(src, relation, dst).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def name_uuid(name: Column) -> Column:
    """UUID version 5 of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substr(variant, nibble % 4 + 1, F.lit(1)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that only seed and keys decide, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def bell(seed: int, *keys: Column) -> Column:
    """A standard normal number that only seed and keys decide."""
    a, b = uniform(seed, *keys, F.lit("a")), uniform(seed, *keys, F.lit("b"))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)


def pick(choices: Column, share: Column) -> Column:
    """The choice at a share in [0, 1) of an array."""
    return F.get(choices, F.floor(share * F.size(choices)).cast("int"))


def weighted_pick(choices: list[tuple[str, float]], share: Column) -> Column:
    """The choice whose span of cumulative weight holds the share. Negative weights are 0; all zero is uniform."""
    weights = [max(0.0, w) for _, w in choices]
    if not sum(weights):
        weights = [1.0] * len(choices)
    total, below, chosen = sum(weights), 0.0, None
    for (name, _), w in zip(choices, weights, strict=True):
        below += w / total
        chosen = F.when(share < below, name) if chosen is None else chosen.when(share < below, name)
    return chosen.otherwise(choices[-1][0])


def default_if_blank(text: Column, default: str) -> Column:
    return F.when(F.trim(text) != "", text).otherwise(F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
