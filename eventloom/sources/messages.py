"""Decoding of the message kinds; each result carries an ``error`` column, NULL when good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_fields as J
from ..functions.hashing import dedupe_key, inline_reference, sha256_hex
from ..functions.text import is_blank
from ..schemas import TARGET_OF_STREAM

PAYLOAD_AUDIT_STREAM = "proxy.payload_audit"
NOT_JSON = "message is not JSON"


def envelope_decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Generic envelope ``{table, data, origin, destination}`` -> columns plus ``error``."""
    v, members = F.col("_v"), J.Members()
    data = J.field(members, "data")
    table, origin, destination = (J.string_value(members, name) for name in ("table", "origin", "destination"))
    df = members.split(J.with_parsed(messages, F.col(value)), v)
    error = (
        F.when(v.isNull(), NOT_JSON)
        .when(~J.is_object(v), "envelope must be a JSON object")
        .when(table.isNull(), "envelope missing 'table' field")
        .when(data.isNull(), "envelope missing 'data' field")
        .when(origin.isNull(), "envelope missing 'origin' field")
        .when(destination.isNull(), "envelope missing 'destination' field")
        .when(~J.is_object(data), "envelope field 'data' must be a JSON object")
    )
    return df.select(
        *messages.columns,
        table.alias("table"),
        origin.alias("origin"),
        destination.alias("destination"),
        data.alias("data"),
        error.alias("error"),
    ).withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("table", "origin", "destination", "data")})


def load_decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Work item: six required strings, nullable ``batch_no``, ``attempt`` 0 when absent."""
    df = J.with_parsed(messages, F.col(value))
    v = F.col("_v")
    texts = ("job_id", "batch_id", "stream_name", "payload_ref", "cursor_start", "cursor_end")
    strings = {name: J.string_value(v, name) for name in texts}
    batch_no, attempt = (J.optional_long(v, name).try_cast("int") for name in ("batch_no", "attempt"))
    errors = [F.when(v.isNull(), F.lit(NOT_JSON))]
    errors += [F.when(J.not_string(v, n), F.lit(f"work item needs string '{n}'")) for n in texts]
    errors += [
        F.when(number.isNull() & (J.json_type(v, n) != "VOID"), F.lit(f"work item needs integer '{n}'"))
        for n, number in (("batch_no", batch_no), ("attempt", attempt))
    ]
    return df.select(
        *messages.columns,
        strings["job_id"].alias("job_id"),
        strings["batch_id"].alias("batch_id"),
        batch_no.alias("batch_no"),
        *[strings[n].alias(n) for n in texts[2:]],
        F.coalesce(attempt, F.lit(0)).alias("attempt"),
        J.first_error(errors).alias("error"),
    )


_AUDIT_TEXTS = ("host", "method", "path", "content_type", "peer_ip", "wg_pubkey", "device_id", "identity_source", "peer_hostname")


def audit_parse(messages: DataFrame, value: str = "value") -> DataFrame:
    """Payload-audit message. ``observed_at`` must be a string; any optional field of a wrong type fails it."""
    df = J.with_parsed(messages, F.col(value))
    v = F.col("_v")

    def wrong(name: str, ok: Column) -> Column:
        present = F.coalesce(J.json_type(v, name) != "VOID", F.lit(False))
        return F.when(present & ~F.coalesce(ok, F.lit(False)), F.lit(f"field '{name}' has the wrong type"))

    strings = {n: J.string_value(v, n) for n in ("observed_at", *_AUDIT_TEXTS)}
    keys = F.try_variant_get(v, "$.query_keys", "array<variant>")
    keys_ok = keys.isNotNull() & F.forall(keys, lambda k: F.schema_of_variant(k) == "STRING")
    size = J.optional_long(v, "body_bytes_original").try_cast("int")
    truncated = J.optional_boolean(v, "truncated")
    errors = [
        F.when(v.isNull(), F.lit(NOT_JSON)),
        F.when(strings["observed_at"].isNull(), F.lit("field 'observed_at' must be a string")),
        *[wrong(n, strings[n].isNotNull()) for n in ("host", "method", "path")],
        wrong("query_keys", keys_ok),
        wrong("body_bytes_original", size.isNotNull()),
        wrong("truncated", truncated.isNotNull()),
        *[wrong(n, strings[n].isNotNull()) for n in _AUDIT_TEXTS[3:]],
    ]
    return df.select(
        *messages.columns,
        strings["observed_at"].alias("observed_at"),
        *[strings[n].alias(n) for n in _AUDIT_TEXTS],
        F.when(keys_ok, F.try_variant_get(v, "$.query_keys", "array<string>")).alias("query_keys"),
        F.to_json(J.field(v, "body")).alias("body"),
        size.alias("body_bytes_original"),
        truncated.alias("truncated"),
        J.string_value(v, "type").alias("event_kind"),
        J.first_error(errors).alias("error"),
    )


def scan_requests(messages: DataFrame, value: str = "value", stream_name: str = PAYLOAD_AUDIT_STREAM) -> DataFrame:
    """Audit messages -> ledger requests ``(stream_name, dedupe_key, payload_ref, payload, ...)``.

    Empty messages are dropped; the others keep their ``error``.
    """
    text = F.col(value)
    parsed = audit_parse(messages.filter(F.coalesce(text != "", F.lit(False))), value)
    return parsed.select(
        *messages.columns,
        F.lit(stream_name).alias("stream_name"),
        dedupe_key(stream_name, text).alias("dedupe_key"),
        inline_reference(text).alias("payload_ref"),
        sha256_hex(text).alias("payload_sha256"),
        text.alias("payload"),
        F.col("observed_at").alias("observed_text"),
        "event_kind",
        "error",
    )


def request_json(requests: DataFrame) -> Column:
    """Text of the request message of a ledger request."""
    return F.to_json(F.struct("stream_name", "dedupe_key", "payload_ref", F.col("observed_text").alias("observed_at")))


def target_route(df: DataFrame, stream: str = "stream_name") -> DataFrame:
    """Add ``target``; an unknown stream gives NULL and a permanent ``route_error``."""
    lookup = F.create_map(*[F.lit(x) for pair in TARGET_OF_STREAM.items() for x in pair])
    target = F.try_element_at(lookup, F.col(stream))
    unknown = F.concat(F.lit("unsupported stream_name "), F.col(stream))
    return df.withColumns({"target": target, "route_error": F.when(target.isNull(), unknown)})


def validate_load(df: DataFrame) -> Column:
    """First message that explains why a work item cannot be handled, else NULL."""
    names = ("job_id", "batch_id", "stream_name", "payload_ref")
    return J.first_error([F.when(is_blank(F.col(n)), F.lit(f"{n} must not be empty")) for n in names])


def work_item_json(df: DataFrame) -> Column:
    """Work item text; ``batch_no`` is written even when it is null."""
    plain = F.struct(
        "job_id", "batch_id", "batch_no", "stream_name", "payload_ref", "cursor_start", "cursor_end", "attempt"
    )
    return F.to_json(plain, {"ignoreNullFields": "false"})
