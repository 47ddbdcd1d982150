"""The scalar helpers, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import json_fields as J
from ..functions import text as X
from ..functions import timestamps as TS
from .registry import query

# One JSON object per event whose field ``x`` takes every JSON type in turn.
_X = """CASE event_id % 12 WHEN 0 THEN '"text"' WHEN 1 THEN '""' WHEN 2 THEN '"12"' WHEN 3 THEN '7' WHEN 4 THEN '-3' WHEN 5 THEN '2.0'
  WHEN 6 THEN '1.5' WHEN 7 THEN 'true' WHEN 8 THEN 'false' WHEN 9 THEN 'null' WHEN 10 THEN '{"k":1}' ELSE '[1,"a"]' END"""
_OBJECT = f"""'{{"x":' || {_X} || ',"n":{{"x":' || {_X} || '}},"e":' || event_id || '}}'"""


def mixed(t):
    rows = t.events.select("event_id", F.expr(_OBJECT).alias("text"))
    return J.with_parsed(rows, F.col("text"), "row")


def _cases(values: dict[int, str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())
    return f"CASE event_id % 12 {arms} ELSE {otherwise} END"


_STRINGS = {0: "'text'", 1: "''", 2: "'12'"}
_LONGS = {2: "12", 3: "7", 4: "-3", 5: "2"}


@query("fn_required_string", f"""
SELECT event_id, {_cases(_STRINGS)} AS value, CASE WHEN event_id % 12 > 2 THEN 'Missing required string field ''x'' in test' END AS error FROM events""")
def _(t):
    value, error = J.required_string(F.col("row"), "x", "test")
    return mixed(t).select("event_id", value.alias("value"), error.alias("error"))


@query("fn_required_long", f"""
SELECT event_id, ({_cases(_LONGS)})::bigint AS value,
  CASE WHEN event_id % 12 NOT IN (2, 3, 4, 5) THEN 'Missing required long field ''x'' in test' END AS error FROM events""")
def _(t):
    value, error = J.required_long(F.col("row"), "x", "test")
    return mixed(t).select("event_id", value.alias("value"), error.alias("error"))


@query("fn_required_timestamp", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - to_seconds(5400) END AS value,
  CASE event_id % 4 WHEN 2 THEN 'Invalid timestamp ''' || replace(ts::varchar, ' ', 'T') || ''' for field ''at'' in test'
    WHEN 3 THEN 'Missing required timestamp field ''at'' in test' END AS error FROM events""")
def _(t):
    iso = "replace(cast(ts AS string), ' ', 'T')"
    text = f"""'{{"at":' || CASE event_id % 4 WHEN 0 THEN '"' || {iso} || 'Z"' WHEN 1 THEN '"' || {iso} || '+01:30"'
      WHEN 2 THEN '"' || {iso} || '"' ELSE '5' END || '}}'"""
    rows = J.with_parsed(t.events.select("event_id", F.expr(text).alias("text")), F.col("text"), "row")
    value, error = J.required_timestamp(F.col("row"), "at", "test")
    return rows.select("event_id", value.alias("value"), error.alias("error"))


@query("fn_optional_string", f"SELECT event_id, {_cases({0: chr(39) + 'text' + chr(39), 2: chr(39) + '12' + chr(39)})} AS value FROM events")
def _(t):
    return mixed(t).select("event_id", J.optional_string(F.col("row"), "x").alias("value"))


@query("fn_optional_long", f"""
SELECT event_id, ({_cases(_LONGS)})::bigint AS value, ({_cases({3: '7', 4: '-3', 5: '2'})})::bigint AS strict_value FROM events""")
def _(t):
    r = F.col("row")
    strict = J.optional_long(r, "x", numeric_strings=False)
    return mixed(t).select("event_id", J.optional_long(r, "x").alias("value"), strict.alias("strict_value"))


@query("fn_optional_double", f"SELECT event_id, ({_cases({2: '12', 3: '7', 4: '-3', 5: '2', 6: '1.5'})})::double AS value FROM events")
def _(t):
    return mixed(t).select("event_id", J.optional_double(F.col("row"), "x").alias("value"))


@query("fn_bool_flag", f"SELECT event_id, ({_cases({2: '1', 3: '1', 4: '1', 5: '1', 7: '1'}, '0')})::bigint AS value FROM events")
def _(t):
    return mixed(t).select("event_id", J.bool_flag(F.col("row"), "x").alias("value"))


@query("fn_alias", """
SELECT event_id, CASE WHEN event_id % 12 IN (0, 2) THEN CASE event_id % 12 WHEN 0 THEN 'text' ELSE '12' END WHEN event_id % 2 = 1 THEN 'second' END AS value,
  CASE WHEN event_id % 12 NOT IN (0, 2) AND event_id % 2 = 0 THEN 'Missing string: neither ''x'' nor ''y'' in test' END AS error FROM events""")
def _(t):
    text = f"""'{{"x":' || {_X} || CASE WHEN event_id % 2 = 1 THEN ',"y":"second"' ELSE '' END || '}}'"""
    rows = J.with_parsed(t.events.select("event_id", F.expr(text).alias("text")), F.col("text"), "row")
    value, error = J.alias("string", F.col("row"), "x", "y", "test")
    return rows.select("event_id", value.alias("value"), error.alias("error"))


@query("fn_nested", f"""
SELECT event_id, {_cases({0: chr(39) + 'text' + chr(39), 2: chr(39) + '12' + chr(39)})} AS s, ({_cases(_LONGS)})::bigint AS l,
  ({_cases({2: '12', 3: '7', 4: '-3', 5: '2', 6: '1.5'})})::double AS d FROM events""")
def _(t):
    r = F.col("row")
    return mixed(t).select(
        "event_id",
        J.optional_string(r, "n.x").alias("s"),
        J.optional_long(r, "n.x").alias("l"),
        J.optional_double(r, "n.x").alias("d"),
    )


@query("fn_json_array_string", "SELECT event_id, CASE WHEN event_id % 12 = 11 THEN '[1,\"a\"]' END AS value FROM events")
def _(t):
    return mixed(t).select("event_id", J.json_array_string(F.col("row"), "x").alias("value"))


@query("fn_raw_json", "SELECT event_id, '{\"z\":' || event_id || ',\"a\":[1,2],\"t\":\"' || event_type || '\"}' AS value FROM events")
def _(t):
    from ..sources.payload import payload_rows

    text = F.expr("""'[ {"z" : ' || event_id || ', "a" : [1, 2],  "t":"' || event_type || '"} ]'""")
    rows = J.with_parsed(t.events.select("event_id", text.alias("payload")), F.col("payload"), "document")
    return payload_rows(rows).select("event_id", F.col("raw").alias("value"))


@query("fn_json_type", f"""
SELECT event_id, {_cases({k: chr(39) + v + chr(39) for k, v in {0: 'str', 1: 'str', 2: 'str', 3: 'long', 4: 'long', 5: 'long', 6: 'decimal', 7: 'bool', 8: 'bool', 9: 'null', 10: 'json', 11: 'json'}.items()})} AS tag FROM events""")
def _(t):
    return mixed(t).select("event_id", J.column_tag(J.field(F.col("row"), "x")).alias("tag"))


@query("fn_parse_ts_offset", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + to_seconds(18000) WHEN 2 THEN date_trunc('minute', o_orderdate) END AS value FROM orders""")
def _(t):
    iso = "replace(cast(o_orderdate AS string), ' ', 'T')"
    text = F.expr(
        f"CASE o_orderkey % 5 WHEN 0 THEN {iso} || 'Z' WHEN 1 THEN {iso} || '-05:00' WHEN 2 THEN left({iso}, 16) || 'z' WHEN 3 THEN {iso} ELSE 'yesterday' END"
    )
    return t.orders.select("o_orderkey", TS.parse_offset_timestamp(text).alias("value"))


@query("fn_parse_ts_lenient", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS value FROM events""")
def _(t):
    iso = "replace(cast(ts AS string), ' ', 'T')"
    text = F.expr(f"CASE event_id % 4 WHEN 0 THEN {iso} || 'Z' WHEN 1 THEN {iso} WHEN 2 THEN cast(ts AS string) || ' local' ELSE 'soon' END")
    return t.events.select("event_id", TS.parse_lenient_timestamp(text).alias("value"))


@query("fn_local_date", "SELECT event_id, ts::date AS value FROM events")
def _(t):
    text = F.expr("replace(cast(ts AS string), ' ', 'T') || '-11:00'")
    return t.events.select("event_id", TS.local_date(text).alias("value"))


@query("fn_sha256_hex", "SELECT doc_id, sha256(text) AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", H.sha256_hex(F.col("text")).alias("value"))


@query("fn_dedupe_key", "SELECT doc_id, sha256('proxy.payload_audit:' || sha256(text)) AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", H.dedupe_key("proxy.payload_audit", F.col("text")).alias("value"))


@query("fn_batch_checksum", "SELECT page_id, sha256(encode('wireless.audit') || '\\x00'::blob || encode(html)) AS value FROM pages")
def _(t):
    return t.pages.select("page_id", H.batch_checksum(F.lit("wireless.audit"), F.col("html")).alias("value"))


@query("fn_md5_batch_id", "SELECT page_id, md5(html) AS value FROM pages")
def _(t):
    return t.pages.select("page_id", H.md5_batch_id(F.col("html")).alias("value"))


@query("fn_uuid_from_md5", """
SELECT doc_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-'
  || ['8', '9', 'a', 'b'][('0x' || substr(m, 17, 1))::int % 4 + 1] || substr(m, 18, 3) || '-' || substr(m, 21) AS value
FROM (SELECT doc_id, md5(text) AS m FROM documents)""")
def _(t):
    return t.documents.select("doc_id", H.uuid_from_md5(F.col("text")).alias("value"))


@query("fn_base64url", """
SELECT conv_id, turn, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS encoded, text AS decoded FROM conversations""")
def _(t):
    encoded = H.base64url_encode(F.col("text"))
    return t.conversations.select("conv_id", "turn", encoded.alias("encoded"), H.base64url_decode(encoded).alias("decoded"))


@query("fn_band_for_channel", "SELECT frame_no, CASE WHEN channel <= 14 THEN '2.4GHz' ELSE '5GHz' END AS band FROM v_frames")
def _(t):
    return t.frames.select("frame_no", X.band_for_channel(F.col("channel")).alias("band"))


@query("fn_json_details", """
SELECT event_id, '{"n":' || event_id || CASE WHEN event_id % 3 <> 0 THEN ',"tag":"' || event_type || '"' ELSE '' END || '}' AS value FROM events""")
def _(t):
    tag = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return t.events.select("event_id", J.json_details(n=F.col("event_id"), tag=tag).alias("value"))


@query("fn_normalize_bssid", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b' || user_id WHEN 1 THEN 'c' || user_id END AS value FROM events""")
def _(t):
    first = F.expr("CASE event_id % 3 WHEN 0 THEN ' B' || user_id || ' ' WHEN 1 THEN '  ' END")
    second = F.expr("CASE WHEN event_id % 3 <> 2 THEN 'C' || user_id ELSE '' END")
    return t.events.select("event_id", X.normalize_bssid(first, second).alias("value"))


@query("fn_json_field", "SELECT event_id, json_extract_string(props, '$.k')::bigint AS value FROM events")
def _(t):
    return t.events.select("event_id", J.json_text_field(F.col("props"), "k").try_cast("bigint").alias("value"))


@query("fn_extract_field", """
SELECT request_id, CASE request_id % 6 WHEN 0 THEN 'wireless.mac.lookup.reply' WHEN 1 THEN '_INBOX.atheros_sensor.' || request_id
  WHEN 2 THEN 'bad?topic' WHEN 3 THEN 'wireless.other.reply' WHEN 4 THEN '..' END AS value FROM v_requests WHERE request_id % 9 <> 0
UNION ALL SELECT request_id, NULL FROM v_requests WHERE request_id % 9 = 0""")
def _(t):
    return t.requests.select("request_id", J.extract_field(F.col("value"), "reply_topic").alias("value"))


@query("fn_hash_mac", """
SELECT c_custkey, CASE WHEN length(c_custkey::varchar) < 4 THEN 'invalid' ELSE left(c_custkey::varchar, 2) || '***' || right(c_custkey::varchar, 2) END AS value FROM customer""")
def _(t):
    return t.customer.select("c_custkey", X.hash_mac(F.col("c_custkey").cast("string")).alias("value"))


@query("fn_sanitize", "SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", X.sanitize(F.col("text")).alias("value"))


@query("fn_valid_topic", """
SELECT url, regexp_full_match(url, '[A-Za-z0-9._-]{1,249}') AS valid, starts_with(url, '_INBOX.atheros_sensor.') AS allowed FROM (
  SELECT replace(replace(url, '/', CASE WHEN page_id % 2 = 0 THEN '.' ELSE '/' END), ':', '-') AS url FROM pages)""")
def _(t):
    url = F.expr("replace(replace(url, '/', CASE WHEN page_id % 2 = 0 THEN '.' ELSE '/' END), ':', '-')").alias("url")
    topics = t.pages.select(url)
    return topics.select("url", X.is_valid_topic(F.col("url")).alias("valid"), X.is_allowed_reply_topic(F.col("url")).alias("allowed"))


@query("fn_inline_reference", """
SELECT page_id, 'inline://json/' || rtrim(translate(to_base64(encode(html)), '+/', '-_'), '=') AS value FROM pages""")
def _(t):
    return t.pages.select("page_id", H.inline_reference(F.col("html")).alias("value"))


@query("fn_upper_abs_least_greatest", """
SELECT event_id, upper(event_type) AS upper_type, abs(event_id % 100 - 50) AS magnitude, least(user_id, event_id) AS low,
  greatest(user_id, event_id) AS high, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'unknown') AS kind FROM events""")
def _(t):
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select(
        "event_id",
        F.upper("event_type").alias("upper_type"),
        F.abs(e % 100 - 50).alias("magnitude"),
        F.least(u, e).alias("low"),
        F.greatest(u, e).alias("high"),
        F.coalesce(F.when(e % 2 == 0, F.col("event_type")), F.lit("unknown")).alias("kind"),
    )
