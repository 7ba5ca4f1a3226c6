"""Records of any kind to the common alert columns, in one pass over the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.cef import with_extension
from alertloom.functions.settle import settle
from alertloom.functions.severity import severity
from alertloom.functions.text import SPACE, WORD, empty_to_null, loose_ips, strip

# JSON key synonyms, most preferred first.
JSON_KEYS = {
    "message": ["message", "msg", "description", "name"],
    "src_ip": ["src_ip", "source_ip", "srcip", "sourceAddress"],
    "dest_ip": ["dest_ip", "destination_ip", "dstip", "destinationAddress"],
    "id": ["id", "alert_id", "uuid"],
    "timestamp": ["timestamp", "time", "@timestamp", "eventTime"],
    "source": ["source", "product", "vendor", "sensor"],
    "signature": ["signature", "rule", "rule_name", "sig", "category"],
    "severity": ["severity", "sev", "priority"],
    "user": ["user", "username", "account"],
}

_JSON_SCHEMA = ", ".join(f"`{k}` string" for keys in JSON_KEYS.values() for k in keys)
_BOOL_SCHEMA = ", ".join(f"`{k}` boolean" for k in JSON_KEYS["severity"])

# Fixed value: time, host, process with optional pid, message.
_S = rf"[{SPACE}]"
_NS = rf"[^{SPACE}]"
SYSLOG = (
    rf"\A({_NS}+{_S}+\p{{Nd}}+{_S}+[\p{{Nd}}:]+){_S}+({_NS}+){_S}+([{WORD}\-/]+)(?:\[\p{{Nd}}+\])?:{_S}*(.*)\z"
)


def pick(record: Column, keys: list[str], default: Column | None = None) -> Column:
    """The first key's value that is neither missing, null nor empty text."""
    values = [empty_to_null(record[k]) for k in keys]
    return F.coalesce(*values, *([default] if default is not None else []))


def generated_id(seq: Column, raw: Column) -> Column:
    """An id that a retried task gives again."""
    return F.substring(F.sha2(F.concat_ws("|", seq.cast("string"), raw), 256), 1, 12)


def _json_fields() -> dict[str, Column]:
    js = F.col("js")
    level = pick(js, JSON_KEYS["severity"], F.lit("5"))
    # JSON true/false count as numbers, the texts "true"/"false" do not.
    flags = F.from_json(F.col("record"), _BOOL_SCHEMA)
    first_flag = F.coalesce(
        *[
            F.when(empty_to_null(js[k]).isNotNull(), F.coalesce(flags[k].cast("int").cast("string"), js[k]))
            for k in JSON_KEYS["severity"]
        ]
    )
    return {
        "message": pick(js, JSON_KEYS["message"], F.lit("")),
        "src_ip": pick(js, JSON_KEYS["src_ip"]),
        "dest_ip": pick(js, JSON_KEYS["dest_ip"]),
        "id": pick(js, JSON_KEYS["id"]),
        "timestamp": pick(js, JSON_KEYS["timestamp"]),
        "source": pick(js, JSON_KEYS["source"], F.lit("unknown")),
        "signature": pick(js, JSON_KEYS["signature"], F.lit("unspecified")),
        # A JSON number that is not finite comes out of the parser in quotes.
        "severity": F.when(level.isin("true", "false"), first_flag)
        .when(level.isin('"Infinity"', '"-Infinity"', '"NaN"'), F.lit("inf"))
        .otherwise(level),
        "user": pick(js, JSON_KEYS["user"]),
    }


def _cef_fields() -> dict[str, Column]:
    ext = F.col("ext")

    def part(i: int) -> Column:
        return F.get("parts", F.lit(i))

    return {
        "message": F.coalesce(ext["msg"], part(5)),
        "src_ip": empty_to_null(ext["src"]),
        "dest_ip": empty_to_null(ext["dst"]),
        "id": ext["externalId"],
        "timestamp": F.coalesce(empty_to_null(ext["rt"]), ext["end"]),
        "source": F.concat(part(1), F.lit("/"), part(2)),
        "signature": F.concat(part(4), F.lit(":"), part(5)),
        "severity": part(6),
        "user": F.coalesce(empty_to_null(ext["suser"]), ext["duser"]),
    }


def _syslog_fields() -> dict[str, Column]:
    text = strip(F.col("record"))
    time = empty_to_null(F.col("time"))

    def group(i: int) -> Column:
        return F.when(time.isNotNull(), F.regexp_extract(text, SYSLOG, i))

    none = F.lit(None).cast("string")
    return {
        "message": F.coalesce(group(4), text),
        "src_ip": none,
        "dest_ip": none,
        "id": none,
        "timestamp": time,
        "source": F.coalesce(group(2), F.lit("unknown")),
        "signature": F.coalesce(group(3), F.lit("unparsed_syslog")),
        "severity": F.lit("5"),
        "user": none,
    }


_FIELDS = {"json": _json_fields, "cef": _cef_fields, "syslog": _syslog_fields}


def _by_kind(choices: dict[str, Column]) -> Column:
    if len(choices) == 1:
        return next(iter(choices.values()))
    chain = F
    for kind, value in choices.items():
        chain = chain.when(F.col("kind") == kind, value)
    return chain


def _normalize(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Every branch is guarded by the row's kind, so one scan serves them all."""
    carried = [c for c in records.columns if c not in ("record", "kind")]
    record = F.col("record")
    is_kind = {k: (F.col("kind") == k) if len(kinds) > 1 else F.lit(True) for k in kinds}
    df = records
    # What a kind is parsed into, once per row; null on rows of another kind.
    if "json" in kinds:
        is_object = F.coalesce(F.ltrim(record).startswith("{"), F.lit(False))
        df = df.withColumn("js", F.when(is_kind["json"] & is_object, F.from_json(record, _JSON_SCHEMA)))
    if "cef" in kinds:
        df = df.withColumn("parts", F.when(is_kind["cef"], F.split(record, r"\|", 8)))
        df = with_extension(df, F.get("parts", F.lit(7)), "ext")
    if "syslog" in kinds:
        df = df.withColumn("time", F.when(is_kind["syslog"], F.regexp_extract(strip(record), SYSLOG, 1)))

    branch = {k: _FIELDS[k]() for k in kinds}
    field = {name: _by_kind({k: branch[k][name] for k in kinds}) for name in JSON_KEYS}
    rejects = {
        "json": lambda: F.when(F.col("js").isNull(), F.lit("not_object")),
        "cef": lambda: F.when(~record.startswith("CEF:") | (F.size("parts") < 7), F.lit("not_cef")),
        "syslog": lambda: F.lit(None).cast("string"),
    }
    df = df.withColumns({f"f_{name}": value for name, value in field.items()})
    text = _by_kind({k: record if k == "syslog" else F.col("f_message") for k in kinds})
    missing = F.col("f_src_ip").isNull() | F.col("f_dest_ip").isNull()
    df = df.withColumn("ips", F.when(missing, loose_ips(text))).withColumn("level", severity(F.col("f_severity")))
    reject = F.coalesce(
        _by_kind({k: rejects[k]() for k in kinds}),
        F.when(F.col("level").isNull(), F.lit("severity_not_finite")),
    )
    # A missing source is the text's first address, a missing target its second.
    parsed = df.select(
        *carried,
        F.coalesce("f_id", generated_id(F.col("seq"), record)).alias("id"),
        F.col("f_timestamp").alias("timestamp"),
        F.col("f_source").alias("source"),
        F.col("f_signature").alias("signature"),
        F.col("level").alias("severity"),
        F.coalesce("f_src_ip", F.get("ips", F.lit(0))).alias("src_ip"),
        F.coalesce("f_dest_ip", F.get("ips", F.lit(1))).alias("dest_ip"),
        F.col("f_user").alias("user"),
        F.col("f_message").alias("message"),
        record.alias("raw"),
        reject.alias("reject"),
    )
    return settle(parsed, [c for c in parsed.columns if c not in carried])


def _only(records: DataFrame, kind: str) -> DataFrame:
    return records.filter(F.col("kind") == kind) if "kind" in records.columns else records


def normalize_json(records: DataFrame) -> DataFrame:
    """(seq, record) of JSON objects to alert columns and ``reject``."""
    return _normalize(_only(records, "json"), ["json"])


def normalize_cef(records: DataFrame) -> DataFrame:
    return _normalize(_only(records, "cef"), ["cef"])


def normalize_syslog(records: DataFrame) -> DataFrame:
    return _normalize(_only(records, "syslog"), ["syslog"])


def normalize(records: DataFrame) -> DataFrame:
    """(seq, kind, record) of any kind as one batch."""
    return _normalize(records, ["json", "cef", "syslog"])
