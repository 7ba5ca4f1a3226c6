import json

import pytest

from alertloom.functions.cef import with_extension
from alertloom.functions.net import is_ip, is_private_ip
from alertloom.functions.severity import severity
from alertloom.operators.normalize import normalize, normalize_cef, normalize_json, normalize_syslog
from alertloom.operators.validate import (
    observe_quality,
    project_alert,
    quality_metrics,
    quarantine,
    require_valid,
    valid_alerts,
    with_reason,
)
from alertloom.sources.ingest import (
    json_records,
    line_records,
    read_blobs,
    read_log_lines,
    read_records,
    reject_empty,
    route_blobs,
)
from pyspark.sql import functions as F


def values(spark, texts, column, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


CEF_CASES = [
    ("src=1.2.3.4 dst=5.6.7.8", {"src": "1.2.3.4", "dst": "5.6.7.8"}),
    ("msg=Multiple failed SSH logins src=1.2.3.4", {"msg": "Multiple failed SSH logins", "src": "1.2.3.4"}),
    ("msg=result = 5 passed src=1.2.3.4", {"msg": "result = 5 passed", "src": "1.2.3.4"}),
    (r"msg=path\=C:\\temp dst=10.0.0.1", {"msg": r"path=C:\temp", "dst": "10.0.0.1"}),
    (r"filePath=C:\\Users\\admin\\file.exe", {"filePath": r"C:\Users\admin\file.exe"}),
    (r"msg=line one\nline two", {"msg": "line one\nline two"}),
    (r"msg=a\\nb", {"msg": r"a\nb"}),
    (r"msg=a\\\=b \x", {"msg": r"a\=b \x"}),
    ("", {}),
    (None, {}),
    ("just some free text with no kv pairs", {}),
    ("deviceCustom.field1=some value here dst=10.0.0.1", {"deviceCustom.field1": "some value here", "dst": "10.0.0.1"}),
    ("junk a=1 b=  a=2", {"a": "2", "b": ""}),
]


def test_cef_extension(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CEF_CASES)], "i int, x string")
    got = [r.m for r in with_extension(rows, F.col("x"), "m").orderBy("i").collect()]
    assert got == [c[1] for c in CEF_CASES]


def test_severity(spark):
    cases = {
        "Critical": 10, " high ": 8, "informational": 1, "info": 1, "low": 3, "moderate": 5, "severe": 10,
        "7": 7, "7.9": 7, "-3": 0, "99": 10, "1e1": 10, "7d": 5, "junk": 5, "": 5, "nan": 5, "1_0": 10,
        "inf": None, "1e999": None, ".5": 0, "5.": 5,
    }
    assert values(spark, list(cases), severity) == list(cases.values())


def test_ip_validity_agrees_with_ipaddress(spark):
    import ipaddress

    texts = [
        "1.2.3.4", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4\n", " 1.2.3.4", "", "x",
        "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:2",
        "1:2:3:4:5:6:7:8:9", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:1.2.3.4", "::1.2.3.04",
        "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "12345::", "g::", ":1:2:3:4:5:6:7:8", "2001:db8::8a2e:370:7334",
        "1:2:3:4:5:6:7:", "::1.2.3.4.5", "1.2.3.4::", "%eth0", "1:2:3:4::5:6:7:8",
    ]

    def ok(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    assert values(spark, texts, is_ip) == [ok(t) for t in texts]


def test_private_ip(spark):
    cases = {
        "10.1.2.3": True, "172.16.0.1": True, "172.31.255.255": True, "172.32.0.1": False, "172.15.0.1": False,
        "192.168.0.1": True, "192.169.0.1": False, "127.0.0.1": False, "8.8.8.8": False, "::1": False,
        "10.1.2": False, "10.0.0.256": False,
    }
    assert values(spark, list(cases), is_private_ip) == list(cases.values())


def records(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq bigint, record string")


def test_cef_line(spark):
    line = (
        "CEF:0|PaloAlto|NGFW|10.1|1001|Brute Force Login Attempt|8|"
        "src=203.0.113.5 dst=10.0.0.12 duser=admin msg=Multiple failed SSH logins"
    )
    row = normalize_cef(records(spark, [line])).first()
    assert (row.source, row.signature, row.severity) == ("PaloAlto/NGFW", "1001:Brute Force Login Attempt", 8)
    assert (row.src_ip, row.dest_ip, row.user) == ("203.0.113.5", "10.0.0.12", "admin")
    assert (row.message, row.raw, row.reject) == ("Multiple failed SSH logins", line, None)
    assert len(row.id) == 12


def test_cef_rejects_and_fallbacks(spark):
    rows = normalize_cef(
        records(
            spark,
            [
                "CEF:0|a|b|c|d|e",
                "no cef",
                "CEF:0|v|p|1|7|Scan from 1.1.1.1 to 2.2.2.2|low",
                "CEF:0|v|p|1|7|n|inf|x=1",
                "CEF:0|v|p|1|7|n|3|externalId= msg= end=later",
            ],
        )
    ).collect()
    assert [r.reject for r in rows] == ["not_cef", "not_cef", None, "severity_not_finite", None]
    assert (rows[2].src_ip, rows[2].dest_ip, rows[2].severity) == ("1.1.1.1", "2.2.2.2", 3)
    assert (rows[4].id, rows[4].message, rows[4].timestamp) == ("", "", "later")


def test_syslog(spark):
    rows = normalize_syslog(
        records(
            spark,
            [
                "Jan  5 10:00:00 web-1 sshd[123]: Failed password from 1.2.3.4 to 5.6.7.8",
                "something else from 9.9.9.9",
                "Jan 5 10:00:00 10.0.0.1 CEF: 0|x",
            ],
        )
    ).collect()
    assert (rows[0].timestamp, rows[0].source, rows[0].signature) == ("Jan  5 10:00:00", "web-1", "sshd")
    assert (rows[0].src_ip, rows[0].dest_ip, rows[0].severity) == ("1.2.3.4", "5.6.7.8", 5)
    assert rows[0].message == "Failed password from 1.2.3.4 to 5.6.7.8"
    assert (rows[1].signature, rows[1].source, rows[1].timestamp) == ("unparsed_syslog", "unknown", None)
    assert (rows[1].src_ip, rows[1].dest_ip, rows[1].message) == ("9.9.9.9", None, "something else from 9.9.9.9")
    assert (rows[2].signature, rows[2].src_ip) == ("CEF", "10.0.0.1")


def test_json(spark):
    rows = normalize_json(
        records(
            spark,
            [
                json.dumps({"msg": "from 1.1.1.1 to 2.2.2.2", "sev": "high", "rule": "", "sig": "S", "alert_id": 7}),
                json.dumps({"message": "a 1.1.1.1 b 2.2.2.2", "source_ip": "9.9.9.9", "severity": True}),
                json.dumps({"severity": "true", "@timestamp": "t", "account": "u", "sensor": "s"}),
                json.dumps({"severity": False, "priority": 9}),
                "[1]",
                "5",
                None,
                '{"severity": 1e999}',
            ],
        )
    ).collect()
    assert (rows[0].id, rows[0].signature, rows[0].severity) == ("7", "S", 8)
    assert (rows[0].src_ip, rows[0].dest_ip) == ("1.1.1.1", "2.2.2.2")
    assert (rows[1].src_ip, rows[1].dest_ip, rows[1].severity) == ("9.9.9.9", "2.2.2.2", 1)
    assert (rows[2].severity, rows[2].timestamp, rows[2].user, rows[2].source) == (5, "t", "u", "s")
    assert (rows[2].signature, rows[2].message) == ("unspecified", "")
    assert rows[3].severity == 0
    assert [r.reject for r in rows[4:]] == ["not_object"] * 3 + ["severity_not_finite"]


def test_scan_routes_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "message": "x"}, {"id": "2"}, 5]))
    (tmp_path / "b.json").write_text(' {"id": "3"}\n')
    (tmp_path / "c.log").write_text("CEF:0|v|p|1|7|n|3|src=1.1.1.1\r\n\n  Jan 5 10:00:00 h p: m \x0blast\n")
    (tmp_path / "d.jsonl").write_text('{"id": "4"}\n{"id": "5"}\n')
    (tmp_path / "e.log").write_text(" \n\t\n")
    blobs = read_blobs(spark, str(tmp_path))
    kept, rejects = reject_empty(blobs)
    assert rejects.count() == 1
    rows = route_blobs(kept).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["json"] * 4 + ["cef", "syslog", "syslog"] + ["syslog"] * 2
    assert rows[5].record == "Jan 5 10:00:00 h p: m"
    assert json_records(kept).count() == 4
    assert line_records(kept.filter("file like '%c.log'")).count() == 3
    alerts = normalize(read_records(spark, str(tmp_path))).orderBy("seq").collect()
    assert [a.reject for a in alerts] == [None, None, "not_object"] + [None] * 6
    assert [a.id for a in alerts[:2]] == ["1", "2"]
    assert alerts[8].signature == "unparsed_syslog"
    jsonl = normalize(read_records(spark, str(tmp_path / "d.jsonl"), mode="jsonl")).orderBy("seq").collect()
    assert [a.id for a in jsonl] == ["4", "5"]


def test_line_numbers_follow_file_order(spark, tmp_path):
    for name, n in (("b.log", 2000), ("a.log", 3), ("c.log", 700)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = read_log_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{n} line {i}" for n, k in (("a.log", 3), ("b.log", 2000), ("c.log", 700)) for i in range(k)]
    assert [r.record for r in rows] == want
    assert len({r.seq for r in rows}) == len(want)


def raw(spark, **changes):
    base = {"id": "a1", "signature": "Brute Force", "severity": 8, "message": "t", "src_ip": "1.2.3.4", "dest_ip": None}
    base.update(changes)
    return spark.createDataFrame(
        [tuple(base.values())],
        ", ".join(f"{k} {'int' if k == 'severity' else 'string'}" for k in base),
    )


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, None),
        ({"id": ""}, "id_empty"),
        ({"id": None}, "id_empty"),
        ({"signature": ""}, "signature_empty"),
        ({"severity": 15}, "severity_out_of_range"),
        ({"severity": None}, "severity_out_of_range"),
        ({"src_ip": "999.999.999.999"}, "src_ip_invalid"),
        ({"dest_ip": "::g"}, "dest_ip_invalid"),
        ({"src_ip": None}, None),
        ({"src_ip": ""}, None),
        ({"some_vendor_field": "x"}, None),
    ],
)
def test_validation(spark, changes, reason):
    df = raw(spark, **changes)
    if reason is None:
        kept = valid_alerts(df).first()
        assert kept.id == "a1" and kept.src_ip in ("1.2.3.4", None)
        assert "some_vendor_field" not in project_alert(df).columns
        assert require_valid(df).count() == 1
    else:
        assert valid_alerts(df).count() == 0
        assert quarantine(df).first().reason == reason
        with pytest.raises(Exception, match=reason):
            require_valid(df).collect()


def test_quality_metrics(spark):
    df = raw(spark).unionAll(raw(spark, message="")).unionAll(raw(spark, id=""))
    want = {"parsed": 3, "valid": 2, "dropped": 1, "empty_messages": 1}
    assert quality_metrics(df).first().asDict() == want
    observed, observation = observe_quality(with_reason(df))
    assert observed.filter("reason is null").count() == 2
    assert observation.get == want


def test_shortened_patterns(spark):
    """Trimming that looks at the ends first, and patterns that look ahead first, against the plain patterns."""
    from alertloom.functions import indicators
    from alertloom.functions.text import DIGIT, LOOSE_IP, SPACE, WORD, loose_ips, rstrip, strip

    digest = "0123456789abcdef" * 4
    texts = [
        None, "", " ", "\n\t", "a", " a", "a ", " a b ", "\x1ca\x1f", "a​ ", "\x85 a", "a \n b\r\n", "\U0001f600 ", " \U0001f600x", "x　",
        "1.2.3.4", "v1.2.3.4 1.2.3.4", "999.1.1.1,1.2.3.4.5 ١.2.3.4 é1.2.3.4", "_1.2.3.4 (10.0.0.1)", "1111.2.3.4 11.2.3.4567 1.2.3.4",
        digest, digest[:40], digest[:32] + "!", "x" + digest[:33], "g" + digest[:32].upper() + "g", digest + "0", f"{digest[:31]} {digest[:32]}",
    ]
    found = lambda pattern: lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    plain_ip, plain_hash = (p.split(")", 1)[1] for p in (indicators.IP, indicators.HASH))
    plain_loose = LOOSE_IP.removeprefix(f"(?={DIGIT})")
    assert plain_loose.startswith(f"(?<![{WORD}])") and plain_ip.startswith("(?<!") and plain_hash.startswith("(?<!")
    pairs = [
        (strip, lambda c: F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")),
        (rstrip, lambda c: F.regexp_replace(c, rf"[{SPACE}]+\z", "")),
        (loose_ips, found(plain_loose)), (found(indicators.IP), found(plain_ip)), (found(indicators.HASH), found(plain_hash)),
    ]
    for now, plain in pairs:
        assert values(spark, texts, now) == values(spark, texts, plain)


def test_white_space_before_cef_keys(spark):
    """Any white space stands before a key, however much; none belongs to a value's end."""
    texts = ["a=1 b=2\x1cc=3", "  a=  b=x\t\n c=y ", "a= =b c==d", "x y=1  z= 2", "a=1 1b=2 éc=3 dé.e=4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.m for r in with_extension(df, F.col("x"), "m").orderBy("i").collect()]
    assert got == [
        {"a": "1", "b": "2", "c": "3"}, {"a": "", "b": "x", "c": "y"}, {"a": " =b", "c": "=d"}, {"y": "1", "z": " 2"}, {"a": "1 1b=2 éc=3", "dé.e": "4"},
    ]
