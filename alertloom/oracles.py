"""The queries' results as SQL over the driver tables."""

from __future__ import annotations

A = r"""
a AS (
  SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS id, ts,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
    'sensor-' || (user_id % 5) AS source,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'SSH Brute-Force Login Attempt' ELSE 'SSH Brute Force Login Attempt' END
      WHEN 'click' THEN 'Port Scan Detected' WHEN 'view' THEN 'Possible C2 Beacon'
      WHEN 'purchase' THEN 'Large Outbound Upload' ELSE 'New Admin Account' END AS signature,
    CAST(least(10, floor(value / 10)) AS INTEGER) AS severity,
    CASE WHEN event_id % 3 = 0 THEN '10.0.0.7' ELSE CASE WHEN user_id % 5 = 0 THEN '198.51.100.' ELSE '10.0.0.' END || (user_id % 250) END AS src_ip,
    '203.0.113.' || CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id % 32 END AS dest_ip,
    CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id % 250 END AS src_n, CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id % 32 END AS dest_n,
    'user' || user_id AS "user",
    'seen via host-' || (user_id % 40) || '.corp.example for 192.0.2.' || (event_id % 200) || ' file ' || md5(CAST(event_id % 300 AS VARCHAR)) AS message,
    user_id, event_type
  FROM events)"""
JSON_TEXT = """'{"alert_id":"' || id || '","time":"' || "timestamp" || '","product":"' || source || '","rule":"' ||
  signature || '","sev":' || severity || ',"source_ip":"' || src_ip || '","dstip":"' || dest_ip || '","username":"' || "user" ||
  '","msg":"' || message || '"}'"""
CEF_TEXT = """'CEF:0|Acme|' || source || '|1.0|' || (seq % 7) || '|' || signature || '|' || severity || '|externalId=' || id ||
  ' rt=' || "timestamp" || ' src=' || src_ip || ' dst=' || dest_ip || ' duser=' || "user" || ' msg=' || message"""
SYSLOG_TEXT = """'Jan ' || (1 + seq % 28) || ' 10:' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || ':00 ' || source ||
  ' proc-' || (seq % 9) || '[' || seq || ']: from ' || src_ip || ' to ' || dest_ip || ' ' || message"""
# Technique ids of the fixture's texts, in rule order, by the rules that can occur in them.
TECH = """array_to_string(list_filter([
    CASE WHEN contains({t}, 'brute force') THEN 'T1110' END,
    CASE WHEN contains({t}, 'new admin account') THEN 'T1136' END,
    CASE WHEN contains({t}, 'beacon') OR contains({t}, 'c2') THEN 'T1071' END,
    CASE WHEN contains({t}, 'port scan') THEN 'T1046' END,
    CASE WHEN contains({t}, 'large outbound upload') THEN 'T1041' END], lambda x: x IS NOT NULL), ',')"""
HAY = "lower(signature || ' ' || message)"
# Long indicator table.
L = """
l AS (
  SELECT seq, 'src_ip' AS slot, 'ip' AS ioc_type, src_ip AS ioc, 0 AS pos, src_n AS n FROM a
  UNION ALL SELECT seq, 'dest_ip', 'ip', dest_ip, 0, dest_n FROM a
  UNION ALL SELECT seq, 'ips', 'ip', '192.0.2.' || (seq % 200), 0, seq % 200 FROM a
  UNION ALL SELECT seq, 'domains', 'domain', 'host-' || (user_id % 40) || '.corp.example', 0, user_id % 40 FROM a
  UNION ALL SELECT seq, 'hashes', 'hash', md5(CAST(seq % 300 AS VARCHAR)), 0, seq % 300 FROM a)"""
# Reputations. The public form of a source address exists in the reports for every user.
REP = """
u AS (
  SELECT DISTINCT ioc_type, ioc, n FROM l WHERE ioc NOT LIKE '10.%'
  UNION SELECT DISTINCT 'ip', '198.51.100.' || (user_id % 250), user_id % 250 FROM a),
p AS (
  SELECT *, (ioc_type = 'ip' AND n % 4 <> 3) AS ab, (n % 5 <> 4) AS vt, (ioc_type <> 'hash' AND n % 3 <> 2) AS ox FROM u),
q AS (
  SELECT *, CASE WHEN ab AND n % 11 <> 0 THEN CAST((n * 37) % 101 AS DOUBLE) END AS s_ab,
    CASE WHEN vt AND n % 13 <> 0 THEN CAST(least(100, ((n * 7) % 8) * 20) AS DOUBLE) END AS s_vt,
    CASE WHEN ox THEN CASE WHEN n % 17 = 0 THEN 0.0 ELSE CAST(least(100, ((n * 5) % 14) * 10) AS DOUBLE) END END AS s_ox,
    (n * 7) % 8 AS votes
  FROM p WHERE ab OR vt OR ox),
m AS (
  SELECT *, array_to_string(list_filter([CASE WHEN ab THEN 'abuseipdb' END, CASE WHEN vt THEN 'virustotal' END, CASE WHEN ox THEN 'otx' END], lambda x: x IS NOT NULL), ',') AS providers,
    (coalesce(s_ab, 0) + coalesce(s_vt, 0) + coalesce(s_ox, 0)) / nullif(CAST(s_ab IS NOT NULL AS INT) + CAST(s_vt IS NOT NULL AS INT) + CAST(s_ox IS NOT NULL AS INT), 0) AS mean,
    CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-31 00:30:00' END AS fetched_at
  FROM q),
rep AS (
  SELECT ioc_type, ioc, n, providers, fetched_at, votes, vt,
    CASE WHEN ioc_type = 'hash' THEN 'hash:md5' ELSE ioc_type END AS "type",
    CASE WHEN ioc_type = 'hash' THEN CASE WHEN n % 13 <> 0 THEN CASE WHEN votes >= 3 THEN 'malicious' WHEN votes >= 1 THEN 'suspicious' ELSE 'clean' END ELSE 'unknown' END
      WHEN mean IS NULL THEN 'unknown' WHEN mean >= 50 THEN 'malicious' WHEN mean >= 20 THEN 'suspicious' ELSE 'clean' END AS verdict,
    CASE WHEN ioc_type = 'hash' THEN CASE WHEN n % 13 <> 0 THEN CAST(round_even(100.0 * votes / (votes + 60), 1) AS DOUBLE) END
      ELSE CAST(round_even(mean, 1) AS DOUBLE) END AS score,
    CASE WHEN ioc_type = 'hash' THEN n % 13 <> 0
      ELSE (ab AND n % 11 <> 0) OR (vt AND n % 13 <> 0) OR (ox AND n % 17 <> 0) END AS answered
  FROM m)"""
PRIV = "(l.ioc_type = 'ip' AND l.ioc LIKE '10.%')"
ATT = """
att AS (
  SELECT l.*, CASE WHEN {priv} THEN 'private/internal' ELSE coalesce(r.verdict, 'unknown') END AS verdict,
    CASE WHEN {priv} THEN NULL ELSE r.score END AS score,
    CASE WHEN {priv} THEN '' ELSE coalesce(r.providers, '') END AS providers,
    r.ioc IS NOT NULL AS has_report
  FROM l LEFT JOIN {rep} r ON l.ioc_type = r.ioc_type AND l.ioc = r.ioc)"""
CONF = """
conf AS (
  SELECT seq, count(*) AS n, count(*) FILTER (verdict = 'malicious') AS mal, count(*) FILTER (verdict = 'suspicious') AS sus,
    bool_or(contains(providers, 'abuseipdb')) AS has_ab, bool_or(contains(providers, 'otx')) AS has_ox, bool_or(contains(providers, 'virustotal')) AS has_vt
  FROM att GROUP BY seq),
cons AS (
  SELECT *, CASE WHEN mal + sus = 0 THEN 'unknown' WHEN mal = n THEN 'strong' WHEN mal >= 2 AND mal > sus THEN 'strong' ELSE 'mixed' END AS consensus,
    CASE WHEN mal > 0 THEN 'malicious' WHEN sus > 0 THEN 'suspicious' ELSE 'unknown' END AS verdict,
    CAST(round_even((mal + sus) / n, 3) AS DOUBLE) AS confidence
  FROM conf)"""
W = """
w AS (
  SELECT DISTINCT * FROM (
    SELECT '10.0.0.' || (user_id % 250) AS asset, user_id % 250 % 20 AS weight FROM events
    UNION ALL SELECT '203.0.113.' || (event_id % 32), event_id % 32 % 6 FROM events
    UNION ALL SELECT 'sensor-' || (user_id % 5), user_id % 5 FROM events) WHERE weight % 2 = 1)"""


def groups(signature: str = "replace(signature, '-', ' ')", src: str = "src_ip", dest: str = "dest_ip") -> str:
    """Sessions per pair and signature, the fixture's input following time."""
    return f"""
gap AS (
  SELECT *, {src} AS g_src, {dest} AS g_dest, {signature} AS g_sig FROM a),
cut AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY g_src, g_dest, g_sig ORDER BY seq) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS is_new FROM gap),
num AS (
  SELECT *, sum(is_new) OVER (PARTITION BY g_src, g_dest, g_sig ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session_no FROM cut),
mem AS (
  SELECT *, min(seq) OVER (PARTITION BY g_src, g_dest, g_sig, session_no) AS group_seq,
    min(seq) OVER (PARTITION BY g_src, g_dest) AS bucket_seq FROM num),
g AS (
  SELECT group_seq, bucket_seq, CAST(count(*) AS INTEGER) AS occurrence_count, min("timestamp") AS first_seen, max("timestamp") AS last_seen, max(ts) AS last_ts
  FROM mem GROUP BY group_seq, bucket_seq)"""


def scored(source: str, severity: str = "severity", mitre: bool = True, occurrences: str = "1") -> str:
    t = TECH.format(t=HAY)
    bonus = f"CASE WHEN {t} <> '' THEN 5 ELSE 0 END" if mitre else "0"
    return f"""
sc AS (
  SELECT a.*, {occurrences} AS occurrence_count_, c.verdict, c.consensus, c.confidence, {t} AS techniques,
    CAST(greatest(0, least(100, {severity} * 6
      + CASE WHEN {occurrences} > 1 THEN least(20, ({occurrences} - 1) * 3) ELSE 0 END
      + (c.mal * 4 + c.sus * 2) * 2
      + CASE c.consensus WHEN 'strong' THEN 6 WHEN 'mixed' THEN 3 ELSE 0 END
      + {bonus}
      + coalesce(w1.weight, 0) + coalesce(w2.weight, 0) + coalesce(w3.weight, 0))) AS INTEGER) AS priority_score
  FROM {source} a JOIN cons c ON c.seq = a.seq
  LEFT JOIN w w1 ON w1.asset = a.src_ip LEFT JOIN w w2 ON w2.asset = a.dest_ip LEFT JOIN w w3 ON w3.asset = a.source),
tr AS (
  SELECT *, CASE WHEN priority_score >= 80 THEN 'P1' WHEN priority_score >= 55 THEN 'P2' WHEN priority_score >= 30 THEN 'P3' ELSE 'P4' END AS priority_tier FROM sc)"""


FILED_SCORES = f"""
k AS (SELECT p.g AS g, CAST(count(*) AS INTEGER) AS occurrence_count FROM (SELECT unnest(last.placed) AS p FROM h) GROUP BY p.g),
sc AS (
  SELECT x.id, x.signature, k.occurrence_count, CAST(greatest(0, least(100, x.severity * 6
      + CASE WHEN k.occurrence_count > 1 THEN least(20, (k.occurrence_count - 1) * 3) ELSE 0 END
      + (c.mal * 4 + c.sus * 2) * 2 + CASE c.consensus WHEN 'strong' THEN 6 WHEN 'mixed' THEN 3 ELSE 0 END
      + CASE WHEN {TECH.format(t="lower(x.signature || ' ' || x.message)")} <> '' THEN 5 ELSE 0 END)) AS INTEGER) AS priority_score
  FROM x JOIN k ON k.g = x.seq JOIN cons c ON c.seq = x.seq),
tr AS (
  SELECT *, CASE WHEN priority_score >= 80 THEN 'P1' WHEN priority_score >= 55 THEN 'P2' WHEN priority_score >= 30 THEN 'P3' ELSE 'P4' END AS priority_tier FROM sc)"""


def att(rep: str = "rep") -> str:
    return ATT.format(priv=PRIV, rep=rep)


def q(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


# The first alert of each group, with the group's columns.
FIRST = """
f AS (
  SELECT a.*, g.bucket_seq, g.occurrence_count, g.first_seen, g.last_seen FROM a JOIN g ON a.seq = g.group_seq)"""
FRESH = """
fresh AS (SELECT * FROM rep WHERE TIMESTAMP '2024-01-31 01:00:00' < fetched_at + INTERVAL 3600 SECOND)"""
TRIAGE = [A, L, REP, att(), CONF, W, groups(), FIRST, scored("f", occurrences="a.occurrence_count")]

# The summary's lines in reading order: by section, then as alerts rank.
LINES = """
lines AS (
  SELECT CAST(0 AS INTEGER) AS section, NULL AS priority_score, NULL AS bucket_seq, NULL AS seq, 'Incident batch: ' || count(*) || ' alerts after dedup.' AS line FROM tr
  UNION ALL SELECT 1, NULL, NULL, NULL, chr(10) || count(*) || ' P1 (critical) alert(s):' FROM tr WHERE priority_tier = 'P1' HAVING count(*) > 0
  UNION ALL SELECT 2, priority_score, bucket_seq, seq, '  - [' || priority_score || '] ' || signature || ' src=' || src_ip || ' dest=' || dest_ip || ' (x' || occurrence_count_ || ')' FROM tr WHERE priority_tier = 'P1'
  UNION ALL SELECT 3, NULL, NULL, NULL, chr(10) || count(*) || ' P2 (high) alert(s):' FROM tr WHERE priority_tier = 'P2' HAVING count(*) > 0
  UNION ALL SELECT 4, priority_score, bucket_seq, seq, '  - [' || priority_score || '] ' || signature || ' src=' || src_ip || ' dest=' || dest_ip FROM tr WHERE priority_tier = 'P2'
  UNION ALL SELECT 5, NULL, NULL, NULL, 'No P1/P2 alerts in this batch — likely routine noise, spot-check P3s.' FROM tr HAVING count(*) > 0 AND count(*) FILTER (priority_tier IN ('P1', 'P2')) = 0
  UNION ALL SELECT 6, NULL, NULL, NULL, chr(10) || '[Note: generated from a template.]')"""
NUMBERED = """
numbered AS (
  SELECT row_number() OVER (ORDER BY section, priority_score DESC, bucket_seq, seq) - 1 AS line_no, section, line FROM lines)"""

STRIDE = 4294967296
BLOB_SEQ = f"(seq // 500) * {STRIDE} + seq % 500"
PARSED_COLS = 'seq, id, "timestamp", source, signature, severity, src_ip, dest_ip, "user", message'
NOT_IP = r"[^\pL\pN_.]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

TEXTS = """
t AS (
  SELECT 'd' || doc_id AS key, text FROM documents
  UNION ALL SELECT 'p' || page_id, url || chr(10) || html FROM pages
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""
OBJ = """
o AS (
  SELECT 'T' || s_suppkey AS technique_id, s_name AS technique,
    CASE WHEN s_nationkey % 5 = 0 THEN 'Unknown' WHEN s_nationkey % 2 = 0 THEN 'Credential Access' ELSE 'Lateral Movement ' || s_nationkey END AS tactic,
    lower(s_name || ' Site' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || ' zone' || s_nationkey || ' relay') AS names
  FROM supplier WHERE s_suppkey % 13 <> 5 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0),
ix AS (
  SELECT DISTINCT unnest(regexp_extract_all(names, '[a-z0-9]{4,}')) AS word, technique_id, technique, tactic FROM o)"""
DIRTY = """
d AS (
  SELECT seq, CASE WHEN seq % 11 = 0 THEN '' ELSE id END AS id, CASE WHEN seq % 13 = 0 THEN NULL ELSE signature END AS signature,
    CAST(CASE WHEN seq % 17 = 0 THEN 15 ELSE severity END AS INTEGER) AS severity,
    CASE WHEN seq % 19 = 0 THEN '999.1.1.1' WHEN seq % 5 = 0 THEN NULL ELSE src_ip END AS src_ip,
    CASE WHEN seq % 23 = 0 THEN 'fe80::1::2' WHEN seq % 6 = 0 THEN '2001:db8::7' ELSE dest_ip END AS dest_ip,
    CASE WHEN seq % 3 = 0 THEN '' ELSE message END AS message,
    CASE WHEN seq % 11 = 0 THEN 'id_empty' WHEN seq % 13 = 0 THEN 'signature_empty' WHEN seq % 17 = 0 THEN 'severity_out_of_range'
      WHEN seq % 19 = 0 THEN 'src_ip_invalid' WHEN seq % 23 = 0 THEN 'dest_ip_invalid' END AS reason
  FROM a)"""
MIXED_TEXT = f"CASE (seq // 500) % 3 WHEN 0 THEN {JSON_TEXT} WHEN 1 THEN {CEF_TEXT} ELSE {SYSLOG_TEXT} END"
LINE_TEXT = f"CASE 1 + (seq // 500) % 2 WHEN 1 THEN {CEF_TEXT} ELSE {SYSLOG_TEXT} END"
LINE_KIND = "CASE WHEN (seq // 500) % 2 = 0 THEN 'cef' ELSE 'syslog' END"
SYSLOG_TIME = """'Jan ' || (1 + seq % 28) || ' 10:' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || ':00'"""
SYSLOG_MESSAGE = "'from ' || src_ip || ' to ' || dest_ip || ' ' || message"
CEF_COLS = f"""seq, id, "timestamp", 'Acme/' || source AS source, (seq % 7) || ':' || signature AS signature, severity, src_ip, dest_ip, "user", message"""


def _texts_by(pattern: str, delimiter: str, alias: str, order: str = "") -> str:
    doubled = f"regexp_replace(text, '({delimiter})', '\\1\\1', 'g')"
    found = f"regexp_extract_all({doubled}, '(?:^|{delimiter})({pattern})(?:$|{delimiter})', 1)"
    if order:
        distinct = f"list_sort(list_distinct(list_transform({found}, lambda x: lower(x))))"
    else:
        distinct = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return q(TEXTS, select=f"SELECT key, array_to_string({distinct}, ',') AS {alias} FROM t")


GROUPS = "SELECT group_seq, bucket_seq, occurrence_count, first_seen, last_seen FROM g"
TRIAGE_COLS = "id, priority_score, priority_tier, occurrence_count_ AS occurrence_count, first_seen, last_seen"
# Input order that has little to do with time: a fold over each pair's and rule's alerts, whose state is the groups so far.
UNORDERED = """
o AS (
  SELECT list_concat([{'g': NULL::BIGINT, 'us': NULL::BIGINT, 'open': []::STRUCT(g BIGINT, us BIGINT)[], 'placed': []::STRUCT(g BIGINT, s BIGINT)[]}],
      list({'g': (seq % 7) * 1000000000 + seq, 'us': epoch_us(ts), 'open': []::STRUCT(g BIGINT, us BIGINT)[], 'placed': []::STRUCT(g BIGINT, s BIGINT)[]}
        ORDER BY (seq % 7) * 1000000000 + seq)) AS steps
  FROM a GROUP BY src_ip, dest_ip, replace(signature, '-', ' ')),
h AS (
  SELECT list_reduce(steps, lambda x, y: {'g': y.g, 'us': y.us,
      'open': CASE WHEN len(list_filter(x.open, lambda e: abs(e.us - y.us) <= 3600000000)) = 0 THEN list_append(x.open, {'g': y.g, 'us': y.us})
        ELSE list_transform(x.open, lambda e: CASE WHEN e.g = list_filter(x.open, lambda f: abs(f.us - y.us) <= 3600000000)[1].g
          THEN {'g': e.g, 'us': greatest(e.us, y.us)} ELSE e END) END,
      'placed': list_append(x.placed, {'g': coalesce(list_filter(x.open, lambda e: abs(e.us - y.us) <= 3600000000)[1].g, y.g), 's': y.g})}) AS last FROM o)"""
# Alerts of mixed files as they are parsed, files and lines in the order of seq; similar signatures share a key.
FILED = f"""
x AS (
  SELECT seq, id0 AS id, src_ip, dest_ip, message, severity, signature, zone, us,
    replace(regexp_replace(signature, '^[0-9]:', ''), '-', CASE WHEN zone = 1 THEN '-' ELSE ' ' END) AS sig FROM (
    SELECT seq, src_ip, dest_ip, (seq // 500) % 3 AS kind,
      CASE WHEN (seq // 500) % 3 < 2 THEN id ELSE substr(sha256(((seq // 500) * 4294967296 + 2 * (seq % 500) + 1) || '|' || {SYSLOG_TEXT}), 1, 12) END AS id0,
      CASE (seq // 500) % 3 WHEN 2 THEN 'from ' || src_ip || ' to ' || dest_ip || ' ' || message ELSE message END AS message,
      CAST(CASE (seq // 500) % 3 WHEN 2 THEN 5 ELSE severity END AS INTEGER) AS severity,
      CASE (seq // 500) % 3 WHEN 0 THEN signature WHEN 1 THEN (seq % 7) || ':' || signature ELSE 'proc-' || (seq % 9) END AS signature,
      CASE (seq // 500) % 3 WHEN 2 THEN 1 ELSE 2 END AS zone,
      CASE (seq // 500) % 3 WHEN 2 THEN epoch_us(TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 DAY * (seq % 28) + INTERVAL 1 MINUTE * (seq % 60)) ELSE epoch_us(ts) END AS us
    FROM a)),
o AS (
  SELECT list_concat([{{'g': NULL::BIGINT, 'us': NULL::BIGINT, 'open': []::STRUCT(g BIGINT, us BIGINT)[], 'placed': []::STRUCT(g BIGINT, s BIGINT)[]}}],
      list({{'g': seq, 'us': us, 'open': []::STRUCT(g BIGINT, us BIGINT)[], 'placed': []::STRUCT(g BIGINT, s BIGINT)[]}} ORDER BY seq)) AS steps
  FROM x GROUP BY src_ip, dest_ip, sig, zone)"""
FOLD = UNORDERED[UNORDERED.index("\nh AS (") :]
# Zone classes, missing times and missing addresses.
MIXED_TIMES = """
t AS (
  SELECT seq, ts, src_ip, CASE WHEN seq % 5 = 0 THEN NULL ELSE dest_ip END AS dest_ip, replace(signature, '-', ' ') AS sig,
    CASE seq % 6 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END AS zone,
    CASE seq % 6 WHEN 3 THEN substr("timestamp", 1, 26) WHEN 4 THEN NULL ELSE "timestamp" END AS stamp FROM a),
n AS (
  SELECT *, sum(is_new) OVER (PARTITION BY src_ip, dest_ip, sig, zone ORDER BY seq ROWS UNBOUNDED PRECEDING) AS no FROM (
    SELECT *, CASE WHEN zone = 0 AND lag(seq) OVER w IS NOT NULL THEN 0 WHEN ts - lag(ts) OVER w <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS is_new
    FROM t WINDOW w AS (PARTITION BY src_ip, dest_ip, sig, zone ORDER BY seq)))"""
MIXED_GROUPS = """SELECT min(seq) AS group_seq, min(pair_seq) AS bucket_seq, CAST(count(*) AS INTEGER) AS occurrence_count, min(stamp) AS first_seen, max(stamp) AS last_seen
  FROM (SELECT *, min(seq) OVER (PARTITION BY src_ip, dest_ip) AS pair_seq FROM n) GROUP BY src_ip, dest_ip, sig, zone, no"""

ORACLES: dict[str, str] = {
    "scan_files": q(A, select=f"""SELECT seq // 500 AS file_no, md5(CASE WHEN (seq // 500) % 3 = 0
        THEN '[' || string_agg(txt, ',' || chr(10) || ' ' ORDER BY seq) || ']'
        ELSE chr(10) || '  ' || string_agg(txt, chr(13) || chr(10) || chr(9) || chr(10) || '  ' ORDER BY seq) END) AS digest
        FROM (SELECT seq, {MIXED_TEXT} AS txt FROM a) GROUP BY seq // 500"""),
    "scan_lines": q(A, select=f"SELECT CAST(1 + seq % 500 AS INTEGER) AS line_no, {LINE_KIND} AS kind, {LINE_TEXT} AS record FROM a"),
    "explode_json": q(A, select=f"SELECT {BLOB_SEQ} AS seq, {JSON_TEXT} AS record FROM a"),
    "split_lines": q(A, select=f"SELECT (seq // 500) * {STRIDE} + 2 * (seq % 500) + 1 AS seq, {LINE_TEXT} AS record FROM a"),
    "route_records": q(A, select=f"""SELECT (seq // 500) * {STRIDE} + CASE WHEN (seq // 500) % 3 = 0 THEN seq % 500 ELSE 2 * (seq % 500) + 1 END AS seq,
        CASE (seq // 500) % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'cef' ELSE 'syslog' END AS kind, {MIXED_TEXT} AS record FROM a"""),
    "load_assets": """SELECT c_name AS asset, CAST(c_nationkey AS INTEGER) AS weight FROM customer
        UNION ALL SELECT 'seg-' || c_custkey, CAST(c_custkey % 9 AS INTEGER) FROM customer""",
    "load_attack_bundle": """SELECT CASE WHEN s_suppkey % 13 = 5 THEN 'malware' ELSE 'attack-pattern' END AS "type", s_name AS name,
        'Site' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || ',zone' || s_nationkey || ' relay' AS aliases FROM supplier""",
    "read_alert_array": q(A, select='SELECT id, "timestamp", source, signature, severity, src_ip, dest_ip, "user", message, CAST(1 AS INTEGER) AS occurrence_count FROM a'),
    "reject_empty": "SELECT 'f' || event_id AS file, 'empty_input' AS reject FROM events WHERE event_id % 7 = 0",
    "write_results": q(*TRIAGE, select="SELECT id, priority_score, priority_tier FROM tr"),
    "json_alerts": q(A, select=f"SELECT {PARSED_COLS} FROM a"),
    "json_pick": q(A, select="""SELECT seq, CASE WHEN seq % 2 = 1 THEN signature WHEN seq % 3 = 0 THEN source WHEN seq % 5 = 0 THEN "user" ELSE 'unspecified' END AS signature FROM a"""),
    "cef_alerts": q(A, select=f"SELECT {CEF_COLS} FROM a"),
    "cef_extension": q(A, select="SELECT seq, src_ip AS src, message || ' a = b' AS msg, CAST(seq AS VARCHAR) AS dup, 'x' AS cs1_label, CAST(4 AS INTEGER) AS n_keys FROM a"),
    "cef_unescape": q(A, select=r"""SELECT seq, 'p=C:\' || "user" || '<NL>' || seq || '\x' AS value FROM a"""),
    "syslog_alerts": q(A, select="""SELECT seq, substr(sha256(seq || '|' || CASE WHEN seq % 4 = 0 THEN 'oops from ' || src_ip || ' to ' || dest_ip || ' ' || message ELSE """ + SYSLOG_TEXT + """ END), 1, 12) AS id,
        CASE WHEN seq % 4 = 0 THEN NULL ELSE 'Jan ' || (1 + seq % 28) || ' 10:' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || ':00' END AS "timestamp",
        CASE WHEN seq % 4 = 0 THEN 'unknown' ELSE source END AS source, CASE WHEN seq % 4 = 0 THEN 'unparsed_syslog' ELSE 'proc-' || (seq % 9) END AS signature,
        CAST(5 AS INTEGER) AS severity, src_ip, dest_ip, CAST(NULL AS VARCHAR) AS "user",
        CASE WHEN seq % 4 = 0 THEN 'oops ' ELSE '' END || 'from ' || src_ip || ' to ' || dest_ip || ' ' || message AS message FROM a"""),
    "severity_levels": "SELECT event_id AS seq, CAST([1,1,3,5,5,8,10,10,5,0,7,10,10,5][1 + event_id % 14] AS INTEGER) AS severity FROM events",
    "address_backfill": q(A, select="""SELECT seq, CASE WHEN seq % 5 = 0 THEN '8.8.8.8' WHEN seq % 3 = 0 THEN dest_ip ELSE src_ip END AS src_ip,
        CASE WHEN seq % 3 <> 0 THEN dest_ip WHEN seq % 2 = 1 THEN '999.1.1.1' END AS dest_ip FROM a"""),
    "generated_ids": q(A, select=f"SELECT seq, substr(sha256(seq || '|' || {SYSLOG_TEXT}), 1, 12) AS id, {SYSLOG_TEXT} AS raw FROM a"),
    "mixed_alerts": q(A, select=f"""SELECT {PARSED_COLS} FROM a WHERE seq % 3 = 0 UNION ALL SELECT {CEF_COLS} FROM a WHERE seq % 3 = 1
        UNION ALL SELECT seq, substr(sha256(seq || '|' || {SYSLOG_TEXT}), 1, 12), {SYSLOG_TIME}, source, 'proc-' || (seq % 9), 5, src_ip, dest_ip, NULL, {SYSLOG_MESSAGE} FROM a WHERE seq % 3 = 2"""),
    "files_to_alerts": q(A, select=f"""SELECT id, "timestamp", severity, src_ip, dest_ip, "user", message FROM a WHERE (seq // 500) % 3 < 2
        UNION ALL SELECT substr(sha256(((seq // 500) * {STRIDE} + 2 * (seq % 500) + 1) || '|' || {SYSLOG_TEXT}), 1, 12), {SYSLOG_TIME}, 5, src_ip, dest_ip, NULL, {SYSLOG_MESSAGE}
        FROM a WHERE (seq // 500) % 3 = 2"""),
    "valid_alerts": q(A, DIRTY, select="SELECT seq, id, signature, severity, src_ip, dest_ip FROM d WHERE reason IS NULL"),
    "quarantine": q(A, DIRTY, select="SELECT seq, reason FROM d WHERE reason IS NOT NULL"),
    "strict_validation": q(A, select="SELECT seq, id FROM a"),
    "address_validity": q(A, select="""SELECT seq, CASE seq % 8 WHEN 0 THEN src_ip WHEN 1 THEN '01.2.3.' || (seq % 300) WHEN 2 THEN '1.2.3.' || (seq % 300)
        WHEN 3 THEN '::' || seq WHEN 4 THEN (seq % 10) || ':2:3:4:5:6:7:8' WHEN 5 THEN '1::2::' || (seq % 10) WHEN 6 THEN '::ffff:1.2.3.' || (seq % 300) ELSE 'fe80::1%eth' || (seq % 3) END AS ip,
        CAST(CASE seq % 8 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN seq % 300 < 256 THEN 1 ELSE 0 END WHEN 3 THEN CASE WHEN length(CAST(seq AS VARCHAR)) <= 4 THEN 1 ELSE 0 END
          WHEN 5 THEN 0 WHEN 6 THEN CASE WHEN seq % 300 < 256 THEN 1 ELSE 0 END ELSE 1 END AS INTEGER) AS valid FROM a"""),
    "alert_projection": q(A, select="""SELECT seq, id, signature, severity, 'unknown' AS source, '' AS raw, CAST(1 AS INTEGER) AS occurrence_count, CAST(0 AS INTEGER) AS n_mitre, CAST(0 AS INTEGER) AS n_related FROM a"""),
    "quality_metrics": q(A, DIRTY, select="""SELECT count(*) AS parsed, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS dropped,
        count(*) FILTER (reason IS NULL AND message = '') AS empty_messages FROM d"""),
    "keyword_rule_hits": q(A, select=f"""SELECT technique_id, keyword, count(*) AS alerts FROM a JOIN (VALUES ('T1110', 'brute force'), ('T1136', 'new admin account'),
        ('T1071', 'beacon'), ('T1071', 'c2'), ('T1046', 'port scan'), ('T1041', 'large outbound upload')) r(technique_id, keyword) ON contains({HAY}, keyword) GROUP BY technique_id, keyword"""),
    "techniques": q(A, select=f"SELECT seq, {TECH.format(t='lower(signature)')} AS techniques FROM a"),
    "tagged_alerts": q(A, select=f"""SELECT seq, {TECH.format(t=HAY)} AS techniques,
        CAST(CASE WHEN {TECH.format(t=HAY)} = '' THEN 0 ELSE len(string_split({TECH.format(t=HAY)}, ',')) END AS INTEGER) AS n, 'heuristic' AS mitre_source FROM a"""),
    "technique_words": q(OBJ, select="SELECT word, technique_id, technique, tactic FROM ix"),
    "index_tagged_alerts": q(A, OBJ, select="""SELECT seq, coalesce(techniques, '') AS techniques, 'stix' AS mitre_source FROM a LEFT JOIN (
        SELECT seq, string_agg(technique_id, ',' ORDER BY technique_id) AS techniques FROM (
          SELECT DISTINCT seq, technique_id FROM (
            SELECT seq, unnest(regexp_extract_all(lower(signature || ' from SITE' || lpad(CAST(seq % 500 AS VARCHAR), 4, '0') || ' to site' || lpad(CAST(seq % 70 AS VARCHAR), 4, '0')), '[a-z0-9]{4,}')) AS word FROM a) JOIN ix USING (word))
        GROUP BY seq) USING (seq)"""),
    "index_fallback": q(A, select=f"""SELECT seq, 'heuristic' AS mitre_source, CAST(CASE WHEN {TECH.format(t=HAY)} = '' THEN 0 ELSE len(string_split({TECH.format(t=HAY)}, ',')) END AS INTEGER) AS n FROM a"""),
    "text_addresses": _texts_by(rf"(?:{OCTET}\.){{3}}{OCTET}", NOT_IP, "ips"),
    "text_hashes": _texts_by("[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32}", "[^a-fA-F0-9]", "hashes", order="sorted"),
    "alert_domains": q(A, select="SELECT seq, 'host-' || (user_id % 40) || '.corp.example,www.example.org' AS domains FROM a"),
    "ioc_extraction": q(A, select="SELECT seq, '192.0.2.' || (seq % 200) || ',' || dest_ip AS ips, 'host-' || (user_id % 40) || '.corp.example' AS domains, md5(CAST(seq % 300 AS VARCHAR)) AS hashes FROM a"),
    "alert_indicators": q(A, L, select="SELECT seq, slot, ioc_type, ioc, CAST(pos AS INTEGER) AS pos FROM l"),
    "distinct_indicators": q(A, L, select="SELECT DISTINCT ioc_type, ioc FROM l"),
    "hash_kinds": "SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' ELSE 'none' END AS kind FROM events",
    "private_addresses": """SELECT event_id AS seq, CAST(CASE WHEN event_id % 260 > 255 THEN 0 WHEN event_id % 5 = 0 THEN 1
        WHEN event_id % 5 = 1 AND 14 + event_id % 20 BETWEEN 16 AND 31 THEN 1 WHEN event_id % 5 = 2 AND event_id % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS private FROM events""",
    "provider_scores": q(A, L, REP, select="""SELECT ioc_type, ioc, 'abuseipdb' AS provider, s_ab AS score FROM q WHERE ab
        UNION ALL SELECT ioc_type, ioc, 'virustotal', s_vt FROM q WHERE vt UNION ALL SELECT ioc_type, ioc, 'otx', s_ox FROM q WHERE ox"""),
    "verdicts": """SELECT seq, score, CASE WHEN score >= 50 THEN 'malicious' WHEN score >= 20 THEN 'suspicious' WHEN score IS NULL THEN 'unknown' ELSE 'clean' END AS verdict
        FROM (SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) END AS score FROM events)""",
    "ip_reputations": q(A, L, REP, select="SELECT ioc_type, ioc, \"type\", providers, verdict, score FROM rep WHERE ioc_type = 'ip'"),
    "domain_reputations": q(A, L, REP, select="SELECT ioc_type, ioc, \"type\", providers, verdict, score FROM rep WHERE ioc_type = 'domain'"),
    "hash_reputations": q(A, L, REP, select="""SELECT ioc, "type", verdict, score, 'name' || n || '-1,name' || n || '-2,name' || n || '-3,name' || n || '-4,name' || n || '-5' AS names FROM rep WHERE ioc_type = 'hash'"""),
    "private_short_circuit": q(A, L, REP, att(), select="""SELECT seq, ioc, CAST(verdict = 'private/internal' AS INTEGER) AS private,
        CAST(CASE WHEN providers = '' THEN 0 ELSE len(string_split(providers, ',')) END AS INTEGER) AS n_providers FROM att WHERE slot = 'src_ip'"""),
    "unknown_reputations": q(A, L, REP, att(), select="""SELECT ioc_type, ioc, count(*) AS alerts, CAST(max(CASE WHEN has_report THEN 0 ELSE 1 END) AS INTEGER) AS no_report FROM att WHERE verdict = 'unknown' GROUP BY ioc_type, ioc"""),
    "attached_reputations": q(A, L, REP, att(), select="SELECT seq, slot, ioc, verdict, score, providers FROM att"),
    "nested_enrichment": q(A, L, REP, att(), select="""SELECT seq, max(verdict) FILTER (slot = 'src_ip') AS src_verdict, max(verdict) FILTER (slot = 'dest_ip') AS dest_verdict,
        max(verdict) FILTER (slot = 'domains') AS domain_verdict, CAST(count(*) FILTER (slot = 'hashes') AS INTEGER) AS n_hashes FROM att GROUP BY seq"""),
    "fresh_reputations": q(A, L, REP, FRESH, select="SELECT ioc_type, ioc, CAST(1 AS INTEGER) AS cached FROM fresh"),
    "reputation_upsert": q(A, L, REP, select="""SELECT ioc_type, ioc, CASE WHEN ioc_type <> 'domain' AND NOT (answered AND fetched_at > TIMESTAMP '2024-01-31 00:10:00') THEN 'old' ELSE verdict END AS verdict
        FROM rep WHERE ioc_type <> 'domain' OR answered"""),
    "lookup_requests": q(A, L, REP, FRESH, select="""SELECT DISTINCT l.ioc_type, l.ioc FROM l LEFT JOIN fresh USING (ioc_type, ioc) WHERE fresh.n IS NULL AND NOT (l.ioc_type = 'ip' AND l.ioc LIKE '10.%')"""),
    "event_times": q(A, select="""SELECT seq, CASE seq % 6 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts) - INTERVAL 2 HOUR)
        WHEN 3 THEN epoch_us(date_trunc('day', ts)) END AS ts_us, CAST(CASE seq % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS ts_zone
        FROM (SELECT seq, CAST(ts AS TIMESTAMP) AS ts FROM a)"""),
    "window_test": q(A, select="SELECT seq, CAST(CASE WHEN seq % 7 = 0 OR seq % 4 = 0 THEN 0 WHEN abs(seq % 5 - 2) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS within FROM a"),
    "gap_islands_by_pair": q(A, select="""SELECT seq, src_ip, dest_ip, CAST(sum(c) OVER (PARTITION BY src_ip, dest_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip, dest_ip ORDER BY ts) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS c FROM a)"""),
    "dedup_exact": q(A, groups("signature"), select=GROUPS),
    "dedup_fuzzy": q(A, groups(), select=GROUPS),
    "dedup_unordered": q(A, UNORDERED, select="SELECT p.g AS group_seq, p.s AS seq FROM (SELECT unnest(last.placed) AS p FROM h)"),
    "dedup_mixed_times": q(A, MIXED_TIMES, select=MIXED_GROUPS),
    "dedup_many_signatures": q(A, groups("(user_id % 20) || '-' || signature", src="1", dest="1"), select=GROUPS),
    "dedup_time_order": q(A, groups(), select="SELECT (group_seq % 7) * 1000000000 + group_seq AS group_seq, occurrence_count, first_seen, last_seen FROM g"),
    "dedup_without_addresses": q(A, groups(src="1", dest="1"), select=GROUPS),
    "dedup_members": q(A, groups(), select="SELECT group_seq, seq, id FROM mem"),
    "related_ids": q(A, groups(), select="SELECT group_seq, string_agg(id, ',' ORDER BY seq) AS related_ids FROM mem GROUP BY group_seq"),
    "representatives": q(A, groups(), FIRST, select="SELECT seq, id, signature, severity, src_ip, dest_ip, occurrence_count, first_seen, last_seen, bucket_seq FROM f"),
    "no_dedup": "SELECT event_id AS seq, CAST(1 AS INTEGER) AS occurrence_count FROM events",
    "enrichment_verdicts": q(A, L, REP, att(), select="SELECT seq, count(*) AS results, count(*) FILTER (verdict = 'malicious') AS malicious FROM att GROUP BY seq"),
    "confidence": q(A, L, REP, att(), CONF, select="""SELECT seq, CAST(n AS INTEGER) AS result_count, CAST(CAST(has_ab AS INT) + CAST(has_ox AS INT) + CAST(has_vt AS INT) AS INTEGER) AS provider_count,
        array_to_string(list_filter([CASE WHEN has_ab THEN 'abuseipdb' END, CASE WHEN has_ox THEN 'otx' END, CASE WHEN has_vt THEN 'virustotal' END], lambda x: x IS NOT NULL), ',') AS providers,
        CAST(mal AS INTEGER) AS malicious_count, CAST(sus AS INTEGER) AS suspicious_count, consensus, confidence, CAST((mal * 4 + sus * 2) * 2 AS BIGINT) AS intel_points FROM cons"""),
    "asset_points": q(A, W, select="""SELECT seq, CAST(coalesce(w1.weight, 0) + coalesce(w2.weight, 0) + coalesce(w3.weight, 0) AS INTEGER) AS asset_points FROM a
        LEFT JOIN w w1 ON w1.asset = a.src_ip LEFT JOIN w w2 ON w2.asset = a.dest_ip LEFT JOIN w w3 ON w3.asset = a.source"""),
    "scores": q(A, L, REP, att(), CONF, W, scored("a"), select="SELECT seq, priority_score FROM tr"),
    "tiers": q(A, L, REP, att(), CONF, W, scored("a"), select="SELECT seq, priority_tier FROM tr"),
    "threat_intelligence": q(A, L, REP, att(), CONF, select="SELECT seq, verdict, consensus, confidence FROM cons"),
    "priority_order": q(*TRIAGE, select="""SELECT id, priority_tier, CAST(row_number() OVER (PARTITION BY priority_tier ORDER BY priority_score DESC, bucket_seq, seq) AS INTEGER) AS rank FROM tr"""),
    "full_triage": q(*TRIAGE, select=f"SELECT {TRIAGE_COLS}, techniques, verdict FROM tr"),
    "fresh_triage": q(A, L, REP, FRESH, att("fresh"), CONF, W, groups(), FIRST, scored("f", occurrences="a.occurrence_count"), select=f"SELECT {TRIAGE_COLS} FROM tr"),
    "triage_given_alerts": q(A, L, REP, att(), CONF, W, groups(), FIRST, scored("f", severity="CASE WHEN a.seq % 10 > 0 THEN a.severity ELSE 5 END", mitre=False, occurrences="a.occurrence_count"),
        select=f"SELECT {TRIAGE_COLS} FROM tr"),
    "jsonl_alerts": q(A, select="""SELECT id, "timestamp", source, signature, severity, src_ip, dest_ip, "user", message, 1 AS n_seq FROM a"""),
    "pipeline_rejects": q(A, DIRTY, select="SELECT seq, reason FROM d WHERE reason IS NOT NULL"),
    "pipeline_members": q(A, groups(), select="SELECT group_seq, seq, id FROM mem"),
    "pipeline_lookups": q(A, L, REP, FRESH, groups(), select="""SELECT DISTINCT l.ioc_type, l.ioc FROM l JOIN g ON l.seq = g.group_seq LEFT JOIN fresh USING (ioc_type, ioc)
        WHERE fresh.n IS NULL AND NOT (l.ioc_type = 'ip' AND l.ioc LIKE '10.%')"""),
    "unvalidated_triage": "SELECT count(*) AS alerts, CAST(0 AS INTEGER) AS rejected FROM events",
    "signature_matches": q(A, groups(), select="""SELECT DISTINCT l.signature AS group_signature, m.signature AS signature,
        CASE WHEN l.signature = m.signature THEN 1.0 ELSE 0.965517 END AS ratio, CAST(1 AS INTEGER) AS match FROM mem m JOIN a l ON l.seq = m.group_seq"""),
    "analyze_files": q(A, L, REP, att(), CONF, FILED, FOLD, FILED_SCORES, select="SELECT id, signature, priority_score, priority_tier, occurrence_count FROM tr"),
    "tier_counts": q(*TRIAGE, select="""SELECT tier, (SELECT count(*) FROM tr WHERE tier = 'total' OR priority_tier = tier) AS alerts FROM (VALUES ('P1'), ('P2'), ('P3'), ('P4'), ('total')) t(tier)"""),
    "top_incident": q(*TRIAGE, select="""SELECT signature, priority_tier, CAST(priority_score AS VARCHAR) AS priority_score, src_ip, dest_ip,
        CASE WHEN techniques = '' THEN 'No MITRE technique matched' ELSE array_to_string(list_transform(string_split(techniques, ','), lambda x: x || ' — ' || CASE x WHEN 'T1110' THEN 'Brute Force'
          WHEN 'T1136' THEN 'Create Account' WHEN 'T1071' THEN 'Application Layer Protocol' WHEN 'T1046' THEN 'Network Service Discovery' ELSE 'Exfiltration Over C2 Channel' END), ', ') END AS mitre_attack
        FROM tr ORDER BY tr.priority_score DESC, bucket_seq, seq LIMIT 1"""),
    "summary_lines": q(*TRIAGE, LINES, select="SELECT section, replace(line, chr(10), '') AS line FROM lines"),
    "summary_ranked": q(*TRIAGE, LINES, NUMBERED, select="SELECT line_no, section, replace(line, chr(10), '') AS line FROM numbered"),
    "summary_text": q(*TRIAGE, LINES, NUMBERED, select="""SELECT line_no // 50 AS part, CAST(sum(length(line)) + count(*) - 1 AS INTEGER) AS n_chars,
        CAST(count(*) + count(*) FILTER (starts_with(line, chr(10))) AS INTEGER) AS n_lines FROM numbered GROUP BY line_no // 50"""),
    "empty_summary": "SELECT 'No alerts to summarize.' AS summary",
    "compact_top": q(*TRIAGE, select="""SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, bucket_seq, seq) AS INTEGER) AS rank, id, priority_score,
        (SELECT verdict FROM att WHERE att.seq = tr.seq AND slot = 'dest_ip') AS dest_verdict, CAST(length(message) AS INTEGER) AS n_message FROM tr ORDER BY priority_score DESC, bucket_seq, seq LIMIT 25"""),
    "triage_listing": q(*TRIAGE, select="SELECT priority_tier AS priority, CAST(priority_score AS VARCHAR) AS score, signature, src_ip AS source, dest_ip AS target FROM tr"),
    "stream_normalize": q(A, select=f"""SELECT *, count(*) AS n_seq, count(*) AS n_id FROM (
        SELECT "timestamp", 'Acme/' || source AS source, severity, src_ip, dest_ip, message FROM a WHERE (seq // 500) % 2 = 0
        UNION ALL SELECT {SYSLOG_TIME}, source, 5, src_ip, dest_ip, {SYSLOG_MESSAGE} FROM a WHERE (seq // 500) % 2 = 1) GROUP BY ALL"""),
    "stream_dedup_exact": q(A, groups("signature"), select="""SELECT g.group_seq, m.src_ip, m.dest_ip, m.signature, g.occurrence_count, g.first_seen, g.last_seen FROM g JOIN a m ON m.seq = g.group_seq"""),
    "stream_dedup_fuzzy": q(A, groups(), select="SELECT group_seq, occurrence_count, first_seen, last_seen FROM g"),
    "stream_reputation_join": q(A, L, REP, FRESH, att("fresh"), select="SELECT seq, slot, ioc, verdict, score FROM att"),
}
