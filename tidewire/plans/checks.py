"""Building blocks of the SQL checks (DuckDB): the derived inputs as common table expressions."""

from __future__ import annotations

PACKETS = """packets AS (
SELECT event_id AS packet_id, epoch_us(ts) // 1000 AS ts_ms,
       CASE WHEN event_id % 3 = 0 THEN srv ELSE cli END AS src_ip,
       CASE WHEN event_id % 3 = 0 THEN cli ELSE srv END AS dst_ip,
       CASE WHEN proto = 'ICMPv4' THEN NULL WHEN event_id % 3 = 0 THEN sport ELSE cport END AS src_port,
       CASE WHEN proto = 'ICMPv4' THEN NULL WHEN event_id % 3 = 0 THEN cport ELSE sport END AS dst_port,
       proto AS protocol,
       54 + CAST(floor(value) AS INT) AS length,
       proto = 'TCP' AND event_type = 'signup' AS syn,
       proto = 'TCP' AND event_type = 'purchase' AS fin,
       proto = 'TCP' AND event_type = 'error' AS rst,
       proto = 'TCP' AND event_type IN ('click', 'view', 'purchase') AS ack,
       proto = 'TCP' AND event_type = 'view' AS psh
FROM (SELECT *,
        '10.' || CAST((user_id // 256) % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.10' AS cli,
        CASE user_id % 8 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '1.1.1.1' WHEN 2 THEN '192.168.1.8'
             WHEN 3 THEN '172.16.0.5' WHEN 4 THEN '172.40.0.5' WHEN 5 THEN '93.184.216.34'
             WHEN 6 THEN '192.168.1.1' ELSE '203.0.113.9' END AS srv,
        CASE user_id % 8 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 WHEN 3 THEN 80
             WHEN 4 THEN 443 WHEN 5 THEN 8080 WHEN 6 THEN 502 ELSE 123 END AS sport,
        1024 + (user_id * 7) % 60000 AS cport,
        CASE user_id % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'TCP' WHEN 2 THEN 'UDP' ELSE 'ICMPv4' END AS proto
      FROM events))"""

KEYED = """keyed AS (
SELECT *, least(directed, turned) AS flow_key FROM (
  SELECT *,
    concat_ws('_', src_ip, dst_ip, coalesce(src_port::VARCHAR, 'null'), coalesce(dst_port::VARCHAR, 'null'),
              coalesce(protocol, 'UNKNOWN')) AS directed,
    concat_ws('_', dst_ip, src_ip, coalesce(dst_port::VARCHAR, 'null'), coalesce(src_port::VARCHAR, 'null'),
              coalesce(protocol, 'UNKNOWN')) AS turned
  FROM packets))"""

RUNS = """p AS MATERIALIZED (
SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts_ms, packet_id) AS rn,
       CASE protocol WHEN 'TCP' THEN 43200000 WHEN 'UDP' THEN 32400000 ELSE 21600000 END AS idle,
       CASE protocol WHEN 'TCP' THEN 172800000 WHEN 'UDP' THEN 129600000 ELSE 86400000 END AS age
FROM keyed),
r AS (
SELECT flow_key, rn, ts_ms, ts_ms AS first_ms, 0 AS flow_seq, rst AS closed FROM p WHERE rn = 1
UNION ALL
SELECT p.flow_key, p.rn, p.ts_ms,
  CASE WHEN r.closed OR p.ts_ms - r.ts_ms >= p.idle OR p.ts_ms - r.first_ms >= p.age THEN p.ts_ms ELSE r.first_ms END,
  r.flow_seq + CASE WHEN r.closed OR p.ts_ms - r.ts_ms >= p.idle OR p.ts_ms - r.first_ms >= p.age THEN 1 ELSE 0 END,
  p.rst AND p.ts_ms = CASE WHEN r.closed OR p.ts_ms - r.ts_ms >= p.idle OR p.ts_ms - r.first_ms >= p.age
                           THEN p.ts_ms ELSE r.first_ms END
FROM r JOIN p ON p.flow_key = r.flow_key AND p.rn = r.rn + 1),
placed AS MATERIALIZED (
SELECT p.*, r.flow_seq::BIGINT AS flow_seq, r.closed,
       p.ts_ms - lag(p.ts_ms) OVER (PARTITION BY p.flow_key, r.flow_seq ORDER BY p.rn) AS gap
FROM p JOIN r ON p.flow_key = r.flow_key AND p.rn = r.rn)"""

FLOWS = """ends AS MATERIALIZED (
SELECT flow_key, flow_seq, arg_min(src_ip, rn) AS src_ip, arg_min(dst_ip, rn) AS dst_ip,
       arg_min(coalesce(src_port, -1), rn) AS sp, arg_min(coalesce(dst_port, -1), rn) AS dp,
       min(protocol) AS protocol, min(ts_ms) AS first_seen_ms, max(ts_ms) AS last_seen_ms,
       arg_min(packet_id, rn) AS first_packet_id, arg_max(closed, rn) AS closed, min(idle) AS idle
FROM placed GROUP BY flow_key, flow_seq),
ended AS MATERIALIZED (
SELECT *, CASE WHEN closed THEN 'TCP RST'
               WHEN nxt IS NULL THEN 'PCAP_DONE'
               WHEN nxt - last_seen_ms >= idle THEN 'Inactivity Timeout' ELSE 'Max Age Exceeded' END AS end_reason
FROM (SELECT *, lead(first_seen_ms) OVER (PARTITION BY flow_key ORDER BY flow_seq) AS nxt FROM ends)),
sums AS MATERIALIZED (
SELECT flow_key, flow_seq, count(*) AS n, sum(length)::BIGINT AS bytes, min(length)::BIGINT AS min_len,
       max(length)::BIGINT AS max_len, avg(length) AS mean_len, stddev_samp(length) AS std_len,
       sum(CASE WHEN placed.src_ip = e.src_ip THEN length ELSE 0 END)::BIGINT AS up_b,
       sum(CASE WHEN placed.src_ip <> e.src_ip AND placed.dst_ip = e.src_ip THEN length ELSE 0 END)::BIGINT AS down_b,
       count(*) FILTER (placed.src_ip = e.src_ip) AS up_n,
       count(*) FILTER (placed.src_ip <> e.src_ip AND placed.dst_ip = e.src_ip) AS down_n,
       min(gap) AS gap_min, max(gap) AS gap_max, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std,
       count(*) FILTER (syn) AS syn_count, count(*) FILTER (fin) AS fin_count, count(*) FILTER (rst) AS rst_count,
       count(*) FILTER (ack) AS ack_count, count(*) FILTER (psh) AS psh_count,
       count(*) FILTER (placed.protocol = 'TCP') AS tcp_n, count(*) FILTER (placed.protocol = 'UDP') AS udp_n
FROM placed JOIN ended e USING (flow_key, flow_seq) GROUP BY flow_key, flow_seq),
flows AS MATERIALIZED (
SELECT flow_key, flow_seq, src_ip, dst_ip, CASE WHEN sp >= 0 THEN sp END AS src_port,
  CASE WHEN dp >= 0 THEN dp END AS dst_port, protocol, first_seen_ms, last_seen_ms, end_reason, first_packet_id,
  n AS packet_count, bytes, last_seen_ms - first_seen_ms AS duration_ms,
  min_len AS min_packet_length, max_len AS max_packet_length, mean_len AS mean_packet_length,
  CASE WHEN n = 1 THEN 'NaN'::DOUBLE ELSE std_len END AS stddev_packet_length,
  CASE WHEN first_seen_ms = last_seen_ms THEN 0.0::DOUBLE ELSE bytes * 1000 / (last_seen_ms - first_seen_ms) END
    AS bytes_per_second,
  CASE WHEN first_seen_ms = last_seen_ms THEN 0.0::DOUBLE ELSE n * 1000 / (last_seen_ms - first_seen_ms) END
    AS packets_per_second,
  up_b AS total_bytes_upstream, down_b AS total_bytes_downstream, up_n AS total_packets_upstream,
  down_n AS total_packets_downstream,
  CASE WHEN down_b > 0 THEN up_b / down_b ELSE 1.0::DOUBLE END AS ratio_bytes_up_down,
  CASE WHEN down_n > 0 THEN up_n / down_n ELSE 1.0::DOUBLE END AS ratio_packets_up_down,
  CASE WHEN up_b + down_b > 0 THEN least(up_b, down_b) / greatest(up_b, down_b) ELSE 1.0::DOUBLE END AS flow_symmetry,
  coalesce(gap_min, 0) AS inter_arrival_time_min, coalesce(gap_max, 0) AS inter_arrival_time_max,
  coalesce(gap_mean, 0.0::DOUBLE) AS inter_arrival_time_mean,
  CASE WHEN n = 1 THEN 0.0::DOUBLE WHEN n = 2 THEN 'NaN'::DOUBLE ELSE gap_std END AS inter_arrival_time_stddev,
  syn_count, fin_count, rst_count, ack_count, psh_count,
  tcp_n / n AS tcp_fraction, udp_n / n AS udp_fraction, (n - tcp_n - udp_n) / n AS other_fraction,
  CASE WHEN tcp_n > 0 THEN syn_count / tcp_n ELSE 0.0::DOUBLE END AS syn_rate,
  CASE WHEN tcp_n > 0 THEN fin_count / tcp_n ELSE 0.0::DOUBLE END AS fin_rate,
  CASE WHEN tcp_n > 0 THEN rst_count / tcp_n ELSE 0.0::DOUBLE END AS rst_rate,
  CASE WHEN tcp_n > 0 THEN ack_count / tcp_n ELSE 0.0::DOUBLE END AS ack_rate,
  CASE WHEN tcp_n > 0 THEN psh_count / tcp_n ELSE -1.0::DOUBLE END AS psh_rate
FROM ended JOIN sums USING (flow_key, flow_seq))"""

RISKY = """risky AS (
SELECT *,
  coalesce(nullif(concat_ws(', ',
    CASE WHEN m & 1 > 0 THEN 'Known proto on non-std port' END, CASE WHEN m & 2 > 0 THEN 'TLS suspicious' END,
    CASE WHEN m & 8 > 0 THEN 'Malformed packet' END, CASE WHEN m & 16 > 0 THEN 'Clear-text credentials' END,
    CASE WHEN m & 32 > 0 THEN 'Unlisted' END), ''), 'No risk') AS risk_label,
  CASE WHEN m & 18 > 0 THEN 'High' WHEN m & 1 > 0 THEN 'Medium' WHEN m & 8 > 0 THEN 'Low'
       WHEN m & 32 > 0 THEN 'Unknown severity' ELSE 'No risk' END AS risk_severity
FROM (SELECT *, (packet_count % 4) | ((bytes % 8) << 3) AS m FROM flows))"""

LABELLED = """labelled AS (
SELECT *, CASE WHEN label = 'MALICIOUS' THEN 1 ELSE 0 END AS y,
  ((bytes * 31 + packet_count * 17) % 1000) / 1000.0::DOUBLE AS score
FROM (SELECT *, CASE
    WHEN src_ip IN ('172.16.0.5', '203.0.113.9', '198.51.100.77')
      OR dst_ip IN ('172.16.0.5', '203.0.113.9', '198.51.100.77') THEN 'MALICIOUS'
    WHEN flow_seq % 5 = 0 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label FROM flows))"""

RULED = """ruled AS (SELECT *, CASE WHEN y = 1 THEN 'MALICIOUS' ELSE 'BENIGN' END AS label
FROM (SELECT *, ((packet_count >= 3) <> (syn_count >= 1))::INT AS y FROM flows))"""

REFERENCE = """geo(s, e, country) AS (VALUES ('8.8.8.0', '8.8.8.255', 'United States'),
  ('1.1.1.0', '1.1.1.255', 'Australia'), ('93.184.216.0', '93.184.216.255', 'United States'),
  ('172.40.0.0', '172.40.255.255', 'Canada')),
asn(s, e, org) AS (VALUES ('8.8.8.0', '8.8.8.255', 'ORG-A'), ('1.1.1.0', '1.1.1.255', 'ORG-B'),
  ('93.184.216.0', '93.184.216.255', 'ORG-C'), ('172.40.0.0', '172.40.255.255', 'ORG-D')),
rdns(ip, host) AS (VALUES ('8.8.8.8', 'dns.a.example'), ('1.1.1.1', 'one.b.example')),
whois(ip, org) AS (VALUES ('8.8.8.8', 'Org A Inc'), ('93.184.216.34', 'Org C: Labs')),
coords(country, lat, lon) AS (VALUES ('United States', 38.0::DOUBLE, -97.0::DOUBLE),
  ('Australia', -27.0::DOUBLE, 133.0::DOUBLE), ('Canada', 60.0::DOUBLE, -95.0::DOUBLE)),
ips AS (SELECT DISTINCT ip,
    split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536
    + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS num,
    ip LIKE '10.%' OR ip LIKE '192.168.%' OR (ip LIKE '172.%' AND split_part(ip, '.', 2)::INT BETWEEN 16 AND 31)
      AS private
  FROM (SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets)),
g AS (SELECT country, split_part(s, '.', 1)::BIGINT * 16777216 + split_part(s, '.', 2)::BIGINT * 65536
    + split_part(s, '.', 3)::BIGINT * 256 + split_part(s, '.', 4)::BIGINT AS lo,
    split_part(e, '.', 1)::BIGINT * 16777216 + split_part(e, '.', 2)::BIGINT * 65536
    + split_part(e, '.', 3)::BIGINT * 256 + split_part(e, '.', 4)::BIGINT AS hi, org
  FROM geo JOIN asn USING (s, e)),
facts AS (SELECT ips.ip,
    CASE WHEN private THEN 'Private IP' ELSE coalesce(g.country, 'Private IP') END AS country,
    CASE WHEN private THEN 'Private IP' ELSE coalesce(g.org, 'Private IP') END AS asn_org,
    coalesce(host, ips.ip) AS domain,
    coalesce(whois.org, CASE WHEN private THEN 'Private IP' ELSE coalesce(g.org, 'Private IP') END) AS org
  FROM ips LEFT JOIN g ON num BETWEEN lo AND hi LEFT JOIN rdns ON rdns.ip = ips.ip
  LEFT JOIN whois ON whois.ip = ips.ip)"""

KINDS = """kinds AS (SELECT *, CASE packet_id % 16 WHEN 0 THEN 'ARP' WHEN 1 THEN 'IPv6' WHEN 2 THEN 'VLAN'
  WHEN 3 THEN 'odd' WHEN 4 THEN 'short' ELSE 'IPv4' END AS kind FROM packets)"""

# One frame in sixteen is ARP, the others are the packets.
ARRIVED = PACKETS.replace("packets AS (", "arrived AS (", 1) + """,
packets AS (SELECT * FROM arrived WHERE packet_id % 16 <> 0)"""

_ORDER = {"packets": [PACKETS], "kinds": [PACKETS, KINDS], "keyed": [PACKETS, KEYED],
          "placed": [PACKETS, KEYED, RUNS], "flows": [PACKETS, KEYED, RUNS, FLOWS],
          "risky": [PACKETS, KEYED, RUNS, FLOWS, RISKY], "labelled": [PACKETS, KEYED, RUNS, FLOWS, LABELLED],
          "ruled": [PACKETS, KEYED, RUNS, FLOWS, RULED],
          "arrived": [ARRIVED, KEYED, RUNS, FLOWS, REFERENCE],
          "facts": [PACKETS, REFERENCE], "enriched": [PACKETS, KEYED, RUNS, FLOWS, REFERENCE]}


def sql(source: str, body: str, *more: str) -> str:
    """``body`` over the derived input ``source``; ``more`` are further table expressions."""
    return "WITH RECURSIVE " + ",\n".join([*_ORDER[source], *more]) + "\n" + body
