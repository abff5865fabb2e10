"""For each query the SQL that gives the same rows over the same tables."""

from __future__ import annotations

_EVENTS = """e AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    (65500 + event_id // 100 + event_id % 3) % 65536 AS seq FROM events)"""

_SESSIONS = f"""{_EVENTS},
b AS (SELECT *, CASE WHEN coalesce(lag(event_type = 'error') OVER w, false) OR coalesce(us - lag(us) OVER w > 86400000000, false)
    THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM b),
i AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_call FROM s),
c AS (SELECT user_id, CAST(seg AS BIGINT) AS call_seq, min(us) AS start_us, max(us) AS last_us, count(*) AS n_rows,
    bool_or(event_type = 'error') AS closed,
    count(*) FILTER (event_type IN ('signup', 'error')) AS sip_packets,
    arg_min(event_id, event_id) FILTER (event_type = 'signup') AS first_id FROM i WHERE in_call = 1 GROUP BY 1, 2),
calls AS (SELECT *, CASE WHEN closed THEN 'finished'
    WHEN (SELECT max(us) FROM e) - last_us > 86400000000 THEN 'timedout' ELSE 'active' END AS state FROM c)"""


def _sequence(source: str, keys: str) -> str:
    """Stream statistics of ``source`` (us, ts, event_id, seq and keys) as the relation ``stats``."""
    return f"""
q1 AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN 0
      ELSE (seq - lag(seq) OVER w + 32768 + 65536) % 65536 - 32768 END AS d, us - lag(us) OVER w AS delta_us
    FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id)),
q2 AS (SELECT *, first_value(seq) OVER w + sum(d) OVER w AS ext
    FROM q1 WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
q3 AS (SELECT *, coalesce(ext < max(ext) OVER (PARTITION BY {keys} ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late,
    row_number() OVER (PARTITION BY {keys}, ext ORDER BY ts, event_id) AS nth,
    row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM q2),
stats AS (SELECT {keys}, count(*) AS packet_count,
    CAST(greatest(max(ext) - max(ext) FILTER (rn = 1) + 1 - count(DISTINCT ext), 0) AS BIGINT) AS lost_packets,
    count(*) FILTER (nth = 1 AND late) AS out_of_order_count,
    count(*) - count(DISTINCT ext) AS duplicate_count,
    greatest(coalesce(max(delta_us), 0), 0) / 1000.0::DOUBLE AS max_delta_ms,
    coalesce(min(delta_us), 0) / 1000.0::DOUBLE AS min_delta_ms,
    CASE WHEN count(delta_us) > 0 THEN CAST(sum(delta_us) AS DOUBLE) / count(delta_us) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_delta_ms
    FROM q3 GROUP BY {keys})"""


_STATS = f"{_EVENTS}, {_sequence('e', 'user_id')}"

_UPSERT = """
ops AS (
  SELECT c_custkey AS call_id, substr(c_name, 1, CAST(c_custkey % 18 AS INT)) AS sip_from, '' AS s3_location, 0 AS ended, 0 AS started,
    CASE WHEN c_custkey % 4 = 0 THEN 'active' ELSE 'finished' END AS state, 'stored' AS kind, -1 AS pos FROM customer WHERE c_custkey % 2 = 0
  UNION ALL
  SELECT o_custkey, o_orderpriority || repeat('x', CAST(o_orderkey % 7 AS INT)),
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 's3://b/' || o_orderkey END,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey END, o_orderkey,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'active' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'timedout' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'insert' END, o_orderkey FROM orders),
made AS (SELECT *, min(CASE WHEN kind <> 'update' THEN pos END) OVER (PARTITION BY call_id) AS made_at FROM ops),
live AS (SELECT *, pos = made_at AS creates FROM made WHERE pos >= made_at),
st AS (SELECT *, last_value(CASE WHEN creates OR kind = 'update' THEN state END IGNORE NULLS)
    OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before FROM live),
app AS (SELECT * FROM st WHERE creates OR kind = 'update' OR state_before = 'active')"""

_FRAGMENTS = """
d AS (SELECT doc_id, text, strlen(text) AS size, CAST(ceil(greatest(strlen(text), 1) / 1480.0) AS BIGINT) AS n FROM documents),
t AS (SELECT *, doc_id % 5 = 0 AND n > 1 AS twice, doc_id % 9 = 0 AS lacks,
    doc_id % 5 = 0 AND n > 1 AND doc_id % 9 <> 0 AND doc_id % 2 = 1 AS late_copy FROM d),
-- A copy that comes after its datagram was complete opens a new one that never ends.
f AS (SELECT doc_id, n + CASE WHEN twice AND NOT late_copy THEN 1 ELSE 0 END - CASE WHEN lacks THEN 1 ELSE 0 END AS n_fragments,
      NOT lacks AS whole, size, text FROM t
  UNION ALL SELECT doc_id, 1, false, size, text FROM t WHERE late_copy)"""


_REASSEMBLED = f"""WITH {_FRAGMENTS} SELECT doc_id, n_fragments, CASE WHEN whole THEN 'reassembled' ELSE 'timeout' END AS status,
    CASE WHEN whole THEN CAST(size AS INT) END AS size, CASE WHEN whole THEN md5(text) END AS digest FROM f WHERE n_fragments > 0"""


#: Bytes of the frame made of an event; `body` is the length of its session description.
_FRAME_SIZE = """CAST(CASE WHEN event_type IN ('signup', 'error') THEN
              42 + 2 * length('user-' || user_id) - length('user-' || user_id)
              + length(CASE WHEN event_type = 'signup' THEN 'INVITE' ELSE 'BYE' END || ' sip:b SIP/2.0')
              + length(CAST(event_id AS VARCHAR))
              + length('....Via: SIP/2.0/UDP x..Call-ID: ..f: <sip:u>;tag=..To:  <sip:b> ..Content-Length: ') - 2
              + length(CAST(body AS VARCHAR)) + 2 + 2 + body
            ELSE 58 END AS INT)"""


def oracle_sql() -> dict[str, str]:
    sessions = f"WITH {_SESSIONS} "
    in_calls = f"""WITH {_SESSIONS}, m AS (SELECT i.*, i.seg AS call FROM i WHERE in_call = 1 AND event_type NOT IN ('signup', 'error')),
        {_sequence('m', 'user_id, call')}"""
    streams = in_calls + """ SELECT stats.user_id, start_us, packet_count, lost_packets, out_of_order_count, duplicate_count,
            max_delta_ms, min_delta_ms, avg_delta_ms, '10.1.0.0:9' AS src_endpoint,
            '10.2.' || (stats.user_id % 65536 // 256) || '.' || (stats.user_id % 256) || ':4000' AS dst_endpoint
            FROM stats JOIN calls ON stats.user_id = calls.user_id AND stats.call = calls.call_seq"""
    return {
        "sessionize_events": sessions + """SELECT user_id, call_seq, start_us, last_us,
            CASE WHEN state <> 'active' THEN last_us END AS end_us, n_rows, state FROM calls""",
        "closed_calls": sessions + """SELECT user_id, call_seq, CASE WHEN state = 'active' THEN (SELECT max(epoch_us(ts)) FROM events) ELSE last_us END AS end_us,
            CASE WHEN state = 'active' THEN 'finished' ELSE state END AS state FROM calls""",
        "null_groups": f"""WITH {_EVENTS}, g AS (SELECT * REPLACE (nullif(user_id % 7, 0) AS user_id) FROM e), {_sequence('g', 'user_id')}
            SELECT user_id, packet_count, max_delta_ms, min_delta_ms, avg_delta_ms FROM stats""",
        "state_counts": sessions + """SELECT count(*) AS total_calls, count(*) FILTER (state = 'active') AS active_calls,
            count(*) FILTER (state = 'finished') AS finished_calls, count(*) FILTER (state = 'timedout') AS timedout_calls FROM calls""",
        "active_calls": sessions + "SELECT user_id, start_us, n_rows FROM calls WHERE state = 'active' ORDER BY start_us DESC",
        "stream_sessionize": sessions + """SELECT user_id, start_us, CASE WHEN state <> 'active' THEN last_us END AS end_us, state FROM calls""",
        "expected_packets": sessions + """SELECT user_id, call_seq, user_id % 4 * 10 AS ptime_ms,
            CASE WHEN last_us > start_us THEN CAST(round((last_us - start_us) / 1000.0::DOUBLE /
                CASE WHEN user_id % 4 = 0 THEN 20 ELSE user_id % 4 * 10 END) AS BIGINT) ELSE 0 END AS expected_packets FROM calls""",
        "inter_arrival": f"WITH {_STATS} SELECT user_id, packet_count, max_delta_ms, min_delta_ms, avg_delta_ms FROM stats",
        "sequence_stats": f"WITH {_STATS} SELECT * FROM stats",
        "unwrap_sequence": f"WITH {_STATS} SELECT event_id, CAST(ext AS BIGINT) AS ext_seq, delta_us, late FROM q3",
        "worst_loss": f"WITH {_STATS} SELECT user_id, lost_packets, packet_count FROM stats WHERE lost_packets > 45 ORDER BY lost_packets DESC",
        "stream_endpoints": f"""WITH {_EVENTS} SELECT user_id,
            arg_min('10.0.0.' || k || ':' || (5000 + event_id % 100), event_id) AS src_endpoint,
            arg_min('10.1.0.' || (user_id % 250) || ':6000', event_id) AS dst_endpoint FROM e GROUP BY user_id""",
        "asof_attach": """WITH p AS (SELECT *, user_id % 16 AS endpoint FROM events WHERE event_type IN ('click', 'view')),
            r AS (SELECT *, user_id % 16 AS endpoint FROM events WHERE event_type = 'signup')
            SELECT p.event_id, p.endpoint, r.user_id AS owner FROM p ASOF JOIN r ON p.endpoint = r.endpoint AND p.ts >= r.ts""",
        "attach_media": """WITH r AS (SELECT s.event_id, s.ts, s.user_id AS owner, '10.0.0.' || (s.user_id % 64) AS ip, x.ts AS ended
              FROM events s ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') x ON s.user_id = x.user_id AND s.ts <= x.ts
              WHERE s.event_type = 'signup'),
            p AS (SELECT event_id, ts, '10.0.0.' || (event_id % 80) AS dst, '10.0.0.' || (user_id % 64) AS src
              FROM events WHERE event_type IN ('click', 'view')),
            a AS (SELECT p.*, CASE WHEN r.ended IS NULL OR p.ts <= r.ended THEN r.owner END AS by_dst
              FROM p ASOF LEFT JOIN r ON p.dst = r.ip AND p.ts >= r.ts),
            b AS (SELECT a.*, CASE WHEN r.ended IS NULL OR a.ts <= r.ended THEN r.owner END AS by_src
              FROM a ASOF LEFT JOIN r ON a.src = r.ip AND a.ts >= r.ts)
            SELECT event_id, coalesce(by_dst, by_src) AS owner, CASE WHEN by_dst IS NOT NULL THEN 'dst' ELSE 'src' END AS matched_by
            FROM b WHERE by_dst IS NOT NULL OR by_src IS NOT NULL""",
        "endpoint_intervals": """SELECT event_id, user_id % 16 AS endpoint, user_id, epoch_us(ts) AS from_us,
            lead(epoch_us(ts)) OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS to_us FROM events WHERE event_type = 'signup'""",
        "endpoint_first_seen": f"""WITH {_EVENTS} SELECT user_id, k % 20 AS endpoint, arg_min(us, event_id) AS first_us, min(event_id) AS first_event
            FROM e GROUP BY 1, 2""",
        "media_sessions": f"""WITH {_EVENTS}, x AS (SELECT user_id, k % 20 AS endpoint, min(event_id) AS first_event FROM e GROUP BY 1, 2)
            SELECT user_id, string_agg(CAST(endpoint AS VARCHAR), ',' ORDER BY first_event) AS endpoints FROM x GROUP BY 1""",
        "mirror_sessions": f"""WITH {_EVENTS} SELECT user_id, CAST(event_id % 3 AS INT) AS span_id, CAST(arg_min(k, event_id) AS INT) AS vlan, 1 AS version,
            min(us) AS first_us, count(*) AS packet_count FROM e WHERE event_id % 4 <> 0 GROUP BY 1, 2""",
        "capture_counters": f"""WITH {_EVENTS} SELECT count(*) AS received, count(*) FILTER (least(k, 60) < k) AS truncated,
            max(us) - min(us) AS duration_us FROM e""",
        "csv_format": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_timestamp,
            '0x' || printf('%08x', event_id * 65537) AS ssrc_hex, printf('%.2f', value) AS value_text FROM events""",
        "longest_text": """WITH x AS (SELECT conv_id, turn, text, strlen(text) AS bytes,
              row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn) AS rn FROM conversations)
            SELECT conv_id, turn, CAST(bytes AS INT) AS bytes, text AS longest FROM x WHERE rn = 1""",
        "calls_of_streams": """SELECT CAST(o_orderkey AS VARCHAR) AS call_id, o_orderpriority AS instance_id, epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) AS start_us,
            CASE WHEN o_orderstatus <> 'O' THEN epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) + o_orderkey END AS end_us,
            CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'finished' ELSE 'timedout' END AS state,
            CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'customer ' END || o_custkey AS sip_from FROM orders""",
        "calls_any_order": """WITH c AS (SELECT o_custkey AS custkey, o_orderkey AS pos, o_orderkey % 3 <> 0 AS upd, o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AS ends,
              o_orderpriority || repeat('x', CAST(o_orderkey % 7 AS INT)) AS sip_from, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 's3://b/' || o_orderkey END AS s3 FROM orders),
            m AS (SELECT custkey, min(pos) AS made FROM c WHERE NOT upd GROUP BY 1),
            t AS (SELECT c.*, pos = made AS creates, CASE WHEN ends THEN 'finished' ELSE 'active' END AS state FROM c JOIN m USING (custkey) WHERE pos >= made),
            b AS (SELECT *, last_value(CASE WHEN upd OR creates THEN state END IGNORE NULLS) OVER (PARTITION BY custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
            app AS (SELECT * FROM b WHERE upd OR creates OR before = 'active')
            SELECT custkey, max('from order ' || pos) FILTER (creates) AS pcap_filename, arg_max(sip_from, length(sip_from) * 1000000000000 - pos) AS sip_from,
              coalesce(arg_max(s3, pos) FILTER (s3 <> ''), '') AS s3_location, arg_max(state, pos) FILTER (upd OR creates) AS state,
              max(pos * 1000000) FILTER (ends) AS end_us, max(pos * 1000000) FILTER (upd OR creates) AS updated_us FROM app GROUP BY 1""",
        "upsert_orders": f"""WITH {_UPSERT} SELECT call_id, arg_max(sip_from, length(sip_from) * 1000000000000 - pos) AS sip_from,
            coalesce(arg_max(s3_location, pos) FILTER (s3_location <> ''), max(s3_location) FILTER (creates)) AS s3_location,
            arg_max(ended, pos) FILTER (ended IS NOT NULL AND (creates OR kind = 'update')) AS ended,
            max(started) FILTER (creates) AS started,
            arg_max(state, pos) FILTER (creates OR kind = 'update') AS state FROM app GROUP BY call_id""",
        "nest_streams": """SELECT l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey ||
            ',"lost_packets":' || CAST(l_quantity AS BIGINT) || '}', ',' ORDER BY l_linenumber, l_partkey, l_quantity) || ']' AS rtp_statistics FROM lineitem GROUP BY 1""",
        "nest_unnest": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS lost_packets FROM lineitem
            WHERE CAST(l_quantity AS BIGINT) > 40 ORDER BY 3 DESC""",
        "unnest_lines": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS lost_packets FROM lineitem
            WHERE CAST(l_quantity AS BIGINT) <= 3""",
        "call_lookup": """SELECT CAST(l_orderkey AS VARCHAR) AS call_id, 'a' AS sip_from, 'b' AS sip_to,
            '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"lost_packets":' ||
            CAST(l_quantity AS BIGINT) || '}', ',' ORDER BY l_linenumber, l_partkey, l_quantity) || ']' AS rtp_stats FROM lineitem WHERE l_orderkey = 7 GROUP BY 1""",
        "privacy_case": """WITH v AS (SELECT c_custkey, c_name AS n, c_mktsegment AS m, 'sip:' || c_nationkey || '@x' AS t FROM customer)
            SELECT c_custkey, true AS everything,
              regexp_matches(n, '[05]$') OR regexp_matches(m, '^BUILD') OR regexp_matches(t, 'sip:1[0-9]@') AS targets,
              NOT (regexp_matches(n, '7$') OR regexp_matches(m, 'AUTO.*E')) AS exceptions,
              CASE WHEN regexp_matches(n, '[2-4]$') THEN false ELSE true END AS both,
              false AS none FROM v""",
        "port_range": """WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus, CAST(l_orderkey % 65536 AS INT) AS src_port,
              CAST(l_partkey * 31 % 65536 AS INT) AS dst_port FROM lineitem)
            SELECT l_orderkey, l_linenumber, src_port, dst_port FROM x
            WHERE (src_port BETWEEN 5060 AND 5560 OR dst_port BETWEEN 5060 AND 5560) AND l_linestatus = 'O'""",
        "media_candidates": """WITH x AS (SELECT l_returnflag, l_orderkey % 65536 AS src_port, CAST(l_partkey * 31 % 65536 AS INT) AS port FROM lineitem)
            SELECT port, count(*) AS packets FROM x WHERE l_returnflag <> 'A' AND NOT (src_port BETWEEN 5060 AND 5560 OR port BETWEEN 5060 AND 5560) GROUP BY 1""",
        "id_list_filter": """SELECT s_suppkey, s_nationkey, s_suppkey || ',' || s_suppkey AS ids FROM supplier
            WHERE s_nationkey IN (1, 5, 10, 16) AND s_suppkey % 8 IN (1, 2, 3, 4, 5)""",
        "header_parse": """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'INVITE' WHEN role = 'assistant' THEN 'STATUS_200' ELSE 'BYE' END AS method,
            'conv-' || conv_id || '@é' AS call_id, '<sip:' || role || '>;tag=é' AS sip_from, 'B <sip:b>' AS sip_to,
            CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN strlen(text) + 100 ELSE strlen(text) END AS content_length,
            turn <> 0 AND role = 'assistant' AS is_answer,
            CASE WHEN turn % 4 <> 3 THEN text END AS body FROM conversations WHERE conv_id % 11 <> 5""",
        "sdp_parse": f"""WITH {_EVENTS}, x AS (
              SELECT event_id, 1 AS m_index, '10.0.' || (user_id % 256) || '.' || k AS ip, 10000 + event_id % 20000 AS port FROM e
              UNION ALL SELECT event_id, 2, '10.9.9.9', 30000 + event_id % 40000 FROM e WHERE event_id % 2 = 1 AND 30000 + event_id % 40000 <= 65535)
            SELECT event_id, m_index, ip, CAST(port AS INT) AS port, CAST(nullif(event_id % 5 * 10, 0) AS INT) AS ptime FROM x""",
        "output_names": """WITH x AS (SELECT c_custkey, substr(sha256(c_name), 1, 16) || '.pcap' AS filename FROM customer)
            SELECT c_custkey, filename, CASE c_custkey % 3 WHEN 0 THEN 's3://bucket/' || filename WHEN 1 THEN 's3://bucket/a/b/' || filename
            ELSE '' END AS s3_location FROM x""",
        "rtp_decode": f"""WITH {_EVENTS} SELECT event_id, CAST(seq AS INT) AS seq, event_id * 40009 % 4294967296 AS ssrc FROM e
            WHERE event_id % 10 <> 9 AND event_id % 13 <> 0""",
        "payload_zero": f"""WITH {_EVENTS}, x AS (SELECT *, event_id % 3 AS csrc, event_id % 2 AS padded, event_id // 2 % 2 AS ext FROM e)
            SELECT event_id, printf('%02x', 128 + csrc + padded * 32 + ext * 16) || '00' || printf('%04x', seq) || '00000000' || printf('%08x', event_id)
            || repeat('11223344', csrc) || CASE WHEN ext = 1 THEN 'abcd000155667788' ELSE '' END || repeat('00', k)
            || CASE WHEN padded = 1 THEN '00000004' ELSE '' END AS cleared FROM x""",
        "ip_decode": f"""WITH {_EVENTS} SELECT event_id, '10.0.' || (user_id % 65536 // 256) || '.' || (user_id % 256) || ':' || (1024 + event_id % 60000) AS src,
            '10.1.0.' || k || ':5060' AS dst, 'udp' AS proto, event_id % 65536 AS ip_id, event_id % 7 IN (0, 1) AS is_fragment, event_type AS payload FROM e""",
        "mirror_decode": f"""WITH {_EVENTS}, x AS (SELECT *, event_id % 4 AS kind FROM e WHERE event_id % 4 <> 3)
            SELECT event_id, CASE WHEN kind = 1 THEN 2 ELSE 1 END AS version,
              CAST(CASE WHEN kind = 0 THEN 0 ELSE event_id % 1024 END AS INT) AS span_id,
              CAST(CASE WHEN kind = 0 THEN 0 ELSE user_id % 4096 END AS INT) AS vlan,
              CAST(CASE WHEN kind = 1 THEN event_id % 2 ELSE 0 END AS INT) AS direction,
              CASE WHEN kind = 1 THEN event_id * 1009 % 4294967296 ELSE 0 END AS ts32,
              CAST(42 + length(event_type) AS INT) AS cap_len FROM x""",
        "fragment_reassembly": _REASSEMBLED,
        "stream_reassembly": _REASSEMBLED,
        "fragment_counters": f"""WITH {_FRAGMENTS} SELECT CAST(sum(n_fragments) AS BIGINT) AS total, count(*) FILTER (whole) AS reassembled,
            count(*) FILTER (NOT whole) AS timeout, 0 AS active, 0 AS dropped FROM f WHERE n_fragments > 0""",
        "call_analysis": sessions + """SELECT calls.user_id, start_us, last_us, state, sip_packets, n_rows - sip_packets AS media_packets, 30 AS ptime_ms,
            (SELECT '<sip:u>;tag=' || arg_max(event_id, length(CAST(event_id AS VARCHAR)) * 1000000000000 - event_id) FROM i
              WHERE in_call = 1 AND i.user_id = calls.user_id AND i.seg = calls.call_seq AND event_type IN ('signup', 'error')) AS sip_from,
            substr(sha256('user-' || calls.user_id), 1, 16) || '.pcap' AS output_filename FROM calls""",
        "stream_call_analysis": sessions + """SELECT calls.user_id, start_us, CASE WHEN state <> 'active' THEN last_us END AS end_us, state,
            (SELECT '<sip:u>;tag=' || arg_max(event_id, length(CAST(event_id AS VARCHAR)) * 1000000000000 - event_id) FROM i
              WHERE in_call = 1 AND i.user_id = calls.user_id AND i.seg = calls.call_seq AND event_type IN ('signup', 'error')) AS sip_from,
            substr(sha256('user-' || calls.user_id), 1, 16) || '.pcap' AS output_filename FROM calls""",
        "call_streams": streams,
        "stream_call_streams": streams,
        "call_index": sessions + """SELECT 'user-' || user_id AS call_id, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') AS start_timestamp,
            substr(sha256('user-' || user_id), 1, 16) || '.pcap' AS output_pcap_filename, '<sip:u>;tag=' || first_id AS sip_from, '<sip:b>' AS sip_to, '' AS s3_location FROM calls""",
        "call_statistics_table": in_calls + """ SELECT 'user-' || stats.user_id AS call_id, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') AS start_timestamp,
            substr(sha256('user-' || stats.user_id), 1, 16) || '.pcap' AS output_pcap_filename,
            (SELECT '<sip:u>;tag=' || arg_max(event_id, length(CAST(event_id AS VARCHAR)) * 1000000000000 - event_id) FROM i
              WHERE in_call = 1 AND i.user_id = stats.user_id AND i.seg = stats.call AND event_type IN ('signup', 'error')) AS sip_from, '<sip:b>' AS sip_to,
            '0x' || printf('%08x', stats.user_id) AS ssrc_hex, '10.1.0.0:9' AS src_rtp_endpoint,
            '10.2.' || (stats.user_id % 65536 // 256) || '.' || (stats.user_id % 256) || ':4000' AS dst_rtp_endpoint, CAST(packet_count AS VARCHAR) AS rtp_packet_count,
            CAST(CAST(greatest(round((CASE WHEN state <> 'active' THEN last_us ELSE (SELECT max(us) FROM e) END - start_us) / 1000.0::DOUBLE / 30), 0) AS BIGINT) AS VARCHAR) AS expected_rtp_packets,
            CAST(lost_packets AS VARCHAR) AS lost_packets, CAST(out_of_order_count AS VARCHAR) AS out_of_order_count, CAST(duplicate_count AS VARCHAR) AS duplicate_count,
            -- Half a hundredth goes up.
            printf('%d.%02d', CAST(round(max_delta_ms * 1000) AS BIGINT) // 1000, ((CAST(round(max_delta_ms * 1000) AS BIGINT) + 5) // 10) % 100) AS max_delta_ms,
            printf('%d.%02d', ((CAST(round(min_delta_ms * 1000) AS BIGINT) + 5) // 10) // 100, ((CAST(round(min_delta_ms * 1000) AS BIGINT) + 5) // 10) % 100) AS min_delta_ms,
            printf('%.2f', avg_delta_ms) AS avg_delta_ms, '30' AS ptime_ms, '' AS s3_location
            FROM stats JOIN calls ON stats.user_id = calls.user_id AND stats.call = calls.call_seq""",
        "call_packet_table": sessions + """SELECT substr(sha256('user-' || user_id), 1, 16)  AS call_file, count(*) AS packets,
            count(*) FILTER (event_type IN ('signup', 'error')) AS messages, min(us) AS first_us, max(us) AS last_us
            FROM i WHERE in_call = 1 AND (event_type IN ('signup', 'error') OR user_id % 5 <> 0) GROUP BY user_id, seg""",
        "table_statistics": in_calls + """ SELECT 'user-' || stats.user_id AS call_id, start_us, state, printf('%08x', stats.user_id) AS ssrc, packet_count,
            CAST(greatest(round((CASE WHEN state <> 'active' THEN last_us ELSE (SELECT max(us) FROM e) END - start_us) / 1000.0::DOUBLE / 30), 0) AS BIGINT) AS expected_packets,
            lost_packets, out_of_order_count, duplicate_count, 30 AS ptime FROM stats JOIN calls ON stats.user_id = calls.user_id AND stats.call = calls.call_seq""",
        "filtered_source": f"""WITH {_EVENTS} SELECT user_id, count(*) AS packets, CAST(min(seq) AS INT) AS least_seq, CAST(max(seq) AS INT) AS largest_seq
            FROM e WHERE event_type NOT IN ('signup', 'error') GROUP BY 1""",
        "arriving_captures": f"""WITH {_EVENTS} SELECT 'stream' AS instance_id, user_id % 8 AS "group", count(*) AS frames, count(*) AS numbers, min(us) AS first_us, sum({_FRAME_SIZE})::BIGINT AS bytes
            FROM (SELECT *, length('v=0..c=IN IP4 10.2..' || (user_id // 256) || (user_id % 256) || '..m=audio 4000 RTP/AVP 0..a=ptime:30..') AS body FROM e) GROUP BY 2""",
        "rebuilt_packets": f"""WITH {_FRAGMENTS} SELECT doc_id % 65536 AS ip_id, '10.0.0.' || (1 + doc_id // 65536) AS src_ip, 34 + size AS cap_len, md5(text) AS digest, (20 + size) % 65536 AS total_length
            FROM f WHERE whole AND n_fragments > 0 AND size <= 65000""",
        "analysis_counters": f"""WITH {_FRAGMENTS}, p AS (SELECT f.*, t.n FROM f JOIN t USING (doc_id) WHERE f.n_fragments > 0 AND f.size <= 65000),
            c AS (SELECT CAST(sum(n_fragments) AS BIGINT) AS received, CAST(sum(n_fragments) FILTER (n > 1) AS BIGINT) AS total,
              count(*) FILTER (n > 1 AND whole) AS reassembled, count(*) FILTER (n > 1 AND NOT whole) AS late FROM p)
            SELECT unnest(['received', 'truncated', 'total', 'reassembled', 'timeout', 'active', 'dropped']) AS counter, unnest([received, 0, total, reassembled, late, 0, 0]) AS value FROM c""",
        "mirrored_calls": sessions + """SELECT 'mirror-1' AS instance_id, 'user-' || user_id AS call_id, CAST(user_id % 8 AS INT) AS span_id, CAST(user_id % 64 AS INT) AS vlan,
            1 AS version, min(us) AS first_us, count(*) AS packet_count FROM i WHERE in_call = 1 AND user_id % 8 IN (1, 2, 3) GROUP BY user_id, seg""",
        "pcap_roundtrip": f"""WITH {_EVENTS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS frame_no, us,
            {_FRAME_SIZE} AS cap_len, 1 AS link_type
            FROM (SELECT *, length('v=0..c=IN IP4 10.2..' || (user_id // 256) || (user_id % 256) || '..m=audio 4000 RTP/AVP 0..a=ptime:30..') AS body FROM e)""",
    }
