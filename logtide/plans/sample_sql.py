"""SQL building blocks over the sample tables, for checking the queries.

Written against the tables alone; position is one number because block and
event id both fit.
"""

EV = """WITH base AS (
 SELECT event_id, user_id, CAST(user_id % 2 + 1 AS INTEGER) AS chain_id, printf('0x%040x', user_id) AS contract,
  CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS block_number, event_id AS log_index, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (
 SELECT *, CASE event_type WHEN 'purchase' THEN 'LeaderClaimed' WHEN 'signup' THEN 'MemberRegistered'
   WHEN 'view' THEN 'PublicEndpointUpdated' WHEN 'click' THEN 'ControlInstructionBroadcast'
   ELSE CASE WHEN k >= 95 THEN 'ClusterDestroyed' ELSE 'MemberRetired' END END AS kind,
  printf('0x%064x', CASE WHEN event_type = 'purchase' THEN event_id % 8 ELSE k % 8 END) AS member_id, block_number % 97 = 0 AS removed,
  CAST(1704067200 + block_number * 3600 AS BIGINT) AS block_ts, block_number * 1000000000 + event_id AS pos,
  '0x' || sha256(CASE WHEN block_number % 97 = 0 THEN 'x' ELSE 'b' END || block_number) AS block_hash,
  'https://m' || k || '.example' AS endpoint, '0x' || lower(hex('https://m' || k || '.example')) AS endpoint_hex,
  CAST(1704067200 + block_number * 3600 + k * 3600 AS BIGINT) AS expiry,
  CASE WHEN k % 3 = 0 THEN '' ELSE printf('0x%064x', k % 8) || ',' || printf('0x%064x', (k + 1) % 8) END AS targets
 FROM base)
"""

BLOCKS = """WITH blk AS (
 SELECT DISTINCT CAST(user_id % 2 + 1 AS INTEGER) AS chain_id, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS number,
  '0x' || sha256('b' || CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT)) AS hash,
  '0x' || sha256('b' || CAST((day(ts) - 1) * 24 + hour(ts) - 1 AS BIGINT)) AS parent_hash,
  CAST(1704067200 + ((day(ts) - 1) * 24 + hour(ts)) * 3600 AS BIGINT) AS block_ts FROM events)
"""

LEADER_AT = """SELECT chain_id, contract, member_id, CAST(k AS BIGINT) AS epoch, block_number AS claimed_block FROM ev
 WHERE kind = 'LeaderClaimed' AND NOT removed AND block_number <= {bound}
 QUALIFY row_number() OVER (PARTITION BY chain_id, contract ORDER BY k DESC, pos) = 1"""

LEADER_ROWS = EV + LEADER_AT

LEADER_CTE = EV + ", won AS (" + LEADER_AT + """), cl AS (SELECT DISTINCT chain_id, contract FROM ev),
leader AS (SELECT chain_id, contract, coalesce(member_id, printf('0x%064x', 0)) AS member_id, coalesce(epoch, 0) AS epoch,
 CAST({bound} AS BIGINT) AS as_of_block, claimed_block FROM cl LEFT JOIN won USING (chain_id, contract))
"""

LEADER = LEADER_CTE + "SELECT * FROM leader"

MEMBERS_CTE = EV + """, m AS (SELECT * FROM ev WHERE NOT removed AND block_number <= {bound}
  AND kind IN ('MemberRegistered', 'PublicEndpointUpdated', 'MemberRetired')),
a AS (SELECT chain_id, contract, member_id, max(pos) FILTER (kind = 'MemberRegistered') AS rp,
  max(pos) FILTER (kind = 'PublicEndpointUpdated') AS ep, max(pos) FILTER (kind = 'MemberRetired') AS tp,
  min(pos) FILTER (kind <> 'MemberRetired') AS sp FROM m GROUP BY ALL
 HAVING min(pos) FILTER (kind <> 'MemberRetired') IS NOT NULL)
"""

MEMBERS = MEMBERS_CTE + """SELECT a.chain_id, a.contract, a.member_id, printf('0x%040x', r.k + 1) AS instance_id,
 printf('0x%040x', r.k + 2) AS passthrough, 'node-' || r.k AS dns_label, e.endpoint AS public_endpoint,
 r.block_ts AS registered_at, t.block_ts AS retired_at
FROM a LEFT JOIN m r ON r.pos = a.rp LEFT JOIN m e ON e.pos = a.ep LEFT JOIN m t ON t.pos = a.tp AND a.tp > a.sp"""

LIFECYCLE_ROWS = EV + """SELECT chain_id, contract, min(block_ts) AS destroyed_at FROM ev
WHERE kind = 'ClusterDestroyed' AND NOT removed AND block_number <= {bound} GROUP BY ALL"""

LIFECYCLE = EV + """SELECT chain_id, contract, min(block_ts) FILTER (kind = 'ClusterDestroyed' AND NOT removed
 AND block_number <= {bound}) AS destroyed_at FROM ev GROUP BY ALL"""

OVERVIEW = MEMBERS_CTE + ", won AS (" + LEADER_AT + """), cl AS (SELECT chain_id, contract,
 min(block_ts) FILTER (kind = 'ClusterDestroyed' AND NOT removed AND block_number <= {bound}) AS destroyed_at FROM ev GROUP BY ALL),
cnt AS (SELECT chain_id, contract, count(*) AS n, count(*) FILTER (tp IS NULL OR tp <= sp) AS act FROM a GROUP BY ALL)
SELECT chain_id, contract, coalesce(won.member_id, printf('0x%064x', 0)) AS member_id, coalesce(epoch, 0) AS epoch,
 CAST({bound} AS BIGINT) AS as_of_block, claimed_block, coalesce(n, 0) AS members_count, coalesce(act, 0) AS active_count, destroyed_at
FROM cl LEFT JOIN won USING (chain_id, contract) LEFT JOIN cnt USING (chain_id, contract)"""

SUNK = EV + """, ins AS (SELECT event_id AS row_id, chain_id, contract AS cluster, CAST(k AS BIGINT) AS nonce, targets, expiry,
  block_number, block_ts FROM ev WHERE kind = 'ControlInstructionBroadcast' AND NOT removed
 QUALIFY row_number() OVER (PARTITION BY chain_id, contract, k ORDER BY event_id) = 1)
"""

ORDERED = SUNK + """, hd AS (SELECT chain_id, max(block_number) AS head FROM ev GROUP BY 1),
fin AS (SELECT ins.*, {initial} AS initial, {head} - block_number >= 12 AS final FROM ins JOIN hd USING (chain_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY chain_id, cluster, final AND nonce >= initial ORDER BY nonce) AS rn FROM fin),
nx AS (SELECT chain_id, cluster, initial + count(*) FILTER (final AND nonce >= initial AND nonce - initial = rn - 1) AS next_expected
 FROM rk GROUP BY chain_id, cluster, initial),
lab AS (SELECT rk.*, next_expected, CASE WHEN NOT final THEN 'NotFinal' WHEN nonce < initial THEN 'Dropped'
  WHEN nonce < next_expected THEN 'Dispatched' ELSE 'AwaitingPredecessor' END AS outcome FROM rk JOIN nx USING (chain_id, cluster))
"""

_HOLES_AT = """fin{h} AS (SELECT *, {h} - block_number >= 12 AS final FROM ins),
rk{h} AS (SELECT *, row_number() OVER (PARTITION BY chain_id, cluster, final ORDER BY nonce) AS rn FROM fin{h}),
nx{h} AS (SELECT chain_id, cluster, count(*) FILTER (final AND nonce = rn - 1) AS nxt FROM rk{h} GROUP BY ALL),
wait{h} AS (SELECT * FROM rk{h} JOIN nx{h} USING (chain_id, cluster) WHERE final AND nonce >= nxt),
hole{h} AS (SELECT chain_id, cluster, max(nxt) AS missing_nonce, max(nonce) AS highest_buffered,
 CASE WHEN arg_min(expiry, nonce) <= {now} THEN 'buffer_expired' WHEN {now} - arg_min(block_ts, nonce) >= 3600000 THEN 'buffer_age'
  WHEN count(*) > 5 THEN 'buffer_full' END AS reason FROM wait{h} GROUP BY ALL HAVING reason IS NOT NULL)"""

_NOW = 1704067200 + 400 * 3600
HOLES = (SUNK + ", " + ",\n".join(_HOLES_AT.format(h=h, now=_NOW) for h in (300, 719)) + """,
lab AS (SELECT *, CASE WHEN final AND nonce < nxt THEN 'Dispatched' ELSE 'other' END AS outcome FROM rk719 JOIN nx719 USING (chain_id, cluster))
""")

ACKS = """WITH ak AS (SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_quantity AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'), l_returnflag, l_linestatus)), 1, 15) AS BIGINT) AS row_id,
  l_partkey, printf('0x%040x', l_orderkey) AS cluster, printf('0x%064x', l_orderkey) AS job_id,
  printf('0x%064x', l_suppkey) AS member_id, CAST(l_linenumber AS BIGINT) AS seq, st AS status,
  CASE WHEN st = 1 THEN printf('0x%064x', 0) ELSE printf('0x%064x', l_partkey + 1) END AS pointer,
  CASE WHEN st = 1 THEN '0x' ELSE '0x' || lower(hex('s' || st)) END AS summary
 FROM (SELECT *, CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2
   + (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) + 1 AS INTEGER) AS st FROM lineitem))
"""
