"""SQL for the queries in :mod:`checks.queries`, written independently over the same tables."""
from __future__ import annotations

LEDGER = """
l AS (SELECT l_orderkey AS k, l_partkey, l_suppkey, CAST(l_quantity * 100000 AS BIGINT) AS amt,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS p
      FROM lineitem),
tot AS (SELECT k, CAST(sum(amt) AS BIGINT) AS total_out, count(*) AS n_out FROM l GROUP BY k),
o AS (SELECT o_orderkey AS k, o_custkey, epoch_us(o_orderdate) AS ts, sha256(CAST(o_orderkey AS VARCHAR)) AS txid,
        total_out, n_out FROM orders JOIN tot ON k = o_orderkey),
outs AS (SELECT o.k, txid, ts, CAST(p AS INTEGER) AS pos, 'A' || l_partkey AS address, amt FROM l JOIN o USING (k)),
ins AS (SELECT k, txid, ts, 0 AS pos, 'A' || o_custkey AS address, total_out AS amt FROM o
        UNION ALL
        SELECT o.k, txid, ts, CAST(p + 1 AS INTEGER), 'A' || l_suppkey, amt FROM l JOIN o USING (k) WHERE p < o.k % 3),
intot AS (SELECT k, CAST(sum(amt) AS BIGINT) AS total_in, count(*) AS n_in FROM ins GROUP BY k),
eq AS (SELECT k, max(n) AS equal_n FROM (SELECT k, amt, count(*) AS n FROM outs GROUP BY ALL) GROUP BY k),
tx AS (SELECT o.*, total_in, n_in, equal_n, n_in >= 3 AND n_out >= 3 AND equal_n >= 3 AS collab
       FROM o JOIN intot USING (k) JOIN eq USING (k)),
io AS (SELECT txid, ts, k, 'input' AS side, pos, address, amt FROM ins
       UNION ALL SELECT txid, ts, k, 'output', pos, address, amt FROM outs),
adt AS (SELECT address, k, txid, ts, CAST(sum(CASE WHEN side = 'output' THEN amt ELSE 0 END) AS BIGINT) AS received,
         CAST(sum(CASE WHEN side = 'input' THEN amt ELSE 0 END) AS BIGINT) AS spent,
         bool_or(side = 'output') AS receives, bool_or(side = 'input') AS spends FROM io GROUP BY ALL),
act AS (SELECT address, count(*) AS tx_count, count(*) FILTER (receives) AS incoming_tx_count,
         count(*) FILTER (spends) AS outgoing_tx_count, CAST(sum(received) AS BIGINT) AS received_sats,
         CAST(sum(spent) AS BIGINT) AS spent_sats, max(received) AS largest, min(ts) AS first_us, max(ts) AS last_us
       FROM adt GROUP BY address)
"""
PAIRS = """,
io_pairs AS (SELECT DISTINCT i.k, i.txid, i.ts, i.address AS payer, u.address AS receiver
             FROM ins i JOIN outs u USING (k) WHERE i.address <> u.address),
cp AS (SELECT address, other, bool_or(s) AS s, bool_or(r) AS r FROM (
         SELECT receiver AS address, payer AS other, true AS s, false AS r FROM io_pairs
         UNION ALL SELECT payer, receiver, false, true FROM io_pairs) GROUP BY ALL),
cpn AS (SELECT address, count(*) FILTER (s) AS distinct_senders, count(*) FILTER (r) AS distinct_receivers,
          count(*) AS distinct_counterparties, count(*) FILTER (s AND r) AS both_ways FROM cp GROUP BY address)
"""
COSPEND = """,
members_of AS (SELECT DISTINCT k, txid, ts, address FROM ins),
member_n AS (SELECT k, count(*) AS n FROM members_of GROUP BY k),
copairs AS (SELECT a.address AS a, b.address AS b, a.k, a.txid, a.ts FROM members_of a JOIN members_of b USING (k)
            JOIN tx USING (k) JOIN member_n USING (k)
            WHERE a.address < b.address AND NOT collab),
usable AS (SELECT copairs.* FROM copairs JOIN tx USING (k) WHERE n_in < 5),
sup AS (SELECT a, b, count(*) AS shared FROM usable GROUP BY ALL HAVING count(*) >= 3),
partners AS (SELECT address, count(*) AS n FROM (
   SELECT unnest([a, b]) AS address FROM (SELECT a, b FROM copairs GROUP BY ALL HAVING count(*) >= 2)) GROUP BY ALL)
"""
COMPONENTS = """,
reach(node, other) AS (
  SELECT a, b FROM sup UNION SELECT b, a FROM sup
  UNION SELECT r.node, CASE WHEN s.a = r.other THEN s.b ELSE s.a END FROM reach r JOIN sup s ON s.a = r.other OR s.b = r.other),
roots AS (SELECT node AS address, least(node, min(other)) AS root FROM reach GROUP BY node),
sized AS (SELECT root, count(*) AS member_count FROM roots GROUP BY root HAVING count(*) >= 2),
mem AS (SELECT root, address, member_count FROM roots JOIN sized USING (root)),
cedge AS (SELECT root, member_count, a, b, shared FROM sup JOIN mem ON address = a),
csup AS (SELECT DISTINCT root, txid, ts FROM usable JOIN cedge USING (a, b)),
cexc AS (SELECT DISTINCT root, txid FROM members_of JOIN tx USING (k, txid) JOIN member_n USING (k) JOIN mem USING (address)
         WHERE n >= 2 AND (collab OR n_in >= 5)),
hyp AS (SELECT root, any_value(member_count) AS member_count, count(*) AS inferred_edge_count,
          round(least(1.0, sum(shared) / (any_value(member_count) * 4.0)), 4) AS strength FROM cedge GROUP BY root)
"""
WINDOW = 1440 * 3600 * 1000000
COLLECT = f""",
ev AS (SELECT p.* FROM io_pairs p JOIN tx USING (k) WHERE NOT collab),
counted AS (SELECT a.receiver, a.ts AS moment, count(DISTINCT b.payer) AS n FROM (SELECT DISTINCT receiver, ts FROM ev) a
            JOIN ev b ON b.receiver = a.receiver AND b.ts BETWEEN a.ts - {WINDOW} AND a.ts GROUP BY ALL),
best AS (SELECT receiver, max(n) AS distinct_payers, arg_max(moment, (n, -moment)) AS peak_us FROM counted GROUP BY receiver
         HAVING max(n) >= 5),
inw AS (SELECT ev.*, distinct_payers, peak_us, min(ts) OVER (PARTITION BY receiver, payer) AS first_ts
        FROM ev JOIN best USING (receiver) WHERE ts BETWEEN peak_us - {WINDOW} AND peak_us),
closing AS (SELECT receiver, max(payer) AS lastp FROM inw WHERE first_ts = peak_us GROUP BY receiver),
closing2 AS (SELECT c.receiver, lastp, min(txid) AS lasttx FROM closing c JOIN inw i
             ON i.receiver = c.receiver AND i.payer = lastp AND i.ts = i.peak_us GROUP BY ALL),
wpay AS (SELECT inw.* FROM inw JOIN closing2 USING (receiver)
         WHERE ts < peak_us OR payer < lastp OR (payer = lastp AND txid <= lasttx)),
wtx AS (SELECT DISTINCT receiver, distinct_payers, k, txid, ts FROM wpay),
meas AS (SELECT receiver, any_value(distinct_payers) AS distinct_payers, count(*) AS contributing_transactions,
           CAST(sum(received) AS BIGINT) AS incoming_sats_in_window, avg(received) AS mean_p, stddev_pop(received) AS sd,
           min(wtx.ts) AS start_us, max(wtx.ts) AS end_us
         FROM wtx JOIN adt ON adt.address = receiver AND adt.k = wtx.k GROUP BY receiver),
outf AS (SELECT receiver, CAST(sum(spent) AS BIGINT) AS out_sats, count(*) AS out_n FROM meas JOIN adt ON adt.address = receiver
         WHERE spends AND ts >= start_us GROUP BY receiver),
dest AS (SELECT m.receiver, count(DISTINCT p.receiver) AS dest_n FROM meas m JOIN io_pairs p ON p.payer = m.receiver
         WHERE p.ts >= m.start_us GROUP BY m.receiver)
"""
def _busy(percentile: float, floor: int) -> str:
    return f""",
gaps AS (SELECT address, ts - lag(ts) OVER (PARTITION BY address ORDER BY ts, txid) AS gap FROM adt),
med AS (SELECT address, median(gap) AS median_gap FROM gaps WHERE gap IS NOT NULL GROUP BY address),
ranked_n AS (SELECT tx_count, row_number() OVER (ORDER BY tx_count) - 1 AS i, count(*) OVER () AS n FROM act),
cut AS (SELECT any_value(tx_count) AS cut FROM ranked_n WHERE i = round_even({percentile} * (n - 1), 0)),
busy AS (SELECT act.*, cut, median_gap, distinct_senders, distinct_receivers, distinct_counterparties, both_ways,
           distinct_senders >= 20 AND distinct_receivers >= 20 AS service
         FROM act JOIN cut ON true JOIN cpn USING (address) LEFT JOIN med USING (address)
         WHERE tx_count >= greatest(cut, {floor}))
"""


BUSY = _busy(0.95, 40)
GRADED = """,
cand AS (SELECT m.*, round_even((end_us - start_us) / 3.6e9, 2) AS span,
           CASE WHEN contributing_transactions > 1 AND mean_p <> 0 THEN sd / mean_p ELSE 0.0 END AS cv,
           round_even(contributing_transactions / act.incoming_tx_count, 4) AS conc,
           coalesce(out_sats, 0) AS out_sats, coalesce(out_n, 0) AS out_n, coalesce(dest_n, 0) AS dest_n,
           coalesce(service, false) AS service
         FROM meas m JOIN act ON act.address = m.receiver LEFT JOIN outf USING (receiver) LEFT JOIN dest USING (receiver)
         LEFT JOIN busy ON busy.address = m.receiver),
raw_grade AS (SELECT *, cv <> 0 AND cv <= 0.5 AS alike,
    least(60.0, greatest(0.0, 20.0 * log2(distinct_payers / 5.0) + 20.0))
    + CASE WHEN contributing_transactions >= 5 THEN
        CASE WHEN cv <> 0 AND cv <= 0.5 THEN 8 ELSE 0 END + CASE WHEN span <= 480.0 THEN 7 ELSE 0 END
        + CASE WHEN incoming_sats_in_window > 0 AND out_sats >= 0.5 * incoming_sats_in_window AND dest_n <= 3 THEN 10 ELSE 0 END
        + CASE WHEN conc >= 0.8 THEN 5 ELSE 0 END ELSE 0 END AS points FROM cand),
graded AS (SELECT *, CASE WHEN service THEN least(30.0, points) ELSE least(75.0, points) END AS severity FROM raw_grade)
"""
TEXT = """,
raw AS (SELECT tx.*, unnest(CASE WHEN k % 37 = 0 AND k % 41 = 0 THEN [0, 1, 2] WHEN k % 37 = 0 THEN [0, 1]
          WHEN k % 41 = 0 THEN [0, 2] ELSE [0] END) AS copy FROM tx),
rep AS (SELECT k, n_in - count(DISTINCT address) AS in_rep FROM ins JOIN intot USING (k) GROUP BY k, n_in),
rep2 AS (SELECT k, n_out - count(DISTINCT address) AS out_rep FROM outs JOIN tot USING (k) GROUP BY k, n_out),
numbered AS (SELECT raw.*, in_rep, out_rep, row_number() OVER (ORDER BY k, copy) AS row_number,
      total_in - total_out AS true_fee FROM raw JOIN rep USING (k) JOIN rep2 USING (k)),
fees AS (SELECT *, CASE WHEN copy = 2 THEN true_fee + 777 WHEN k % 11 = 0 THEN true_fee + 1 WHEN k % 13 = 0 THEN true_fee + 5000
      WHEN k % 17 = 0 THEN NULL ELSE true_fee END AS fee,
      CASE WHEN k % 23 = 0 AND n_out = 1 THEN 'missing' WHEN k % 23 = 0 THEN 'mismatch' WHEN k % 29 = 0 THEN 'amount'
      ELSE 'ok' END AS state FROM numbered),
issues AS (
  SELECT row_number, 'SCHEMA_MISSING_FIELD' AS code, 1 AS n, true AS demote FROM fees WHERE state = 'missing'
  UNION ALL SELECT row_number, 'TXID_FORMAT_UNVERIFIED', 1, true FROM fees WHERE state <> 'missing' AND k % 19 = 0
  UNION ALL SELECT row_number, 'ARRAY_LENGTH_MISMATCH', 1, true FROM fees WHERE state = 'mismatch'
  UNION ALL SELECT row_number, 'AMOUNT_INVALID', 1, true FROM fees WHERE state = 'amount'
  UNION ALL SELECT row_number, 'ADDRESS_REPEATED_IN_ROW', in_rep, true FROM fees WHERE state <> 'missing' AND in_rep > 0
  UNION ALL SELECT row_number, 'ADDRESS_REPEATED_IN_ROW', out_rep, true FROM fees WHERE state = 'ok' AND out_rep > 0
  UNION ALL SELECT row_number, 'ADDRESS_CHECKSUM_UNVERIFIED', 1, false FROM fees WHERE state = 'ok'
  UNION ALL SELECT row_number, 'FEE_MISSING', 1, true FROM fees WHERE state = 'ok' AND fee IS NULL
  UNION ALL SELECT row_number, 'FEE_RESIDUAL_WITHIN_TOLERANCE', 1, true FROM fees WHERE state = 'ok' AND abs(true_fee - fee) = 1
  UNION ALL SELECT row_number, 'FEE_RESIDUAL_ABOVE_TOLERANCE', 1, true FROM fees WHERE state = 'ok' AND abs(true_fee - fee) > 1
  UNION ALL SELECT row_number, 'PORT_INVALID', 1, true FROM fees WHERE state = 'ok' AND k % 31 = 0),
all_issues AS (
  SELECT * FROM issues
  UNION ALL SELECT row_number, 'DUPLICATE_OBSERVATION', 1, true FROM fees WHERE state = 'ok' AND copy = 1
  UNION ALL SELECT row_number, 'TXID_CONFLICT', 1, true FROM fees WHERE state = 'ok' AND copy = 2),
first_status AS (SELECT row_number, any_value(state) AS state, any_value(copy) AS copy,
    CASE WHEN any_value(state) <> 'ok' THEN 'quarantined' WHEN coalesce(bool_or(demote), false) THEN 'warning' ELSE 'accepted' END AS status,
    coalesce(sum(n), 0) AS n_issues FROM fees LEFT JOIN issues USING (row_number) GROUP BY row_number),
final_status AS (SELECT row_number, state, copy, CASE WHEN state = 'ok' AND copy = 2 THEN 'quarantined'
    WHEN state = 'ok' AND copy = 1 THEN 'warning' ELSE status END AS status, state = 'ok' AND copy = 1 AS repeat_sighting FROM first_status)
"""
TEXT_CELLS = """,
cells AS (SELECT row_number, k, copy, state, n_in, n_out, CASE WHEN k % 19 = 0 THEN 'order-' || k ELSE txid END AS id,
   CASE WHEN k % 23 = 0 THEN greatest(n_out - 1, 1) ELSE n_out END AS n_amounts,
   CASE WHEN k % 31 = 0 THEN '70000' ELSE '40000' END AS src_port FROM fees)
"""
IMPORTED = """,
named AS (SELECT f.*, fs.status, fs.repeat_sighting, CASE WHEN f.k % 19 = 0 THEN 'order-' || f.k ELSE f.txid END AS id
          FROM fees f JOIN final_status fs USING (row_number)),
seen_n AS (SELECT id, count(*) AS sightings FROM named WHERE status <> 'quarantined' GROUP BY id),
stored AS (SELECT * FROM named JOIN seen_n USING (id) WHERE status <> 'quarantined' AND NOT repeat_sighting)
"""
_STORED = """SELECT id AS txid, total_in AS total_in_sats, total_out AS total_out_sats, fee AS fee_sats,
  true_fee - coalesce(fee, 0) AS residual_sats, CAST(n_in AS INTEGER) AS input_count, CAST(n_out AS INTEGER) AS output_count,
  CASE WHEN status = 'warning' THEN 'warning' ELSE 'clean' END AS quality_status, sightings FROM stored"""
_TABLE_ROWS = """
kept AS (SELECT 'source_rows' AS name, count(*) AS rows FROM named
         UNION ALL SELECT 'transactions', count(*) FROM stored
         UNION ALL SELECT 'tx_io', CAST(sum(n_in + n_out) AS BIGINT) FROM stored
         UNION ALL SELECT 'observations', CAST(sum(sightings) AS BIGINT) FROM stored
         UNION ALL SELECT 'validation_issues', CAST(sum(n) + 4 AS BIGINT) FROM all_issues)
SELECT name, rows, 4 AS datasets FROM kept UNION ALL SELECT name || ' on disk', rows, 4 FROM kept
UNION ALL SELECT 'retry', count(*), 4 FROM named UNION ALL SELECT 'known files', 0, 0 UNION ALL SELECT 'dropped', 0, 5"""
JUDGED = """
WITH pred AS (SELECT CAST(doc_id AS VARCHAR) AS address, CASE WHEN lang <> 'en' THEN CAST(n_chars AS DOUBLE) END AS pct,
    lang <> 'en' AS scored, n_chars > 1000 AS flagged, CAST(n_chars AS DOUBLE) AS priority, lang FROM documents),
truth AS (SELECT CAST(doc_id AS VARCHAR) AS address, quality = 1 AND doc_id % 7 <> 0 AS label, 'toxic_' || toxic AS pattern_type FROM labels),
j AS (SELECT * FROM pred JOIN truth USING (address)),
v AS (SELECT address, label, 'rules_only' AS variant, CASE WHEN flagged THEN 1.0 ELSE 0.0 END AS score FROM j
      UNION ALL SELECT address, label, 'model_only', coalesce(pct, -1.0) FROM j
      UNION ALL SELECT address, label, 'combined', priority FROM j),
r AS (SELECT *, row_number() OVER w AS rank, sum(CAST(label AS INTEGER)) OVER (PARTITION BY variant ORDER BY score DESC, address
        ROWS UNBOUNDED PRECEDING) AS hits FROM v WINDOW w AS (PARTITION BY variant ORDER BY score DESC, address))
"""
INBOX = """
WITH inbox AS (SELECT CAST(event_id AS VARCHAR) AS alert_id, CAST(user_id AS VARCHAR) AS subject_id, event_type AS pattern,
   value AS priority, CASE WHEN value >= 75 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS priority_band,
   CASE WHEN value > 50 THEN 'medium' ELSE 'low' END AS evidence_strength, 'new' AS review_state,
   'role_' || event_type AS role_hypothesis FROM events)
"""
STAR_CASE = """
WITH files AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS file FROM customer),
rows_of AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS row_number, o_orderpriority,
   CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'accepted_warning' ELSE 'quarantined' END AS status FROM orders),
issues AS (SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, l_orderkey AS row_number, l_linenumber AS ordinal, l_returnflag AS code,
   l_linestatus AS field, CAST(l_partkey AS VARCHAR) AS message FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
HOPS = """,
dom AS (SELECT k, txid, ts, n_out, collab, total_out, arg_max(address, (amt, -pos)) AS address, max(amt) AS amount
        FROM outs JOIN tx USING (k, txid, ts) GROUP BY ALL),
steps AS (SELECT * FROM dom WHERE NOT collab AND n_out >= 2 AND amount / total_out >= 0.5),
spends AS (SELECT DISTINCT address, ts, txid FROM ins),
hop AS (SELECT s.txid, s.address, arg_min(p.txid, (p.ts, p.txid)) AS next_txid, min(p.ts) AS next_us
        FROM steps s JOIN spends p ON p.address = s.address AND (p.ts > s.ts OR (p.ts = s.ts AND p.txid > s.txid))
         AND p.ts - s.ts <= CAST(8760 AS BIGINT) * 3600000000 GROUP BY ALL)
"""
CHAINS = """,
qual AS (SELECT txid, next_txid FROM hop WHERE next_txid IN (SELECT txid FROM steps)),
paths(start, node, path) AS (
  SELECT txid, txid, [txid] FROM steps
  UNION ALL SELECT p.start, q.next_txid, list_append(p.path, q.next_txid) FROM paths p JOIN qual q ON q.txid = p.node),
long AS (SELECT start, arg_max(path, len(path)) AS path FROM paths GROUP BY start HAVING max(len(path)) >= 3),
starts AS (SELECT row_number() OVER (ORDER BY ts, txid) AS i, path FROM long JOIN steps ON txid = start),
claim(i, used, chain) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT i, CASE WHEN len(c) >= 3 THEN list_concat(used, c) ELSE used END, CASE WHEN len(c) >= 3 THEN c ELSE CAST([] AS VARCHAR[]) END
  FROM (SELECT s.i, used, CASE WHEN coalesce(stop, 0) > 0 THEN s.path[1:stop - 1] ELSE s.path END AS c
        FROM (SELECT s.i, s.path, used, list_position(list_transform(s.path, lambda x: list_contains(used, x)), true) AS stop
              FROM claim JOIN starts s ON s.i = claim.i + 1) s)),
chained AS (SELECT chain[1] AS chain, unnest(chain) AS txid, unnest(range(1, len(chain) + 1)) AS hop FROM claim WHERE len(chain) > 0),
hopped AS (SELECT c.chain, c.hop, d.txid, d.ts, d.k, d.address, d.amount, d.total_out, d.amount / d.total_out AS share,
     (lead(d.ts) OVER (PARTITION BY c.chain ORDER BY c.hop) - d.ts) / 3.6e9 AS gap FROM chained c JOIN dom d USING (txid)),
conts AS (SELECT chain, address, row_number() OVER (PARTITION BY chain ORDER BY min(hop)) AS position FROM hopped GROUP BY chain, address),
sides AS (SELECT DISTINCT h.chain, outs.address FROM hopped h JOIN outs USING (k) WHERE outs.address <> h.address),
csum AS (SELECT chain, count(*) AS hop_count, round_even(min(share), 4) AS min_share, round_even(max(share), 4) AS max_share,
   min(ts) AS start_us, max(ts) AS end_us,
   CAST(sum((SELECT coalesce(sum(amt), 0) FROM outs WHERE outs.k = hopped.k AND outs.address <> hopped.address)) AS BIGINT) AS peeled
   FROM hopped GROUP BY chain),
peel_subjects AS (SELECT chain, address, 'sequence_continuation' AS role, 75.0 AS severity, position FROM conts
   UNION ALL SELECT chain, address, 'sequence_side_recipient', 40.0, NULL FROM sides s
   WHERE NOT EXISTS (SELECT 1 FROM conts c WHERE c.chain = s.chain AND c.address = s.address))
"""
SEEN = """,
seen_at AS (SELECT '10.0.' || c_nationkey || '.1' AS ip, address, count(*) AS n
   FROM adt JOIN o USING (k, txid) JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
ip_n AS (SELECT '10.0.' || c_nationkey || '.1' AS ip, count(*) AS obs FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(*) >= 3),
ips AS (SELECT ip, min(address) FILTER (n >= 2) AS address FROM seen_at JOIN ip_n USING (ip) GROUP BY ip HAVING count(*) FILTER (n >= 2) >= 3)
"""
FINDINGS = """,
finds AS (
  SELECT 'collection_pattern' AS pattern, receiver AS subject, '' AS context, 'collection_point' AS role, severity,
         contributing_transactions AS supports FROM graded WHERE severity >= 40
  UNION ALL SELECT 'payment_participant', payer, g.receiver, 'potential_payment_participant', 20.0, count(*)
    FROM graded g JOIN ev USING (receiver) WHERE severity >= 40 GROUP BY payer, g.receiver
  UNION ALL SELECT 'peeling_sequence', p.address, 'peel:' || p.chain, p.role, p.severity, hop_count FROM peel_subjects p JOIN csum USING (chain)
  UNION ALL SELECT 'common_control', address, 'clu_' || left(sha256(root), 16), 'possible_common_control_member', 40.0, n
    FROM mem JOIN (SELECT root, count(*) AS n FROM csup GROUP BY root) USING (root)
  UNION ALL SELECT 'shared_ip_observation', address, 'ip:' || ip, 'unknown_role', 0.0, 1 FROM ips
  UNION ALL SELECT 'high_activity_context', address, '', CASE WHEN service THEN 'high_activity_service_like' ELSE 'unknown_role' END, 0.0, 1 FROM busy
  UNION ALL SELECT 'coinjoin_like', txid, '', 'collaborative_transaction_participant', 25.0, 1 FROM tx WHERE collab)
"""
EDGES = """,
edges AS MATERIALIZED (
  SELECT CASE WHEN side = 'input' THEN 'addr:' || address ELSE 'tx:' || txid END AS source,
         CASE WHEN side = 'input' THEN 'tx:' || txid ELSE 'addr:' || address END AS target,
         CASE WHEN side = 'input' THEN 'in:' ELSE 'out:' END || pos AS key,
         CASE WHEN side = 'input' THEN 'spend' ELSE 'receive' END AS kind, amt AS amount_sats FROM io
  UNION ALL SELECT 'ip:10.0.' || c_nationkey || '.1', 'tx:' || txid, 'obs:' || (k + 1), 'observation', NULL
  FROM o JOIN customer ON c_custkey = o_custkey),
und AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
h1 AS MATERIALIZED (SELECT b AS id, row_number() OVER (ORDER BY b) AS rank FROM (SELECT DISTINCT b FROM und WHERE a = 'addr:A0' AND b <> 'addr:A0')
       ORDER BY b LIMIT 299),
h2c AS MATERIALIZED (SELECT b AS id, min(rank) AS parent FROM und JOIN h1 ON a = id WHERE b <> 'addr:A0' AND b NOT IN (SELECT id FROM h1) GROUP BY b),
h2 AS MATERIALIZED (SELECT id, (SELECT count(*) FROM h1) + row_number() OVER (ORDER BY parent, id) AS rank FROM h2c
       QUALIFY row_number() OVER (ORDER BY parent, id) <= 299 - (SELECT count(*) FROM h1)),
view AS MATERIALIZED (SELECT 'addr:A0' AS id, 0 AS hop, 0 AS rank UNION ALL SELECT id, 1, rank FROM h1 UNION ALL SELECT id, 2, rank FROM h2)
"""
PRIORITY = """,
ranks AS (SELECT a.address, a.tx_count, a.spent_sats, a.received_sats,
   (count(*) FILTER (b.tx_count < a.tx_count) + count(*) FILTER (b.tx_count <= a.tx_count)) / 2.0 / count(*) * 100.0 AS pct
   FROM act a JOIN act b ON true GROUP BY ALL),
sev AS (SELECT ranks.*, CASE WHEN partners.n > 0 THEN 40.0 ELSE 0.0 END AS severity FROM ranks LEFT JOIN partners USING (address))
"""
LOOSE = "n_in >= 2 AND n_out >= 2 AND equal_n >= 2"
FEATURE_SQL = """,
pertx AS (SELECT adt.*, n_in, n_out, equal_n >= 3 AS eq3 FROM adt JOIN tx USING (k, txid, ts)),
base AS (SELECT address, avg(n_in) AS mean_input_count, avg(n_out) AS mean_output_count,
           avg(CAST(eq3 AS INTEGER)) AS equal_output_participation FROM pertx GROUP BY address),
day AS (SELECT address, max(n) AS n FROM (
          SELECT a.address, a.ts, count(*) AS n FROM (SELECT DISTINCT address, ts FROM adt) a JOIN adt b
          ON b.address = a.address AND b.ts BETWEEN a.ts - 86400000000 AND a.ts GROUP BY ALL) GROUP BY address),
feat AS (SELECT act.address, CAST(tx_count AS DOUBLE) AS tx_count, CAST(incoming_tx_count AS DOUBLE) AS incoming_tx_count,
   CAST(outgoing_tx_count AS DOUBLE) AS outgoing_tx_count,
   CAST(coalesce(distinct_senders, 0) AS DOUBLE) AS distinct_senders,
   CAST(coalesce(distinct_receivers, 0) AS DOUBLE) AS distinct_receivers,
   CAST(coalesce(distinct_counterparties, 0) AS DOUBLE) AS distinct_counterparties,
   round(ln(1 + received_sats), 6) AS received_sats_log, round(ln(1 + spent_sats), 6) AS spent_sats_log,
   round(CASE WHEN incoming_tx_count = 0 THEN 0.0 ELSE ln(1 + received_sats / incoming_tx_count) END, 6) AS mean_incoming_sats_log,
   round(CASE WHEN received_sats = 0 THEN 0.0 ELSE largest / received_sats END, 6) AS incoming_value_concentration,
   round(mean_input_count, 6) AS mean_input_count, round(mean_output_count, 6) AS mean_output_count,
   round(equal_output_participation, 6) AS equal_output_participation,
   CAST(coalesce(partners.n, 0) AS DOUBLE) AS repeated_co_input_partners,
   round(coalesce(median_gap / 3.6e9, 0.0), 6) AS median_inter_event_hours,
   round((last_us - first_us) / 3.6e9, 6) AS activity_span_hours, CAST(day.n AS DOUBLE) AS max_tx_in_24h,
   CASE WHEN tx_count > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_multiple_events
   FROM act JOIN base USING (address) JOIN day USING (address) LEFT JOIN cpn USING (address)
   LEFT JOIN partners USING (address) LEFT JOIN med USING (address))
"""
_FEATURES = (
    "tx_count incoming_tx_count outgoing_tx_count distinct_senders distinct_receivers distinct_counterparties "
    "received_sats_log spent_sats_log mean_incoming_sats_log incoming_value_concentration mean_input_count "
    "mean_output_count equal_output_participation repeated_co_input_partners median_inter_event_hours "
    "activity_span_hours max_tx_in_24h has_multiple_events").split()


def _q(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{LEDGER}{''.join(ctes)} {select}"


_RUN = (PAIRS, COSPEND, COMPONENTS, COLLECT, _busy(0.99, 50), GRADED, HOPS, CHAINS, SEEN, FINDINGS)
_SCORED_RUN = (PAIRS, COSPEND, COMPONENTS, COLLECT, _busy(0.5, 20), GRADED, HOPS, CHAINS, SEEN, FINDINGS)
_SINGLE = "'common_control', 'coinjoin_like', 'shared_ip_observation', 'high_activity_context'"


def _quantiles() -> str:
    # Unrounded values go into the quantiles; only the result is rounded.
    exact = FEATURE_SQL
    for name in ("received_sats_log", "spent_sats_log", "mean_incoming_sats_log", "incoming_value_concentration",
                 "mean_input_count", "mean_output_count", "equal_output_participation", "median_inter_event_hours",
                 "activity_span_hours"):
        exact = exact.replace(f", 6) AS {name}", f", 15) AS {name}")
    marks = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, quantile_cont({f}, {marks}) AS q FROM feat" for f in _FEATURES)
    return _q(f"SELECT feature, CAST(i AS BIGINT) AS level, round(q[i + 1], 6) AS value FROM ({parts}), range(101) t(i)",
              PAIRS, COSPEND, BUSY, exact)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    found = "0.0"
    for c in coefficients:
        found = f"({found} * {x} + ({c!r}))"
    return found


def _normal_scores() -> str:
    from checks.queries import PLAIN_FEATURES

    exact = FEATURE_SQL
    for name in ("received_sats_log", "spent_sats_log"):
        exact = exact.replace(f", 6) AS {name}", f", 15) AS {name}")
    marks = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
    knots = " UNION ALL ".join(f"SELECT '{f}' AS feature, i, q[i + 1] AS k FROM (SELECT quantile_cont({f}, {marks}) AS q FROM feat), range(101) t(i)"
                               for f in PLAIN_FEATURES)
    cells = " UNION ALL ".join(f"SELECT address, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM feat" for f in PLAIN_FEATURES)
    middle = _horner((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01,
                      2.506628277459239e+00), "(q * q)")
    below = _horner((-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0), "(q * q)")
    tail = _horner((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00,
                    2.938163982698783e+00), "t")
    under = _horner((7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0), "t")
    return _q(f"""SELECT address, feature, round(least(greatest(z, -5.1993375821928165), 5.1993375821928165), 6) AS score
        FROM cells JOIN scores USING (feature, x)""", PAIRS, COSPEND, BUSY, exact, f""",
      knots AS MATERIALIZED ({knots}), cells AS MATERIALIZED ({cells}),
      near AS (SELECT feature, x, max(i) FILTER (k <= x) AS a, min(i) FILTER (k >= x) AS b, min(k) AS k0, max(k) AS ks
               FROM (SELECT DISTINCT feature, x FROM cells) JOIN knots USING (feature) GROUP BY ALL),
      placed AS (SELECT near.feature, x, CASE WHEN x >= ks - 1e-7 THEN 1.0 WHEN x <= k0 + 1e-7 THEN 0.0 WHEN l.k = x THEN (a + b) / 200.0
                   ELSE (a + (x - l.k) / (r.k - l.k)) / 100.0 END AS p FROM near
                 JOIN knots l ON l.feature = near.feature AND l.i = a JOIN knots r ON r.feature = near.feature AND r.i = b),
      ends AS (SELECT feature, x, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM placed),
      parts AS (SELECT *, p - 0.5 AS q, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS t FROM ends),
      scores AS (SELECT feature, x, CASE WHEN abs(q) <= 0.47575 THEN q * {middle} / {below}
                   ELSE CASE WHEN q < 0 THEN 1 ELSE -1 END * {tail} / {under} END AS z FROM parts)""")


def _forest() -> str:
    from checks.queries import SMALL_FOREST

    rows = ", ".join(f"({t}, {n}, {f!r}, {c}, {l}, {r}, {size}, {depth})" if f else f"({t}, {n}, NULL, {c}, {l}, {r}, {size}, {depth})"
                     for t, n, f, c, l, r, size, depth in SMALL_FOREST)
    path = "CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 ELSE 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} END"
    return _q(f"""SELECT address, round(pow(2.0, -avg(depth + {path.format('size')}) / ({path.format('8')})), 9) AS anomaly_score
        FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY address""", PAIRS, COSPEND, BUSY, FEATURE_SQL, f""",
      nodes(tree, node, feature, threshold, l, r, size, depth) AS (VALUES {rows}),
      walk(address, tree, node) AS (SELECT address, tree, 0 FROM feat, nodes WHERE node = 0
        UNION ALL SELECT w.address, w.tree, CASE WHEN CASE feature WHEN 'tx_count' THEN tx_count WHEN 'received_sats_log' THEN received_sats_log
            WHEN 'distinct_counterparties' THEN distinct_counterparties ELSE outgoing_tx_count END <= threshold THEN l ELSE r END
          FROM walk w JOIN nodes USING (tree, node) JOIN feat ON feat.address = w.address WHERE feature IS NOT NULL)""", recursive=True)


SCORED = """,
scored AS (SELECT address, CAST(tx_count - 1000 * outgoing_tx_count AS DOUBLE) AS score FROM act WHERE tx_count % 13 <> 0),
weights AS (SELECT score, count(*) AS w FROM scored GROUP BY score),
pcts AS (SELECT a.score, (2 * coalesce(sum(b.w) FILTER (b.score < a.score), 0) + any_value(a.w)) / 2.0 / sum(b.w) * 100.0 AS pct
         FROM weights a JOIN weights b ON true GROUP BY a.score),
pct_of AS (SELECT address, pct FROM scored JOIN pcts USING (score)),
odd AS (SELECT address FROM pct_of WHERE pct >= 90 AND address NOT IN (SELECT subject FROM finds
         WHERE pattern IN ('collection_pattern', 'payment_participant', 'peeling_sequence', 'common_control'))),
held AS (SELECT DISTINCT subject FROM finds WHERE pattern IN ('high_activity_context', 'shared_ip_observation')),
more AS (SELECT * FROM finds UNION ALL SELECT 'statistical_anomaly', address, '', 'unknown_role', 0.0, 1 FROM odd),
weighed AS (SELECT more.*, CASE WHEN pattern <> 'coinjoin_like' THEN pct END AS pct,
    pattern IN ('high_activity_context', 'shared_ip_observation') OR (pattern = 'statistical_anomaly' AND subject IN (SELECT subject FROM held)) AS suppressed
  FROM more LEFT JOIN pct_of ON address = subject),
blended AS (SELECT *, CASE WHEN pct IS NULL THEN CAST(severity AS DOUBLE) WHEN suppressed THEN least(60.0, 0.6 * pct + 0.4 * CAST(severity AS DOUBLE))
    ELSE 0.6 * pct + 0.4 * CAST(severity AS DOUBLE) END AS p FROM weighed)
"""


ORACLE: dict[str, str] = {
    "ledger_index": _q("SELECT txid, ts AS ts_us, row_number() OVER (ORDER BY ts, txid) - 1 AS tx_index FROM tx"),
    "ledger_entries": _q("SELECT txid, side, pos AS position, address, amt AS amount_sats FROM io"),
    "address_activity": _q("SELECT address, tx_count, incoming_tx_count, outgoing_tx_count, received_sats, spent_sats FROM act"),
    "dominant_output": _q("SELECT txid, address, amount AS amount_sats, round(amount / total_out, 6) AS share FROM dom", HOPS),
    "coverage": _q("""SELECT (SELECT count(*) FROM tx) AS transactions, CAST(0 AS BIGINT) AS transactions_with_amount_discrepancy,
        (SELECT min(ts) FROM tx) AS period_start_us, (SELECT max(ts) FROM tx) AS period_end_us,
        (SELECT count(*) FROM act) AS addresses, (SELECT count(*) FROM o JOIN customer ON c_custkey = o_custkey) AS observations,
        (SELECT count(DISTINCT c_nationkey) FROM o JOIN customer ON c_custkey = o_custkey) AS distinct_src_ips"""),
    "endpoint_index": _q("SELECT DISTINCT '10.0.' || c_nationkey || '.1' AS src_ip, txid FROM o JOIN customer ON c_custkey = o_custkey"),
    "address_endpoints": _q("""SELECT DISTINCT address, '10.0.' || c_nationkey || '.1' AS src_ip
        FROM adt JOIN o USING (k, txid) JOIN customer ON c_custkey = o_custkey"""),
    "top_endpoints": _q("""SELECT address, src_ip, n AS sightings, row_number() OVER (PARTITION BY address ORDER BY n DESC, src_ip) AS rank
        FROM (SELECT address, '10.0.' || c_nationkey || '.1' AS src_ip, count(*) AS n
              FROM adt JOIN o USING (k, txid) JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        """),
    "norm_amounts": _q("""SELECT row_number, total_in AS total_in_sats, total_out AS total_out_sats, fee AS fee_sats,
        true_fee - coalesce(fee, 0) AS residual_sats FROM fees WHERE state = 'ok'""", TEXT),
    "norm_status": _q("SELECT row_number, status, CAST(n_issues AS BIGINT) AS n_issues FROM first_status", TEXT),
    "resolve_duplicates": _q("SELECT row_number, status, repeat_sighting FROM final_status", TEXT),
    "issue_counts": _q("""SELECT code, CAST(sum(n) AS BIGINT) AS n FROM all_issues GROUP BY code
        UNION ALL SELECT 'LABEL_COLUMN_REMOVED', 1""", TEXT),
    "import_summary": _q("""SELECT count(*) AS total_rows, count(*) FILTER (status = 'accepted') AS accepted_clean,
        count(*) FILTER (status = 'warning') AS accepted_warning, count(*) FILTER (status = 'quarantined') AS quarantined,
        count(*) FILTER (status <> 'quarantined' AND NOT repeat_sighting) AS transactions_stored,
        count(*) FILTER (status <> 'quarantined') AS observations_stored, true AS reconciles FROM final_status""", TEXT),
    "dataset_fingerprints": """WITH lines AS (
        SELECT o_orderkey % 4 AS part, o_orderkey AS place, o_orderkey || '|' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders
        UNION ALL SELECT range, -1, 'order|customer|day' FROM range(4)),
      files AS (SELECT part, string_agg(line, chr(10) ORDER BY place) || chr(10) AS content FROM lines GROUP BY part)
      SELECT CAST(part AS INTEGER) AS part, CAST(strlen(content) AS BIGINT) AS byte_size, sha256(content) AS sha256, 'csv' AS format, 'utf-8' AS encoding,
        '|' AS delimiter, 'lf' AS newline, 'order;customer;day' AS header FROM files""",
    **{name: _q(_STORED, TEXT, IMPORTED) for name in ("import_csv", "import_json", "import_xml")},
    "import_retry": _q("", TEXT, IMPORTED, "," + _TABLE_ROWS),
    "profile_ledger": _q("""SELECT count(*) AS rows, count(DISTINCT id) AS distinct_txids,
        (SELECT count(*) FROM (SELECT id FROM cells GROUP BY id HAVING count(*) > 1)) AS duplicated_txids,
        count(*) FILTER (k % 23 = 0 AND n_out > 1) AS length_mismatch_rows,
        count(*) FILTER (k % 23 = 0 AND n_out = 1) AS empty_element_rows,
        (SELECT count(*) FROM fees WHERE in_rep > 0 OR out_rep > 0) AS repeated_address_rows,
        (SELECT count(*) FROM res WHERE r <> 0) AS residual_rows,
        (SELECT count(*) FROM res WHERE abs(r) = 1) AS residual_rows_within_1,
        (SELECT max(abs(r)) FROM res) AS max_abs_residual,
        (SELECT count(*) FROM act) AS distinct_addresses FROM cells""", TEXT, TEXT_CELLS, """,
        last_amt AS (SELECT k, arg_max(amt, pos) AS last_amt FROM outs GROUP BY k),
        res AS (SELECT true_fee - fee + CASE WHEN k % 23 = 0 THEN last_amt ELSE 0 END AS r FROM fees JOIN last_amt USING (k)
                WHERE NOT (k % 23 = 0 AND n_out = 1) AND NOT (k % 29 = 0))"""),
    "value_histograms": _q("""SELECT 'input_count' AS measure, CAST(n_in AS VARCHAR) AS value, count(*) AS n FROM cells GROUP BY ALL
        UNION ALL SELECT 'output_count', CAST(n_out AS VARCHAR), count(*) FROM cells GROUP BY ALL
        UNION ALL SELECT 'script_type', 'P2PKH', count(*) FROM cells
        UNION ALL SELECT 'dst_port', '8333', count(*) FROM cells
        UNION ALL SELECT 'txid_length', CAST(length(id) AS VARCHAR), count(*) FROM cells GROUP BY ALL
        UNION ALL SELECT 'address_length', CAST(length(address) AS VARCHAR), count(*) FROM io JOIN cells USING (k) GROUP BY ALL
        UNION ALL SELECT 'address_prefix', address[1], count(*) FROM io JOIN cells USING (k) GROUP BY ALL""", TEXT, TEXT_CELLS),
    "equal_groups": _q("""SELECT txid, max(n) AS equal_output_count, arg_max(amt, (n, -amt)) AS denomination_sats,
        count(*) FILTER (n >= 3) AS denomination_group_count
        FROM (SELECT txid, amt, count(*) AS n FROM outs GROUP BY ALL) GROUP BY txid"""),
    "coinjoin_like": _q(f"""SELECT txid, CAST(n_in AS INTEGER) AS input_count, CAST(n_out AS INTEGER) AS output_count,
        CAST(equal_n AS INTEGER) AS equal_output_count, denomination_sats FROM tx JOIN (
          SELECT k, arg_max(amt, (n, -amt)) AS denomination_sats FROM (SELECT k, amt, count(*) AS n FROM outs GROUP BY ALL) GROUP BY k)
        USING (k) WHERE {LOOSE}"""),
    "equal_output_histogram": _q("""SELECT CAST(equal_n AS INTEGER) AS multiplicity, count(*) AS transactions FROM tx
        WHERE n_out >= 3 GROUP BY ALL"""),
    "co_input_pairs": _q("SELECT a, b, txid FROM usable", COSPEND),
    "supported_pairs": _q("SELECT a, b, shared AS shared_transaction_count FROM sup", COSPEND),
    "excluded_transactions": _q("""SELECT txid, CASE WHEN collab THEN 'collaborative structure'
        ELSE 'inputs ' || n_in || ' >= 5' END AS reason
        FROM tx JOIN member_n USING (k) WHERE n >= 2 AND (collab OR n_in >= 5)""", COSPEND),
    "clusters": _q("SELECT root, address, member_count FROM mem", COSPEND, COMPONENTS, recursive=True),
    "cluster_hypotheses": _q("""SELECT root, member_count, inferred_edge_count, strength, supporting_transaction_count,
        coalesce(x, 0) AS excluded_transactions, start_us, end_us FROM hyp
        JOIN (SELECT root, count(*) AS supporting_transaction_count, min(ts) AS start_us, max(ts) AS end_us FROM csup GROUP BY root) USING (root)
        LEFT JOIN (SELECT root, count(*) AS x FROM cexc GROUP BY root) USING (root)""", COSPEND, COMPONENTS, recursive=True),
    "cluster_edges": _q("""SELECT 'addr:' || a AS source, 'addr:' || b AS target, shared AS support, strength
        FROM cedge JOIN hyp USING (root)""", COSPEND, COMPONENTS, recursive=True),
    "features_counts": _q("""SELECT address, tx_count, incoming_tx_count, outgoing_tx_count, coalesce(distinct_senders, 0) AS distinct_senders,
        coalesce(distinct_receivers, 0) AS distinct_receivers, coalesce(distinct_counterparties, 0) AS distinct_counterparties
        FROM act LEFT JOIN cpn USING (address)""", PAIRS),
    "features_values": _q("""SELECT address, received_sats_log, spent_sats_log, mean_incoming_sats_log, incoming_value_concentration,
        mean_input_count, mean_output_count, equal_output_participation FROM feat""", PAIRS, COSPEND, BUSY, FEATURE_SQL),
    "features_time": _q("""SELECT address, median_inter_event_hours, activity_span_hours, max_tx_in_24h, has_multiple_events
        FROM feat""", PAIRS, COSPEND, BUSY, FEATURE_SQL),
    "features_partners": _q("SELECT address, n AS repeated_co_input_partners FROM partners", COSPEND),
    "address_features": _q(f"SELECT address, {', '.join(_FEATURES)} FROM feat", PAIRS, COSPEND, BUSY, FEATURE_SQL),
    "event_gaps": """SELECT user_id, median(gap) AS median_gap_us FROM (
        SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
        WHERE gap IS NOT NULL GROUP BY user_id""",
    "event_peaks": """WITH c AS (SELECT a.user_id, a.event_type, epoch_us(a.ts) AS moment, count(*) AS n FROM events a JOIN events b
          ON a.user_id = b.user_id AND a.event_type = b.event_type
          AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 86400000000 AND epoch_us(a.ts) GROUP BY a.event_id, a.user_id, a.event_type, a.ts)
        SELECT user_id, event_type, max(n) AS peak, arg_max(moment, (n, -moment)) AS peak_us FROM c GROUP BY ALL""",
    "receive_events": _q("SELECT txid, ts AS ts_us, payer, receiver FROM ev", PAIRS, COLLECT),
    "best_window": _q("SELECT receiver, distinct_payers, peak_us FROM best", PAIRS, COLLECT),
    "collection_graded": _q("""SELECT receiver AS address, distinct_payers, span AS observed_span_hours, contributing_transactions,
        incoming_sats_in_window, round_even(cv, 4) AS payment_amount_cv, alike AS payments_similar_in_size,
        conc AS inbound_concentration, out_sats AS subsequent_outflow_sats, out_n AS subsequent_outflow_transactions,
        dest_n AS distinct_outflow_destinations, start_us, end_us, service AS service_like_profile, round(severity, 6) AS severity
        FROM graded""", PAIRS, COLLECT, BUSY, GRADED),
    "payment_participants": _q("""SELECT payer AS subject_id, g.receiver AS collection_point, count(*) AS payments_to_collection_point,
        CAST(sum(received) AS BIGINT) AS paid_sats, min(ev.ts) AS start_us, max(ev.ts) AS end_us
        FROM graded g JOIN ev USING (receiver) JOIN adt ON adt.address = g.receiver AND adt.k = ev.k
        WHERE severity >= 40 GROUP BY ALL""", PAIRS, COLLECT, BUSY, GRADED),
    "activity_cut": _q("SELECT cut AS activity_cut FROM cut", PAIRS, BUSY),
    "high_activity": _q("""SELECT address AS subject_id, CASE WHEN service THEN 'high_activity_service_like' ELSE 'unknown_role' END AS role_hypothesis,
        tx_count AS transaction_count, cut AS case_activity_percentile_cut, distinct_counterparties, distinct_senders, distinct_receivers,
        both_ways AS reciprocal_counterparties, round_even(both_ways / distinct_counterparties, 4) AS reciprocity_ratio,
        round_even(least(received_sats, spent_sats) / greatest(received_sats, spent_sats), 4) AS flow_balance,
        round_even((last_us - first_us) / 3.6e9, 2) AS activity_span_hours, round_even(median_gap / 3.6e9, 3) AS median_gap_hours,
        service AS service_like_profile FROM busy""", PAIRS, BUSY),
    "shared_endpoint": _q("""SELECT endpoint, min(address) FILTER (n >= 2) AS subject_id, any_value(obs) AS observation_count,
        count(*) FILTER (n >= 2) AS distinct_addresses_observed, count(*) AS addresses_seen_at_endpoint,
        count(*) FILTER (n >= 2) >= 20 AS looks_like_shared_infrastructure
        FROM (SELECT '10.0.' || c_nationkey || '.1' AS endpoint, address, count(*) AS n
              FROM adt JOIN o USING (k, txid) JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        JOIN (SELECT '10.0.' || c_nationkey || '.1' AS endpoint, count(*) AS obs FROM o JOIN customer ON c_custkey = o_custkey
              GROUP BY ALL HAVING count(*) >= 3) USING (endpoint)
        GROUP BY endpoint HAVING count(*) FILTER (n >= 2) >= 3"""),
    "shared_endpoint_addresses": _q("""SELECT endpoint, address, n AS sightings FROM (
        SELECT '10.0.' || c_nationkey || '.1' AS endpoint, address, count(*) AS n
        FROM adt JOIN o USING (k, txid) JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        WHERE n >= 2 AND endpoint IN (SELECT '10.0.' || c_nationkey || '.1' FROM o JOIN customer ON c_custkey = o_custkey
              GROUP BY ALL HAVING count(*) >= 3)
        QUALIFY count(*) OVER (PARTITION BY endpoint) >= 3"""),
    "next_hop": _q("SELECT txid, address, next_txid, next_us FROM hop", HOPS),
    "peel_chains": _q("""SELECT chain, CAST(hop AS BIGINT) AS hop, txid, address, amount AS amount_sats,
        round_even(share, 4) AS share, round_even(gap, 2) AS gap_hours FROM hopped""", HOPS, CHAINS, recursive=True),
    "peel_findings": _q("""SELECT address AS subject_id, 'peel:' || chain AS context_id, role AS role_hypothesis,
        CAST(severity AS DOUBLE) AS severity, hop_count, coalesce(n, 0) AS side_recipient_count, min_share, max_share,
        peeled AS total_peeled_off_sats, position AS subject_position FROM peel_subjects JOIN csum USING (chain)
        LEFT JOIN (SELECT chain, count(*) AS n FROM sides GROUP BY chain) USING (chain)""", HOPS, CHAINS, recursive=True),
    "alerts": _q(f"""SELECT sha256('check|' || pattern || '|' || subject || '|' || context) AS alert_id,
        CASE WHEN pattern = 'coinjoin_like' THEN 'transaction' ELSE 'address' END AS subject_type, subject AS subject_id, pattern,
        role AS role_hypothesis, round_even(CAST(severity AS DOUBLE), 2) AS priority,
        CASE WHEN severity >= 75 THEN 'high' WHEN severity >= 40 THEN 'medium' ELSE 'low' END AS priority_band,
        CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS evidence_strength
        FROM (SELECT *, CAST(supports >= 3 AS INTEGER) + CAST(supports >= 8 AS INTEGER)
              - CAST(pattern IN ({_SINGLE}) AS INTEGER) AS s FROM finds)""", *_RUN, recursive=True),
    "predictions": _q("""SELECT address, false AS scored, coalesce(patterns, '') AS patterns,
        CASE WHEN address IN (SELECT address FROM adt JOIN tx USING (k) WHERE collab) THEN 'coinjoin_like' ELSE '' END AS transaction_patterns,
        coalesce(priority, 0.0) AS review_priority, priority IS NOT NULL AS raised_alert, coalesce(roles, '') AS roles
        FROM act LEFT JOIN (SELECT subject AS address, array_to_string(list_sort(list(DISTINCT pattern)), ',') AS patterns,
          round_even(CAST(max(severity) AS DOUBLE), 2) AS priority, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles
          FROM finds WHERE pattern <> 'coinjoin_like' GROUP BY subject) USING (address)""", *_RUN, recursive=True),
    "alerts_scored": _q(f"""SELECT sha256('check|' || pattern || '|' || subject || '|' || context) AS alert_id, subject AS subject_id, pattern,
        round_even(p, 2) AS priority, CASE WHEN p >= 75 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS priority_band,
        CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS evidence_strength, round(pct, 6) AS anomaly_percentile, suppressed
        FROM (SELECT *, CAST(supports >= 3 AS INTEGER) + CAST(supports >= 8 AS INTEGER)
              - CAST(pattern IN ({_SINGLE}, 'statistical_anomaly') AS INTEGER) AS s FROM blended)""", *_SCORED_RUN, SCORED, recursive=True),
    "predictions_scored": _q("""SELECT address, pct IS NOT NULL AS scored, round(pct, 6) AS anomaly_percentile, coalesce(patterns, '') AS patterns,
        coalesce(priority, round_even(0.6 * pct, 2), 0.0) AS review_priority, priority IS NOT NULL AS raised_alert, coalesce(roles, '') AS roles
        FROM act LEFT JOIN pct_of USING (address) LEFT JOIN (SELECT subject AS address, array_to_string(list_sort(list(DISTINCT pattern)), ',') AS patterns,
          round_even(max(p), 2) AS priority, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles
          FROM blended WHERE pattern <> 'coinjoin_like' GROUP BY subject) USING (address)""", *_SCORED_RUN, SCORED, recursive=True),
    "normal_scores": _normal_scores(),
    "fixed_forest_scores": _forest(),
    "run_statistics": _q("""SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM act) AS addresses,
        (SELECT count(*) FROM o JOIN customer ON c_custkey = o_custkey) AS observations, (SELECT count(*) FROM finds) AS alerts_total,
        (SELECT count(*) FROM act) AS addresses_unscored, (SELECT count(*) FROM tx WHERE collab) AS collaborative_transactions_excluded,
        (SELECT count(*) FROM sized) AS cluster_hypotheses, (SELECT count(*) FROM graded) AS collection_candidates,
        (SELECT count(*) FROM graded WHERE severity >= 40) AS collection_reported,
        (SELECT count(*) FROM graded WHERE severity < 40) AS collection_below_threshold""", *_RUN, recursive=True),
    "feature_quantiles": _quantiles(),
    "percentile_rank": _q("""SELECT a.address, a.spent_sats, round((count(*) FILTER (b.received_sats < a.spent_sats)
        + count(*) FILTER (b.received_sats <= a.spent_sats)) / 2.0 / count(*) * 100.0, 6) AS anomaly_percentile
        FROM act a JOIN act b ON true GROUP BY ALL"""),
    "review_priority": _q("""SELECT address, severity, round(p, 6) AS priority,
        CASE WHEN p >= 75 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS priority_band,
        CASE WHEN s >= 2 THEN 'high' WHEN s = 1 THEN 'medium' ELSE 'low' END AS evidence_strength
        FROM (SELECT *, CASE WHEN tx_count >= 100 THEN least(60.0, 0.6 * pct + 0.4 * severity) ELSE 0.6 * pct + 0.4 * severity END AS p,
          CAST(tx_count >= 3 AS INTEGER) + CAST(tx_count >= 8 AS INTEGER) - CAST(spent_sats > received_sats AS INTEGER)
          - CAST(severity = 0 AS INTEGER) AS s
          FROM (SELECT address, tx_count, spent_sats, received_sats, pct, CAST(severity AS DOUBLE) AS severity FROM sev))""", COSPEND, PRIORITY),
    "sensitivity": _q("""SELECT address AS alert_id, CAST(severity AS DOUBLE) AS revised_priority,
        CASE WHEN severity >= 40 THEN 'medium' ELSE 'low' END AS revised_band FROM sev""", COSPEND, PRIORITY),
    "project_tx_patterns": _q(f"SELECT DISTINCT address, 'coinjoin_like' AS transaction_patterns FROM adt JOIN tx USING (k) WHERE {LOOSE}"),
    "graph_nodes": _q("""SELECT 'addr:' || address AS id, 'address' AS kind, address AS label, received_sats, tx_count,
          CAST(NULL AS BIGINT) AS total_out_sats, CAST(NULL AS BIGINT) AS fee_sats FROM act
        UNION ALL SELECT 'tx:' || txid, 'transaction', left(txid, 12), NULL, NULL, total_out, total_in - total_out FROM tx
        UNION ALL SELECT DISTINCT 'ip:10.0.' || c_nationkey || '.1', 'endpoint', '10.0.' || c_nationkey || '.1', NULL, NULL,
          CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o JOIN customer ON c_custkey = o_custkey"""),
    "graph_edges": _q("SELECT source, target, key, kind, amount_sats FROM edges", EDGES),
    "neighbourhood": _q("SELECT id, CAST(hop AS INTEGER) AS hop, CAST(rank AS INTEGER) AS rank FROM view", EDGES),
    "neighbourhood_edges": _q("""SELECT e.source, e.target, e.key, e.kind FROM edges e JOIN view a ON a.id = e.source
        JOIN view b ON b.id = e.target""", EDGES),
    "join_coverage": JUDGED + """SELECT (SELECT count(*) FROM pred) AS addresses_in_predictions, (SELECT count(*) FROM truth) AS addresses_in_ground_truth,
        (SELECT count(*) FROM j) AS joined, (SELECT count(*) FROM pred ANTI JOIN truth USING (address)) AS in_predictions_only,
        (SELECT count(*) FROM truth ANTI JOIN pred USING (address)) AS in_ground_truth_only,
        (SELECT count(*) FROM j WHERE NOT scored) AS joined_but_unscored""",
    "confusion": JUDGED + """SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
        round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate,
        CASE WHEN tp > 0 THEN round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) END AS f1
        FROM (SELECT count(*) FILTER (flagged AND label) AS tp, count(*) FILTER (flagged AND NOT label) AS fp,
              count(*) FILTER (NOT flagged AND label) AS fn, count(*) FILTER (NOT flagged AND NOT label) AS tn FROM j)""",
    "average_precision": JUDGED + "SELECT variant, round(avg(hits / rank) FILTER (label), 6) AS pr_auc FROM r GROUP BY variant",
    "precision_at_k": JUDGED + """SELECT variant, CAST(k AS BIGINT) AS k, CAST(sum(CAST(label AS INTEGER)) AS BIGINT) AS hits,
        count(*) AS denominator, round(avg(CAST(label AS INTEGER)), 6) AS precision
        FROM r JOIN (SELECT unnest([20, 50, 100]) AS k) ON rank <= k GROUP BY ALL""",
    "predicted_patterns": JUDGED + """SELECT pattern_type, found, count(*) AS n FROM (
        SELECT pattern_type, 'peeling_sequence' AS found FROM j WHERE flagged
        UNION ALL SELECT pattern_type, 'shared_ip_observation' FROM j WHERE priority % 2 = 0) GROUP BY ALL""",
    "truth_counts": """SELECT c_mktsegment AS pattern_type, CASE WHEN c_acctbal < 0 THEN '1' ELSE '0' END AS is_suspicious, count(*) AS n
        FROM customer GROUP BY ALL""",
    "pattern_endpoints": _q("""SELECT '10.0.' || c_nationkey || '.1' AS src_ip, count(*) AS sightings FROM o JOIN customer ON c_custkey = o_custkey
        WHERE txid IN (SELECT txid FROM adt JOIN customer c ON address = 'A' || c.c_custkey WHERE c.c_mktsegment = 'BUILDING') GROUP BY ALL"""),
    "alerts_for_address": INBOX + """SELECT alert_id, pattern, upper(pattern) AS pattern_label, priority, priority_band
        FROM inbox WHERE subject_id = '1'""",
    "per_pattern": JUDGED + """SELECT pattern_type, count(*) AS support, count(*) FILTER (flagged) AS flagged_by_rules,
        count(*) FILTER (label) AS labelled_suspicious, round(avg(CAST(flagged AS INTEGER)), 6) AS recall_within_pattern FROM j GROUP BY pattern_type""",
    "per_role": JUDGED + "SELECT lang AS role, pattern_type, count(*) AS n FROM j GROUP BY ALL",
    "profile_truth": _q("""SELECT count(*) AS rows, count(*) FILTER (c_acctbal < 0) AS suspicious_rows, count(DISTINCT c_custkey) AS distinct_ids,
        (SELECT count(*) FROM act WHERE address NOT IN (SELECT 'A' || c_custkey FROM customer)) AS addresses_without_truth,
        (SELECT count(*) FROM customer WHERE 'A' || c_custkey NOT IN (SELECT address FROM act)) AS truth_without_addresses FROM customer"""),
    "pattern_touch_counts": _q("""SELECT coalesce(c_mktsegment, '?') AS pattern_type, count(DISTINCT txid) AS transactions
        FROM adt LEFT JOIN customer ON address = 'A' || c_custkey GROUP BY ALL"""),
    "alert_facets": INBOX + """SELECT facet, value, count(*) AS n FROM (
        SELECT 'pattern' AS facet, pattern AS value FROM inbox UNION ALL SELECT 'priority_band', priority_band FROM inbox
        UNION ALL SELECT 'evidence_strength', evidence_strength FROM inbox UNION ALL SELECT 'review_state', review_state FROM inbox
        UNION ALL SELECT 'role_hypothesis', role_hypothesis FROM inbox) GROUP BY ALL""",
    "list_alerts": INBOX + """SELECT alert_id, subject_id, priority, priority_band, n AS evidence_count FROM inbox
        JOIN (SELECT CAST(user_id AS VARCHAR) AS u, event_type, count(*) AS n FROM events GROUP BY ALL) ON u = subject_id AND event_type = pattern
        WHERE pattern = 'click' AND contains(subject_id, '1') ORDER BY priority DESC, alert_id LIMIT 50 OFFSET 10""",
    "review_state": """SELECT CAST(c_custkey AS VARCHAR) AS alert_id, coalesce(s, 'new') AS review_state FROM customer
        LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id) ON user_id = c_custkey""",
    "case_overview": """SELECT c_custkey AS case_id, coalesce(n, 0) AS dataset_count, coalesce(n, 0) AS run_count, coalesce(e, 0) AS alert_count,
        latest_run_id FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS latest_run_id
                   FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
        LEFT JOIN (SELECT user_id, count(*) AS e FROM events GROUP BY user_id) ON user_id = c_custkey""",
    "dataset_detail": STAR_CASE + """SELECT dataset_id, file, total_rows, accepted_clean, accepted_warning, quarantined, true AS reconciles,
        i AS issue_counts FROM files JOIN (SELECT dataset_id, count(*) AS total_rows, count(*) FILTER (status = 'accepted') AS accepted_clean,
          count(*) FILTER (status = 'accepted_warning') AS accepted_warning, count(*) FILTER (status = 'quarantined') AS quarantined
          FROM rows_of GROUP BY dataset_id) USING (dataset_id)
        LEFT JOIN (SELECT dataset_id, string_agg(code || '=' || n, ',' ORDER BY code) AS i FROM (
          SELECT dataset_id, code, count(*) AS n FROM issues GROUP BY ALL) GROUP BY dataset_id) USING (dataset_id)""",
    "list_issues": STAR_CASE + """SELECT row_number, ordinal, code, message FROM issues WHERE dataset_id = '1' AND code = 'R'
        ORDER BY row_number, ordinal, code LIMIT 20 OFFSET 2""",
    "list_source_rows": STAR_CASE + """SELECT dataset_id, row_number, status, '{"o_orderpriority":"' || o_orderpriority || '"}' AS payload
        FROM rows_of WHERE dataset_id = '1' AND status = 'accepted' ORDER BY row_number LIMIT 10""",
    "trace_source_row": STAR_CASE + """SELECT r.dataset_id, r.row_number, file, sha256(file) AS sha256, status, i AS issues
        FROM rows_of r JOIN files USING (dataset_id) LEFT JOIN (
          SELECT row_number, string_agg(ordinal || '/' || code || '/' || field || '/' || message, ',' ORDER BY ordinal, code, field, message) AS i
          FROM issues GROUP BY row_number) USING (row_number)
        WHERE r.dataset_id = '1' AND row_number = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 1)""",
    "alert_detail": INBOX + """SELECT a.alert_id, a.subject_id, a.pattern, c_acctbal AS anomaly_score, body AS notes, states, CAST(e.event_id AS VARCHAR) AS txid
        FROM (SELECT * FROM inbox WHERE alert_id = (SELECT CAST(min(event_id) AS VARCHAR) FROM events WHERE user_id = 1)) a
        LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = a.subject_id
        CROSS JOIN (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) AS body,
               string_agg(event_type, ',' ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) AS states FROM events WHERE user_id = 1)
        JOIN events e ON e.event_type = a.pattern AND (e.event_id % 3 = 0 OR CAST(e.user_id AS VARCHAR) = a.subject_id)""",
    "case_audit": """SELECT event_id, CAST(user_id AS VARCHAR) AS case_id, event_type FROM events WHERE user_id = 1
        ORDER BY event_id DESC LIMIT 200""",
    "coinjoin_evidence": _q(f"""SELECT 'coinjoin_like' AS detector, tx.txid AS subject_id, tx.txid, k + 1 AS row_number, CAST(n_in AS INTEGER) AS input_count,
        address AS first_output, amt AS first_output_sats FROM tx JOIN (SELECT k, address, amt FROM outs WHERE pos = 0) USING (k) WHERE {LOOSE}"""),
    "peel_evidence": _q("""SELECT 'peel:' || chain AS context_id, h.txid, h.k + 1 AS row_number, CAST(hop AS BIGINT) AS hop, address,
        amount AS amount_sats, CAST(tx.n_out - 1 AS INTEGER) AS side_outputs FROM hopped h JOIN tx USING (k)""", HOPS, CHAINS, recursive=True),
    "overlay_edges": _q("""SELECT source, target, key, kind, CAST(NULL AS BIGINT) AS support FROM edges UNION ALL
        SELECT DISTINCT 'tx:' || txid, 'tx:' || nx, 'continuity:' || txid || ':' || nx, 'inferred_continuity', CAST(2 AS BIGINT) FROM (
          SELECT txid, lead(txid) OVER (PARTITION BY chain ORDER BY hop) AS nx FROM hopped) WHERE nx IS NOT NULL""",
        HOPS, CHAINS, EDGES, recursive=True),
    "decorated_view": _q("""SELECT view.id, CAST(hop AS INTEGER) AS hop, CAST(rank AS INTEGER) AS rank,
          CASE WHEN view.id LIKE 'addr:%' THEN 'address' WHEN view.id LIKE 'tx:%' THEN 'transaction' ELSE 'endpoint' END AS kind,
          CASE WHEN view.id LIKE 'tx:%' THEN view.id[4:15] ELSE split_part(view.id, ':', 2) END AS label,
          CASE WHEN tx_count > 5 THEN CAST(tx_count AS DOUBLE) END AS anomaly_percentile,
          CASE WHEN tx_count > 5 THEN tx_count % 2 = 0 END AS scored, pattern, priority, band
        FROM view LEFT JOIN act ON view.id = 'addr:' || address LEFT JOIN (
          SELECT 'addr:A' || user_id AS id, arg_max(event_type, (value, CAST(event_id AS VARCHAR))) AS pattern, max(value) AS priority,
            CASE WHEN max(value) >= 75 THEN 'high' WHEN max(value) >= 40 THEN 'medium' ELSE 'low' END AS band
          FROM events GROUP BY user_id) al ON al.id = view.id""", EDGES),
    "view_edges": _q("""SELECT e.source || '|' || e.key || '|' || e.target AS id, e.kind, false AS inferred FROM edges e
        JOIN view a ON a.id = e.source JOIN view b ON b.id = e.target""", EDGES),
    "address_history": _q("""SELECT adt.txid, adt.k + 1 AS row_number, CASE WHEN spends AND receives THEN 'both' WHEN spends THEN 'out' ELSE 'in' END AS direction,
        CAST(n_in AS INTEGER) AS input_count, CAST(n_out AS INTEGER) AS output_count, CASE WHEN received > 0 THEN received ELSE spent END AS amount_sats
        FROM adt JOIN tx USING (k) WHERE address = 'A0'"""),
    "address_totals": _q("""SELECT address, tx_count AS transaction_count, received_sats, spent_sats, incoming_tx_count AS incoming_transactions,
        outgoing_tx_count AS outgoing_transactions, first_us, last_us FROM act WHERE address = 'A0'"""),
    "amount_discrepancies": _q("""SELECT txid, 1 - (k + 1) % 3 AS residual_sats, total_in - total_out + (k + 1) % 3 - 1 AS fee_sats
        FROM tx WHERE (k + 1) % 3 <> 1"""),
    "instants": """SELECT event_id, CASE event_id % 8 WHEN 3 THEN s - 9000000000 WHEN 4 THEN epoch_us(date_trunc('minute', ts))
          WHEN 5 THEN epoch_us(date_trunc('millisecond', ts)) WHEN 6 THEN NULL WHEN 7 THEN s + 6300000000 ELSE s END AS instant_us
        FROM (SELECT event_id, ts, epoch_us(date_trunc('second', ts)) AS s FROM events)""",
    "canonical_ips": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 300 < 256 THEN '10.' || event_id % 300 || '.0.1' END
          WHEN 1 THEN '2001:db8::' || printf('%x', event_id % 65536) END AS ip FROM events""",
}
