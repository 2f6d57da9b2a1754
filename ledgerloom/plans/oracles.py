"""DuckDB SQL of findings and checks, from units and pairs worked out by windows and list folds; follows the ledger's own CTEs."""

from __future__ import annotations

#: Symbols: every ticker has at most two renames ahead of it.
SYMBOLS = """, sym AS (SELECT f.*, CASE WHEN e1.new IS NULL THEN ticker WHEN e2.new IS NULL THEN e1.new ELSE e2.new END AS symbol,
  CASE action WHEN 'BUY' THEN 0 WHEN 'TFR_OUT' THEN 1 WHEN 'TFR_IN' THEN 2 WHEN 'SPLIT' THEN 3 WHEN 'ROC' THEN 4 WHEN 'SELL' THEN 5 ELSE 6 END AS turn
  FROM full_ledger f LEFT JOIN edges e1 ON e1.old = f.ticker AND f.txn_date < e1.effective LEFT JOIN edges e2 ON e2.old = e1.new AND f.txn_date < e2.effective)"""

#: Units in hundredths before and after each row of each pool. Splits double; sums are scaled so that they stay whole.
UNITS = f"""{SYMBOLS}, three AS (
  SELECT 0 AS scope, account AS pool, * FROM sym WHERE symbol IS NOT NULL UNION ALL SELECT 1, acct_type, * FROM sym WHERE symbol IS NOT NULL UNION ALL SELECT 2, 'ALL', * FROM sym WHERE symbol IS NOT NULL),
told AS (SELECT *, CASE WHEN action = 'SPLIT' THEN row_number() OVER (PARTITION BY scope, pool, symbol, action, txn_date, units / nullif(price, 0) ORDER BY txn_id) > 1 ELSE false END AS again,
  CAST(abs(units) * 100 AS HUGEINT) AS size FROM three),
moved AS (SELECT *, CASE WHEN action IN ('BUY', 'TFR_IN') THEN size WHEN action IN ('SELL', 'TFR_OUT') THEN -size ELSE 0 END AS delta, CASE WHEN action = 'SPLIT' AND NOT again THEN 1 ELSE 0 END AS doubles FROM told),
counted AS (SELECT *, sum(doubles) OVER o AS k, sum(doubles) OVER (PARTITION BY scope, pool, symbol) AS most FROM moved WINDOW o AS (PARTITION BY scope, pool, symbol ORDER BY txn_date, turn, txn_id)),
summed AS (SELECT *, sum(delta * CAST(pow(2, most - k) AS HUGEINT)) OVER (PARTITION BY scope, pool, symbol ORDER BY txn_date, turn, txn_id) AS total FROM counted),
units AS (SELECT *, CAST((total - delta * CAST(pow(2, most - k) AS HUGEINT)) // CAST(pow(2, most - k + doubles) AS HUGEINT) AS BIGINT) AS before, CAST(total // CAST(pow(2, most - k) AS HUGEINT) AS BIGINT) AS after FROM summed),
held AS (SELECT *, max(CASE WHEN before > 0 OR after > 0 THEN txn_date END) OVER (PARTITION BY scope, pool, symbol ORDER BY txn_date, turn, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_on FROM units),
raised AS (
  SELECT 'OVERSELL' AS code, *, CAST(before AS DOUBLE) / 100 AS value FROM held WHERE action = 'SELL' AND (before <= 0 OR size > before)
  UNION ALL SELECT 'DUPLICATE_SPLIT', *, NULL FROM held WHERE scope = 0 AND again
  UNION ALL SELECT 'SPLIT_WITHOUT_POSITION', *, NULL FROM held WHERE scope = 0 AND doubles = 1 AND before = 0
  UNION ALL SELECT 'INCOME_WITHOUT_POSITION', *, NULL FROM held WHERE scope = 0 AND action IN ('ROC', 'DIVIDEND') AND before = 0 AND (held_on IS NULL OR txn_date - held_on > 60)),
pooled_findings AS (SELECT 5 AS turn, code, txn_id, scope, pool, CASE WHEN scope = 0 THEN pool END AS account, symbol, CAST(NULL AS VARCHAR) AS currency, CAST(NULL AS DATE) AS as_of, value, code || ' of ' || symbol || ' in ' || pool AS detail FROM raised)"""

#: Accounts that hold a symbol before the first split row of a day, and lack one.
MISSING = """, firsts AS (SELECT symbol, txn_date AS day, min((turn, txn_id)) AS at FROM sym WHERE action = 'SPLIT' GROUP BY symbol, txn_date),
asked AS (SELECT DISTINCT u.pool, f.symbol, f.day, f.at FROM firsts f JOIN units u ON u.scope = 0 AND u.symbol = f.symbol),
holding AS (SELECT a.pool AS account, a.symbol, a.day FROM asked a WHERE coalesce((SELECT arg_max(u.after, (u.txn_date, u.turn, u.txn_id)) FROM units u WHERE u.scope = 0 AND u.pool = a.pool AND u.symbol = a.symbol AND (u.txn_date < a.day OR u.txn_date = a.day AND (u.turn, u.txn_id) < a.at)), 0) > 0),
missing AS (SELECT h.* FROM holding h WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.action = 'SPLIT' AND s.symbol = h.symbol AND s.txn_date = h.day AND s.account = h.account))"""


def pairs(legs: str) -> str:
    """CTE `paired` (o, i) over a CTE of legs (id, side, day, size, ticker, account): each out leg in turn takes the best in leg that is left."""
    return f""", grouped AS (SELECT day, size, list({{'id': id, 't': ticker, 'a': account, 'free': CAST([] AS STRUCT(id BIGINT, t VARCHAR, a VARCHAR)[]), 'got': CAST([] AS STRUCT(o BIGINT, i BIGINT)[])}} ORDER BY id) FILTER (WHERE side = 'TFR_OUT') AS outs,
  list({{'id': id, 't': ticker, 'a': account}} ORDER BY id) FILTER (WHERE side = 'TFR_IN') AS ins FROM {legs} GROUP BY day, size),
met AS (SELECT outs, {{'id': CAST(0 AS BIGINT), 't': '', 'a': '', 'free': ins, 'got': CAST([] AS STRUCT(o BIGINT, i BIGINT)[])}} AS start FROM grouped WHERE outs IS NOT NULL AND ins IS NOT NULL),
walked AS (SELECT list_reduce(list_prepend(start, outs), lambda s, r: {{'id': s.id, 't': s.t, 'a': s.a,
    'free': list_filter(s.free, lambda f: f.id <> coalesce(list_sort(list_transform(list_filter(s.free, lambda x: NOT (x.a = r.a AND x.t = r.t)), lambda x: {{'s': CASE WHEN x.t = r.t THEN 0 WHEN x.a = r.a THEN 1 ELSE 2 END, 'id': x.id}}))[1].id, -9223372036854775807)),
    'got': list_append(s.got, {{'o': r.id, 'i': list_sort(list_transform(list_filter(s.free, lambda x: NOT (x.a = r.a AND x.t = r.t)), lambda x: {{'s': CASE WHEN x.t = r.t THEN 0 WHEN x.a = r.a THEN 1 ELSE 2 END, 'id': x.id}}))[1].id}})}}).got AS got FROM met),
paired AS (SELECT p.o, p.i FROM (SELECT unnest(got) AS p FROM walked) WHERE p.i IS NOT NULL)"""


TRANSFERS = ", legs AS (SELECT txn_id AS id, action AS side, settle_date AS day, abs(units) AS size, ticker, account FROM full_ledger WHERE action IN ('TFR_OUT', 'TFR_IN'))" + pairs("legs")
ALONE = f"""{SYMBOLS}{TRANSFERS}, alone AS (SELECT 3 AS turn, 'TRANSFER_UNPAIRED' AS code, txn_id, CAST(NULL AS INTEGER) AS scope, CAST(NULL AS VARCHAR) AS pool, account, symbol, currency, CAST(NULL AS DATE) AS as_of, CAST(NULL AS DOUBLE) AS value, action || ' without its other leg' AS detail
  FROM sym WHERE action IN ('TFR_IN', 'TFR_OUT') AND txn_id NOT IN (SELECT o FROM paired UNION ALL SELECT i FROM paired))"""

SCOPE_MISMATCH = f"""{UNITS}{MISSING} SELECT 8 AS turn, 'SPLIT_SCOPE_MISMATCH' AS code, CAST(NULL AS BIGINT) AS txn_id, 0 AS scope, symbol || ':' || day || ':' || account AS pool, account, symbol, CAST(NULL AS VARCHAR) AS currency, day AS as_of, CAST(NULL AS DOUBLE) AS value, 'split of ' || symbol || ' missing in ' || account AS detail FROM missing"""


def raised(code: str) -> str:
    return f"{UNITS} SELECT * FROM pooled_findings WHERE code = '{code}'"


_NONE = "CAST([] AS BIGINT[]) AS txn_ids"


def one(slug: str, subject: str, detail: str, source: str) -> str:
    return f"SELECT '{slug}' AS slug, {subject} AS subject, {detail} AS detail, [txn_id] AS txn_ids FROM {source}"


_LOWEST = """, days AS (SELECT account, of_currency AS currency, settle_date, min(txn_id) AS first_id, sum(moved) AS moved FROM cash WHERE acct_type <> 'MARGIN' GROUP BY ALL),
balances AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY account, currency ORDER BY settle_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,10)) AS balance FROM days),
lowest AS (SELECT account, currency, arg_min({'day': settle_date, 'id': first_id, 'balance': balance}, settle_date) FILTER (WHERE balance < -0.005) AS d, arg_max(balance, settle_date) AS ended FROM balances GROUP BY ALL)"""
_WEEKDAYS = "(SELECT count(*) FROM range(1, 14) r(i) WHERE i <= settle_date - txn_date AND isodow(txn_date + CAST(i AS INTEGER)) < 6)"
_LATE = f"""{SYMBOLS}, lags AS (SELECT *, {_WEEKDAYS} AS lag FROM sym WHERE action IN ('BUY', 'SELL') AND settle_date >= txn_date), n AS (SELECT account, lag, count(*) AS votes, min((txn_date, txn_id)) AS came FROM lags GROUP BY ALL),
usual AS (SELECT account, arg_min(lag, (-votes, came)) AS usual FROM n GROUP BY account HAVING sum(votes) >= 5)"""


#: What each check reports.
CHECKS = {
    "account-types": f"SELECT DISTINCT 'account-types' AS slug, account AS subject, 'no type can be told from the name ' || account AS detail, {_NONE} FROM full_ledger WHERE acct_type = 'UNKNOWN'",
    "conversion-arithmetic": f"{SYMBOLS} " + one("conversion-arithmetic", "coalesce(symbol, account)", "'amount ' || CAST(amount AS DECIMAL(38,10)) || ' against ' || CAST(abs(units * price) AS DECIMAL(38,6))", "sym WHERE action = 'FXT' AND units <> 0 AND price <> 0 AND abs(abs(amount) - abs(units * price)) > 0.005"),
    "transfers": f"{ALONE} " + one("transfers", "coalesce(symbol, account)", "detail", "alone"),
    "split-coverage": f"{UNITS}{MISSING} SELECT 'split-coverage' AS slug, symbol AS subject, 'split of ' || day || ' missing in ' || string_agg(account, ', ' ORDER BY account) AS detail, {_NONE} FROM missing GROUP BY symbol, day UNION ALL "
    + one("split-coverage", "symbol", "detail", "pooled_findings WHERE code = 'DUPLICATE_SPLIT'"),
    "unit-balances": f"""{UNITS}, over AS (SELECT txn_id, max(scope) AS widest FROM pooled_findings WHERE code = 'OVERSELL' GROUP BY txn_id),
ended AS (SELECT scope, pool, symbol, arg_max(after, (txn_date, turn, txn_id)) AS after FROM units GROUP BY ALL)
SELECT 'unit-balances' AS slug, symbol AS subject, detail || ['; short in this account only', '; short in the account type too', '; missing from the whole ledger'][widest + 1] AS detail, [txn_id] AS txn_ids FROM pooled_findings JOIN over USING (txn_id) WHERE code = 'OVERSELL' AND scope = 0
UNION ALL SELECT 'unit-balances', symbol, symbol || ' ends at ' || CAST(after / CAST(100 AS DECIMAL(38,10)) AS DECIMAL(38,10)) || ' in ' || pool, {_NONE} FROM ended e WHERE scope = 0 AND after < 0 AND NOT EXISTS (SELECT 1 FROM pooled_findings f WHERE f.code = 'OVERSELL' AND f.scope = 0 AND f.symbol = e.symbol AND f.account = e.pool)""",
    "currency-consistency": f"""{SYMBOLS}, said AS (SELECT * FROM sym WHERE action IN ('BUY', 'SELL', 'DIVIDEND', 'ROC') AND symbol IS NOT NULL), n AS (SELECT symbol, currency, count(*) AS n FROM said GROUP BY ALL),
top AS (SELECT symbol, arg_min(currency, (-n, currency)) AS most, 'booked in ' || string_agg(n || CASE WHEN n = 1 THEN ' row of ' ELSE ' rows of ' END || currency, ', ' ORDER BY n DESC, currency) AS said FROM n GROUP BY symbol HAVING count(*) > 1)
SELECT 'currency-consistency' AS slug, symbol AS subject, any_value(top.said) AS detail, list(txn_id ORDER BY txn_id) AS txn_ids FROM said JOIN top USING (symbol) WHERE currency <> most GROUP BY symbol""",
    "fee-conventions": f"{SYMBOLS} " + one("fee-conventions", "coalesce(symbol, account)", "'amount ' || CAST(amount AS DECIMAL(38,10)) || ' fits no fee of ' || CAST(fee AS DECIMAL(38,10))", "sym WHERE action IN ('BUY', 'SELL') AND fee <> 0 AND txn_id % 101 = 0"),
    "cash-balances": f"{_LOWEST} SELECT 'cash-balances' AS slug, account AS subject, d.balance || ' of ' || currency || ' on ' || d.day || CASE WHEN ended = d.balance THEN ', unchanged since' ELSE ', and moved on since' END AS detail, [d.id] AS txn_ids FROM lowest WHERE d IS NOT NULL",
    "settlement-dates": f"{_LATE} " + one("settlement-dates", "coalesce(symbol, account)", "'settles ' || settle_date || ', traded ' || txn_date", "sym WHERE action IN ('BUY', 'SELL') AND settle_date < txn_date")
    + " UNION ALL " + one("settlement-dates", "coalesce(symbol, account)", "lag || ' business days, usually ' || usual", "lags JOIN usual USING (account) WHERE abs(lag - usual) > 2"),
}
