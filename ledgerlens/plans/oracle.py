"""DuckDB SQL for the registered queries, over the same base tables.

``INVOICES`` rebuilds the accounts-payable tables and the rule results, ``PAGES`` the reader responses; each query adds
its own final SELECT.
"""

from __future__ import annotations

import re

from ledgerlens.functions.text import LABELLED_NUMBER
from ledgerlens.model import ACTION, RULES, TABLE_COMMENTS

AS_OF = "DATE '2001-07-25'"

INVOICES = f"""
WITH vendors AS (
  SELECT 'V' || s_suppkey AS vendor_id, s_name AS name, 'Nation ' || s_nationkey AS address,
    (10 + s_suppkey % 90) || '-' || (1000000 + (s_suppkey * 7919) % 9000000) AS tax_id,
    'Bank ' || (s_suppkey % 6) AS bank_name, '0' || (10000000 + (s_suppkey * 31337) % 90000000) AS routing_number,
    CAST(10000000000 + s_suppkey * 104729 AS VARCHAR) AS bank_account,
    CASE WHEN s_suppkey % 4 = 3 THEN '2/10 Net 30' ELSE 'Net 30' END AS payment_terms, 'active' AS status
  FROM supplier),
billed AS (
  SELECT o_orderkey AS k, o_custkey % (SELECT count(*) FROM supplier) AS vendor, CAST(o_orderdate AS DATE) AS order_date,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_shipdate) AS INTEGER) AS line_no,
    'SKU-' || l_partkey AS sku, 'Part ' || l_partkey AS description, CAST(l_quantity AS INTEGER) AS qty,
    CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(12,2)) AS unit_price, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
po_lines AS (SELECT 'PO-' || k AS po_number, line_no, sku, description, qty, unit_price FROM billed),
goods_receipts AS (
  SELECT 'GR-' || k || '-' || line_no AS receipt_id, 'PO-' || k AS po_number, line_no, sku,
    qty - CASE WHEN (k + line_no) % 47 = 7 THEN 1 ELSE 0 END AS qty_received, ship_date AS received_date FROM billed),
inv_lines AS (
  SELECT 'B' || k AS doc_id, k, vendor, order_date, line_no, sku, description, qty, price AS unit_price,
    CAST(price * qty AS DECIMAL(12,2)) AS amount
  FROM (SELECT *, CAST(unit_price + CASE WHEN (k + line_no) % 43 = 6 THEN 1.25 ELSE 0 END AS DECIMAL(12,2)) AS price FROM billed)),
truth AS (
  SELECT 'B' || k AS doc_id, k, vendor_id, n_lines,
    CASE WHEN k % 31 = 3 THEN 'Unlisted ' || k WHEN k % 7 = 0 THEN '  ' || upper(name) || ' ' ELSE name END AS vendor_name,
    address AS vendor_address,
    CASE WHEN k % 31 <> 3 AND k % 7 <> 0 THEN replace(tax_id, '-', ' ') END AS vendor_tax_id,
    'INV-' || k AS invoice_number, order_date AS invoice_date, CAST(order_date + INTERVAL 30 DAY AS DATE) AS due_date,
    CASE WHEN k % 37 = 4 THEN NULL WHEN k % 41 = 4 THEN 'PO-X' || k ELSE 'po-' || k END AS po_number,
    payment_terms, 'USD' AS currency, bank_name, routing_number,
    CASE WHEN k % 97 = 5 THEN NULL WHEN k % 23 = 1 THEN '9' || bank_account ELSE bank_account END AS bank_account,
    CASE WHEN k % 46 = 1 THEN 'Our bank details have changed.' END AS bank_change_notice,
    total AS subtotal, CAST(0 AS DECIMAL(12,2)) AS tax, total
  FROM (SELECT k, vendor, order_date, CAST(sum(amount) AS DECIMAL(12,2)) AS total, CAST(count(*) AS INTEGER) AS n_lines
        FROM inv_lines GROUP BY k, vendor, order_date) JOIN vendors ON vendor_id = 'V' || vendor),
purchase_orders AS (
  SELECT 'PO-' || k AS po_number, vendor_id, CAST(invoice_date - INTERVAL 21 DAY AS DATE) AS po_date,
    'Buyer ' || (k % 7) AS buyer, 'open' AS status FROM truth),
payments AS (
  SELECT 'PAY-' || k AS payment_id, vendor_id, ' ' || lower(invoice_number) AS invoice_number, invoice_date, total AS amount,
    CAST(invoice_date + INTERVAL 18 DAY AS DATE) AS paid_date, 'ACH' AS payment_method FROM truth WHERE k % 29 = 2),
files AS (
  SELECT doc_id, doc_id || '_' || vendor_id || '_' || invoice_number || '.pdf' AS file_name,
    'landing/' || doc_id || '_' || vendor_id || '_' || invoice_number || '.pdf' AS s3_uri,
    sha256(doc_id || '_' || vendor_id || '_' || invoice_number || '.pdf') AS sha256, CAST(n_lines * 900 + 20000 AS BIGINT) AS size_bytes,
    CASE WHEN k % 19 = 3 THEN 'upload' ELSE 'batch' END AS source, TIMESTAMP '2001-07-24 08:30:00' AS ingested_at,
    CASE WHEN k % 13 <> 5 THEN 'processed' ELSE 'pending' END AS status,
    CASE WHEN k % 13 <> 5 THEN TIMESTAMP '2001-07-25 06:00:00' END AS processed_at FROM truth),
field_rows AS (
  SELECT doc_id, k, CAST(NULL AS INTEGER) AS line_no, i, f AS field_name, i < 10 AS scored, 1 AS on_page,
    CASE f WHEN 'vendor_name' THEN vendor_name WHEN 'vendor_tax_id' THEN vendor_tax_id WHEN 'invoice_number' THEN invoice_number
      WHEN 'invoice_date' THEN CAST(invoice_date AS VARCHAR) WHEN 'po_number' THEN po_number WHEN 'payment_terms' THEN payment_terms
      WHEN 'bank_name' THEN bank_name WHEN 'bank_account' THEN bank_account WHEN 'bank_change_notice' THEN bank_change_notice
      WHEN 'total' THEN CAST(total AS VARCHAR) WHEN 'due_date' THEN CAST(due_date AS VARCHAR) WHEN 'vendor_address' THEN vendor_address
      WHEN 'currency' THEN currency WHEN 'routing_number' THEN routing_number WHEN 'subtotal' THEN CAST(subtotal AS VARCHAR)
      ELSE CAST(tax AS VARCHAR) END AS field_value
  FROM truth, (VALUES (0, 'vendor_name'), (1, 'vendor_tax_id'), (2, 'invoice_number'), (3, 'invoice_date'), (4, 'po_number'),
    (5, 'payment_terms'), (6, 'bank_name'), (7, 'bank_account'), (8, 'bank_change_notice'), (9, 'total'), (90, 'due_date'),
    (91, 'vendor_address'), (92, 'currency'), (93, 'routing_number'), (94, 'subtotal'), (95, 'tax')) AS names(i, f)
  UNION ALL
  SELECT doc_id, k, line_no, i, f, true, CAST(floor((line_no - 1) / 20) AS INTEGER) + 1,
    CASE f WHEN 'sku' THEN sku WHEN 'description' THEN description WHEN 'quantity' THEN CAST(qty AS VARCHAR)
      WHEN 'unit_price' THEN CAST(unit_price AS VARCHAR) ELSE CAST(amount AS VARCHAR) END
  FROM inv_lines, (VALUES (16, 'sku'), (17, 'description'), (18, 'quantity'), (19, 'unit_price'), (20, 'amount')) AS names(i, f)),
extractions AS (
  SELECT doc_id, field_name, line_no, field_value, confidence, CASE WHEN confidence IS NOT NULL THEN on_page END AS page,
    CASE WHEN confidence IS NOT NULL THEN '[0.1, 0.2, 0.5, 0.25]' END AS bbox, 'reader-1' AS model, k
  FROM (SELECT *, CAST(CASE WHEN field_value IS NULL OR (scored AND (k * 13 + i * 7) % 211 = 0) THEN NULL
      WHEN scored AND (k * 31 + i * 17) % 199 < 3 THEN 0.41 ELSE 0.97 END AS DOUBLE) AS confidence FROM field_rows)),
header AS (
  SELECT * FROM (PIVOT (SELECT doc_id, field_name, field_value FROM extractions WHERE line_no IS NULL)
    ON field_name IN ('vendor_name', 'vendor_tax_id', 'invoice_number', 'invoice_date', 'due_date', 'po_number', 'payment_terms',
      'bank_name', 'routing_number', 'bank_account', 'bank_change_notice', 'total') USING max(field_value) GROUP BY doc_id)),
invoice_header AS (
  SELECT doc_id, vendor_name, vendor_tax_id, invoice_number, TRY_CAST(invoice_date AS DATE) AS invoice_date,
    TRY_CAST(due_date AS DATE) AS due_date, po_number, payment_terms, bank_name, bank_account, bank_change_notice,
    TRY_CAST(total AS DECIMAL(12,2)) AS total FROM header),
invoice_lines AS (
  SELECT doc_id, line_no, sku, description, TRY_CAST(quantity AS DECIMAL(12,2)) AS quantity,
    TRY_CAST(unit_price AS DECIMAL(12,2)) AS unit_price, TRY_CAST(amount AS DECIMAL(12,2)) AS amount
  FROM (PIVOT (SELECT doc_id, line_no, field_name, field_value FROM extractions WHERE line_no IS NOT NULL)
    ON field_name IN ('sku', 'description', 'quantity', 'unit_price', 'amount') USING max(field_value) GROUP BY doc_id, line_no)),
iv AS (
  SELECT h.*, coalesce(t.vendor_id, n.vendor_id) AS vendor_id FROM invoice_header h
  LEFT JOIN vendors t ON replace(t.tax_id, '-', '') = regexp_replace(h.vendor_tax_id, '\\D', '', 'g')
  LEFT JOIN vendors n ON lower(trim(n.name)) = lower(trim(h.vendor_name))),
billed_lines AS (
  SELECT iv.doc_id, vendor_id, invoice_number, upper(trim(po_number)) AS po_key, line_no, sku, description, quantity, unit_price
  FROM iv JOIN invoice_lines USING (doc_id)),
found AS (
  SELECT iv.doc_id, iv.vendor_id, iv.invoice_number, 'BANK_MISMATCH' AS rule_code,
    'Invoice asks for payment to ' || coalesce(iv.bank_name, '?') || ' acct ' || iv.bank_account || '; vendor master has ' || v.bank_name
      || ' acct ' || v.bank_account || CASE WHEN bank_change_notice IS NULL THEN '' ELSE '. Invoice includes a "bank details changed" notice.' END AS detail,
    total AS amount_at_risk, 'bank_account' AS evidence_field
  FROM iv, vendors v WHERE iv.vendor_id = v.vendor_id
    AND regexp_replace(iv.bank_account, '\\D', '', 'g') <> regexp_replace(v.bank_account, '\\D', '', 'g')
  UNION ALL
  SELECT doc_id, iv.vendor_id, iv.invoice_number, 'DUPLICATE', 'Invoice ' || iv.invoice_number || ' was already paid: ' || payment_id
    || ' on ' || CAST(paid_date AS VARCHAR) || ' for ' || CAST(amount AS VARCHAR), total, 'invoice_number'
  FROM iv, payments p WHERE p.vendor_id = iv.vendor_id AND lower(trim(p.invoice_number)) = lower(trim(iv.invoice_number))
  UNION ALL
  SELECT doc_id, NULL, invoice_number, 'UNKNOWN_VENDOR', 'No vendor master record for "' || coalesce(vendor_name, '?') || '" (tax ID '
    || coalesce(vendor_tax_id, '?') || ')', total, 'vendor_name' FROM iv WHERE vendor_id IS NULL
  UNION ALL
  SELECT doc_id, vendor_id, invoice_number, 'NO_PO', coalesce('PO ' || po_number || ' does not exist for this vendor',
    'Invoice does not reference a purchase order'), total, 'po_number'
  FROM iv WHERE vendor_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM purchase_orders p WHERE p.vendor_id = iv.vendor_id AND p.po_number = upper(trim(iv.po_number)))
  UNION ALL
  SELECT doc_id, vendor_id, invoice_number, 'PRICE_OVER_PO', b.sku || ': billed ' || b.unit_price || ' vs PO ' || p.unit_price || ' x '
    || CAST(trunc(quantity) AS INTEGER), CAST((b.unit_price - p.unit_price) * quantity AS DECIMAL(12,2)), 'line:' || b.line_no || ':unit_price'
  FROM billed_lines b JOIN po_lines p ON p.po_number = b.po_key AND p.sku = b.sku AND b.unit_price > p.unit_price
  UNION ALL
  SELECT doc_id, vendor_id, invoice_number, 'QTY_OVER_RECEIPT', b.sku || ': billed ' || CAST(trunc(quantity) AS INTEGER) || ', received '
    || qty_received || ' (' || receipt_id || ')', CAST((quantity - qty_received) * unit_price AS DECIMAL(12,2)), 'line:' || b.line_no || ':quantity'
  FROM billed_lines b JOIN goods_receipts r ON r.po_number = b.po_key AND r.sku = b.sku AND quantity > qty_received
  UNION ALL
  SELECT doc_id, vendor_id, invoice_number, 'LOW_CONFIDENCE', field_name || ' read as "' || field_value || '" with confidence '
    || CAST(confidence AS DECIMAL(4,2)), NULL, field_name
  FROM extractions JOIN iv USING (doc_id) WHERE line_no IS NULL AND confidence < 0.85
    AND field_name IN ('invoice_number', 'invoice_date', 'po_number', 'bank_account', 'routing_number', 'total')),
exc0 AS (
  SELECT * FROM found UNION ALL
  SELECT doc_id, vendor_id, invoice_number, 'DISCOUNT_WINDOW', 'Terms ' || payment_terms || ': pay by '
    || CAST(CAST(invoice_date + INTERVAL 10 DAY AS DATE) AS VARCHAR) || ' to save 2%', CAST(total * 0.02 AS DECIMAL(12,2)), 'payment_terms'
  FROM iv WHERE starts_with(payment_terms, '2/10') AND invoice_date + INTERVAL 10 DAY >= {AS_OF}
    AND doc_id NOT IN (SELECT doc_id FROM found)),
rules(rule_code, label, how, tone, priority, action) AS (VALUES
  {", ".join("('" + "', '".join([c, l, h.replace("'", "''"), t]) + f"', {p}, '" + a + "')" for c, l, h, t, p, a in RULES)}),
exc AS (SELECT exc0.*, CAST(priority AS INTEGER) AS priority, action FROM exc0 JOIN rules USING (rule_code))
"""

_TOKENS = "unnest(string_split({0}, ' ')) AS w, generate_subscripts(string_split({0}, ' '), 1) AS o"


def _words(source: str, text: str, seed: str) -> str:
    flat = f"regexp_replace({text}, '[\\s|]', ' ', 'g')"
    return f"""
  SELECT k, p, w, CAST(s AS INTEGER) AS s, CAST(({seed.format(s='s')}) % 1000 AS DOUBLE) / 1000 AS c
  FROM (SELECT k, p, w, o, coalesce(sum(length(w) + 1) OVER (PARTITION BY k, p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT k, p, {_TOKENS.format(flat)} FROM {source}))
  WHERE regexp_matches(w, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_full_match(w, '\\[tbl-\\d+\\.md\\]\\(tbl-\\d+\\.md\\)')"""


PAGES = f"""
WITH src AS (SELECT doc_id AS k, 'D' || doc_id AS doc_id, text, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS day,
    CAST((doc_id % 9000 + 1) * 1.25 AS DECIMAL(12,2)) AS total FROM documents),
ln AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS n, line
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM src)
  WHERE trim(line) <> ''),
pl AS (SELECT k, n // 5 AS p, n % 5 AS j, line, count(*) OVER (PARTITION BY k, n // 5) AS m FROM ln),
pg AS (SELECT k, 0 AS p FROM src UNION SELECT k, p FROM pl),
tok AS (
  SELECT k, p, w, row_number() OVER (PARTITION BY k, p ORDER BY o) - 1 AS t
  FROM (SELECT k, p, {_TOKENS.format("regexp_replace(line, '[\\s|]+', ' ', 'g')")} FROM pl WHERE j = 1 AND m > 2) WHERE w <> ''),
items AS (
  SELECT *, CAST(price * quantity AS DECIMAL(12,2)) AS amount FROM (
    SELECT k, p, CAST(t // 2 AS INTEGER) AS i, max(w) FILTER (t % 2 = 0) AS sku, max(w) FILTER (t % 2 = 1) AS description,
      length(max(w) FILTER (t % 2 = 0)) AS quantity, CAST(length(max(w) FILTER (t % 2 = 1)) * 1234.50 AS DECIMAL(12,2)) AS price
    FROM tok GROUP BY k, p, t // 2 HAVING count(*) = 2)),
item_rows AS (
  SELECT *, '| ' || sku || ' | ' || description || ' | ' || quantity || ' | ' || format('{{:,.2f}}', CAST(price AS DOUBLE)) || ' |' AS line,
    CAST(row_number() OVER (PARTITION BY k ORDER BY p, i) AS INTEGER) AS line_no FROM items),
tbl AS (
  SELECT pl.k, pl.p, '| Item | Description | Qty | Price |' || chr(10) || '|---|---|---|---|'
    || coalesce(string_agg(chr(10) || item_rows.line, '' ORDER BY i), '') AS content, count(i) AS n_items
  FROM pl LEFT JOIN item_rows USING (k, p) WHERE j = 1 AND m > 2 GROUP BY pl.k, pl.p),
info AS (SELECT k, 'Invoice No. INV-' || k AS l0, 'Date: ' || CASE k % 4 WHEN 0 THEN strftime(day, '%m/%d/%Y') WHEN 1 THEN strftime(day, '%B %d, %Y')
    WHEN 2 THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%b %d, %Y') END AS l1, 'Total due: ' || format('{{:,.2f}}', CAST(total AS DOUBLE)) AS l2 FROM src),
blk AS (
  SELECT k, 0 AS p, -1 AS b, 'text' AS type, l0 || chr(10) || l1 || chr(10) || l2 AS content, 55 AS y0, 220 AS y1 FROM info
  UNION ALL
  SELECT k, p, j, CASE WHEN j = 0 THEN 'title' WHEN j = m - 1 THEN 'footer' WHEN j = 1 AND m > 2 THEN 'table' ELSE 'text' END,
    CASE WHEN j = 0 THEN '# ' || line WHEN j < m - 1 AND j = 1 AND m > 2 THEN content ELSE line END, 275 + j * 330, 605 + j * 330
  FROM pl LEFT JOIN tbl USING (k, p)),
md AS (SELECT k, p, string_agg(CASE WHEN type = 'table' THEN '[tbl-' || p || '.md](tbl-' || p || '.md)' ELSE content END,
    chr(10) || chr(10) ORDER BY b) AS markdown FROM blk GROUP BY k, p),
wd AS ({_words("md", "markdown", "k * 31 + p * 7 + {s} * 17")}),
twd AS ({_words("tbl", "content", "k * 29 + p * 11 + {s} * 13")}),
rows_of AS (
  SELECT k, 0 AS p, -1 AS b, r AS row, 3 AS n_rows, CASE r WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS line, false AS in_table, false AS foot, 55 AS y0, 220 AS y1
  FROM info, (VALUES (0), (1), (2)) AS v(r)
  UNION ALL
  SELECT k, p, b, 0, 1, regexp_replace(content, '\\*\\*|^#+\\s*|\\s{{2,}}$', '', 'g'), false, type = 'footer', y0, y1 FROM blk WHERE b >= 0 AND type <> 'table'
  UNION ALL
  SELECT k, p, 1, 0, CAST(n_items AS INTEGER) + 1, '| Item | Description | Qty | Price |', true, false, 605, 935 FROM tbl
  UNION ALL
  SELECT k, p, 1, i + 1, CAST(n_items AS INTEGER) + 1, line, true, false, 605, 935 FROM item_rows JOIN tbl USING (k, p)),
sl AS (
  SELECT *, lower(line) AS low, row_number() OVER (PARTITION BY k ORDER BY p, foot, b, row) AS ord,
    round(100 / 1700, 4) AS x0, round((y0 + row * ((y1 - y0) / n_rows)) / 2203, 4) AS top, round(1600 / 1700, 4) AS x1,
    round((y0 + (row + 1) * ((y1 - y0) / n_rows)) / 2203, 4) AS bottom FROM rows_of)
"""

# A lookup: want(k, id, needle, pref, row_key) -> hit (the first line) -> placed (confidence).
_LOOKUP = """
, cand AS (
  SELECT w.k, w.id, arg_min({'ord': ord, 'needle': w.needle}, {'ord': ord, 'pref': pref}) AS h
  FROM want w JOIN sl ON sl.k = w.k AND contains(low, w.needle) AND (w.row_key IS NULL OR contains(low, w.row_key)) GROUP BY w.k, w.id),
hit AS (SELECT c.k, c.id, h.needle AS needle, sl.p, in_table, trim(line) AS printed, x0, top, x1, bottom FROM cand c JOIN sl ON sl.k = c.k AND sl.ord = c.h.ord),
spot AS (
  SELECT hit.*, CASE WHEN in_table THEN strpos(content, printed) - 1 + strpos(lower(substr(content, strpos(content, printed))), needle)
      ELSE strpos(lower(markdown), needle) END AS a, CASE WHEN in_table THEN strpos(lower(content), lower(printed)) END AS ra
  FROM hit JOIN md USING (k, p) LEFT JOIN tbl USING (k, p)),
conf AS (
  SELECT s.k, s.id, round(min(c), 4) AS c FROM spot s JOIN wd ON NOT in_table AND wd.k = s.k AND wd.p = s.p
    AND wd.s < a - 1 + length(needle) AND wd.s + length(wd.w) > a - 1 GROUP BY s.k, s.id
  UNION ALL
  SELECT s.k, s.id, CASE WHEN round(min(c) FILTER (t.s < a - 1 + length(needle) AND t.s + length(t.w) > a - 1), 4) > 0
      THEN round(min(c) FILTER (t.s < a - 1 + length(needle) AND t.s + length(t.w) > a - 1), 4) ELSE round(min(c), 4) END
  FROM spot s JOIN twd t ON in_table AND t.k = s.k AND t.p = s.p AND t.s < ra - 1 + length(printed) AND t.s + length(t.w) > ra - 1 GROUP BY s.k, s.id),
placed AS (SELECT hit.*, conf.c AS confidence FROM hit LEFT JOIN conf USING (k, id))
"""
_WORDS_WANTED = """
, vals AS (SELECT DISTINCT k, doc_id, unnest(list_append(regexp_extract_all(text, '\\p{L}{6,}'), 'zzabsentzz')) AS value FROM src),
want AS (SELECT k, value AS id, lower(value) AS needle, 0 AS pref, CAST(NULL AS VARCHAR) AS row_key FROM vals)
""" + _LOOKUP
_FIELDS_WANTED = """
, vals AS (
  SELECT k, doc_id, f AS field_name, CAST(NULL AS INTEGER) AS line_no, CAST(NULL AS VARCHAR) AS row_key,
    CASE f WHEN 'vendor_name' THEN (SELECT trim(line) FROM ln WHERE ln.k = src.k AND n = 0) WHEN 'invoice_number' THEN 'INV-' || k
      WHEN 'invoice_date' THEN CAST(day AS VARCHAR) WHEN 'po_number' THEN nullif(regexp_extract(text, '\\p{L}{6,}'), '')
      WHEN 'currency' THEN 'USD' WHEN 'total' THEN CAST(total AS VARCHAR) END AS value, day, total AS amt
  FROM src, (VALUES ('vendor_name'), ('vendor_address'), ('vendor_tax_id'), ('invoice_number'), ('invoice_date'), ('due_date'), ('po_number'),
    ('payment_terms'), ('currency'), ('bank_name'), ('routing_number'), ('bank_account'), ('bank_change_notice'), ('subtotal'), ('tax'), ('total')) AS v(f)
  UNION ALL
  SELECT k, 'D' || k, f, line_no, sku, CASE f WHEN 'sku' THEN sku WHEN 'description' THEN description WHEN 'quantity' THEN CAST(quantity AS VARCHAR)
      WHEN 'unit_price' THEN CAST(price AS VARCHAR) ELSE CAST(amount AS VARCHAR) END, NULL, CASE f WHEN 'unit_price' THEN price WHEN 'amount' THEN amount END
  FROM item_rows, (VALUES ('sku'), ('description'), ('quantity'), ('unit_price'), ('amount')) AS v(f)),
variants AS (
  SELECT k, field_name || coalesce(':' || line_no, '') AS id, lower(row_key) AS row_key, unnest(
    CASE WHEN value IS NULL THEN [] WHEN amt IS NOT NULL AND field_name IN ('total', 'unit_price', 'amount') THEN [format('{:,.2f}', CAST(amt AS DOUBLE)), value]
      WHEN field_name = 'invoice_date' THEN [strftime(day, '%m/%d/%Y'), strftime(day, '%B %d, %Y'), value, strftime(day, '%b %d, %Y')] ELSE [value] END) AS v,
    generate_subscripts(CASE WHEN value IS NULL THEN [] WHEN amt IS NOT NULL AND field_name IN ('total', 'unit_price', 'amount') THEN ['', '']
      WHEN field_name = 'invoice_date' THEN ['', '', '', ''] ELSE [''] END, 1) AS pref FROM vals),
want AS (SELECT k, id, lower(v) AS needle, pref, row_key FROM variants)
""" + _LOOKUP


def _mean(c: str, places: int) -> str:
    """Mean of a column rounded half up in whole numbers, so that ties do not depend on floating point."""
    unit = 10 ** places
    return f"(CAST(sum(CAST(round({c} * 1000000) AS HUGEINT)) AS HUGEINT) * {2 * unit} + count({c}) * 1000000) // (2 * nullif(count({c}), 0) * 1000000) / {unit}.0::DOUBLE"


_BOX = "x0, top AS y0, x1, bottom AS y1"

_RULE = "SELECT doc_id, vendor_id, invoice_number, rule_code, detail, amount_at_risk, priority, action, evidence_field FROM exc WHERE rule_code = '{}'"
_SCORED = """
, misread AS (
  SELECT doc_id, field_name, line_no, k, field_value AS plain, CASE WHEN (k * 19 + length(field_name) + coalesce(line_no, 0)) % 251 = 0 THEN '8' || substr(field_value, 2)
    ELSE field_value END AS field_value FROM extractions),
forms AS (
  SELECT doc_id, field_name, line_no, plain AS expected, field_value AS extracted, regexp_replace(plain, '^\\s+|\\s+$', '', 'g') AS a,
    regexp_replace(field_value, '^\\s+|\\s+$', '', 'g') AS b FROM misread),
scored AS (
  SELECT doc_id, field_name, line_no, expected, extracted,
    coalesce(CAST(CAST(TRY_CAST(replace(a, ',', '') AS DOUBLE) AS DECIMAL(38,2)) AS VARCHAR), lower(a), '')
      = coalesce(CAST(CAST(TRY_CAST(replace(b, ',', '') AS DOUBLE) AS DECIMAL(38,2)) AS VARCHAR), lower(b), '') AS ok FROM forms
  WHERE field_name IN ('vendor_name', 'invoice_number', 'invoice_date', 'due_date', 'po_number', 'payment_terms', 'bank_name', 'routing_number',
    'bank_account', 'total', 'sku', 'quantity', 'unit_price', 'amount'))
"""
_EXPECTED = f"""
, clean AS (SELECT t.*, upper(t.po_number) AS po_key, v.bank_account AS on_file FROM truth t JOIN vendors v USING (vendor_id)),
agreed AS (SELECT po_number, sku, arg_max(unit_price, line_no) AS agreed FROM po_lines GROUP BY ALL),
received AS (SELECT po_number, sku, arg_max(qty_received, line_no) AS qty_received FROM goods_receipts GROUP BY ALL),
overs AS (
  SELECT c.doc_id, sum((l.unit_price - a.agreed) * l.qty) FILTER (l.unit_price > a.agreed) AS price_over,
    sum((l.qty - r.qty_received) * l.unit_price) FILTER (l.qty > r.qty_received) AS qty_over
  FROM clean c JOIN inv_lines l USING (doc_id) LEFT JOIN agreed a ON a.po_number = c.po_key AND a.sku = l.sku
  LEFT JOIN received r ON r.po_number = c.po_key AND r.sku = l.sku WHERE c.po_key IN (SELECT po_number FROM purchase_orders) GROUP BY c.doc_id),
exp5 AS (
  SELECT doc_id, 'BANK_MISMATCH' AS rule_code, CAST(total AS DECIMAL(24,2)) AS amount FROM clean WHERE bank_account IS DISTINCT FROM on_file
  UNION ALL SELECT doc_id, 'DUPLICATE', total FROM clean WHERE (vendor_id, invoice_number) IN (SELECT (vendor_id, upper(trim(invoice_number))) FROM payments)
  UNION ALL SELECT doc_id, 'NO_PO', total FROM clean WHERE po_key IS NULL OR po_key NOT IN (SELECT po_number FROM purchase_orders)
  UNION ALL SELECT doc_id, 'PRICE_OVER_PO', price_over FROM overs WHERE price_over > 0
  UNION ALL SELECT doc_id, 'QTY_OVER_RECEIPT', qty_over FROM overs WHERE qty_over > 0),
expected AS (
  SELECT * FROM exp5 UNION ALL
  SELECT doc_id, 'DISCOUNT_WINDOW', CAST(total * 0.02 AS DECIMAL(24,2)) FROM clean
  WHERE starts_with(payment_terms, '2/10') AND invoice_date + INTERVAL 10 DAY >= {AS_OF} AND doc_id NOT IN (SELECT doc_id FROM exp5)),
rollup_found AS (SELECT doc_id, rule_code, CAST(sum(coalesce(amount_at_risk, 0)) AS DECIMAL(24,2)) AS found FROM exc WHERE rule_code <> 'LOW_CONFIDENCE' GROUP BY ALL),
matched AS (
  SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, coalesce(e.rule_code, f.rule_code) AS rule_code, e.amount AS expected, f.found,
    coalesce(abs(e.amount - f.found) < 0.01, false) AS ok
  FROM expected e FULL OUTER JOIN rollup_found f ON e.doc_id = f.doc_id AND e.rule_code = f.rule_code),
per_doc AS (SELECT doc_id, count(expected) AS n_expected, count(found) AS n_found, CASE WHEN bool_and(ok) THEN 'ok' ELSE 'WRONG' END AS status FROM matched GROUP BY doc_id)
"""
_QUEUE = """SELECT e.*, v.name AS vendor_name, f.source, f.file_name FROM exc e LEFT JOIN vendors v USING (vendor_id) LEFT JOIN files f USING (doc_id)"""
_KEYS = """
, keyed AS (SELECT *, string_split(evidence_field, ':') AS parts FROM exc),
keys AS (
  SELECT doc_id, rule_code, evidence_field, CAST(pos AS INTEGER) AS pos, f AS field_name, CAST(n AS INTEGER) AS evidence_line FROM (
    SELECT doc_id, rule_code, evidence_field, 0 AS pos, parts[-1] AS f, CASE WHEN len(parts) = 3 THEN CAST(parts[2] AS INTEGER) END AS n FROM keyed
    UNION ALL SELECT doc_id, rule_code, evidence_field, v.pos, v.f, CAST(parts[2] AS INTEGER) FROM keyed, (VALUES (1, 'sku'), (2, 'description')) AS v(pos, f) WHERE len(parts) = 3
    UNION ALL SELECT doc_id, keyed.rule_code, evidence_field, v.pos, v.f, NULL FROM keyed JOIN (VALUES ('BANK_MISMATCH', 1, 'bank_name'), ('BANK_MISMATCH', 2, 'routing_number'),
      ('BANK_MISMATCH', 3, 'bank_change_notice'), ('DUPLICATE', 1, 'total'), ('DUPLICATE', 2, 'invoice_date'), ('UNKNOWN_VENDOR', 1, 'vendor_tax_id'),
      ('DISCOUNT_WINDOW', 1, 'invoice_date'), ('DISCOUNT_WINDOW', 2, 'total')) AS v(rule_code, pos, f) USING (rule_code))),
located AS (
  SELECT keys.*, page, bbox, confidence, model FROM keys LEFT JOIN extractions x
    ON x.doc_id = keys.doc_id AND x.field_name = keys.field_name AND x.line_no IS NOT DISTINCT FROM keys.evidence_line)
"""


def _same(a: str, b: str) -> str:
    strip = "regexp_replace(coalesce({}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"lower({strip.format(a)}) = lower({strip.format(b)})"


def _cmp(source: str, pos: int | str, what: str, invoice: str, record: str, table: str, ok: str | None = None) -> str:
    return (f"SELECT doc_id, rule_code, evidence_field, detail, {pos} AS pos, {what} AS what, {invoice} AS invoice, {record} AS record, "
            f"'{table}' AS source, {ok or _same(invoice, record)} AS ok FROM {source}")


_LISTS = """
, lists AS (SELECT vendor_id, chunk, count(*) AS n, string_agg(po_number, ', ' ORDER BY po_number) AS pos
  FROM (SELECT vendor_id, po_number, CAST((row_number() OVER (PARTITION BY vendor_id ORDER BY po_number) - 1) // 100 AS INTEGER) AS chunk FROM purchase_orders)
  GROUP BY vendor_id, chunk)
"""
_COMPARISON = _LISTS + """, e AS (SELECT x.doc_id, x.rule_code, x.evidence_field, x.detail, x.amount_at_risk, x.vendor_id, h.* EXCLUDE (doc_id),
    TRY_CAST(string_split(x.evidence_field, ':')[2] AS INTEGER) AS line_no FROM exc x JOIN header h USING (doc_id)),
bank AS (SELECT e.*, v.bank_name AS vb, v.routing_number AS vr, v.bank_account AS va FROM e JOIN vendors v USING (vendor_id) WHERE rule_code = 'BANK_MISMATCH'),
dup AS (SELECT e.*, p.payment_id, p.invoice_number AS pn, CAST(p.amount AS VARCHAR) AS pa, CAST(p.invoice_date AS VARCHAR) AS pd, CAST(p.paid_date AS VARCHAR) AS pp
  FROM e JOIN payments p ON p.vendor_id = e.vendor_id AND upper(trim(p.invoice_number)) = upper(trim(e.invoice_number)) WHERE rule_code = 'DUPLICATE'),
nopo AS (SELECT e.*, coalesce(chunk, 0) AS chunk, coalesce(lists.pos, '(none)') AS candidates FROM e LEFT JOIN lists USING (vendor_id) WHERE rule_code = 'NO_PO'),
ltext AS (SELECT doc_id, line_no, max(field_value) FILTER (field_name = 'sku') AS sku, max(field_value) FILTER (field_name = 'description') AS ld,
  max(field_value) FILTER (field_name = 'quantity') AS lq, max(field_value) FILTER (field_name = 'unit_price') AS lp FROM extractions WHERE line_no IS NOT NULL GROUP BY ALL),
lines AS (SELECT e.*, l.sku, ld, lq, lp FROM e JOIN ltext l USING (doc_id, line_no)),
pol AS (SELECT po_number, sku, arg_min({'d': description, 'p': unit_price, 'q': qty}, line_no) AS r FROM po_lines GROUP BY ALL),
price AS (SELECT lines.*, r.d AS rd, CAST(r.p AS VARCHAR) AS rp, CAST(r.q AS VARCHAR) AS rq FROM lines JOIN pol ON pol.po_number = upper(trim(lines.po_number)) AND pol.sku = lines.sku WHERE rule_code = 'PRICE_OVER_PO'),
rec AS (SELECT po_number, sku, arg_min({'i': receipt_id, 'q': qty_received, 'd': received_date}, line_no) AS r FROM goods_receipts GROUP BY ALL),
qty AS (SELECT lines.*, r.i AS ri, CAST(r.q AS VARCHAR) AS rq, CAST(r.d AS VARCHAR) AS rd FROM lines JOIN rec ON rec.po_number = upper(trim(lines.po_number)) AND rec.sku = lines.sku WHERE rule_code = 'QTY_OVER_RECEIPT'),
disc AS (SELECT * FROM e WHERE rule_code = 'DISCOUNT_WINDOW'),
low AS (SELECT e.*, x.field_value, x.confidence, replace(e.evidence_field, '_', ' ') AS t FROM e JOIN extractions x ON x.doc_id = e.doc_id AND x.field_name = e.evidence_field AND x.line_no IS NULL WHERE rule_code = 'LOW_CONFIDENCE'),
unk AS (SELECT * FROM e WHERE rule_code = 'UNKNOWN_VENDOR')
""" + "\nUNION ALL ".join([
    _cmp("bank", 0, "'Bank'", "bank_name", "vb", "vendors"),
    _cmp("bank", 1, "'Routing (ABA)'", "routing_number", "vr", "vendors"),
    _cmp("bank", 2, "'Account'", "bank_account", "va", "vendors"),
    _cmp("bank", 3, "'Change notice on invoice'", "bank_change_notice", "'(none on file)'", "vendors", "false") + " WHERE bank_change_notice <> ''",
    _cmp("dup", 0, "'Invoice number'", "invoice_number", "pn", "payments"),
    _cmp("dup", 1, "'Amount'", "total", "pa", "payments"),
    _cmp("dup", 2, "'Invoice date'", "invoice_date", "pd", "payments"),
    _cmp("dup", 3, "'Paid'", "'(this invoice)'", "payment_id || ' on ' || pp", "payments", "false"),
    _cmp("nopo", "chunk", "'PO number'", "coalesce(po_number, '(none)')", "candidates", "purchase_orders", "false"),
    _cmp("price", 0, "'Item'", "sku || ' ' || coalesce(ld, '')", "sku || ' ' || rd", "po_lines"),
    _cmp("price", 1, "'Unit price'", "lp", "rp", "po_lines", "false"),
    _cmp("price", 2, "'Quantity'", "lq", "rq", "po_lines"),
    _cmp("qty", 0, "'Item'", "sku || ' ' || coalesce(ld, '')", "sku || ' (receipt ' || ri || ')'", "goods_receipts", "true"),
    _cmp("qty", 1, "'Quantity'", "lq", "rq", "goods_receipts", "false"),
    _cmp("qty", 2, "'Received on'", "''", "rd", "goods_receipts", "true"),
    _cmp("disc", 0, "'Terms'", "payment_terms", "'2% if paid within 10 days'", "vendors", "true"),
    _cmp("disc", 1, "'Invoice date'", "invoice_date",
         "'pay by ' || CAST(CAST(CAST(invoice_date AS DATE) + INTERVAL 10 DAY AS DATE) AS VARCHAR) || ' (today 2001-07-25)'", "", "true"),
    _cmp("disc", 2, "'Savings'", "total", "format('{:,.2f}', CAST(amount_at_risk AS DOUBLE))", "", "true"),
    _cmp("low", 0, "upper(t[1]) || t[2:]", "field_value", "'confidence ' || CAST(coalesce(confidence, 0) AS DECIMAL(4,2))", "extractions", "false"),
    _cmp("unk", 0, "'Vendor'", "vendor_name", "'(no match)'", "vendors", "false"),
    _cmp("unk", 1, "'Tax ID'", "vendor_tax_id", "'(no match)'", "vendors", "false"),
])


def _inv(select: str, extra: str = "") -> str:
    return INVOICES + extra + select


def _pag(select: str, extra: str = "") -> str:
    return PAGES + extra + select


def _queue_columns(prefix: str = "") -> str:
    return ", ".join(prefix + c for c in ("doc_id", "vendor_id", "invoice_number", "rule_code", "detail", "amount_at_risk", "priority", "action", "evidence_field"))


_EVERY_EXCEPTION = f"SELECT {_queue_columns()} FROM exc"
_FILES = """
WITH reg AS (SELECT 'D' || doc_id AS doc_id, lang, source, '%PDF-1.7 ' || text AS text, sha256('%PDF-1.7 ' || text) AS sha256, 'D' || doc_id || '_' || lang || '_' || source || '.pdf' AS file_name
  FROM documents WHERE source <> 'src7')
"""
_LAND = _FILES + """, firsts AS (SELECT sha256, min(doc_id) AS first_id FROM reg GROUP BY sha256),
known AS (SELECT sha256, min(doc_id) AS known_id FROM reg WHERE lang = 'en' GROUP BY sha256)
"""
_REVIEWS = """
, ev AS (SELECT 'B' || user_id AS doc_id, arg_max({'v': CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), 'r': event_type}, {'t': ts, 's': event_id}) AS r FROM events WHERE event_id % 7 <> 1 GROUP BY user_id),
patched AS (
  SELECT x.doc_id, field_name, line_no, CASE WHEN ev.doc_id IS NULL THEN field_value ELSE ev.r.v END AS field_value,
    CASE WHEN ev.doc_id IS NULL THEN confidence ELSE 1.0 END AS confidence, CASE WHEN ev.doc_id IS NULL THEN model ELSE 'reviewed by ' || ev.r.r END AS model
  FROM extractions x LEFT JOIN ev ON ev.doc_id = x.doc_id AND x.field_name = 'total' AND x.line_no IS NULL)
"""
_TABLES = ["vendors", "purchase_orders", "po_lines", "goods_receipts", "payments", "documents", "extractions", "exceptions"]
_SQL_NAME = {"documents": "files", "exceptions": "exc"}
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {_SQL_NAME.get(t, t)}" for t in _TABLES)


def _reviewed_rules() -> str:
    """The rule results when the reviewed field rows take the place of the extracted ones."""
    head, tail = INVOICES.split("header AS (", 1)
    return head.replace("\nextractions AS (", "\nread_rows AS (") + _REVIEWS.replace("FROM extractions x", "FROM read_rows x").lstrip()[2:].rstrip() + \
        ",\nextractions AS (SELECT * FROM patched),\nheader AS (" + tail


def _changed_enterprise() -> str:
    """The rule results when some vendors and orders are on file with other values than the invoices were made from."""
    head, tail = INVOICES.split("\niv AS (", 1)
    changed = """
vendors_now AS (
  SELECT * REPLACE (CASE WHEN n % 5 = 1 THEN '7' || bank_account ELSE bank_account END AS bank_account,
    CASE WHEN n % 5 = 2 THEN '99-' || n ELSE tax_id END AS tax_id, CASE WHEN n % 5 = 2 THEN 'Renamed ' || n ELSE name END AS name)
  FROM (SELECT *, CAST(vendor_id[2:] AS BIGINT) AS n FROM vendors) WHERE n % 7 <> 3),
orders_now AS (
  SELECT * REPLACE (CASE WHEN CAST(po_number[4:] AS BIGINT) % 11 = 3 THEN 'V0' ELSE vendor_id END AS vendor_id) FROM purchase_orders),"""
    return head + changed + "\niv AS (" + re.sub(r"\bpurchase_orders\b", "orders_now", re.sub(r"\bvendors\b", "vendors_now", tail))


_KPIS = "SELECT (SELECT count(*) FROM files WHERE status = 'processed') AS processed, (SELECT count(*) FROM extractions) AS fields, count(*) AS actions, count(DISTINCT doc_id) FILTER (priority <= 3) AS need_action, CAST(coalesce(sum(amount_at_risk) FILTER (priority <= 3), 0) AS DECIMAL(24,2)) AS at_risk, CAST(coalesce(sum(amount_at_risk) FILTER (rule_code = 'DISCOUNT_WINDOW'), 0) AS DECIMAL(24,2)) AS discounts, count(DISTINCT doc_id) FILTER (rule_code = 'LOW_CONFIDENCE') AS review FROM exc"

SQL: dict[str, str] = {
    # ---- scans, sources, sinks
    **{f"S1_erp_{t}": _inv(f"SELECT * FROM {t}") for t in ("vendors", "purchase_orders", "po_lines", "goods_receipts", "payments")},
    "S2_register_files": _FILES + "SELECT doc_id, file_name, 'landing/' || file_name AS s3_uri, sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, 'batch' AS source, 'pending' AS status FROM reg",
    "S3_land": _LAND + "SELECT first_id AS doc_id, sha256 FROM firsts WHERE sha256 NOT IN (SELECT sha256 FROM known)",
    "S3_landed_ids": _LAND + "SELECT doc_id, coalesce(known_id, first_id) AS landed_id, known_id IS NULL AND doc_id = first_id AS added FROM reg JOIN firsts USING (sha256) LEFT JOIN known USING (sha256)",
    "S4_responses_json": _pag("SELECT 'D' || md.k AS doc_id, CAST(md.p + 1 AS INTEGER) AS page, markdown, b.n AS n_blocks, coalesce(w.n, 0) AS n_words FROM md JOIN (SELECT k, p, CAST(count(*) AS INTEGER) AS n FROM blk GROUP BY k, p) b USING (k, p) LEFT JOIN (SELECT k, p, CAST(count(*) AS INTEGER) AS n FROM wd GROUP BY k, p) w USING (k, p)"),
    "S5_create_tables": _inv("SELECT * FROM po_lines"),
    "S6_append_rows": _inv("SELECT doc_id, field_name, line_no, field_value FROM extractions"),
    "S7_replace_by_key": _inv("SELECT doc_id, field_name, line_no, CASE WHEN source = 'upload' THEN field_value ELSE plain END AS field_value FROM misread JOIN files USING (doc_id)", _SCORED),
    "S8_mark_processed": _inv("SELECT doc_id, CASE WHEN r THEN 'processed' ELSE status END AS status, CAST(CASE WHEN r THEN TIMESTAMP '2001-07-25 07:00:00' ELSE processed_at END AS VARCHAR) AS processed_at FROM (SELECT *, status = 'pending' AS r FROM files)"),
    "S8_apply_reviews": _inv("SELECT * FROM patched", _REVIEWS),
    "S9_delete_documents": _inv("SELECT doc_id, source, status FROM files WHERE source <> 'upload'"),
    "S9_delete_extractions": _inv("SELECT doc_id, field_name, line_no, field_value FROM extractions WHERE doc_id IN (SELECT doc_id FROM files WHERE source <> 'upload')"),
    "S9_delete_exceptions": _inv(f"SELECT {_queue_columns()} FROM exc WHERE doc_id IN (SELECT doc_id FROM files WHERE source <> 'upload')"),
    "S8_review_rejects": "SELECT event_id AS seq, 'B' || user_id AS doc_id, 'total' AS field_name, 'about ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, 'Total must be an amount, for example 2273.60.' AS error FROM events WHERE event_id % 7 = 1",
    "S10_rebuild_queue": _inv(_EVERY_EXCEPTION),
    "S11_table_inventory": _inv("SELECT table_name, CASE WHEN table_name IN ('documents', 'extractions', 'exceptions') THEN 'Document AI' ELSE 'Enterprise data' END AS kind, n_rows, comment FROM (" + _COUNTS + ") JOIN (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in TABLE_COMMENTS.items()) + ") AS c(table_name, comment) USING (table_name)"),
    "S12_json_safe": _inv("SELECT doc_id, CAST(total AS DOUBLE) AS total, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(processed_at AS VARCHAR) AS processed_at, CASE WHEN status = 'processed' THEN size_bytes / 1000 END AS kilobytes FROM truth JOIN files USING (doc_id)"),
    # ---- projections, pivots
    "P1_invoice_header": _inv("SELECT * FROM invoice_header"),
    "P2_invoice_lines": _inv("SELECT * FROM invoice_lines"),
    "P3_flatten_annotation": _pag("SELECT doc_id, field_name, line_no, value AS field_value, row_key FROM vals", _FIELDS_WANTED),
    "P4_canonical_value": _inv("SELECT doc_id, field_name, line_no, CASE WHEN field_name IN ('subtotal', 'tax', 'total', 'unit_price', 'amount') THEN CAST(TRY_CAST(field_value AS DECIMAL(12,2)) AS VARCHAR) WHEN field_name = 'quantity' THEN field_value ELSE regexp_replace(field_value, '^\\s+|\\s+$', '', 'g') END AS canonical FROM misread", _SCORED),
    "P5_check_value": _inv("""
, kinds AS (SELECT *, field_name IN ('subtotal', 'tax', 'total', 'unit_price', 'amount') AS money, field_name IN ('invoice_date', 'due_date') AS day FROM extractions),
reviews AS (SELECT *, CASE WHEN k % 17 = 3 THEN ' ' WHEN money AND k % 5 = 2 THEN 'twelve' WHEN money THEN ' $' || format('{:,.2f}', TRY_CAST(field_value AS DOUBLE))
    WHEN day AND k % 5 = 3 THEN replace(field_value, '-', '/') ELSE field_value || ' ' END AS v FROM kinds),
stripped AS (SELECT doc_id, field_name, line_no, money, day, trim(v) AS v, CASE WHEN money THEN CAST(TRY_CAST(replace(replace(trim(v), '$', ''), ',', '') AS DECIMAL(38,2)) AS VARCHAR)
    WHEN day THEN CASE WHEN regexp_full_match(trim(v), '\\d{4}-\\d{2}-\\d{2}') THEN CAST(TRY_CAST(trim(v) AS DATE) AS VARCHAR) END ELSE trim(v) END AS stored,
    upper(field_name[1]) || replace(field_name, '_', ' ')[2:] AS label FROM reviews)
SELECT doc_id, field_name, line_no, CASE WHEN v <> '' THEN stored END AS value, CASE WHEN v = '' OR v IS NULL THEN 'Enter a value.'
  WHEN stored IS NULL AND money THEN label || ' must be an amount, for example 2273.60.'
  WHEN stored IS NULL AND day THEN label || ' must be a date as YYYY-MM-DD.' END AS error FROM stripped"""),
    "P6_documents_by_ids": _inv("SELECT doc_id, file_name, s3_uri, sha256 FROM files WHERE CAST(doc_id[2:] AS BIGINT) BETWEEN 1 AND 199"),
    "P6_select_documents": _inv("SELECT doc_id, file_name, s3_uri, sha256 FROM files WHERE status = 'pending'"),
    "P7_list_extractions": _inv("SELECT doc_id, field_name, line_no, field_value, confidence, page, model FROM extractions"),
    "P8_evidence_keys": _inv("SELECT * FROM keys", _KEYS),
    # ---- joins
    "J1_resolve_vendor": _inv("SELECT * FROM iv"),
    "J2_bank_mismatch": _inv(_RULE.format("BANK_MISMATCH")),
    "J3_duplicate": _inv(_RULE.format("DUPLICATE")),
    "J4_unknown_vendor": _inv(_RULE.format("UNKNOWN_VENDOR")),
    "J5_no_po": _inv(_RULE.format("NO_PO")),
    "J6_price_over_po": _inv(_RULE.format("PRICE_OVER_PO")),
    "J7_qty_over_receipt": _inv(_RULE.format("QTY_OVER_RECEIPT")),
    "J8_low_confidence": _inv(_RULE.format("LOW_CONFIDENCE")),
    "J9_discount_window": _inv(_RULE.format("DISCOUNT_WINDOW")),
    "J10_queue": _inv(f"SELECT {_queue_columns('q.')}, vendor_name, source, file_name FROM ({_QUEUE}) q"),
    "J11_document_list": _inv("SELECT doc_id, file_name, s3_uri, sha256, source, status, CAST(ingested_at AS VARCHAR) AS ingested_at, CAST(processed_at AS VARCHAR) AS processed_at, vendor_name, invoice_number, total FROM files LEFT JOIN invoice_header USING (doc_id)"),
    "J12_evidence_marks": _inv("SELECT doc_id, rule_code, evidence_field, pos, field_name, evidence_line, page, bbox, pos = 0 AS is_primary, replace(field_name, '_', ' ') || coalesce(' · ' || CAST(confidence AS DECIMAL(4,2)), '') AS label FROM located WHERE bbox IS NOT NULL AND page IS NOT NULL", _KEYS),
    "J12_evidence_caption": _inv("SELECT doc_id, rule_code, evidence_field, CAST(coalesce(page, 1) AS INTEGER) AS open_page, CASE WHEN bbox IS NOT NULL THEN confidence END AS caption_confidence, CASE WHEN bbox IS NOT NULL THEN model END AS caption_model FROM located WHERE pos = 0", _KEYS),
    "J13_comparison": _inv("", _COMPARISON),
    "J14_candidate_pos": _inv("SELECT vendor_id, coalesce(chunk, 0) AS chunk, coalesce(n, 0) AS n_orders, coalesce(pos, '(none)') AS candidates FROM (SELECT DISTINCT vendor_id FROM exc WHERE rule_code = 'NO_PO') LEFT JOIN lists USING (vendor_id)", _LISTS),
    "J14_candidate_orders": _inv("SELECT vendor_id, po_number FROM purchase_orders WHERE vendor_id IN (SELECT vendor_id FROM exc WHERE rule_code = 'NO_PO')"),
    "J15_score_fields": _inv("SELECT * FROM scored", _SCORED),
    "J16_score_queue": _inv("SELECT * FROM per_doc", _EXPECTED),
    "J17_expected_exceptions": _inv("SELECT doc_id, rule_code, CAST(amount AS DECIMAL(24,2)) AS amount FROM expected", _EXPECTED),
    "J18_other_issues": _inv("SELECT a.doc_id, a.rule_code, a.evidence_field, a.detail, o.rule_code AS other_rule, r.label AS other_label, o.n - CASE WHEN o.rule_code = a.rule_code THEN 1 ELSE 0 END AS n_others FROM exc a JOIN (SELECT doc_id, rule_code, count(*) AS n FROM exc GROUP BY ALL) o USING (doc_id) JOIN rules r ON r.rule_code = o.rule_code WHERE o.n > CASE WHEN o.rule_code = a.rule_code THEN 1 ELSE 0 END"),
    "J19_caught_by_review": _inv("SELECT doc_id, field_name, line_no, expected, extracted, doc_id IN (SELECT doc_id FROM exc WHERE rule_code = 'LOW_CONFIDENCE') AS caught FROM scored WHERE NOT ok", _SCORED),
    "J20_rule_labels": _inv("SELECT doc_id, rule_code, evidence_field, detail, label, how, tone, CASE exc.priority WHEN 1 THEN '1 · Critical' WHEN 2 THEN '2 · High' WHEN 3 THEN '3 · Medium' WHEN 4 THEN 'Opportunity' ELSE 'Review' END AS priority_name FROM exc JOIN rules USING (rule_code)"),
    "J21_clean_invoices": _inv("SELECT doc_id, invoice_number, due_date, total FROM files JOIN invoice_header USING (doc_id) WHERE status = 'processed' AND doc_id NOT IN (SELECT doc_id FROM exc)"),
    # ---- aggregations
    "A1_kpis": _inv(_KPIS),
    "A2_rule_rollup": _inv("SELECT doc_id, rule_code, found AS amount FROM rollup_found", _EXPECTED),
    "A3_accuracy": _inv("SELECT (SELECT count(DISTINCT doc_id) FROM extractions) AS docs, count(*) AS fields, round(count(*) FILTER (ok) / greatest(count(*), 1), 6) AS field_accuracy, (SELECT count(DISTINCT doc_id) FROM exc WHERE rule_code = 'LOW_CONFIDENCE') AS review_docs FROM scored", _SCORED),
    "A3_review_documents": _inv("SELECT DISTINCT doc_id FROM exc WHERE rule_code = 'LOW_CONFIDENCE'"),
    "A4_planted_summary": _inv("SELECT count(*) FILTER (status = 'ok') AS planted_ok, count(*) AS planted_total FROM per_doc", _EXPECTED),
    "A5_page_confidence": _pag("SELECT 'D' || pg.k AS doc_id, CAST(pg.p + 1 AS INTEGER) AS page, " + _mean("c", 4) + " AS avg_confidence, min(c) AS min_confidence FROM pg LEFT JOIN (SELECT k, p, c FROM wd UNION ALL SELECT k, p, c FROM twd) USING (k, p) GROUP BY pg.k, pg.p"),
    "A6_document_metrics": _pag("SELECT 'D' || k AS doc_id, CAST(count(*) AS INTEGER) AS page_count, " + _mean("a", 6) + " AS avg_confidence, CAST(sum(n) AS INTEGER) AS block_count, CAST(round(count(*) * 0.004, 4) AS DOUBLE) AS cost FROM (SELECT pg.k, pg.p, " + _mean("c", 4) + " AS a FROM pg LEFT JOIN (SELECT k, p, c FROM wd UNION ALL SELECT k, p, c FROM twd) USING (k, p) GROUP BY pg.k, pg.p) JOIN (SELECT k, p, count(*) AS n FROM blk GROUP BY k, p) USING (k, p) GROUP BY k"),
    "A7_block_types": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, string_agg(type, ',' ORDER BY type) AS block_types FROM (SELECT DISTINCT k, p, type FROM blk) GROUP BY k, p"),
    "A8_row_counts": _inv(_COUNTS),
    # ---- first, best, evidence
    "W1_locate": _pag(f"SELECT doc_id, value, CAST(p + 1 AS INTEGER) AS page, {_BOX} FROM vals LEFT JOIN placed ON placed.k = vals.k AND id = value", _WORDS_WANTED),
    "W2_span_confidence": _pag("SELECT doc_id, value, confidence FROM vals LEFT JOIN placed ON placed.k = vals.k AND id = value", _WORDS_WANTED),
    "W1_extract": _pag(f"SELECT doc_id, field_name, line_no, value AS field_value, confidence, CAST(p + 1 AS INTEGER) AS page, {_BOX} FROM vals LEFT JOIN placed ON placed.k = vals.k AND id = field_name || coalesce(':' || line_no, '')", _FIELDS_WANTED),
    "W3_least_certain": _pag("SELECT 'D' || k AS doc_id, CAST(r AS INTEGER) AS rank, CAST(p + 1 AS INTEGER) AS page, w AS word, c AS confidence, '…' || replace(substr(markdown, f + 1, s + length(w) + 50 - f), chr(10), ' ') || '…' AS context FROM (SELECT wd.*, markdown, greatest(s - 50, 0) AS f, row_number() OVER (PARTITION BY k ORDER BY c, p, s) AS r FROM wd JOIN md USING (k, p) WHERE regexp_matches(w, '[A-Za-z0-9]') AND regexp_full_match(w, '[\\p{L}\\p{N}_$%.,;:''\"()/&-]+')) WHERE r <= 15"),
    "W4_low_confidence_spans": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY k, p ORDER BY s) - 1 AS INTEGER) AS mark, s AS start_index, CAST(s + length(w) AS INTEGER) AS end_index, w AS word, round(c, 4) AS confidence FROM wd JOIN md USING (k, p) WHERE c < 0.85 AND regexp_full_match(w, '[\\p{L}\\p{N}_$%.,;:''\"()/&-]+') AND substr(markdown, s + 1, length(w)) = w"),
    "W4_marked_markdown": _pag("""
, marks AS (SELECT k, p, s, w, row_number() OVER (PARTITION BY k, p ORDER BY s) - 1 AS n, lag(s + length(w), 1, 0) OVER (PARTITION BY k, p ORDER BY s) AS prev
  FROM wd JOIN md USING (k, p) WHERE c < 0.85 AND regexp_full_match(w, '[\\p{L}\\p{N}_$%.,;:''"()/&-]+')),
marked AS (SELECT md.k, md.p, count(n) AS n_marks, coalesce(string_agg(substr(markdown, prev + 1, s - prev) || chr(57344) || n || chr(57345) || w || chr(57346), '' ORDER BY s), '')
    || substr(any_value(markdown), coalesce(max(s + length(w)), 0) + 1) AS t FROM md LEFT JOIN marks USING (k, p) GROUP BY md.k, md.p)
SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, replace(t, '[tbl-' || p || '.md](tbl-' || p || '.md)', coalesce(content, '')) AS markdown,
  CAST(n_marks AS INTEGER) AS n_marks FROM marked LEFT JOIN tbl USING (k, p)"""),
    "W5_first_by_key": _inv("SELECT doc_id, rule_code, min(evidence_field || '/' || detail) AS shown FROM exc GROUP BY ALL"),
    # ---- order
    "O1_ranked_queue": _inv(f"SELECT {_queue_columns('q.')}, vendor_name, source, file_name FROM ({_QUEUE}) q"),
    "O2_documents_by_id": _inv("SELECT doc_id, file_name, s3_uri, sha256 FROM files ORDER BY doc_id"),
    "O3_extractions_nulls_first": _inv("SELECT doc_id, line_no, field_name FROM extractions ORDER BY doc_id, line_no NULLS FIRST, field_name"),
    "O4_top_words": _pag("SELECT 'D' || k AS doc_id, w AS word, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c, p, s) AS r FROM wd WHERE regexp_matches(w, '[A-Za-z0-9]') AND regexp_full_match(w, '[\\p{L}\\p{N}_$%.,;:''\"()/&-]+')) WHERE r <= 15"),
    # ---- set operations
    "U1_union_rules": _inv("SELECT rule_code, count(*) AS n_rows, CAST(sum(amount_at_risk) AS DECIMAL(24,2)) AS amount FROM exc GROUP BY rule_code"),
    "U2_union_counts": _inv(_COUNTS),
    "U3_rule_set_difference": _inv("SELECT doc_id, rule_code, CASE WHEN found IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM matched WHERE found IS NULL OR expected IS NULL", _EXPECTED),
    "U4_extra_lines": _inv("SELECT doc_id, 'extra lines' AS field_name, CAST(NULL AS INTEGER) AS line_no, CAST(n_lines - 1 AS VARCHAR) AS expected, CAST(n_lines AS VARCHAR) AS extracted, false AS ok FROM truth WHERE k % 29 = 2"),
    # ---- scalar functions
    "F1_digits": _inv("SELECT vendor_id, tax_id, replace(tax_id, '-', '') AS tax_digits FROM vendors"),
    "F2_case_trim": _inv("SELECT payment_id, upper(trim(invoice_number)) AS number_key, lower(invoice_number) AS lowered, trim(invoice_number) AS trimmed FROM payments"),
    "F3_concat_nulls": _inv("SELECT doc_id, invoice_number || ' for ' || po_number AS reference FROM truth"),
    "F4_conditionals": _inv("SELECT doc_id, coalesce(po_number, 'none') AS po, CASE WHEN bank_change_notice IS NOT NULL THEN 'notice' ELSE '' END AS notice, payment_terms LIKE '2/10%' AS discount, currency IN ('USD', 'EUR') AS known_currency, vendor_tax_id IS NULL AS no_tax FROM truth"),
    "F5_casts": _inv("SELECT doc_id, field_name, line_no, TRY_CAST(field_value AS DECIMAL(12,2)) AS amount, TRY_CAST(trunc(TRY_CAST(field_value AS DECIMAL(12,2))) AS INTEGER) AS whole FROM misread", _SCORED),
    "F6_dates": _inv(f"SELECT doc_id, CAST(invoice_date + INTERVAL 10 DAY AS DATE) AS pay_by, {AS_OF} <= invoice_date + INTERVAL 10 DAY AS open_offer, CAST(invoice_date AS VARCHAR) AS printed FROM truth"),
    "F7_decimal_math": _inv("SELECT doc_id, line_no, CAST((unit_price - 1.25) * qty AS DECIMAL(12,2)) AS diff, CAST(amount * 0.02 AS DECIMAL(12,2)) AS two_percent FROM inv_lines"),
    "F8_printed_variants": _inv("SELECT doc_id, field_name, line_no, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS variant FROM (SELECT doc_id, field_name, line_no, CASE WHEN field_name IN ('subtotal', 'tax', 'total', 'unit_price', 'amount') THEN [format('{:,.2f}', CAST(field_value AS DOUBLE)), field_value] WHEN field_name IN ('invoice_date', 'due_date') THEN [strftime(CAST(field_value AS DATE), '%m/%d/%Y'), strftime(CAST(field_value AS DATE), '%B %d, %Y'), field_value, strftime(CAST(field_value AS DATE), '%b %d, %Y')] ELSE [trim(field_value)] END AS v FROM extractions WHERE trim(field_value) <> '')"),
    "F9_content_lines": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, CASE WHEN in_table THEN 'table' WHEN foot THEN 'footer' WHEN b = 0 THEN 'title' ELSE 'text' END AS type, CAST(row AS INTEGER) AS row, line FROM rows_of"),
    "F10_block_boxes": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, type, round(100 / 1700, 4) AS x0, round(y0 / 2203, 4) AS y0, round(1600 / 1700, 4) AS x1, round(y1 / 2203, 4) AS y1 FROM blk"),
    "F11_compare_norm": _inv("SELECT doc_id, field_name, line_no, coalesce(CAST(CAST(TRY_CAST(replace(b, ',', '') AS DOUBLE) AS DECIMAL(38,2)) AS VARCHAR), lower(b), '') AS norm FROM forms", _SCORED),
    "F12_inline_tables": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, replace(markdown, '[tbl-' || p || '.md](tbl-' || p || '.md)', coalesce(content, '')) AS markdown FROM md LEFT JOIN tbl USING (k, p)"),
    "F13_document_text": _pag("SELECT 'D' || k AS doc_id, string_agg('### Page ' || (p + 1) || chr(10) || replace(markdown, '[tbl-' || p || '.md](tbl-' || p || '.md)', coalesce(content, '')), chr(10) || chr(10) ORDER BY p) AS doc_text FROM md LEFT JOIN tbl USING (k, p) GROUP BY k"),
    "F14_pipe_tables": _pag("SELECT 'D' || k AS doc_id, CAST(p + 1 AS INTEGER) AS page, CAST(0 AS INTEGER) AS row_no, 'Item' AS item, 'Description' AS description, 'Qty' AS qty, 'Price' AS price FROM tbl UNION ALL SELECT 'D' || k, CAST(p + 1 AS INTEGER), CAST(i + 1 AS INTEGER), sku, description, CAST(quantity AS VARCHAR), format('{:,.2f}', CAST(price AS DOUBLE)) FROM item_rows"),
    "F15_safe_file_name": _pag("SELECT 'D' || k AS doc_id, CASE WHEN ends_with(lower(b), '.pdf') THEN b ELSE b || '.pdf' END AS safe_name FROM (SELECT k, left(regexp_replace(regexp_replace(line, '^.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 100) AS b FROM ln WHERE n = 0)"),
    "F16_quarantine": "SELECT 'D' || doc_id || CASE WHEN source = 'src3' THEN ' x' ELSE '' END AS doc_id, CASE WHEN source = 'src3' THEN 'Invalid doc_id.' WHEN lang <> 'en' THEN 'That file isn''t a PDF.' END AS problem FROM documents",
    "F17_label_text": _inv("SELECT doc_id, field_name, line_no, upper(field_name[1]) || replace(field_name, '_', ' ')[2:] AS label FROM extractions"),
    "F18_hash_json": _inv("SELECT doc_id, field_name, line_no, sha256(field_value) AS value_hash, CASE WHEN bbox IS NOT NULL THEN 0.1::DOUBLE END AS x0, CASE WHEN bbox IS NOT NULL THEN 0.25::DOUBLE END AS y1, CASE WHEN bbox IS NOT NULL THEN '[0.1,0.2,0.5,0.25]' END AS box_json FROM extractions"),
    "F19_fallback_fields": _pag(f"SELECT 'D' || md.k AS doc_id, CAST(p + 1 AS INTEGER) AS page, trim(CASE WHEN p = 0 THEN 'Invoice No. INV-' || md.k ELSE '# ' || line END) AS vendor_name, nullif(regexp_extract(markdown, '{LABELLED_NUMBER}', 1), '') AS invoice_number FROM md LEFT JOIN (SELECT k, p, line FROM pl WHERE j = 0) USING (k, p)"),
    # ---- incremental
    "ST1_land_stream": _FILES + "SELECT DISTINCT sha256 FROM reg",
    "ST2_pending_stream": _pag("SELECT 'D' || vals.k AS doc_id, field_name, line_no, value AS field_value FROM vals JOIN documents d ON d.doc_id = vals.k WHERE lang <> 'de' AND source <> 'src7'", _FIELDS_WANTED),
    "ST3_review_stream": _reviewed_rules() + "SELECT doc_id, vendor_id, rule_code, detail, amount_at_risk, evidence_field FROM exc",
    "A1_kpis_kept": _changed_enterprise() + _KPIS,
    "ST3_enterprise_stream": _changed_enterprise() + "SELECT doc_id, vendor_id, rule_code, detail, amount_at_risk, evidence_field FROM exc",
    "X1_extract_documents": _pag("SELECT doc_id, coalesce((SELECT trim(line) FROM ln WHERE ln.k = src.k AND n = 0), 'Unknown vendor') AS vendor_name FROM src"),
}
