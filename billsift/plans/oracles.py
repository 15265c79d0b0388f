"""The registered queries again, as DuckDB SQL over the same tables.

Two kinds: *truth* computes the expected answer by arithmetic on the order
tables, without the text; *text* repeats the reading rule over the same text
with another regex engine.
"""

from __future__ import annotations

from billsift import constants as K
from billsift.plans import stores, strict
from billsift.schemas import RECORD_COLUMNS, STORE_EXPORT, record_columns

WS = "'" + K.WHITESPACE + "'"
AMT = f"'({K.AMOUNT})'"
ITEM = r"'\d+\s+.*\d{2}\.\d{2}$'"

BASE = r"""
g AS (
  SELECT l_orderkey, count(*) AS n_lines, min(l_suppkey) AS suppkey,
         CAST(sum(cents) AS BIGINT) AS total,
         list({'p': l_partkey, 'q': qty, 'c': cents}
              ORDER BY l_linenumber, l_partkey, qty, cents) AS items
  FROM (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey,
               CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem)
  GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS k, o_custkey AS c, c_name, c_nationkey, c_mktsegment,
         s_suppkey AS s, s_name, s_nationkey, n_lines, total, items,
         CASE o_orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 6 ELSE 14 END AS rate,
         CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_orderdate + INTERVAL 40 YEAR AS DATE)
              ELSE CAST(o_orderdate AS DATE) END AS issued
  FROM orders LEFT JOIN g ON o_orderkey = l_orderkey
       LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN supplier ON suppkey = s_suppkey),
b2 AS (SELECT *, (total * 100 + 59) // (100 + 2 * rate) AS sub FROM b),
b3 AS (
  SELECT *, (sub * rate + 50) // 100 AS tax,
         total + CASE WHEN k % 17 = 0 THEN 10000 ELSE 0 END AS grand,
         items IS NULL AS scanned,
         k % 37 = 0 AND items IS NOT NULL AS failed,
         CAST(500000000000 + s + CASE WHEN k % 31 = 0 THEN 7 ELSE 0 END AS VARCHAR) AS account,
         '27' || translate(lpad(CAST(s % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ')
           || lpad(CAST((s // 100000) % 10000 AS VARCHAR), 4, '0') || 'P1Z5' AS vgstin,
         '29' || translate(lpad(CAST(c % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ')
           || lpad(CAST((c // 100000) % 10000 AS VARCHAR), 4, '0') || 'C1Z7' AS bgstin,
         CASE k % 6 WHEN 5 THEN '=' WHEN 4 THEN '-' ELSE '' END || s_name
           || CASE WHEN k % 23 = 0 THEN ' Traders' ELSE ' PVT LTD' END AS company,
         CASE WHEN k % 2 = 1 THEN strftime(issued, '%d-%m-%Y')
              ELSE strftime(issued, '%d/%m/%Y') END AS day,
         strftime(issued + 30, '%d/%m/%Y') AS due
  FROM b2),
d AS (
  SELECT *, k * 2 + copy AS doc_id,
         CASE copy WHEN 1 THEN 'copy_of_invoice_' ELSE 'invoice_' END || k || '.txt' AS filename
  FROM (SELECT *, unnest(CASE WHEN k % 41 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM b3))
"""


def grouped(c: str) -> str:
    return f"format('{{:,.2f}}', CAST({c} AS DOUBLE) / 100)"


def plain(c: str) -> str:
    return f"format('{{:.2f}}', CAST({c} AS DOUBLE) / 100)"


ITEM_LINE = (
    "i || ' Part ' || x.p || ' HSN ' || (x.p % 90 + 7300) || ' ' || x.q || ' NOS ' || "
    + grouped("x.c")
)

TEXT = BASE + rf""",
r AS (
  SELECT doc_id, k, filename,
    CASE WHEN scanned THEN 'Scan ' || k || chr(10) ELSE concat_ws(chr(10),
      company,
      'Unit ' || s || ' Industrial Estate',
      'Nation ' || s_nationkey,
      'GSTIN: ' || vgstin,
      CASE WHEN k % 2 = 0 THEN 'PAN: ' || substr(vgstin, 3, 10) END,
      'Email: billing' || s || '@vendor.example',
      CASE WHEN k % 5 = 0 THEN 'INVOICE' ELSE 'TAX INVOICE' END,
      CASE WHEN k % 13 = 0 THEN 'Invoice No. ' || k ELSE 'Invoice No: INV-' || k END,
      'Invoice Date: ' || day,
      CASE WHEN k % 7 = 0 THEN 'Due Date:' || chr(10) || due ELSE 'Due Date: ' || due END,
      'Place of Supply: State ' || c_nationkey,
      'Payment Terms - NET 30',
      CASE WHEN k % 37 <> 0 THEN concat_ws(chr(10),
        CASE k % 3 WHEN 0 THEN 'Invoice To' WHEN 1 THEN 'Bill To' ELSE 'BILL TO:' END,
        c_name, 'Street ' || c, c_mktsegment, 'Nation ' || c_nationkey,
        'GSTIN: ' || bgstin) END,
      '  Sr Description HSN Qty Amount  ',
      array_to_string(list_transform(items, lambda x, i: {ITEM_LINE}), chr(10)),
      '',
      'Sub Total ' || {grouped('sub')},
      CASE WHEN k % 19 = 0 THEN 'CGST @ ' || rate || ' % ' ELSE 'CGST ' || rate || '% ' END
        || {grouped('tax')},
      CASE WHEN k % 8 = 0 THEN 'SGST ' ELSE 'SGST ' || rate || '% ' END || {grouped('tax')},
      'Total Tax ' || {grouped('tax * 2')},
      'Grand Total ' || CASE k % 4 WHEN 0 THEN 'Rs.' WHEN 1 THEN '₹' WHEN 2 THEN 'Rs '
        ELSE 'INR ' END
        || CASE WHEN k % 11 = 0 THEN {plain('grand')} ELSE {grouped('grand')} END,
      'Amount in Words: Rupees ' || (grand // 100) || ' only',
      'Bank Name: Bank of Nation ' || s_nationkey,
      'Account Name: ' || s_name,
      'Account No: ' || account,
      'IFSC: ABCD0' || lpad(CAST(s % 1000000 AS VARCHAR), 6, '0'),
      'Branch: Main ' || s_nationkey,
      CASE WHEN k % 37 = 0 THEN 'Bill To' END,
      '') END AS raw,
    CASE WHEN scanned THEN 'TAX INVOICE' || chr(10) || 'Invoice No: SCAN-' || k || chr(10)
      || 'Bill To' || chr(10) || c_name || chr(10) END AS fallback
  FROM d),
n AS (
  SELECT doc_id, k, filename,
    CASE WHEN length(trim(raw, {WS})) < 50 THEN 'OCR' ELSE 'TEXT' END AS method,
    replace(replace(replace(replace(
      CASE WHEN length(trim(raw, {WS})) < 50 THEN raw || coalesce(fallback, '') ELSE raw END,
      '₹', 'INR '), 'Rs.', 'INR '), 'Rs', 'INR '), 'â‚¹', 'INR ') AS txt
  FROM r),
t AS (
  SELECT *, list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x, {WS})),
                        lambda x: x <> '') AS lines
  FROM n)
"""


def truth(select: str) -> str:
    return "WITH " + BASE + select


def text(select: str, more: str = "") -> str:
    return "WITH " + TEXT + more + select


def label(name: str) -> str:
    return rf"trim(regexp_extract(txt, '(?i){name}\s*[:\-]?\s*(.+)', 1), {WS})"


def match(pattern: str, source: str = "txt") -> str:
    return f"regexp_extract({source}, '{pattern}', 0)"


def amount(keyword: str) -> str:
    line = (
        f"list_filter(lines, lambda x: contains(lower(x), '{keyword.lower()}') "
        f"AND regexp_matches(x, {AMT}))[1]"
    )
    return f"coalesce(replace(regexp_extract_all({line}, {AMT})[-1], ',', ''), '')"


def percent(keyword: str) -> str:
    line = (
        f"list_filter(lines, lambda x: contains(lower(x), '{keyword.lower()}') "
        r"AND regexp_matches(x, '\d+%'))[1]"
    )
    return rf"coalesce(regexp_extract({line}, '(\d+)%', 1), '')"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def anchor(words: tuple[str, ...]) -> str:
    marks = f"list_transform(lines, lambda x: {any_of('lower(x)', words)})"
    return f"coalesce(list_position({marks}, true), 0)"


def vendor(words: tuple[str, ...]) -> str:
    return f"coalesce(list_filter(lines, lambda x: {any_of('upper(x)', words)})[1], '')"


def buyer(words: tuple[str, ...]) -> tuple[str, str]:
    a = anchor(words)
    return (
        f"CASE WHEN {a} > 0 THEN coalesce(lines[{a} + 1], '') ELSE '' END",
        f"CASE WHEN {a} > 0 THEN array_to_string(lines[{a} + 2 : {a} + 5], ' ') ELSE '' END",
    )


VENDOR_ADDRESS = "array_to_string(lines[2:6], ' ')"
INVOICE_TYPE = (
    "CASE WHEN len(list_filter(lines, lambda x: contains(upper(x), 'TAX INVOICE'))) > 0 "
    "THEN 'TAX INVOICE' ELSE '' END"
)
BUYER_GSTIN = f"coalesce(list_filter(lines, lambda x: regexp_matches(x, '{K.GSTIN}'))[1], '')"
ITEMS = f"list_filter(lines, lambda x: regexp_matches(x, {ITEM}))"
ITEM_AMOUNT = f"replace(regexp_extract_all(x, {AMT})[-1], ',', '')"


def pipes(value: str) -> str:
    return f"array_to_string(list_transform({ITEMS}, lambda x, i: {value}), '|')"


def record_fields(profile: str) -> dict[str, str]:
    a = profile == "a"
    vendor_words = K.VENDOR_KEYWORDS if a else K.VENDOR_KEYWORDS_B
    anchors = K.BUYER_ANCHORS if a else K.BUYER_ANCHORS_B
    name, address = buyer(anchors)
    cgst, sgst = percent("CGST"), percent("SGST")
    return {
        "filename": "filename",
        "status": "'PROCESSED'",
        "processed_on": "'02-01-2024 03:04'",
        "ocr_method": "method",
        "invoice_type": INVOICE_TYPE,
        "invoice_no": label("Invoice No"),
        "invoice_date": match(K.DATE),
        "due_date": label("Due Date"),
        "place_of_supply": label("Place of Supply"),
        "payment_terms": label("Payment Terms"),
        "currency": "'INR'",
        "vendor_name": vendor(vendor_words),
        "vendor_address": VENDOR_ADDRESS,
        "vendor_gstin": match(K.GSTIN),
        "vendor_pan": match(K.PAN) if a else label("PAN"),
        "vendor_email": label("Email"),
        "buyer_name": name,
        "buyer_address": address,
        "buyer_gstin": BUYER_GSTIN,
        "item_sr_nos": pipes("CAST(i AS VARCHAR)"),
        "item_descriptions": pipes("x"),
        "hsn_sac_codes": pipes("''"),
        "quantities": pipes("'1'"),
        "rates": pipes(ITEM_AMOUNT),
        "item_amounts": pipes(ITEM_AMOUNT),
        "cgst_rate": cgst,
        "cgst_amount": amount("CGST"),
        "sgst_rate": f"coalesce(nullif({sgst}, ''), {cgst})" if a else sgst,
        "sgst_amount": amount("SGST"),
        "total_tax": amount("Tax" if a else "Total Tax"),
        "subtotal": amount("Sub Total" if a else "Total"),
        "grand_total": amount("Grand Total"),
        "amount_in_words": label("Amount in Words"),
        "bank_name": label("Bank" if a else "Bank Name"),
        "account_name": label("Account Name"),
        "account_number": match(K.ACCOUNT) if a else label("Account No"),
        "ifsc_code": match(K.IFSC) if a else label("IFSC"),
        "branch": label("Branch"),
        "raw_text": "txt",
    }


def record(profile: str = "a", wanted: list[str] | None = None) -> str:
    """The select list of a record with its error rule."""
    anchors = K.BUYER_ANCHORS if profile == "a" else K.BUYER_ANCHORS_B
    a = anchor(anchors)
    bad = f"({a} > 0 AND {a} = len(lines))"
    out = []
    for name, value in record_fields(profile).items():
        if name not in (wanted or record_columns(profile)):
            continue
        if name == "status":
            value = f"CASE WHEN {bad} THEN 'ERROR' ELSE {value} END"
        elif name == "vendor_name":
            value = f"CASE WHEN {bad} THEN 'N/A' ELSE {value} END"
        elif name != "filename":
            value = f"CASE WHEN {bad} THEN NULL ELSE {value} END"
        out.append(f"{value} AS {name}")
    out.append(f"CASE WHEN {bad} THEN 'ANCHOR_ON_LAST_LINE' END AS error_reason")
    return ",\n  ".join(out)


def sanitized(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN '''' || {c} ELSE {c} END"


def stored(keys: str = "doc_id") -> str:
    """The store view of the records, as a CTE."""
    wanted = ["filename", "invoice_no", "invoice_date", "vendor_name", "vendor_gstin",
              "buyer_name", "cgst_amount", "sgst_amount", "grand_total", "currency"]
    return f""",
rec AS (SELECT doc_id, txt, {record("a", wanted)} FROM t),
st AS (
  SELECT {keys}, sha256(txt) AS file_hash, filename, '2024-01-02 03:04' AS upload_date,
    coalesce(invoice_no, 'N/A') AS invoice_number,
    coalesce(invoice_date, 'N/A') AS invoice_date,
    coalesce(vendor_name, 'Unknown') AS vendor_name,
    coalesce(vendor_gstin, 'N/A') AS vendor_gstin,
    coalesce(buyer_name, 'Unknown') AS buyer_name,
    coalesce(cgst_amount, '0') AS cgst, coalesce(sgst_amount, '0') AS sgst,
    coalesce(grand_total, '0') AS grand_total, coalesce(currency, 'INR') AS currency,
    'PROCESSED' AS status
  FROM rec WHERE error_reason IS NULL)
"""


def parity_amount(c: str) -> str:
    return f"replace({grouped(c)}, ',', '')"


TRUE_ITEMS = f"""
  SELECT doc_id, CAST(i AS BIGINT) AS sr, {ITEM_LINE} AS description, x.c AS cents
  FROM (SELECT doc_id, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM d)
  UNION ALL
  SELECT doc_id, len(items) + 1, 'CGST @ ' || rate || ' % ' || {grouped('tax')}, tax
  FROM d WHERE k % 19 = 0 AND NOT scanned
"""

MONEY = "CAST({} AS DOUBLE) / 100"

VALID = "'[a-zA-Z0-9\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.,%$-]'"
WORD = "'[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"
SCORE = (
    f"CAST(len(regexp_extract_all(text, {WORD})) + length(text) "
    f"- 2 * length(regexp_replace(text, {VALID}, '', 'g')) AS BIGINT)"
)

GRID = """
  SELECT page_id, p.page_no, dpi, textline, det_thresh, box_thresh, prep,
    'page' || p.page_no || '_dpi' || dpi || '_textline' || CAST(textline AS INTEGER)
      || '_td' || det_thresh || '_bt' || box_thresh || '_prep' || prep AS variant
  FROM (SELECT page_id, page_id + 1 AS page_no FROM pages) p,
    (SELECT unnest([200, 300, 400]) AS dpi),
    (SELECT unnest([true, false]) AS textline),
    (SELECT unnest(['0.3', '0.5', '0.7']) AS det_thresh),
    (SELECT unnest(['0.3', '0.5', '0.7']) AS box_thresh),
    (SELECT unnest(['original', 'grayscale', 'adaptive_threshold', 'gaussian_blur',
                    'bilateral_filter', 'clahe', 'median_blur', 'sharpen']) AS prep)
"""

HASHED = "h AS (SELECT doc_id, source, sha256(text) AS file_hash FROM documents)"


def first_line(pattern: str) -> str:
    return f"coalesce(list_filter(ls, lambda x: regexp_matches(x, '{pattern}'))[1], '')"


STRUCTURED = rf""",
l AS (
  SELECT doc_id, list_concat(list_filter(lines, lambda x: NOT regexp_matches(x, {ITEM})),
                             list_filter(lines, lambda x: regexp_matches(x, {ITEM}))) AS ls
  FROM t),
l2 AS (
  SELECT doc_id, ls AS lines, ls, array_to_string(ls, chr(10)) AS txt,
    coalesce(list_filter(ls, lambda x: {any_of('upper(x)', K.VENDOR_KEYWORDS)})[1], '') AS name,
    {first_line('(?i)buyer')} AS buyer, {first_line('(?i)cgst')} AS cgst,
    {first_line('(?i)sgst')} AS sgst, {first_line('(?i)igst')} AS igst,
    {first_line('(?i)\\bonly\\b')} AS words, {first_line('(?i)bank')} AS bank
  FROM l),
s AS (
  SELECT doc_id, name, buyer, cgst, sgst, igst, words, bank,
    regexp_extract(txt, '\b\d{{2}}[A-Z0-9]{{13}}\b', 0) AS gstin,
    regexp_extract(txt, '(?i)Invoice No\.?\s*[:\-]?\s*(\S+)', 1) AS invoice_no,
    {match(K.DATE)} AS invoice_date,
    regexp_extract(txt, '(?i)PO No\.?\s*[:\-]?\s*(\d+)', 1) AS po_no,
    coalesce(nullif({label('Place of Supply')}, ''), 'Unknown') AS place,
    {amount('Taxable Value')} AS taxable, {amount('Total Tax')} AS total_tax,
    {amount('Grand Total')} AS grand,
    {match(K.ACCOUNT)} AS account_no, {match(K.IFSC)} AS ifsc,
    list_filter(ls, lambda x: NOT list_contains([name, buyer, cgst, sgst, igst, words, bank], x))
      AS declarations,
    list_transform(list_filter(ls, lambda x: regexp_matches(x, {ITEM})), lambda x: {{
      'description': x, 'hsn': regexp_extract(x, '\d{{4,8}}', 0),
      'qty': regexp_extract(x, '\d+', 0), 'unit': '',
      'rate': regexp_extract(x, '\b\d{{1,3}}\b', 0),
      'amount': regexp_extract(x, '\b\d{{1,3}}\b', 0)}}) AS line_items
  FROM l2)
"""


def oracle_sql() -> dict[str, str]:
    name_a, address_a = buyer(K.BUYER_ANCHORS)
    export = ", ".join(
        f'{sanitized(c)} AS "{RECORD_COLUMNS[c]}"' for c in record_columns("a")
    )
    return {
        # ---- sources and documents
        "fold_pages": """
            SELECT conv_id, count(*) AS n_pages,
              coalesce(string_agg(text || chr(10), '' ORDER BY turn) FILTER (text <> ''), '')
                AS raw_text
            FROM conversations GROUP BY conv_id""",
        "page_gate": """
            SELECT conv_id, turn, NULL::BIGINT AS n_pages FROM conversations
            QUALIFY count(*) OVER (PARTITION BY conv_id) <= 5
            UNION ALL
            SELECT conv_id, NULL, count(*) FROM conversations GROUP BY conv_id HAVING count(*) > 5""",
        "size_gate": r"""
            SELECT page_id, regexp_extract(url, '[^/\\]*$', 0) AS name, strlen(html)::BIGINT AS length,
              strlen(html) <= 2000 AS size_ok FROM pages""",
        "type_gate": """
            SELECT page_id, starts_with(html, '<!DOCTYPE') AS type_ok FROM pages""",
        "route_short_text": f"""
            WITH f AS (
              SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS pages
              FROM conversations WHERE text <> '' GROUP BY conv_id),
            q AS (SELECT doc_id, text, pages, length(trim(text, {WS})) < 50 AS short
                  FROM documents LEFT JOIN f ON doc_id = conv_id)
            SELECT doc_id, CASE WHEN short THEN 'OCR' ELSE 'TEXT' END AS ocr_method,
              CASE WHEN short THEN text || coalesce(pages, '') ELSE text END AS text
            FROM q""",
        "text_lines": f"""
            SELECT doc_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no
            FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                    lambda x: trim(x, {WS})), lambda x: x <> '') AS ls FROM documents)""",
        "normalize_currency": text("SELECT doc_id, txt AS text FROM n"),
        # ---- fields
        "extract_record": text(f"SELECT doc_id, {record('a')} FROM t"),
        "extract_record_b": text(f"SELECT doc_id, {record('b')} FROM t"),
        "extract_items": truth(f"""
            SELECT doc_id, sr, description, '' AS hsn, '1' AS qty,
              {plain('cents')} AS rate, {plain('cents')} AS amount
            FROM ({TRUE_ITEMS})"""),
        "items_pipe": truth(f"""
            SELECT doc_id, coalesce(string_agg(CAST(sr AS VARCHAR), '|' ORDER BY sr), '') AS sr_nos,
              coalesce(string_agg(description, '|' ORDER BY sr), '') AS descriptions,
              coalesce(string_agg(CASE WHEN sr IS NOT NULL THEN '' END, '|'), '') AS hsn_codes,
              coalesce(string_agg(CASE WHEN sr IS NOT NULL THEN '1' END, '|'), '') AS quantities,
              coalesce(string_agg({plain('cents')}, '|' ORDER BY sr), '') AS rates,
              coalesce(string_agg({plain('cents')}, '|' ORDER BY sr), '') AS amounts
            FROM d LEFT JOIN ({TRUE_ITEMS}) USING (doc_id) GROUP BY doc_id"""),
        "find_amounts": truth(f"""
            SELECT doc_id,
              CASE WHEN scanned THEN '' ELSE {parity_amount('tax')} END AS cgst_amount,
              CASE WHEN scanned THEN '' ELSE {parity_amount('tax')} END AS sgst_amount,
              CASE WHEN scanned THEN '' ELSE {parity_amount('tax * 2')} END AS total_tax,
              CASE WHEN scanned THEN '' ELSE {parity_amount('sub')} END AS subtotal,
              CASE WHEN scanned THEN ''
                   WHEN k % 11 = 0 AND grand >= 100000 THEN right({plain('grand')}, 6)
                   ELSE {parity_amount('grand')} END AS grand_total,
              CASE WHEN scanned THEN '' ELSE {plain('grand')} END AS grand_total_strict
            FROM d"""),
        "tax_rates": truth("""
            SELECT doc_id,
              CASE WHEN scanned OR k % 19 = 0 THEN '' ELSE CAST(rate AS VARCHAR) END AS cgst_rate,
              CASE WHEN scanned OR (k % 8 = 0 AND k % 19 = 0) THEN ''
                   ELSE CAST(rate AS VARCHAR) END AS sgst_rate
            FROM d"""),
        "label_values": truth("""
            SELECT doc_id,
              CASE WHEN scanned THEN 'SCAN-' || k WHEN k % 13 = 0 THEN '. ' || k
                   ELSE 'INV-' || k END AS invoice_no,
              CASE WHEN scanned THEN '' ELSE due END AS due_date,
              CASE WHEN scanned THEN '' ELSE 'State ' || c_nationkey END AS place_of_supply,
              CASE WHEN scanned THEN '' ELSE 'NET 30' END AS payment_terms,
              CASE WHEN scanned THEN '' ELSE 'billing' || s || '@vendor.example' END AS email,
              CASE WHEN scanned THEN '' ELSE 'Rupees ' || (grand // 100) || ' only' END
                AS amount_in_words,
              CASE WHEN scanned THEN '' ELSE 'Name: Bank of Nation ' || s_nationkey END AS bank_name,
              CASE WHEN scanned THEN '' ELSE s_name END AS account_name,
              CASE WHEN scanned THEN '' ELSE account END AS account_no,
              CASE WHEN scanned THEN '' ELSE 'Main ' || s_nationkey END AS branch
            FROM d"""),
        "first_match_ids": truth("""
            SELECT doc_id,
              CASE WHEN scanned THEN '' ELSE day END AS invoice_date,
              CASE WHEN scanned THEN '' ELSE vgstin END AS gstin,
              CASE WHEN scanned THEN '' ELSE substr(vgstin, 3, 10) END AS pan,
              substr(CASE WHEN scanned THEN c_name ELSE s_name END, 10) AS account,
              CASE WHEN scanned THEN '' ELSE substr(vgstin, 4, 11) END AS ifsc
            FROM d"""),
        "vendor_block": text(f"""
            SELECT doc_id, {vendor(K.VENDOR_KEYWORDS)} AS vendor_name,
              {VENDOR_ADDRESS} AS vendor_address FROM t"""),
        "buyer_block": text(f"""
            SELECT doc_id, {name_a} AS buyer_name, {address_a} AS buyer_address FROM t"""),
        "buyer_gstin": text(f"""
            SELECT t.doc_id, {BUYER_GSTIN} AS buyer_line,
              CASE WHEN d.scanned OR d.k % 37 = 0 THEN '' ELSE d.bgstin END AS buyer_gstin
            FROM t JOIN d USING (doc_id)"""),
        "invoice_type": truth("""
            SELECT doc_id, CASE WHEN scanned OR k % 5 <> 0 THEN 'TAX INVOICE' ELSE '' END
              AS invoice_type FROM d"""),
        "error_rows": truth("""
            SELECT filename,
              CASE WHEN failed OR n_lines > 10 THEN 'ERROR' ELSE 'PROCESSED' END AS status,
              CASE WHEN failed OR n_lines > 10 THEN NULL
                   WHEN scanned THEN 'SCAN-' || k WHEN k % 13 = 0 THEN '. ' || k
                   ELSE 'INV-' || k END AS invoice_no,
              CASE WHEN failed OR n_lines > 10 THEN 'N/A' WHEN scanned OR k % 23 = 0 THEN ''
                   ELSE company END AS vendor_name,
              CASE WHEN n_lines > 10 THEN 'TOO_MANY_PAGES'
                   WHEN failed THEN 'ANCHOR_ON_LAST_LINE' END AS error_reason
            FROM d"""),
        # ---- typed checks
        "typed_record": truth(f"""
            SELECT doc_id,
              CASE WHEN NOT scanned THEN strftime(issued, '%Y-%m-%d') END AS invoice_date,
              CASE WHEN NOT scanned THEN strftime(issued + 30, '%Y-%m-%d') END AS due_date,
              {MONEY.format('sub')} AS subtotal, {MONEY.format('tax')} AS cgst_amount,
              {MONEY.format('tax')} AS sgst_amount, {MONEY.format('tax * 2')} AS total_tax,
              {MONEY.format('grand')} AS grand_total,
              CASE WHEN NOT scanned AND k % 19 <> 0 THEN CAST(rate AS BIGINT) END AS cgst_rate,
              CASE WHEN NOT scanned AND NOT (k % 8 = 0 AND k % 19 = 0)
                   THEN CAST(rate AS BIGINT) END AS sgst_rate,
              CAST(coalesce(len(items), 0) + CASE WHEN k % 19 = 0 AND NOT scanned THEN 1 ELSE 0 END
                AS BIGINT) AS n_items
            FROM d"""),
        "reconcile_totals": truth(f"""
            SELECT doc_id, {MONEY.format('grand')} AS grand_total,
              {MONEY.format('coalesce(total, 0) + CASE WHEN k % 19 = 0 AND NOT scanned '
                            'THEN tax ELSE 0 END')} AS items_sum,
              CASE WHEN NOT scanned THEN
                grand = total + CASE WHEN k % 19 = 0 THEN tax ELSE 0 END END AS reconciles
            FROM d"""),
        "tax_check": truth("""
            SELECT doc_id,
              CASE WHEN NOT scanned AND k % 19 <> 0 THEN true END AS cgst_ok,
              CASE WHEN NOT scanned AND NOT (k % 8 = 0 AND k % 19 = 0) THEN true END AS sgst_ok
            FROM d"""),
        "future_dated": truth("""
            SELECT doc_id, NOT scanned AND issued > DATE '2020-01-01' AS future_dated FROM d"""),
        "fraud_bank_account": truth("""
            SELECT doc_id, CASE WHEN scanned THEN 'UNKNOWN_VENDOR'
              WHEN k % 31 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS bank_check FROM d"""),
        "vendor_baseline": truth("""
            , v AS (SELECT doc_id, vgstin, issued, grand,
                count(*) OVER w AS n, coalesce(sum(grand) OVER w, 0) AS s,
                coalesce(sum(CAST(grand AS HUGEINT) * grand) OVER w, 0) AS q
              FROM d WHERE NOT scanned
              WINDOW w AS (PARTITION BY vgstin ORDER BY issued, doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            m AS (SELECT *, CAST(s AS DOUBLE) / 100 AS sd, CAST(q AS DOUBLE) / 10000 AS qd FROM v),
            z AS (SELECT doc_id, vgstin, n, CAST(grand AS DOUBLE) / 100 AS amount,
                CASE WHEN n > 0 THEN CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100 END AS mean_prior,
                CASE WHEN n > 1 THEN round(sqrt(greatest(qd - sd * sd / n, 0) / (n - 1)), 2) END
                  AS stddev_prior FROM m)
            SELECT doc_id, vgstin AS vendor_gstin, amount, n AS n_prior, mean_prior, stddev_prior,
              coalesce(abs(amount - mean_prior) > 2.0 * stddev_prior, false) AS out_of_line
            FROM z
            UNION ALL SELECT doc_id, '', NULL, 0, NULL, NULL, false FROM d WHERE scanned"""),
        # ---- store, export
        "default_fill": text("""
            SELECT doc_id, invoice_number, invoice_date, vendor_name, vendor_gstin, buyer_name,
              cgst, sgst, grand_total, currency FROM st""", stored()),
        "store_export": text(
            "SELECT doc_id, " + ", ".join(f'{c} AS "{h}"' for c, h in STORE_EXPORT.items())
            + " FROM st", stored()),
        "stored_record": text("""
            SELECT doc_id, sha256(txt) AS file_hash, filename, invoice_no, invoice_date, vendor_name,
              grand_total, raw_text FROM rec WHERE error_reason IS NULL""",
            f", rec AS (SELECT doc_id, txt, {record('a')} FROM t)"),
        "store_ids": text(
            "SELECT count(*)::HUGEINT::BIGINT AS n_rows, count(*) AS n_ids FROM st", stored()),
        "export_count": text("SELECT count(*) AS n_read, count(*) AS n_written FROM st", stored()),
        "export_records": text(
            f"SELECT doc_id, {export} FROM rec",
            f", rec AS (SELECT doc_id, {record('a')} FROM t)"),
        "sanitize_cells": truth("""
            SELECT doc_id, CASE WHEN failed THEN 'N/A' WHEN scanned OR k % 23 = 0 THEN ''
                WHEN k % 6 >= 4 THEN '''' || company ELSE company END AS vendor_name
            FROM d"""),
        "review_queue": truth("""
            SELECT filename, CASE WHEN failed THEN 'N/A' WHEN scanned OR k % 23 = 0 THEN ''
                ELSE company END AS vendor_name,
              CASE WHEN failed THEN 'ERROR' ELSE 'PROCESSED' END AS status
            FROM d"""),
        "column_widths": text(
            "SELECT * FROM (" + " UNION ALL ".join(
                f"SELECT CAST({i + 1} AS BIGINT) AS position, '{RECORD_COLUMNS[c]}' AS column_name, "
                f"CAST(least(greatest(max(length(coalesce({c}, 'nan'))), "
                f"{len(RECORD_COLUMNS[c])}) + 2, 60) AS BIGINT) AS width FROM rec"
                for i, c in enumerate(record_columns("a")[:26])
            ) + ")",
            f", rec AS MATERIALIZED (SELECT doc_id, {record('a')} FROM t)"),
        "status_summary": truth("""
            SELECT status, count(*) AS n_documents FROM (
              SELECT CASE WHEN failed THEN 'ERROR' WHEN copy = 1 THEN 'DUPLICATE'
                     ELSE 'PROCESSED' END AS status FROM d)
            GROUP BY status"""),
        "audit_log": """
            SELECT 'document_' || doc_id || '.txt' AS filename, sha256(text) AS file_hash,
              '2024-01-02 03:04' AS ts, 'EXTRACT' AS action FROM documents""",
        # ---- duplicates
        "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
        "first_by_hash": f"""
            WITH {HASHED}
            SELECT doc_id, source, file_hash FROM h
            QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) = 1""",
        "find_duplicates": f"""
            WITH {HASHED}
            SELECT doc_id, file_hash, count(*) OVER (PARTITION BY file_hash) AS copies FROM h
            QUALIFY copies > 1""",
        "append_new": f"""
            WITH {HASHED}
            SELECT doc_id, source, file_hash FROM h
            WHERE file_hash NOT IN (
              SELECT file_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
            QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) = 1""",
        # ---- text functions
        "redact_text": f"""
            SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
              regexp_replace(text, '{K.EMAIL}', '[EMAIL]', 'g'),
              '{K.GSTIN}', '[GSTIN]', 'g'), '{K.PAN}', '[PAN]', 'g'),
              '{K.ACCOUNT}', '[ACCOUNT]', 'g'), '{K.AMOUNT}', '[AMOUNT]', 'g') AS text
            FROM documents""",
        "quality_score": f"SELECT doc_id, {SCORE} AS score FROM documents",
        "safe_path": r"""
            SELECT page_id, regexp_extract(url, '[^/\\]*$', 0) AS name FROM pages""",
        "run_stamp": """
            SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y %H:%M') AS record_stamp,
              strftime(o_orderdate, '%Y-%m-%d %H:%M') AS store_stamp FROM orders""",
        "encrypt_roundtrip": """
            SELECT doc_id, text AS decrypted, '[DECRYPTION_FAILED]' AS bad_token,
              text <> '' AS has_token FROM documents""",
        # ---- candidates
        "param_grid": f"SELECT page_id, variant, dpi::BIGINT AS dpi, prep FROM ({GRID})",
        "candidate_parse": f"""
            SELECT page_id, CAST(regexp_extract(variant, '^page(\\d+)_', 1) AS BIGINT) AS page_no,
              variant || '.txt' AS file_name FROM ({GRID})""",
        "variant_slug": """
            SELECT page_id, replace(replace(replace(replace(replace(setting, '--', ''), ' ', '_'),
              '+', '_'), '=', ''), ',', '') AS slug
            FROM pages, (SELECT unnest([""" + ", ".join(f"'{s}'" for s in K.ENGINE_SETTINGS)
            + "]) AS setting)",
        "best_candidate": f"""
            WITH s AS (SELECT conv_id, turn, text, {SCORE} AS score,
                count(*) OVER (PARTITION BY conv_id) AS n_candidates FROM conversations)
            SELECT conv_id, n_candidates, score,
              CASE WHEN score > -1 THEN CAST(turn AS VARCHAR) ELSE '' END AS best_variant,
              CASE WHEN score > -1 THEN text ELSE '' END AS best_text
            FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1""",
        "candidate_sink": f"""
            SELECT conv_id, turn, turn % 16 AS page_no, text FROM conversations
            WHERE turn % 3 <> 0 AND trim(text, {WS}) <> ''""",
        # ---- structured
        "raw_lines": text(
            "SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, "
            "unnest(ls) AS line FROM l", STRUCTURED),
        "structured_items": text("""
            SELECT doc_id, i.description, i.hsn, i.qty, i.unit, i.rate, i.amount
            FROM (SELECT doc_id, unnest(line_items) AS i FROM s)""", STRUCTURED),
        "leftover_lines": text(
            "SELECT doc_id, unnest(declarations) AS line FROM s", STRUCTURED),
        "structured_flatten": text("""
            SELECT doc_id, name AS vendor_name, gstin AS vendor_gstin, '' AS vendor_contact,
              buyer AS buyer_name, gstin AS buyer_gstin, '' AS buyer_address,
              invoice_no, invoice_date, po_no, place AS place_of_supply, cgst, sgst, igst,
              taxable AS taxable_value, total_tax, grand AS grand_total,
              words AS amount_in_words, bank AS bank_name, account_no, ifsc,
              CAST(len(line_items) AS BIGINT) AS n_items,
              CAST(len(declarations) AS BIGINT) AS n_declarations FROM s""", STRUCTURED),
        "structured_build": text("""
            SELECT doc_id, CAST(to_json({
              'supplier': {'name': name, 'gstin': gstin, 'contact': ''},
              'buyer': {'name': buyer, 'gstin': gstin, 'address': ''},
              'invoice_meta': {'invoice_no': invoice_no, 'invoice_date': invoice_date,
                               'po_no': po_no, 'place_of_supply': place},
              'line_items': line_items,
              'taxes': {'cgst': cgst, 'sgst': sgst, 'igst': igst},
              'totals': {'taxable_value': taxable, 'total_tax': total_tax,
                         'grand_total': grand, 'amount_in_words': words},
              'bank_details': {'bank_name': bank, 'account_no': account_no, 'ifsc': ifsc},
              'declarations': declarations}) AS VARCHAR) AS invoice FROM s""", STRUCTURED),
        # ---- streams: the result of the drained stream
        "stream_ingest": text(f"SELECT doc_id, {record('a')} FROM t"),
        "stream_dedupe": f"""
            WITH {HASHED} SELECT file_hash, count(*) AS n FROM (SELECT DISTINCT file_hash FROM h)
            GROUP BY file_hash""",
        "stream_store": f"""
            WITH {HASHED} SELECT min(doc_id) AS doc_id, file_hash FROM h GROUP BY file_hash""",
        "stream_status": truth("""
            SELECT CASE WHEN failed THEN 'ERROR' ELSE 'PROCESSED' END AS status,
              count(*) AS n_documents FROM d GROUP BY 1"""),
    } | strict.oracle_sql(BASE) | stores.oracle_sql(truth)
