"""Invoice-shaped tables derived from the given tables.

Each table is one SELECT that Spark and DuckDB read alike, so a query and its
check see the same input. ``{name}`` stands for another table. Only the
rendering of invoice texts is Spark's alone: checks of text jobs compare with
the columns a text was printed from.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.sources.tables import SCHEMAS, read_table


@dataclass(frozen=True)
class Dialect:
    sha256: Callable[[str], str]
    rows_of: Callable[[str, str], str]  # (array expression, column) -> FROM item
    add_days: Callable[[str, str], str]


SPARK = Dialect(
    sha256=lambda x: f"sha2({x}, 256)",
    rows_of=lambda array, col: f"LATERAL VIEW explode({array}) t_{col} AS {col}",
    add_days=lambda d, n: f"date_add({d}, cast({n} as int))",
)
DUCKDB = Dialect(
    sha256=lambda x: f"sha256({x})",
    rows_of=lambda array, col: f", unnest({array}) AS t_{col}({col})",
    add_days=lambda d, n: f"({d} + cast({n} as int))",
)


def _text(x: str) -> str:
    return f"cast({x} as string)"


def _padded(x: str, n: int) -> str:
    return f"lpad({_text(x)}, {n}, '0')"


def _array(d: Dialect, *items: str) -> str:
    return f"array({', '.join(items)})" if d is SPARK else f"[{', '.join(items)}]"


def templates(d: Dialect) -> dict[str, str]:
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    unit_price = (
        f"cast(cast(floor({cents} * 100 / cast(l_quantity as bigint)) as decimal(18,0))"
        " * cast(0.0001 as decimal(5,4)) as decimal(15,4))"
    )
    line_id = (
        f"concat({_padded('l_linenumber', 4)}, '-', {_padded('l_partkey', 12)}, '-',"
        f" {_padded('l_suppkey', 12)}, '-', {_padded(cents, 12)})"
    )
    vendor_id = f"concat('CO-', {_padded('s_suppkey', 6)}, '-', {_text('r')})"
    return {
        # One row per printed line; (invoice_key, line_id) is unique.
        "line_items": f"""
            SELECT l_orderkey AS invoice_key, {line_id} AS line_id, l_linenumber AS line_number,
                   p_name AS description, {_text('l_partkey')} AS item_code,
                   cast(l_quantity as decimal(10,3)) AS quantity, {unit_price} AS unit_price,
                   cast(l_extendedprice as decimal(15,2)) AS total_price,
                   l_discount * 100 AS discount_rate, l_tax * 100 AS tax_rate
            FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
        # The same lines with faults for the rules to find.
        "line_items_noisy": """
            SELECT invoice_key, line_id, line_number,
                   CASE WHEN invoice_key % 89 = 0 AND line_number = 1 THEN '' ELSE description END AS description,
                   item_code,
                   CASE WHEN invoice_key % 101 = 0 THEN cast(0 as decimal(10,3)) ELSE quantity END AS quantity,
                   unit_price,
                   cast(CASE WHEN (invoice_key + line_number) % 17 = 0 THEN total_price + 1
                             WHEN (invoice_key + line_number) % 97 = 0 THEN -total_price
                             ELSE total_price END as decimal(15,2)) AS total_price,
                   discount_rate, tax_rate
            FROM {line_items}""",
        # Every tenant (region) holds its own row per supplier.
        "companies": f"""
            SELECT {vendor_id} AS id, s_name AS name,
                   CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' Ltd.') ELSE '' END AS legal_name,
                   concat('TX-', {_padded('s_suppkey', 7)}) AS tax_id,
                   CASE WHEN s_suppkey % 13 = 0 THEN cast(NULL as string)
                        ELSE concat('billing', {_text('s_suppkey')}, '@vendor.example.com') END AS email,
                   CASE WHEN s_suppkey % 11 = 0 THEN '12-34'
                        ELSE concat('(555) ', {_padded('s_suppkey % 1000', 3)}, '-', {_padded('s_suppkey % 10000', 4)}) END AS phone,
                   CASE WHEN s_suppkey % 7 = 0 THEN cast(NULL as string)
                        ELSE concat({_text('s_suppkey')}, ' Depot Road') END AS address_line1,
                   'Springfield' AS city, 'IL' AS state_province, '10001' AS postal_code, 'USA' AS country,
                   CASE WHEN s_suppkey % 5 = 0 THEN concat('www.supplier', {_text('s_suppkey')}, '.example.com') ELSE '' END AS website,
                   cast(0.5 as double) AS confidence_score,
                   'USD' AS currency, concat('tenant_', {_text('r')}) AS tenant_id,
                   s_suppkey % 10 <> 9 AS is_active,
                   cast(30 * (1 + s_suppkey % 3) as int) AS payment_terms_days
            FROM {{supplier}} {d.rows_of(_array(d, '0', '1', '2', '3', '4'), 'r')}""",
        "customers": f"""
            SELECT concat('CU-', {_padded('c_custkey', 6)}) AS id, c_name AS name,
                   CASE WHEN c_custkey % 6 = 0 THEN concat('ID-', {_text('c_custkey')}) ELSE '' END AS tax_id,
                   CASE WHEN c_acctbal < 0 THEN concat('Firm ', {_text('c_custkey')}) ELSE '' END AS company_name,
                   CASE WHEN c_acctbal < 0 THEN 'business' ELSE 'individual' END AS customer_type,
                   concat('cust', {_text('c_custkey')}, '@example.com') AS email,
                   CASE WHEN c_custkey % 9 = 0 THEN cast(NULL as string)
                        ELSE concat('(555) ', {_padded('c_custkey % 1000', 3)}, '-', {_padded('c_custkey % 10000', 4)}) END AS phone,
                   concat({_text('c_custkey')}, ' Elm Ave') AS billing_address_line1,
                   'Springfield' AS billing_city, '20002' AS billing_postal_code, 'IL' AS billing_state_province, 'USA' AS billing_country,
                   cast(0.5 as double) AS confidence_score,
                   CASE WHEN c_custkey % 4 = 0 THEN concat({_text('c_custkey')}, ' Dock Lane') ELSE '' END AS shipping_address_line1,
                   CASE WHEN c_custkey % 4 = 0 THEN 'Shelbyville' ELSE cast(NULL as string) END AS shipping_city,
                   concat('tenant_', {_text('n_regionkey')}) AS tenant_id,
                   c_custkey % 10 <> 7 AS is_active,
                   cast(30 * (1 + c_custkey % 4) as int) AS payment_terms_days
            FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey""",
        "invoice_headers": f"""
            SELECT o_orderkey AS invoice_key,
                   concat('INV-', {_padded('o_orderkey', 8)}) AS invoice_number,
                   cast(o_orderdate as date) AS invoice_date,
                   {d.add_days('cast(o_orderdate as date)', '30 * (1 + o_orderkey % 3)')} AS due_date,
                   concat('tenant_', {_text('n_regionkey')}) AS tenant_id,
                   concat('CO-', {_padded('coalesce(supplier_key, 0)', 6)}, '-', {_text('n_regionkey')}) AS company_id,
                   concat('CU-', {_padded('o_custkey', 6)}) AS customer_id,
                   coalesce(supplier_key, 0) AS supplier_key, o_custkey AS customer_key,
                   'USD' AS currency, subtotal AS subtotal_amount,
                   cast((o_orderkey % 3) * 5 as double) AS tax_rate, tax AS tax_amount,
                   cast(0 as decimal(15,2)) AS shipping_amount, cast(0 as decimal(15,2)) AS discount_amount,
                   total AS total_amount,
                   CASE o_orderstatus WHEN 'F' THEN total
                        WHEN 'P' THEN cast(round(total * cast(0.5 as decimal(2,1)), 2) as decimal(15,2))
                        ELSE cast(0 as decimal(15,2)) END AS paid_amount,
                   CASE o_orderstatus WHEN 'F' THEN 'paid' ELSE 'unpaid' END AS payment_status,
                   CASE WHEN o_orderstatus = 'O' THEN cast(NULL as date)
                        ELSE {d.add_days('cast(o_orderdate as date)', '10')} END AS payment_date,
                   CASE o_orderkey % 3 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'Net 60' ELSE 'Net 90' END AS payment_terms,
                   CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
                        ELSE 'completed' END AS processing_status,
                   cast(o_orderkey % 101 as double) / 100 AS extraction_confidence,
                   o_orderkey % 5 = 0 AS requires_review,
                   concat('invoice_', {_text('o_orderkey')}, '.pdf') AS original_filename,
                   cast(1000 + o_orderkey % 5000 as bigint) AS file_size,
                   {d.sha256(_text('CASE WHEN o_orderkey % 20 < 2 THEN o_orderkey - o_orderkey % 2 ELSE o_orderkey END'))} AS file_hash,
                   o_orderkey % 50 = 0 AS is_archived, o_orderdate AS created_at
            FROM (
                SELECT o.*, supplier_key, n_regionkey, subtotal, tax,
                       cast(subtotal + tax + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END as decimal(15,2)) AS total
                FROM (
                    SELECT h.*, cast(round(subtotal * cast((o_orderkey % 3) * 0.05 as decimal(5,2)), 2) as decimal(15,2)) AS tax
                    FROM (
                        SELECT orders.*, supplier_key, coalesce(line_sum, cast(0 as decimal(15,2))) AS subtotal
                        FROM {{orders}} AS orders LEFT JOIN (
                            SELECT l_orderkey, min(l_suppkey) AS supplier_key,
                                   cast(sum(cast(l_extendedprice as decimal(15,2))) as decimal(15,2)) AS line_sum
                            FROM {{lineitem}} GROUP BY l_orderkey
                        ) s ON l_orderkey = o_orderkey
                    ) h
                ) o
                JOIN {{customer}} ON c_custkey = o_custkey
                JOIN {{nation}} ON n_nationkey = c_nationkey
            ) x""",
        # Headers as they arrive, some of them sent twice.
        "header_arrivals": f"""
            SELECT invoice_key * 10 + copy AS arrival_id, invoice_number, tenant_id, company_id,
                   CASE WHEN copy = 1 AND invoice_key % 50 = 25 THEN {d.sha256("concat('resent-', " + _text('invoice_key') + ")")}
                        ELSE file_hash END AS file_hash,
                   is_archived AND copy = 0 AS is_archived, processing_status, requires_review, total_amount,
                   created_at + copy * INTERVAL '1' DAY AS created_at
            FROM {{invoice_headers}}
            {d.rows_of(f"CASE WHEN invoice_key % 25 = 0 THEN {_array(d, '0', '1')} ELSE {_array(d, '0')} END", 'copy')}""",
        # What is printed on each invoice; texts are rendered from these columns.
        "invoice_prints": f"""
            SELECT invoice_key, invoice_number, invoice_date, due_date, tenant_id, payment_terms, created_at,
                   subtotal_amount, tax_amount, total_amount, customer_key, supplier_key,
                   CASE WHEN invoice_key % 4 = 3 THEN concat('Vendor ', {_text('supplier_key')})
                        WHEN invoice_key % 4 = 2 THEN concat('plier#', {_padded('supplier_key', 9)})
                        ELSE concat('Supplier#', {_padded('supplier_key', 9)}) END AS vendor_name,
                   CASE WHEN invoice_key % 2 = 0 THEN concat('(555) ', {_padded('supplier_key % 1000', 3)}, '-', {_padded('supplier_key % 10000', 4)})
                        ELSE '' END AS vendor_phone,
                   CASE WHEN invoice_key % 5 < 2 THEN concat('ap', {_text('supplier_key')}, '@mail.example.com') ELSE '' END AS vendor_email,
                   CASE WHEN invoice_key % 3 = 0 THEN concat('TX-', {_padded('supplier_key', 7)}) ELSE '' END AS vendor_tax_id,
                   CASE WHEN invoice_key % 6 < 4 THEN concat({_text('supplier_key % 90 + 10')}, ' Main Street') ELSE '' END AS vendor_street,
                   CASE WHEN invoice_key % 8 < 5 THEN concat('PO-', {_padded('customer_key', 6)}) ELSE '' END AS po_number,
                   CASE WHEN invoice_key % 10 = 9 THEN concat('Client ', {_text('customer_key')})
                        ELSE concat('Customer#', {_padded('customer_key', 9)}) END AS customer_name,
                   concat({_text('customer_key % 90 + 10')}, ' Elm Avenue') AS customer_street
            FROM {{invoice_headers}}""",
        # Headers as they are stored when files have come in and are not read yet.
        "stored_headers": """
            SELECT invoice_key, tenant_id, 'PENDING' AS invoice_number, cast(created_at as date) AS invoice_date, cast(NULL as date) AS due_date,
                   CASE WHEN invoice_key % 3 = 0 THEN concat('PO-S', cast(invoice_key as string)) ELSE cast(NULL as string) END AS po_number,
                   cast(NULL as string) AS company_id, cast(NULL as string) AS customer_id, 'USD' AS currency,
                   cast(0 as decimal(15,2)) AS subtotal_amount, cast(0 as decimal(15,2)) AS tax_amount, cast(0 as double) AS tax_rate,
                   cast(0 as decimal(15,2)) AS discount_amount, cast(0 as decimal(15,2)) AS shipping_amount, cast(0 as decimal(15,2)) AS total_amount,
                   cast(NULL as string) AS payment_terms, cast(0 as int) AS line_items_count, cast(0 as double) AS extraction_confidence,
                   'pending' AS processing_status, false AS requires_review, original_filename, file_size
            FROM {invoice_headers} WHERE invoice_key % 31 <> 5""",
        # Headers with their parties and planted faults for the rules to find.
        "headers_to_check": f"""
            SELECT invoice_key, h.tenant_id,
                   CASE WHEN invoice_key % 43 = 0 THEN '' WHEN invoice_key % 47 = 0 THEN 'A!' ELSE invoice_number END AS invoice_number,
                   invoice_date, CASE WHEN invoice_key % 53 = 0 THEN {d.add_days('invoice_date', '-5')} ELSE due_date END AS due_date,
                   CASE WHEN invoice_key % 59 = 0 THEN 'XXX' ELSE h.currency END AS currency,
                   CASE WHEN invoice_key % 61 = 0 THEN cast(60 as double) WHEN invoice_key % 67 = 0 THEN cast(-1 as double) ELSE tax_rate END AS tax_rate,
                   subtotal_amount, tax_amount, shipping_amount, discount_amount,
                   cast(CASE WHEN invoice_key % 73 = 0 THEN -total_amount ELSE total_amount END as decimal(15,2)) AS total_amount,
                   CASE WHEN invoice_key % 71 = 0 THEN 'Net 400' ELSE payment_terms END AS payment_terms,
                   extraction_confidence AS metadata_confidence, extraction_confidence AS company_confidence,
                   cast(0.75 as double) AS customer_confidence, cast(0.9 as double) AS financial_confidence,
                   CASE WHEN supplier_key % 23 = 0 THEN upper(c.name) WHEN supplier_key % 29 = 0 THEN 'S' ELSE c.name END AS vendor_name,
                   CASE WHEN supplier_key % 31 = 0 THEN 'billing(at)vendor' ELSE coalesce(c.email, '') END AS vendor_email,
                   coalesce(c.phone, '') AS vendor_phone, coalesce(c.address_line1, '') AS vendor_address_line1,
                   c.city AS vendor_city, c.postal_code AS vendor_postal_code,
                   CASE WHEN customer_key % 37 = 0 THEN 'C' ELSE u.name END AS customer_name,
                   CASE WHEN customer_key % 41 = 0 THEN 'cust at example' ELSE u.email END AS customer_email
            FROM {{invoice_headers}} h JOIN {{companies}} c ON c.id = h.company_id JOIN {{customers}} u ON u.id = h.customer_id""",
        "checked_companies": """
            SELECT id, tenant_id, CASE WHEN tax_id LIKE '%05' THEN '' WHEN tax_id LIKE '%15' THEN ' X ' ELSE name END AS name,
                   CASE WHEN tax_id LIKE '%3' THEN 'billing.vendor.example.com' WHEN tax_id LIKE '%4' THEN 'a..b@vendor.com' ELSE email END AS email,
                   phone, CASE WHEN tax_id LIKE '%8' THEN 'T!' ELSE tax_id END AS tax_id
            FROM {companies}""",
        "checked_headers": """
            SELECT invoice_key, tenant_id,
                   CASE WHEN invoice_key % 11 = 0 THEN '' WHEN invoice_key % 13 = 0 THEN 'A1' WHEN invoice_key % 17 = 0 THEN 'INV 17' ELSE invoice_number END AS invoice_number,
                   CASE WHEN invoice_key % 19 = 0 THEN '2001-13-45' WHEN invoice_key % 23 = 0 THEN '' ELSE cast(invoice_date as string) END AS invoice_date,
                   CASE WHEN invoice_key % 29 = 0 THEN '01/02/2001' ELSE cast(due_date as string) END AS due_date,
                   CASE WHEN invoice_key % 31 = 0 THEN '-1.50' WHEN invoice_key % 37 = 0 THEN 'abc' ELSE cast(total_amount as string) END AS total_amount
            FROM {invoice_headers}""",
        # Suppliers with planted near copies.
        "companies_dirty": f"""
            SELECT concat('CD-', {_padded('s_suppkey', 6)}, '-', {_text('v')}) AS id,
                   CASE v WHEN 1 THEN concat('SUPPLIER ', {_text('s_suppkey')}, ' TRADING COMPANY LIMITED')
                          WHEN 2 THEN concat('Other House ', {_text('s_suppkey')})
                          WHEN 3 THEN concat('Supplier ', {_text('s_suppkey')}, ' Trading Group Company Limited')
                          WHEN 4 THEN concat('Supplier ', {_text('s_suppkey')}, ' Trading Company Limited Group')
                          WHEN 5 THEN concat('Limited Supplier ', {_text('s_suppkey')}, ' Company Trading')
                          ELSE concat('Supplier ', {_text('s_suppkey')}, ' Trading Company Limited') END AS name,
                   CASE WHEN v IN (0, 2) THEN concat('TX-', {_text('s_suppkey')}) ELSE '' END AS tax_id,
                   concat({_text('s_suppkey')}, ' Main St') AS address_line1, 'Springfield' AS city,
                   CASE WHEN s_suppkey % 2 = 0 THEN '10001' ELSE cast(NULL as string) END AS postal_code,
                   concat('tenant_', {_text('s_nationkey % 5')}) AS tenant_id
            FROM {{supplier}}
            {d.rows_of(f"CASE WHEN s_suppkey % 6 = 0 THEN {_array(d, '0')} ELSE {_array(d, '0', _as_int('s_suppkey % 6'))} END", 'v')}""",
        "customers_dirty": f"""
            SELECT concat('CC-', {_padded('c_custkey', 6)}, '-', {_text('v')}) AS id,
                   CASE v WHEN 1 THEN concat('Someone Else ', {_text('c_custkey')})
                          WHEN 2 THEN concat('Another Name ', {_text('c_custkey')})
                          WHEN 3 THEN concat('Last', {_text('c_custkey')}, ' First', {_text('c_custkey')})
                          WHEN 4 THEN concat('First', {_text('c_custkey')}, ' Middle Other', {_text('c_custkey')})
                          ELSE concat('First', {_text('c_custkey')}, ' Last', {_text('c_custkey')}) END AS name,
                   CASE v WHEN 0 THEN concat('cust', {_text('c_custkey')}, '@example.com')
                          WHEN 1 THEN concat('CUST', {_text('c_custkey')}, '@EXAMPLE.COM')
                          ELSE '' END AS email,
                   CASE WHEN v IN (0, 2) THEN concat('ID', {_text('c_custkey')}) ELSE cast(NULL as string) END AS tax_id,
                   concat({_text('c_custkey')}, ' Elm Ave') AS address_line1, 'Springfield' AS city,
                   cast(NULL as string) AS postal_code,
                   concat('tenant_', {_text('c_nationkey % 5')}) AS tenant_id
            FROM {{customer}}
            {d.rows_of(f"CASE WHEN c_custkey % 5 = 0 THEN {_array(d, '0')} ELSE {_array(d, '0', _as_int('c_custkey % 5'))} END", 'v')}""",
        # Tables with every column that documents show, some of them null or empty.
        "company_records": """
            SELECT c.*, concat('HRB ', id) AS registration_number, CASE WHEN id LIKE '%3-%' THEN 'Floor 2' ELSE '' END AS address_line2,
                   CASE WHEN id LIKE '%4-%' THEN 'freight' ELSE cast(NULL as string) END AS industry,
                   CASE WHEN is_active THEN 'small' ELSE 'large' END AS company_size, id LIKE '%5-%' AS is_verified,
                   CASE WHEN id LIKE '%5-%' THEN 'manual' ELSE cast(NULL as string) END AS verification_source,
                   id LIKE '%7-%' AS is_preferred_vendor, timestamp '2001-01-02 03:04:05' AS created_at,
                   CASE WHEN is_active THEN timestamp '2001-06-07 08:09:10' ELSE timestamp '2001-02-03 00:00:00' END AS updated_at
            FROM {companies} c""",
        "customer_records": """
            SELECT c.*, CASE WHEN id LIKE '%1' THEN '555-0101' ELSE '' END AS mobile,
                   CASE WHEN id LIKE '%2' THEN 'Rear' ELSE cast(NULL as string) END AS billing_address_line2,
                   CASE WHEN id LIKE '%3' THEN concat('R-', id) ELSE '' END AS registration_number,
                   concat('https://', lower(id), '.example.com') AS website, id LIKE '%4' AS is_verified,
                   CASE WHEN id LIKE '%4' THEN 'email' ELSE cast(NULL as string) END AS verification_source,
                   CASE WHEN id LIKE '%5' THEN cast(NULL as date) ELSE date '1999-04-05' END AS customer_since,
                   CASE WHEN is_active THEN 'retail' ELSE 'lost' END AS customer_segment,
                   CASE WHEN id LIKE '%6' THEN cast(0 as decimal(15,2)) WHEN id LIKE '%7' THEN cast(NULL as decimal(15,2))
                        ELSE cast(2500.5 as decimal(15,2)) END AS credit_limit,
                   id LIKE '%8' AS is_vip, id LIKE '%9' AS allow_credit, 'email' AS preferred_contact_method,
                   is_active AS send_invoice_copy, NOT is_active AS marketing_consent,
                   '' AS shipping_address_line2, cast(NULL as string) AS shipping_state_province,
                   CASE WHEN id LIKE '%4' THEN '30003' ELSE '' END AS shipping_postal_code,
                   CASE WHEN id LIKE '%5' THEN 'USA' ELSE cast(NULL as string) END AS shipping_country,
                   timestamp '2001-01-02 03:04:05' AS created_at, timestamp '2001-06-07 08:09:10' AS updated_at
            FROM {customers} c""",
        "header_records": """
            SELECT h.*, CASE WHEN invoice_key % 4 = 0 THEN cast(NULL as string) ELSE concat('PO-', cast(invoice_key as string)) END AS po_number,
                   invoice_key % 30 AS user_id, CASE WHEN payment_status = 'paid' THEN 'transfer' ELSE cast(NULL as string) END AS payment_method,
                   CASE WHEN payment_status = 'paid' THEN concat('REF', cast(invoice_key as string)) ELSE '' END AS payment_reference,
                   'standard' AS invoice_type, CASE WHEN invoice_key % 6 = 0 THEN 'freight' ELSE cast(NULL as string) END AS invoice_category,
                   CASE WHEN requires_review THEN invoice_key % 7 ELSE cast(NULL as bigint) END AS reviewed_by,
                   CASE WHEN requires_review THEN timestamp '2001-03-04 05:06:07' ELSE cast(NULL as timestamp) END AS reviewed_at,
                   invoice_key % 20 = 1 AS is_duplicate, CASE WHEN invoice_key % 20 = 1 THEN invoice_key - 1 ELSE cast(NULL as bigint) END AS duplicate_of,
                   invoice_key % 8 AS line_items_count, timestamp '2001-06-07 08:09:10' AS updated_at
            FROM {invoice_headers} h""",
        "line_records": """
            SELECT l.*, CASE WHEN line_number = 1 THEN 'kg' ELSE cast(NULL as string) END AS unit_of_measure,
                   CASE WHEN line_number = 2 THEN cast(NULL as decimal(15,2)) ELSE cast(1.25 as decimal(15,2)) END AS tax_amount,
                   CASE WHEN line_number = 3 THEN cast(0.5 as decimal(15,2)) ELSE cast(NULL as decimal(15,2)) END AS discount_amount,
                   CASE WHEN line_number = 1 THEN 'goods' ELSE '' END AS category,
                   CASE WHEN line_number = 2 THEN 'service' ELSE cast(NULL as string) END AS product_type,
                   cast(line_number as double) / 8 AS confidence_score, timestamp '2001-01-02 03:04:05' AS created_at,
                   timestamp '2001-06-07 08:09:10' AS updated_at
            FROM {line_items} l""",
        "log_records": """
            SELECT p.*, id % 30 AS user_id, concat('stage ', process_stage) AS message, cast(id % 8 as double) / 8 AS confidence_score,
                   CASE WHEN log_level = 'ERROR' THEN 'PROCESSING_FAILED' ELSE cast(NULL as string) END AS error_code,
                   CASE WHEN log_level = 'ERROR' THEN 'bad scan' ELSE cast(NULL as string) END AS error_details,
                   concat('10.0.0.', cast(id % 40 as string)) AS ip_address, 'agent/1.0' AS user_agent
            FROM {processing_logs} p""",
        # Customers with faults for the checks to find, and codes of every length.
        "checked_customers": """
            SELECT id, CASE WHEN id LIKE '%11' THEN '' WHEN id LIKE '%12' THEN ' Z ' ELSE name END AS name,
                   CASE WHEN id LIKE '%3' THEN 'no at sign' ELSE email END AS email, CASE WHEN id LIKE '%4' THEN '12-34' ELSE phone END AS phone,
                   CASE WHEN id LIKE '%5' THEN 'SW1A 1AA' WHEN id LIKE '%6' THEN '12' WHEN id LIKE '%7' THEN '12345-67890-1' WHEN id LIKE '%8' THEN '20#02'
                        WHEN id LIKE '%9' THEN cast(NULL as string) ELSE billing_postal_code END AS billing_postal_code,
                   CASE WHEN id LIKE '%21' THEN 't1' WHEN id LIKE '%22' THEN 'tenant-1' WHEN id LIKE '%23' THEN '' ELSE tenant_id END AS tenant_id
            FROM {customers}""",
        "access_log": f"""
            SELECT event_id, ts, user_id, concat('10.0.0.', {_text('user_id % 40')}) AS address,
                   CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_ok'
                        ELSE 'api_request' END AS action,
                   CASE event_type WHEN 'click' THEN 'upload' WHEN 'purchase' THEN 'register'
                        WHEN 'error' THEN 'login' WHEN 'signup' THEN 'login' ELSE 'list' END AS endpoint
            FROM {{events}}""",
        "processing_logs": """
            SELECT event_id AS id, event_id % 1500 AS invoice_key,
                   CASE event_type WHEN 'click' THEN 'upload' WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'extraction'
                        WHEN 'purchase' THEN 'validation' ELSE 'error' END AS process_stage,
                   CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level,
                   cast(round(value * 100) as int) AS processing_time_ms, props AS metadata, ts AS created_at
            FROM {events}""",
        "users": f"""
            SELECT user_id, concat('tenant_', {_text('user_id % 5')}) AS tenant_id,
                   CASE WHEN user_id % 50 = 0 THEN 'super_admin' WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS role,
                   2 AS api_rate_limit
            FROM (SELECT DISTINCT user_id FROM {{events}}) u""",
    }


def _as_int(x: str) -> str:
    return f"cast({x} as int)"


def _parents(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w+)\}", sql)))


_SPARK_SQL = templates(SPARK)
_DUCKDB_SQL = templates(DUCKDB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a lazy DataFrame."""
    if name in SCHEMAS:
        return read_table(spark, sf_dir, name)
    if name in _BUILDERS:
        return _BUILDERS[name](spark, sf_dir)
    sql = _SPARK_SQL[name]
    return spark.sql(sql, **{p: table(spark, sf_dir, p) for p in _parents(sql)})


def oracle(body: str) -> str:
    """``body`` for DuckDB, with the derived tables it names as CTEs."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for parent in _parents(sql):
            if parent in _DUCKDB_SQL and parent not in ordered:
                visit(_DUCKDB_SQL[parent])
                ordered.append(parent)

    visit(body)
    plain = lambda s: re.sub(r"\{([a-z]\w+)\}", r"\1", s)
    ctes = [f"{n} AS ({plain(_DUCKDB_SQL[n])})" for n in ordered]
    body = plain(body).strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body.removeprefix('WITH RECURSIVE ')}"
    if body.startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body.removeprefix('WITH ')}"
    return f"WITH {', '.join(ctes)} {body}"


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recognised text per invoice: invoice_key, tenant_id, created_at, text.

    A text is one value, so its lines are gathered per invoice here. Real
    input arrives as whole texts and skips this step. Reading a text costs
    far more than moving it, so the rendered texts are spread over all tasks.
    """
    lines = (
        table(spark, sf_dir, "line_items")
        .select(
            "invoice_key",
            F.struct(
                "line_id",
                F.concat_ws(
                    " ",
                    "description",
                    F.col("quantity").cast("int").cast("string"),
                    F.round("unit_price", 2).cast("decimal(15,2)").cast("string"),
                    F.col("total_price").cast("string"),
                ).alias("printed"),
            ).alias("line"),
        )
        .groupBy("invoice_key")
        .agg(F.array_join(F.sort_array(F.collect_list("line")).getField("printed"), "\n").alias("lines"))
    )
    p = table(spark, sf_dir, "invoice_prints")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    when_set = lambda c, *parts: F.when(F.length(c) > 0, F.concat(*parts))
    return p.join(lines, "invoice_key", "left").select(
        "invoice_key",
        "tenant_id",
        "created_at",
        F.concat_ws(
            "\n",
            "vendor_name",
            when_set("vendor_phone", F.lit("Phone: "), "vendor_phone"),
            when_set("vendor_street", "vendor_street", F.lit("\nSpringfield, IL 10001")),
            when_set("vendor_email", F.lit("Email: "), "vendor_email"),
            when_set("vendor_tax_id", F.lit("Tax ID: "), "vendor_tax_id"),
            F.concat(F.lit("Invoice #: "), "invoice_number"),
            F.concat(F.lit("Date: "), F.date_format("invoice_date", "MM/dd/yyyy")),
            F.concat(F.lit("Due Date: "), F.date_format("due_date", "MM/dd/yyyy")),
            when_set("po_number", F.lit("PO #: "), "po_number"),
            F.concat(F.lit("Bill To: "), "customer_name"),
            "customer_street",
            F.lit(""),
            F.when(F.col("lines").isNotNull(), F.concat(F.lit("Description Quantity Price Amount\n"), "lines")),
            F.concat(F.lit("Subtotal: "), money("subtotal_amount")),
            F.concat(F.lit("Tax: "), money("tax_amount")),
            F.concat(F.lit("Total: "), money("total_amount")),
            "payment_terms",
        ).alias("text"),
    ).repartition(_text_tasks(spark, sf_dir), "invoice_key")


def _text_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for text work: as many as the lines are read by, so they grow with the table; sizes alone would merge them."""
    read = read_table(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, read)


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of a page: one per line of a document."""
    return (
        read_table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
        .select(
            "doc_id",
            "block_index",
            "text",
            (((F.col("doc_id") * 31 + F.col("block_index") * 17) % 101) / F.lit(100.0)).alias("confidence"),
            F.lit(0).alias("x"),
            (F.col("block_index") * 10).alias("y"),
            F.lit(100).alias("width"),
            F.lit(10).alias("height"),
        )
    )


_DUCKDB_SQL["ocr_blocks"] = """
    SELECT doc_id, cast(i - 1 as int) AS block_index, parts[i] AS text,
           ((doc_id * 31 + (i - 1) * 17) % 101) / 100.0 AS confidence,
           0 AS x, (i - 1) * 10 AS y, 100 AS width, 10 AS height
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents}) d, unnest(range(1, len(parts) + 1)) AS t(i)"""


def rotated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks read at four page angles, with a confidence that moves with the angle."""
    return ocr_blocks(spark, sf_dir).select(
        "doc_id",
        F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])).alias("angle"),
        ((F.col("doc_id") * 31 + F.col("block_index") * 17 + F.col("angle")) % 101).alias("confidence_points"),
    )


_DUCKDB_SQL["rotated_blocks"] = """
    SELECT doc_id, angle, (doc_id * 31 + block_index * 17 + angle) % 101 AS confidence_points
    FROM {ocr_blocks}, unnest([0, 90, 180, 270]) AS t(angle)"""

_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "invoice_texts": invoice_texts,
    "ocr_blocks": ocr_blocks,
    "rotated_blocks": rotated_blocks,
}
