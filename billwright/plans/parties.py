"""Queries that match, update and compare vendors and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from billwright.operators import match, party_duplicates, party_groups
from billwright.plans.registry import query
from billwright.sources.derived import table


def printed_parties(spark, sf_dir):
    """Parties as extracted from each invoice, with an e-mail for some customers."""
    mail = F.concat(F.lit("CUST"), F.col("customer_key").cast("string"), F.lit("@EXAMPLE.COM"))
    return table(spark, sf_dir, "invoice_prints").select(
        "invoice_key",
        "tenant_id",
        "created_at",
        F.when(F.col("invoice_key") % 4 == 1, F.lit("")).otherwise(F.col("payment_terms")).alias("payment_terms"),
        "vendor_name",
        "vendor_tax_id",
        "vendor_phone",
        "vendor_email",
        F.col("vendor_street").alias("vendor_address_line1"),
        "customer_name",
        F.when(F.col("invoice_key") % 12 == 9, mail).otherwise("").alias("customer_email"),
        F.lit("").alias("customer_phone"),
        F.col("customer_street").alias("billing_address_line1"),
        *[F.expr(text).alias(name) for name, text in _FURTHER.items()],
    )


#: Attributes that only some invoices have.
_FURTHER = {
    "vendor_website": "CASE WHEN vendor_email <> '' THEN 'mail.example.com' ELSE '' END",
    "vendor_city": "CASE WHEN vendor_street <> '' THEN 'Capital City' ELSE '' END",
    "vendor_state_province": "CASE WHEN vendor_street <> '' THEN 'NY' ELSE '' END",
    "vendor_postal_code": "CASE WHEN invoice_key % 4 = 2 THEN '30003' ELSE '' END",
    "vendor_country": "CASE WHEN invoice_key % 7 = 2 THEN 'Canada' ELSE '' END",
    "company_confidence": "cast(invoice_key % 10 as double) / 10",
    "customer_tax_id": "CASE WHEN invoice_key % 12 = 3 THEN concat('ID-', cast(customer_key as string)) ELSE '' END",
    "customer_company_name": "CASE WHEN invoice_key % 11 = 0 THEN concat('House ', cast(customer_key as string)) ELSE '' END",
    "billing_city": "CASE WHEN invoice_key % 5 = 0 THEN 'Capital City' ELSE '' END",
    "billing_state_province": "CASE WHEN invoice_key % 5 = 0 THEN 'NY' ELSE '' END",
    "billing_postal_code": "CASE WHEN invoice_key % 4 = 2 THEN '40004' ELSE '' END",
    "billing_country": "CASE WHEN invoice_key % 7 = 2 THEN 'Canada' ELSE '' END",
    "customer_confidence": "cast(invoice_key % 10 as double) / 10",
}

_PARTIES = f"""WITH p AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in _FURTHER.items())}, vendor_street AS vendor_address_line1, customer_street AS billing_address_line1, '' AS customer_phone,
                  CASE WHEN invoice_key % 12 = 9 THEN concat('CUST', customer_key, '@EXAMPLE.COM') ELSE '' END AS customer_email,
                  CASE WHEN invoice_key % 4 = 1 THEN '' ELSE payment_terms END AS terms
           FROM {{invoice_prints}}),
     ac AS (SELECT * FROM {{companies}} WHERE is_active), au AS (SELECT * FROM {{customers}} WHERE is_active),
     vt AS (SELECT tenant_id, tax_id, min(id) AS id FROM ac GROUP BY ALL),
     vn AS (SELECT d.tenant_id, d.vendor_name, min(ac.id) AS id FROM (SELECT DISTINCT tenant_id, vendor_name FROM p) d
            JOIN ac ON ac.tenant_id = d.tenant_id AND contains(lower(ac.name), lower(d.vendor_name)) GROUP BY ALL),
     v AS (SELECT p.*, coalesce(vt.id, vn.id) AS company_id,
                  CASE WHEN vt.id IS NOT NULL THEN 'tax_id' WHEN vn.id IS NOT NULL THEN 'name' END AS vendor_by
           FROM p LEFT JOIN vt ON vt.tenant_id = p.tenant_id AND vt.tax_id = p.vendor_tax_id
           LEFT JOIN vn ON vn.tenant_id = p.tenant_id AND vn.vendor_name = p.vendor_name),
     ue AS (SELECT tenant_id, lower(email) AS email, min(id) AS id FROM au GROUP BY ALL),
     ut AS (SELECT tenant_id, tax_id, min(id) AS id FROM au WHERE tax_id <> '' GROUP BY ALL),
     un AS (SELECT d.tenant_id, d.customer_name, min(au.id) AS id FROM (SELECT DISTINCT tenant_id, customer_name FROM p) d
            JOIN au ON au.tenant_id = d.tenant_id AND contains(lower(au.name), lower(d.customer_name)) GROUP BY ALL),
     r AS (SELECT v.*, coalesce(ue.id, ut.id, un.id) AS customer_id,
                  CASE WHEN ue.id IS NOT NULL THEN 'email' WHEN ut.id IS NOT NULL THEN 'tax_id' WHEN un.id IS NOT NULL THEN 'name' END AS customer_by
           FROM v LEFT JOIN ue ON ue.tenant_id = v.tenant_id AND ue.email = lower(v.customer_email)
           LEFT JOIN ut ON ut.tenant_id = v.tenant_id AND ut.tax_id = v.customer_tax_id
           LEFT JOIN un ON un.tenant_id = v.tenant_id AND un.customer_name = v.customer_name)"""


@query(
    "resolve_vendors",
    f"""{_PARTIES}
    SELECT invoice_key, r.tenant_id, company_id AS existing_company_id, vendor_by AS matched_by,
           coalesce(nullif(vendor_address_line1, ''), c.address_line1, '') AS address_line1,
           coalesce(nullif(vendor_phone, ''), c.phone, '') AS phone, coalesce(nullif(vendor_email, ''), c.email, '') AS email
    FROM r LEFT JOIN {{companies}} c ON c.id = company_id""",
)
def resolve_vendors(spark, sf_dir):
    return match.resolve_vendors(printed_parties(spark, sf_dir), table(spark, sf_dir, "companies"))


@query(
    "resolve_customers",
    f"{_PARTIES} SELECT invoice_key, tenant_id, customer_id AS existing_customer_id, customer_by AS matched_by FROM r",
)
def resolve_customers(spark, sf_dir):
    return match.resolve_customers(printed_parties(spark, sf_dir), table(spark, sf_dir, "customers"))


@query(
    "vendor_candidates",
    """WITH d AS (SELECT DISTINCT tenant_id, lower(vendor_name) AS searched_name FROM {invoice_prints}),
            m AS (SELECT d.*, c.id, cast(row_number() OVER (PARTITION BY d.tenant_id, searched_name ORDER BY c.id) as int) AS rank
                  FROM d JOIN {companies} c ON c.is_active AND c.tenant_id = d.tenant_id AND contains(lower(c.name), searched_name))
       SELECT * FROM m WHERE rank <= 5""",
)
def vendor_candidates(spark, sf_dir):
    return match.name_candidates(printed_parties(spark, sf_dir), table(spark, sf_dir, "companies"), match.VENDOR)


@query(
    "enhance_from_dimensions",
    f"""{_PARTIES}
    SELECT invoice_key, r.tenant_id, company_id, customer_id,
           coalesce(nullif(vendor_phone, ''), c.phone, '') AS vendor_phone, coalesce(nullif(vendor_email, ''), c.email, '') AS vendor_email,
           coalesce(nullif(vendor_address_line1, ''), c.address_line1, '') AS vendor_address_line1,
           CASE WHEN vendor_address_line1 = '' AND c.address_line1 <> '' THEN c.city ELSE '' END AS vendor_city,
           CASE WHEN vendor_address_line1 = '' AND c.address_line1 <> '' THEN c.state_province ELSE '' END AS vendor_state_province,
           CASE WHEN vendor_address_line1 = '' AND c.address_line1 <> '' THEN c.postal_code ELSE '' END AS vendor_postal_code,
           CASE WHEN vendor_address_line1 = '' AND c.address_line1 <> '' THEN c.country ELSE '' END AS vendor_country,
           coalesce(nullif(customer_email, ''), u.email, '') AS customer_email, coalesce(u.phone, '') AS customer_phone,
           coalesce(nullif(terms, ''), 'Net ' || u.payment_terms_days, '') AS payment_terms
    FROM r LEFT JOIN {{companies}} c ON c.id = company_id LEFT JOIN {{customers}} u ON u.id = customer_id""",
)
def enhance_from_dimensions(spark, sf_dir):
    return match.enhance_from_dimensions(
        printed_parties(spark, sf_dir), table(spark, sf_dir, "companies"), table(spark, sf_dir, "customers")
    )


def _upsert_sql(party: match.Party, dimension: str, match_column: str) -> str:
    order = "ORDER BY created_at DESC, invoice_key DESC"
    last = ", ".join(
        f"first(nullif({s}, '') {order}) FILTER (WHERE {s} <> '') AS {t}" for s, t in party.attributes
    )
    new = ", ".join(f"arg_min({s}, invoice_key) AS {t}" for s, t in party.attributes + party.when_created)
    targets, first = [t for _, t in party.attributes], [t for _, t in party.when_created]
    return f"""{_PARTIES},
        changes AS (SELECT {match_column} AS id, {last} FROM r WHERE {match_column} IS NOT NULL GROUP BY {match_column}),
        created AS (SELECT concat('{party.prefix}', min(invoice_key)) AS id, tenant_id, true AS is_active, {new}, true AS is_new
                    FROM r WHERE {match_column} IS NULL GROUP BY tenant_id, lower(trim({party.name})))
        SELECT d.id, d.tenant_id, d.is_active, {', '.join(f'coalesce(c.{t}, d.{t}) AS {t}' for t in targets)},
               {', '.join(f'd.{t}' for t in first)}, false AS is_new
        FROM {{{dimension}}} d LEFT JOIN changes c ON c.id = d.id
        UNION ALL SELECT id, tenant_id, is_active, {', '.join(targets + first)}, is_new FROM created"""


@query("upsert_vendors", _upsert_sql(match.VENDOR, "companies", "company_id"))
def upsert_vendors(spark, sf_dir):
    return match.upsert(printed_parties(spark, sf_dir), table(spark, sf_dir, "companies"), match.VENDOR)


@query("upsert_customers", _upsert_sql(match.CUSTOMER, "customers", "customer_id"))
def upsert_customers(spark, sf_dir):
    return match.upsert(printed_parties(spark, sf_dir), table(spark, sf_dir, "customers"), match.CUSTOMER)


def _duplicates_sql(dimension: str, same: dict[str, str], threshold: float, containment: bool) -> str:
    place = "address_line1, city, postal_code"
    held = "WHEN contains(a.name, b.name) OR contains(b.name, a.name) THEN 0.8" if containment else ""
    groups = [
        f"""SELECT tenant_id, id, first AS duplicate_of, '{rule}' AS rule
            FROM (SELECT *, min(id) OVER (PARTITION BY tenant_id, {value}) AS first FROM {{{dimension}}} WHERE {value} <> '') g WHERE id > first"""
        for rule, value in same.items()
    ]
    return f"""WITH n AS (SELECT tenant_id, {place}, lower(trim(name)) AS name, min(id) AS first_id FROM {{{dimension}}} GROUP BY ALL),
        w AS (SELECT *, list_distinct(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '')) AS words FROM n),
        s AS (SELECT a.tenant_id, greatest(a.first_id, b.first_id) AS id, least(a.first_id, b.first_id) AS duplicate_of,
                     CASE {held} WHEN true THEN len(list_intersect(a.words, b.words))::double / len(list_distinct(list_concat(a.words, b.words))) END AS score
              FROM w a JOIN w b ON a.tenant_id = b.tenant_id AND a.address_line1 IS NOT DISTINCT FROM b.address_line1
                   AND a.city IS NOT DISTINCT FROM b.city AND a.postal_code IS NOT DISTINCT FROM b.postal_code AND a.name < b.name)
        {' UNION ALL '.join(groups)}
        UNION ALL SELECT tenant_id, id, first AS duplicate_of, 'name_and_address' AS rule
            FROM (SELECT *, min(id) OVER (PARTITION BY tenant_id, {place}, lower(trim(name))) AS first FROM {{{dimension}}}) g WHERE id > first
        UNION ALL SELECT tenant_id, id, duplicate_of, 'similar_name' AS rule FROM s WHERE score > {threshold}"""


@query("vendor_duplicate_pairs", _duplicates_sql("companies_dirty", {"name": "lower(name)", "tax_id": "tax_id"}, 0.8, True))
def vendor_duplicate_pairs(spark, sf_dir):
    return party_duplicates.vendor_duplicates(table(spark, sf_dir, "companies_dirty"))


@query("customer_duplicate_pairs", _duplicates_sql("customers_dirty", {"email": "lower(email)", "tax_id": "tax_id"}, 0.9, False))
def customer_duplicate_pairs(spark, sf_dir):
    return party_duplicates.customer_duplicates(table(spark, sf_dir, "customers_dirty"))


def _groups_sql(*args):
    return f"""WITH RECURSIVE link AS ({_duplicates_sql(*args)}),
        either AS (SELECT tenant_id, id AS a, duplicate_of AS b FROM link UNION SELECT tenant_id, duplicate_of, id FROM link),
        reach AS (SELECT tenant_id, a AS id, a AS other FROM either UNION SELECT r.tenant_id, r.id, l.b FROM reach r JOIN either l ON l.a = r.other)
        SELECT tenant_id, id, min(other) AS group_id, count(*) AS members FROM reach GROUP BY tenant_id, id"""


@query("vendor_duplicate_groups", _groups_sql("companies_dirty", {"name": "lower(name)", "tax_id": "tax_id"}, 0.8, True))
def vendor_duplicate_groups(spark, sf_dir):
    return party_groups.vendor_groups(table(spark, sf_dir, "companies_dirty"))


@query("customer_duplicate_groups", _groups_sql("customers_dirty", {"email": "lower(email)", "tax_id": "tax_id"}, 0.9, False))
def customer_duplicate_groups(spark, sf_dir):
    return party_groups.customer_groups(table(spark, sf_dir, "customers_dirty"))
