"""Vendors and customers named on invoices, found in the stored tables.

Invoices repeat few parties, so matching works on the distinct parties of a
batch and the result is attached to the invoices afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.functions.text import filled, strip
from billwright.operators.skew import attach
from billwright.session import staged


@dataclass(frozen=True)
class Party:
    """Columns of a party on an invoice and of its stored table.

    ``exact`` are (invoice column, stored column, ignore case), tried in order
    before the name. ``attributes`` are (invoice column, stored column); a pair
    counts only where both tables have it. ``when_created`` are set on new rows
    alone, ``defaults`` are what a new row has in other columns.
    """

    name: str
    exact: tuple
    attributes: tuple
    prefix: str
    needs_name: bool
    when_created: tuple = ()
    defaults: tuple = ()


VENDOR = Party(
    name="vendor_name",
    exact=(("vendor_tax_id", "tax_id", False),),
    attributes=(
        ("vendor_name", "name"),
        ("vendor_tax_id", "tax_id"),
        ("vendor_email", "email"),
        ("vendor_phone", "phone"),
        ("vendor_address_line1", "address_line1"),
        ("vendor_website", "website"),
        ("vendor_city", "city"),
        ("vendor_state_province", "state_province"),
        ("vendor_postal_code", "postal_code"),
        ("vendor_country", "country"),
    ),
    prefix="CO-new-",
    needs_name=True,
    when_created=(("company_confidence", "confidence_score"),),
    defaults=(("currency", "USD"),),
)
CUSTOMER = Party(
    name="customer_name",
    exact=(("customer_email", "email", True), ("customer_tax_id", "tax_id", False)),
    attributes=(
        ("customer_name", "name"),
        ("customer_email", "email"),
        ("customer_phone", "phone"),
        ("billing_address_line1", "billing_address_line1"),
        ("customer_tax_id", "tax_id"),
        ("customer_company_name", "company_name"),
        ("billing_city", "billing_city"),
        ("billing_state_province", "billing_state_province"),
        ("billing_postal_code", "billing_postal_code"),
        ("billing_country", "billing_country"),
    ),
    prefix="CU-new-",
    needs_name=False,
    when_created=(("customer_confidence", "confidence_score"),),
    defaults=(("customer_type", "individual"),),
)


#: Letters of the parts that stored names are listed under.
GRAM = 4


def active(dimension: DataFrame) -> DataFrame:
    return dimension.where(F.col("is_active"))


def blank_keys(invoices: DataFrame, party: Party) -> DataFrame:
    """The invoices with '' for null, and for what they don't have, in the columns that tell parties apart."""
    keys = [k for k in party_keys(party) if k != "tenant_id"]
    return invoices.withColumns({k: F.coalesce(k, F.lit("")) if k in invoices.columns else F.lit("") for k in keys})


def _grams(text: Column, size: int) -> Column:
    """The distinct parts of ``size`` letters, none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, parts).otherwise(F.array().cast("array<string>"))


def name_hits(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """tenant_id, part, id: the stored names that hold each of the searched ``names`` (tenant_id, part).

    Stored names are listed under their parts of ``GRAM`` letters. A searched
    name looks under its rarest part only, and what it finds is checked. Names
    shorter than a part are looked up among the parts of their length.
    """
    stored = active(dimension).select("tenant_id", "id", F.lower("name").alias("stored"))
    listed = stored.select("*", F.explode(_grams(F.col("stored"), GRAM)).alias("gram"))
    counts = listed.groupBy("tenant_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = names.where(F.length("part") >= GRAM).select("*", F.explode(_grams(F.col("part"), GRAM)).alias("gram"))
    rarest = (
        asked.join(counts, ["tenant_id", "gram"], "left")  # a part that no name has is the rarest
        .groupBy("tenant_id", "part")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).getField("gram").alias("gram"))
    )
    found = rarest.join(listed, ["tenant_id", "gram"]).where(F.col("stored").contains(F.col("part")))
    short = names.where(F.length("part").between(1, GRAM - 1))
    all_short = F.flatten(F.array(*[_grams(F.col("stored"), n) for n in range(1, GRAM)]))
    short_found = stored.select("tenant_id", "id", F.explode(all_short).alias("part")).join(short, ["tenant_id", "part"], "left_semi")
    return found.select("tenant_id", "part", "id").unionByName(short_found.select("tenant_id", "part", "id"))


def match_parties(parties: DataFrame, dimension: DataFrame, party: Party) -> DataFrame:
    """Distinct parties with ``match_id`` and ``matched_by``.

    The first exact rule that finds a stored row wins, then the containment
    of the name; among several rows the smallest id.
    """
    stored = active(dimension)
    found, ids, labels = parties, [], []
    for on_invoice, in_table, ignore_case in party.exact:
        if in_table not in dimension.columns or on_invoice not in parties.columns:
            continue
        fold = F.lower if ignore_case else (lambda c: c)
        key, hit = f"_key_{in_table}", f"_id_{in_table}"
        firsts = (
            stored.where(F.length(in_table) > 0)
            .groupBy("tenant_id", fold(F.col(in_table)).alias(key))
            .agg(F.min("id").alias(hit))
        )
        found = found.withColumn(key, filled(fold(F.col(on_invoice)))).join(firsts, ["tenant_id", key], "left").drop(key)
        ids.append(hit)
        labels.append(in_table)
    named = parties.where(F.length(party.name) > 0)
    names = named.select("tenant_id", F.lower(party.name).alias("part")).distinct()
    by_name = name_hits(dimension, names).groupBy("tenant_id", "part").agg(F.min("id").alias("_id_name"))
    by_name = by_name.withColumnRenamed("part", "_part")
    found = found.withColumn("_part", filled(F.lower(party.name))).join(by_name, ["tenant_id", "_part"], "left").drop("_part")
    ids, labels = [*ids, "_id_name"], [*labels, "name"]
    match_id = F.coalesce(*ids)
    if party.needs_name:
        match_id = F.when(F.length(party.name) > 0, match_id)
    return found.withColumn("match_id", match_id).withColumn(
        "matched_by",
        F.when(F.col("match_id").isNotNull(), F.coalesce(*[F.when(F.col(i).isNotNull(), F.lit(n)) for i, n in zip(ids, labels)])),
    ).drop(*ids)


def name_candidates(parties: DataFrame, dimension: DataFrame, party: Party, limit: int = 5) -> DataFrame:
    """Up to ``limit`` stored rows whose name holds the searched name, per distinct name."""
    names = parties.where(F.length(party.name) > 0).select("tenant_id", F.lower(party.name).alias("part")).distinct()
    hits = name_hits(dimension, names)
    rank = F.row_number().over(Window.partitionBy("tenant_id", "part").orderBy("id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnRenamed("part", "searched_name")


def party_keys(party: Party) -> list[str]:
    return ["tenant_id", party.name, *[e[0] for e in party.exact]]


def resolve(invoices: DataFrame, dimension: DataFrame, party: Party, stored_columns: list[str]) -> DataFrame:
    """Invoices with match_id, matched_by and ``stored_columns`` of the match as ``stored_<name>``."""
    keys, invoices = party_keys(party), blank_keys(invoices, party)
    parties = staged(invoices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "parties")
    matched = match_parties(parties, dimension, party)
    stored = dimension.select(F.col("id").alias("match_id"), *[F.col(c).alias(f"stored_{c}") for c in stored_columns])
    per_party = staged(matched.join(stored, "match_id", "left"), "matched")
    return attach(invoices, per_party, keys, F.col("invoice_key")).drop("n")


def _prefer(extracted: str, stored: str) -> Column:
    return F.coalesce(filled(F.col(extracted)), filled(F.col(stored)), F.lit(""))


def resolve_vendors(invoices: DataFrame, companies: DataFrame) -> DataFrame:
    """Vendor of each invoice; blank street, phone and e-mail come from the stored vendor."""
    rows = resolve(invoices, companies, VENDOR, ["address_line1", "phone", "email"])
    return rows.select(
        "invoice_key",
        "tenant_id",
        F.col("match_id").alias("existing_company_id"),
        "matched_by",
        *[_prefer(f"vendor_{c}", f"stored_{c}").alias(c) for c in ("address_line1", "phone", "email")],
    )


def resolve_customers(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    rows = resolve(invoices, customers, CUSTOMER, [])
    return rows.select("invoice_key", "tenant_id", F.col("match_id").alias("existing_customer_id"), "matched_by")


def enhance_from_dimensions(invoices: DataFrame, companies: DataFrame, customers: DataFrame) -> DataFrame:
    """Blank contact, address and terms filled from the matched vendor and customer."""
    place = ["city", "state_province", "postal_code", "country"]
    rows = resolve(invoices, companies, VENDOR, ["phone", "email", "address_line1", *place])
    no_street = F.coalesce(F.length("vendor_address_line1"), F.lit(0)) == 0
    take_place = no_street & (F.length("stored_address_line1") > 0)
    rows = rows.select(
        *invoices.columns,
        F.col("match_id").alias("company_id"),
        *[_prefer(f"vendor_{c}", f"stored_{c}").alias(f"new_{c}") for c in ("phone", "email", "address_line1")],
        *[F.when(take_place, F.col(f"stored_{c}")).otherwise(F.lit("")).alias(f"new_{c}") for c in place],
    )
    kept = [c for c in rows.columns if c.startswith("new_")] + ["company_id"]
    rows = resolve(rows, customers, CUSTOMER, ["email", "phone", "payment_terms_days"])
    days = F.col("stored_payment_terms_days")
    terms = F.when(days > 0, F.concat(F.lit("Net "), days.cast("string")))
    return rows.select(
        "invoice_key",
        "tenant_id",
        "company_id",
        F.col("match_id").alias("customer_id"),
        *[F.col(c).alias(c.replace("new_", "vendor_")) for c in kept if c != "company_id"],
        _prefer("customer_email", "stored_email").alias("customer_email"),
        _prefer("customer_phone", "stored_phone").alias("customer_phone"),
        F.coalesce(filled(F.col("payment_terms")), terms, F.lit("")).alias("payment_terms"),
    )


def _shared(pairs: tuple, invoices: DataFrame, dimension: DataFrame) -> list[tuple[str, str]]:
    return [(a, b) for a, b in pairs if a in invoices.columns and b in dimension.columns]


def _batch_parties(invoices: DataFrame, dimension: DataFrame, party: Party) -> DataFrame:
    """The distinct parties of a batch, matched once: keys, ``n``, ``_last_<attribute>``, ``_first``, ``match_id``."""
    keys, invoices = party_keys(party), blank_keys(invoices, party)
    latest = [
        F.max(F.when(F.length(a) > 0, F.struct("created_at", "invoice_key", F.col(a).alias("value")))).alias(f"_last_{b}")
        for a, b in _shared(party.attributes, invoices, dimension)
    ]
    new = [F.col(a).alias(b) for a, b in _shared(party.attributes + party.when_created, invoices, dimension)]
    parties = invoices.groupBy(*keys).agg(
        *latest, F.min(F.struct("invoice_key", F.struct(*new).alias("row"))).alias("_first"), F.count(F.lit(1)).alias("n")
    )
    return staged(match_parties(staged(parties, "parties"), dimension, party), "matched")


def _changes(matched: DataFrame) -> DataFrame:
    """id and ``_last_<attribute>``: the newest non-empty values for the stored rows that a batch names."""
    last = [c for c in matched.columns if c.startswith("_last_")]
    return matched.where(F.col("match_id").isNotNull()).groupBy(F.col("match_id").alias("id")).agg(*[F.max(c).alias(c) for c in last])


def _created(matched: DataFrame, party: Party) -> DataFrame:
    """tenant_id, ``_key`` (the name), id and ``row`` of the rows that a batch creates, one per tenant and name."""
    name = F.lower(strip(F.col(party.name)))
    rows = matched.where(F.col("match_id").isNull() & (F.length(name) > 0)).groupBy("tenant_id", name.alias("_key")).agg(F.min("_first").alias("_first"))
    new_id = F.concat(F.lit(party.prefix), F.col("_first.invoice_key").cast("string"))
    return rows.select("tenant_id", "_key", new_id.alias("id"), F.col("_first.row").alias("row"))


def upsert(invoices: DataFrame, dimension: DataFrame, party: Party) -> DataFrame:
    """The stored table after a batch: id, tenant_id, is_active, the party's attributes, is_new.

    A batch has no order of its own: every invoice is matched with the table
    as it was before. Of several invoices for one stored row the newest
    non-empty value per attribute wins (created_at, then invoice_key). Parties
    without a match become one new row per tenant and name, from the smallest
    invoice_key; ``when_created`` columns are set on those alone.
    """
    matched = _batch_parties(invoices, dimension, party)
    pairs, first = _shared(party.attributes, invoices, dimension), _shared(party.when_created, invoices, dimension)
    updated = dimension.join(_changes(matched), "id", "left").select(
        "id",
        "tenant_id",
        "is_active",
        *[F.coalesce(F.col(f"_last_{t}.value"), F.col(t)).alias(t) for _, t in pairs],
        *[t for _, t in first],
        F.lit(False).alias("is_new"),
    )
    created = _created(matched, party).select(
        "id", "tenant_id", F.lit(True).alias("is_active"), *[F.col(f"row.{t}").alias(t) for _, t in pairs + first], F.lit(True).alias("is_new")
    )
    return updated.unionByName(created)


def settle(invoices: DataFrame, dimension: DataFrame, party: Party, column: str) -> tuple[DataFrame, DataFrame]:
    """What a batch makes of its parties, from one match: ids per party, and the stored rows that change.

    The ids are the party's keys, the count ``n`` and ``column``: the matched
    row, else the row created for the name. The changed rows are whole rows of
    ``dimension`` after the batch, created ones among them; rows the batch does
    not name are not in it.
    """
    matched = _batch_parties(invoices, dimension, party)
    created = staged(_created(matched, party), "created")
    name = filled(F.lower(strip(F.col(party.name))))
    ids = (
        matched.withColumn("_key", name)
        .join(created.select("tenant_id", "_key", "id"), ["tenant_id", "_key"], "left")
        .select(*party_keys(party), "n", F.coalesce("match_id", "id").alias(column))
    )
    pairs, first = _shared(party.attributes, invoices, dimension), _shared(party.when_created, invoices, dimension)
    new_values = {t: F.coalesce(F.col(f"_last_{t}.value"), F.col(t)) for _, t in pairs}
    updated = dimension.join(_changes(matched), "id").select(*[new_values.get(c, F.col(c)).alias(c) for c in dimension.columns])
    given = {"id": F.col("id"), "tenant_id": F.col("tenant_id"), "is_active": F.lit(True)}
    given |= {c: F.lit(v) for c, v in party.defaults} | {t: F.col(f"row.{t}") for _, t in pairs + first}
    kinds = {f.name: f.dataType for f in dimension.schema}
    new = created.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in dimension.columns])
    return staged(ids, "entities"), updated.unionByName(new)
