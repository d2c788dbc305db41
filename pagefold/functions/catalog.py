"""The field types, their tasks and families."""

from __future__ import annotations

# Page-level field types.
KILE = """account_num amount_due amount_paid amount_total_gross amount_total_net amount_total_tax bank_num bic currency_code_amount_due
customer_billing_address customer_billing_name customer_delivery_address customer_delivery_name customer_id customer_order_id customer_other_address
customer_other_name customer_registration_id customer_tax_id date_due date_issue document_id iban order_id payment_reference payment_terms
tax_detail_gross tax_detail_net tax_detail_rate tax_detail_tax vendor_address vendor_email vendor_name vendor_order_id vendor_registration_id vendor_tax_id""".split()

# Row-grouped field types.
LIR = """line_item_amount_gross line_item_amount_net line_item_code line_item_currency line_item_date line_item_description line_item_discount_amount
line_item_discount_rate line_item_hts_number line_item_order_id line_item_person_name line_item_position line_item_quantity line_item_tax line_item_tax_rate
line_item_unit_price_gross line_item_unit_price_net line_item_units_of_measure line_item_weight""".split()

# Page-level types that a page may have more than once.
MULTI = "tax_detail_gross tax_detail_net tax_detail_rate tax_detail_tax".split()

# The field types of each validator.
FAMILIES = {
    "iban": ["iban"],
    "bic": ["bic"],
    "email": ["vendor_email"],
    "quantity": ["line_item_quantity"],
    "position": ["line_item_position"],
    "amount": """amount_due amount_paid amount_total_gross amount_total_net amount_total_tax tax_detail_gross tax_detail_net tax_detail_tax
    line_item_amount_gross line_item_amount_net line_item_unit_price_gross line_item_unit_price_net line_item_tax line_item_discount_amount""".split(),
    "rate": "tax_detail_rate line_item_tax_rate line_item_discount_rate".split(),
    "date": "date_due date_issue line_item_date".split(),
    "tax_id": "vendor_tax_id customer_tax_id".split(),
    "registration_id": "vendor_registration_id customer_registration_id".split(),
    "currency": "currency_code_amount_due line_item_currency".split(),
}

AMOUNT_FIELDS = "amount_due amount_paid amount_total_gross amount_total_net amount_total_tax tax_detail_gross tax_detail_net tax_detail_tax".split()

# Types that a second pass looks for.
TARGETED = """account_num bank_num bic iban vendor_registration_id customer_registration_id vendor_tax_id customer_tax_id
tax_detail_gross tax_detail_net tax_detail_rate tax_detail_tax""".split()

# Types with weak classifiers, besides all row-grouped ones.
WEAK = """bic customer_delivery_name customer_registration_id customer_tax_id iban line_item_discount_amount line_item_discount_rate line_item_person_name
line_item_weight tax_detail_rate vendor_registration_id""".split()


def rows() -> list[tuple[str, str, bool, str | None, bool, bool]]:
    """(fieldtype, task, multi, family, targeted, weak) of every type, by name."""
    family = {t: f for f, types in FAMILIES.items() for t in types}
    return [(t, "kile" if t in KILE else "lir", t in MULTI, family.get(t), t in TARGETED, t in WEAK or t in LIR) for t in sorted(KILE + LIR)]
