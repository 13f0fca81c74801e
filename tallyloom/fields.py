"""The canonical register: its fields, dimensions, measures and the limits of queries."""

from __future__ import annotations

#: canonical column -> (label, type, role)
FIELDS: dict[str, tuple[str, str, str]] = {
    "sale_date": ("Date", "timestamp_ntz", "required"),
    "category": ("Category", "string", "dimension"),
    "item": ("Item", "string", "dimension"),
    "quantity": ("Quantity", "double", "measure"),
    "selling_price": ("Selling Price", "double", "measure"),
    "cost_price": ("Cost Price", "double", "measure"),
    "line_total": ("Line Total", "double", "measure"),
    "discount": ("Discount", "double", "measure"),
    "tax": ("Tax", "double", "measure"),
    "stock_on_hand": ("Stock On Hand", "double", "measure"),
    "mrp": ("MRP", "double", "measure"),
    "branch": ("Branch", "string", "dimension"),
    "payment_mode": ("Payment Mode", "string", "dimension"),
    "customer": ("Customer", "string", "dimension"),
    "salesperson": ("Salesperson", "string", "dimension"),
    "brand": ("Brand", "string", "dimension"),
    "size": ("Size", "string", "dimension"),
    "colour": ("Colour", "string", "dimension"),
    "invoice_no": ("Invoice No", "string", "dimension"),
}
BY_LABEL = {label: name for name, (label, _, _) in FIELDS.items()}
DIMENSIONS = [name for name, (_, _, role) in FIELDS.items() if role == "dimension"]
TIME_DIMENSIONS = ["day", "weekday", "month"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
UNSPECIFIED = "Unspecified"

#: measure -> (additive, columns that must be there without blanks)
MEASURES: dict[str, tuple[bool, list[str]]] = {
    "revenue": (True, []),
    "profit": (True, ["quantity", "cost_price"]),
    "cost": (True, ["quantity", "cost_price"]),
    "units": (True, ["quantity"]),
    "transactions": (True, []),
    "discount": (True, ["discount"]),
    "margin_pct": (False, ["quantity", "cost_price"]),
    "avg_price": (False, ["quantity"]),
}

MAX_FILTERS, MAX_FILTER_VALUES, MAX_VALUE, MAX_KEY = 8, 5000, 200, 64
TOP_N, MAX_TOP_N = 10, 50
PAGE_SIZE, MAX_PAGE_SIZE = 50, 1000
OPTIONS = 200
HORIZON, MAX_HORIZON = 14, 90
PARETO, ABC = 0.80, (0.80, 0.95)
AGEING = (15, 30, 60)


class QueryError(ValueError):
    """A question that can't be asked of this register."""
