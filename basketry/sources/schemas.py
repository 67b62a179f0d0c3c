"""Columns the jobs read from each CSV export, with their types.

The exports are read with ``header=true`` and every column as text (no
inference pass over the data); the used columns are then selected **by header
name** and cast, so the column order of a table and any extra columns in it do
not matter. The files of one table must agree on the header.
"""

from __future__ import annotations

# Header names in the source files -> (library name, Spark type).
ORDERS = {
    "order_id": ("order_id", "string"),
    "customer_id": ("customer_id", "string"),
    "order_status": ("order_status", "string"),
    "order_purchase_timestamp": ("purchase_ts", "day_first"),
    "order_approved_at": ("approved_ts", "day_first"),
    "order_delivered_carrier_date": ("carrier_ts", "day_first"),
    "order_delivered_customer_date": ("delivered_ts", "day_first"),
    "order_estimated_delivery_date": ("estimated_ts", "day_first"),
}
PAYMENTS = {
    "order_id": ("order_id", "string"),
    "payment_type": ("payment_type", "string"),
    "payment_installments": ("payment_installments", "int"),
    "payment_value": ("payment_value", "double"),
}
CUSTOMERS = {
    "customer_id": ("customer_id", "string"),
    "customer_unique_id": ("customer_unique_id", "string"),
}
REVIEWS = {
    "order_id": ("order_id", "string"),
    "review_score": ("review_score", "int"),
}
REVIEW_COMMENT = {"review_comment_message": ("review_comment", "string")}
ITEMS = {
    "order_id": ("order_id", "string"),
    "order_item_id": ("order_item_id", "int"),
    "product_id": ("product_id", "string"),
    "seller_id": ("seller_id", "string"),
    "shipping_limit_date": ("shipping_limit_ts", "day_first"),
    "price": ("price", "double"),
    "freight_value": ("freight_value", "double"),
}

ORDER_TIMESTAMP_HEADERS = tuple(h for h, (_, t) in ORDERS.items() if t == "day_first")
