"""Canonical shop-event schema and the fixed values every metric shares."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType, LongType, MapType, StringType, StructField, StructType,
    TimestampNTZType,
)

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced, so they are
# stated here once, plainly, in their natural order.
# ---------------------------------------------------------------------------
PRODUCT_VIEWED = "product_viewed"
CART_ADDED = "cart_added"
CART_REMOVED = "cart_removed"
PURCHASE_COMPLETED = "purchase_completed"
PAYMENT_FAILED = "payment_failed"
EVENT_TYPES = (PRODUCT_VIEWED, CART_ADDED, CART_REMOVED, PURCHASE_COMPLETED, PAYMENT_FAILED)

UNKNOWN = "unknown"            # default for a missing event_type / user_id / product_name
FEED_DEFAULT_NAME = "Item"     # default product name inside the live feed
FEED_ERROR_SUBTITLE = "Processing error"
FEED_TIME_LABEL = "Just now"
CURRENCY = "INR"
CURRENCY_SIGN = "₹"       # the rupee sign
ACTIVE_WINDOW_LABEL = "last 5 minutes"

# feed type, title per feed-worthy event type
FEED_KINDS = {
    PURCHASE_COMPLETED: ("purchase", "Purchase Completed"),
    CART_ADDED: ("cart", "Cart Added"),
    PAYMENT_FAILED: ("error", "Payment Failed"),
}

# dashboard breakdown: label and colour of the three charted types
BREAKDOWN = (
    (PRODUCT_VIEWED, "Page Views", "#8ed5ff"),
    (CART_ADDED, "Cart Additions", "#bdc2ff"),
    (PURCHASE_COMPLETED, "Purchases", "#10b981"),
)

TOP_PRODUCTS_LIMIT = 10
REVENUE_HISTORY_LIMIT = 20
RECENT_EVENTS_LIMIT = 15
ACTIVE_GAP_SECONDS = 300

# Our own choice (not the reference's): how the driver's `events` table maps
# onto shop events.  signup -> cart_removed only fills the fifth type.
SOURCE_TYPE_MAP = {
    "view": PRODUCT_VIEWED,
    "click": CART_ADDED,
    "signup": CART_REMOVED,
    "purchase": PURCHASE_COMPLETED,
    "error": PAYMENT_FAILED,
}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
# Canonical event every metric takes.  `seq` is a total-order tie breaker
# (the arrival order); `ts` is event time.
CANONICAL_SCHEMA = StructType([
    StructField("seq", LongType()),
    StructField("event_id", StringType()),
    StructField("event_type", StringType()),
    StructField("user_id", StringType()),
    StructField("product_id", StringType()),
    StructField("product_name", StringType()),
    StructField("price", DoubleType()),
    StructField("quantity", LongType()),
    StructField("ts", TimestampNTZType()),
    StructField("metadata", MapType(StringType(), StringType())),
])
CANONICAL_COLUMNS = [f.name for f in CANONICAL_SCHEMA.fields]
