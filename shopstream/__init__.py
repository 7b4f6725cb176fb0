"""shopstream: shop-event analytics as Spark DataFrame plans.

Every metric maps canonical events (see ``schema.CANONICAL_SCHEMA``) to a
DataFrame; nothing is collected.  The common entry points::

    from shopstream import shop_events, dashboard, top_products, purchases
    events = shop_events(spark, "/path/to/tables")
    dashboard(events).show(truncate=False)
"""

__version__ = "0.1.0"

from .operators.active_users import active_users_now, active_users_sliding, global_sessions  # noqa: E402
from .operators.counts import (  # noqa: E402
    cart_abandonment, event_breakdown, event_counts, events_by_type, failed_payment_rate,
    kpi_aggregates, revenue_total,
)
from .operators.enrich import enrich_events  # noqa: E402
from .operators.events import dedupe_events, purchases, with_amount  # noqa: E402
from .operators.feed import feed_age, recent_events  # noqa: E402
from .operators.products import product_counts, top_products, top_products_percent  # noqa: E402
from .operators.revenue import (  # noqa: E402
    revenue_by_period, revenue_by_window, revenue_history, revenue_running,
)
from .operators.trend import kpi_trend  # noqa: E402
from .plans.dashboard import dashboard, dashboard_json, kpi_text, kpis  # noqa: E402
from .sources.adapters import sales, shop_events  # noqa: E402
from .sources.json_events import (  # noqa: E402
    parse_lenient, rejected_events, to_wire, valid_events, validate_strict,
)

__all__ = [
    "active_users_now", "active_users_sliding", "global_sessions",
    "cart_abandonment", "event_breakdown", "event_counts", "events_by_type", "failed_payment_rate",
    "kpi_aggregates", "revenue_total", "enrich_events", "dedupe_events", "purchases", "with_amount",
    "feed_age", "recent_events", "product_counts", "top_products", "top_products_percent",
    "revenue_by_period", "revenue_by_window", "revenue_history", "revenue_running", "kpi_trend",
    "dashboard", "dashboard_json", "kpi_text", "kpis", "sales", "shop_events",
    "parse_lenient", "rejected_events", "to_wire", "valid_events", "validate_strict",
]
