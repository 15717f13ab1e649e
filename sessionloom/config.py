"""Every parameter of the recommender, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Event types and their ids.
TYPES = ("clicks", "carts", "orders")
CLICKS, CARTS, ORDERS = range(3)


@dataclass(frozen=True)
class CoEvent:
    """A kind of co-event: first type, second types, longest time between (s), least count, items kept per item."""

    first: int
    second: tuple[int, ...]
    within: int
    min_count: int
    first_n: int


# The five kinds.
CO_EVENTS = {
    "click_to_click": CoEvent(CLICKS, (CLICKS,), 43_200, 10, 10),
    "click_to_cart_or_buy": CoEvent(CLICKS, (CARTS, ORDERS), 86_400, 5, 10),
    "cart_to_cart": CoEvent(CARTS, (CARTS,), 86_400, 2, 20),
    "cart_to_buy": CoEvent(CARTS, (ORDERS,), 86_400, 2, 20),
    "buy_to_buy": CoEvent(ORDERS, (ORDERS,), 86_400, 2, 20),
}


@dataclass(frozen=True)
class Config:
    co_events: dict[str, CoEvent] = field(default_factory=lambda: dict(CO_EVENTS))
    max_time_to_next: int = 86_400
    last_events: int = 99
    most_frequent: int = 99
    top_quantile: float = 0.9999
    trim_first: int = 20
    trim_least: int = 3
    trim_at_order: int = 20
    vector_size: int = 100
    window_size: int = 10
    min_item_count: int = 5
    knn: int = 20
    knn_items: int = 600_000
    ivf_cells: int = 100
    ivf_probes: int = 3
    ivf_recall: float = 0.97
    ivf_audit: int = 256
    clusters: int = 50
    kmeans_iterations: int = 100
    kmeans_tolerance: float = 1e-3
    type_weights: tuple[float, ...] = (0.1, 0.3, 0.6)
    weight_days: int = 3
    weight_floor: float = 0.10
    popular_days: int = 7
    popular_clip: int = 999
    popular_keep: int = 20
    no_order: int = 999
    negatives_per_positive: int = 40
    max_negatives: int = 100
    keep_top_k: int = 20
    truth_cap: int = 20
    trees: int = 150
    tree_depth: int = 4
    step_size: float = 0.25
    column_share: float = 0.25
    row_share: float = 0.5
    min_leaf_rows: int = 20
    seed: int = 42

    def with_min_count(self, n: int) -> Config:
        """The same with one least count for all co-events, for small data."""
        from dataclasses import replace

        return replace(self, co_events={k: replace(c, min_count=n) for k, c in self.co_events.items()})
