"""All registered queries."""

from seatwise.plans import booking_queries, case_queries, decision_queries, menu_queries, state_queries

REGISTRIES = [booking_queries.registry, menu_queries.registry, case_queries.registry, decision_queries.registry,
              state_queries.registry]
