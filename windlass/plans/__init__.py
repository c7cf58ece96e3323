"""Query plans: public report functions and the registered query catalogue."""


def load_all():
    """Import every plan module so that its queries register themselves."""
    from windlass.plans import (events, io_queries, model_queries, normals, reports, state_queries,  # noqa: F401
                                station_queries, wind)
    from windlass.plans.registry import QUERIES
    return QUERIES
