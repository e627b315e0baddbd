"""Named queries over the supplied tables, each beside the SQL it must equal."""


def load():
    """Import every query module and return the filled registry."""
    from . import (  # noqa: F401
        registry,
        scalar_queries,
        snapshot_queries,
        change_queries,
        set_queries,
        history_queries,
        text_queries,
        review_queries,
    )

    return registry
