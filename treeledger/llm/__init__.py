"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""

MODULES = ("mixing", "langid", "urlfilter", "neardup", "merkle", "packing", "sharding", "suffixes", "jaccard", "extraction", "manifest", "codes", "chat")


def load():
    """Import every query module and return the filled registry."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
