"""The registered queries: every operator applied to flows that Spark derives from the given tables."""


def load() -> None:
    """Import the query modules (each registers its queries)."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
