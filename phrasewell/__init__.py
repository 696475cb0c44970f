"""A full-text phrase search engine on Spark DataFrames."""

__all__ = ["Document", "Index", "PhraseSearch", "Result"]


def __getattr__(name: str):
    """The engine is imported when it is first asked for, not in every Python worker."""
    if name in __all__:
        from . import engine

        return getattr(engine, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
