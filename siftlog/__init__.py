"""Log anomaly analytics on Spark DataFrames."""

from .config import Settings, settings

__all__ = ["Settings", "settings", "analyze", "detect", "parse_logs", "read_logs"]


def __getattr__(name):
    if name in ("analyze", "detect", "parse_logs"):
        from .plans import analyze as m

        return getattr(m, name)
    if name == "read_logs":
        from .sources.readers import read_logs

        return read_logs
    raise AttributeError(name)
