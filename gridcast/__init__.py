"""gridcast: hourly demand joins, profiles, labels and regional forecasting on Spark DataFrames."""

from gridcast.session import local_session, scratch_dir

__all__ = ["local_session", "scratch_dir"]
