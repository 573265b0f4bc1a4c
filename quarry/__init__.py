"""quarry: text and vector retrieval operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames. A batch of queries is a
table; a single query is the one-row special case. Heavy work stays in Spark
plans (joins, aggregations, windows) or MLlib fits.
"""

from quarry.session import build_session, checked_broadcast, checkpoint_dir, load_tables

__all__ = ["build_session", "checked_broadcast", "checkpoint_dir", "load_tables"]
