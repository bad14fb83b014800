"""ticketscope: DataFrame operators for support-ticket classification logs.

Every operator takes DataFrames (plus keyword parameters) and returns a
DataFrame. Results that depend on "now" take an explicit ``as_of`` which
may be a literal timestamp or a Column (for instance a scalar subquery
``df.select(F.max("ts")).scalar()``), so the whole computation stays one
Catalyst plan.
"""

from ticketscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
