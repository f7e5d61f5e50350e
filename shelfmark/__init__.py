"""shelfmark: retail stock, order and revenue analytics as Spark jobs.

Modules:
    schemas                 declared schemas, defaults and constraints of the 7 model tables
    session                 session settings and the shared checkpoint folder
    sources.tables          the ``Tables`` model, load / save in any format, versions, bucketing
    sources.fixtures        the model derived from TPC-H-style driver tables
    sources.sql             temp views and parameterised SQL
    sources.loading         checked load and versioned publish
    plans.views / reports   the 19 reports (lazy DataFrames)
    operators.changes       batch change operators (append, update, delete, insert-ignore)
    operators.quality       constraint checks
    operators.lookups       set-wise lookups
    operators.keys          dense keys and latest-row-per-key
    streaming.stock_stream  the streaming stock job
"""

__version__ = "0.1.0"
