"""windlass.streaming.

The reference has no streaming sources, watermarks, state or late-data handling, so this
package holds no operators. The row-level functions in ``windlass.functions`` are plain
column expressions and apply unchanged to streaming DataFrames.
"""
