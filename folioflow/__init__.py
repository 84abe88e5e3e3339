"""Document analytics on Spark: blocks, tables, versions, changes and page layout as DataFrame operators."""
