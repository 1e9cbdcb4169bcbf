"""Document-table analytics on Spark DataFrames.

A corpus of document-parse responses goes in; tables of elements, cells, captions,
assets, figures, footnotes and quality checks come out.  Every operator is a lazy
``DataFrame -> DataFrame`` function.
"""
