"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage. Modules that run code on executors need the
package on the executors' Python path (``spark.submit.pyFiles`` or an installed wheel).
"""
