"""Training-data operators.

Nothing else in the library imports this subpackage. Every operator takes
and returns DataFrames; fixed-size statistics are the only things that
reach the driver.
"""
