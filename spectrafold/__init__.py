"""Spectra analytics as Spark DataFrame operators.

``sources``    reads instrument files, sample sheets and plate tables, writes figure rows
``functions``  column expressions: NA-strict aggregates, labels, rounding
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole analyses composed from the operators
"""
