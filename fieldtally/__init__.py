"""Fieldtally: analytics jobs over species-recording data, as PySpark DataFrame functions.

Layers, lowest first:

``functions``  Column expressions (text, dates, attributes, geometry)
``operators``  DataFrame -> DataFrame building blocks (filters, joins, aggregates, spatial joins ...)
``sources``    table readers, cursor reads and sinks
``plans``      the jobs a user runs, and their form over the driver's tables
``streaming``  Structured Streaming alerts
"""
