"""Records as tables and as text, on Spark.

``sources``    typed CSV, JDBC options, image files, event frames, vector store
``functions``  column expressions: templates, vectors, JSON, paths, links, log lines
``operators``  DataFrame -> DataFrame jobs: quality, top-k, embedding, context, events
``plans``      the SQL tool, and the queries registered for checking
``streaming``  the incremental forms
"""
