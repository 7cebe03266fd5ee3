"""Training-data pipeline operators (quality, de-duplication, tokens, archives).

Nothing outside this subpackage imports it except ``__spark_entry__.py`` (which
tolerates its absence) and ``corpus_pipeline.py``.
"""
