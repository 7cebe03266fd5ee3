"""folio — corpus analytics as Spark DataFrame operators.

Documents, tags, crawl jobs, images and analysis results are tables; every
operator takes DataFrames (plus an explicit ``as_of`` instant where the rules
depend on "now") and returns a DataFrame that Catalyst plans end to end.

    from folio import get_session
    from folio.operators import documents, timeline, merges, jobs, crawl, images, publish, stats
    from folio.functions import normalize_url, slugify, effective_date
"""

from folio.session import checkpoint_dir, configure, get_session, size_partitions

__version__ = "0.1.0"

__all__ = ["configure", "checkpoint_dir", "get_session", "size_partitions", "__version__"]
