"""proselens: text-quality analytics for generated product texts, on Spark.

The package is a set of ``DataFrame -> DataFrame`` operators and ``Column``
builders.  Everything on the default path is a native Spark expression so that
Catalyst can prune, push down and code-generate it; user models plug in
through ``mapInPandas`` hooks only.

Layout
------
functions/   Column builders (text, tolerant JSON, scoring rules, vectors)
sources/     readers for product exports, descriptors, gold texts, replies,
             and the stand-in views built from the driver test tables
operators/   DataFrame operators (catalogue, requests, replies, similarity,
             duplicate detection, reports)
plans/       compositions of operators (evaluation, iteration results, reports)
sinks/       writers (results, aggregates, summaries, history)
streaming/   the same stateless reply scoring applied to a stream of replies
"""

from proselens.config import EvalConfig
from proselens.session import build_session, checkpoint_dir

__all__ = ["EvalConfig", "build_session", "checkpoint_dir"]
