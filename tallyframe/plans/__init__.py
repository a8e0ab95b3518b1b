"""Registered queries, by area."""

from importlib import import_module

AREAS = [
    "attempt_queries", "aggregate_queries", "ngram_queries", "table_queries", "prompt_queries", "join_queries",
    "filter_queries", "text_queries", "math_queries", "code_queries", "corpus_queries", "stream_queries", "round_trip_queries",
]


def load_all():
    for area in AREAS:
        try:
            import_module(f"{__name__}.{area}")
        except ModuleNotFoundError as e:
            if not str(e.name).endswith(area):
                raise
    return import_module(f"{__name__}.registry")
