"""Importing this module registers every query of the catalogue."""

from . import (action_queries, alignment_queries, io_queries, label_queries,  # noqa: F401
               metric_queries, misc_queries, model_queries, policy_queries, quality_queries, rfm_queries,
               sim_queries, stream_queries)
