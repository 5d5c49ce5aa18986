"""All registered queries of the reference's operators."""

from tessera.plans import agent_queries, episode_queries, extension_queries, reward_queries, rollout_queries, row_queries, series_queries, source_queries, stream_queries, text_queries, token_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
