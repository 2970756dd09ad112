"""All registered queries of the library but those of ``tendon.llm``."""

from tendon.jobs import conversion_queries, curation_queries, dataset_queries, filmed_queries, motion_queries, pose_queries, profile_queries, stream_queries, validation_queries, video_queries

_MODULES = (motion_queries, pose_queries, validation_queries, profile_queries, dataset_queries, video_queries, filmed_queries, curation_queries, conversion_queries, stream_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
