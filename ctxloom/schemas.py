"""Schemas of the stored tables; nothing is inferred."""

FACTS = "id long, scope string, user_id string, agent_id string, session_id string, key string, value string, category string, content_hash string, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, confidence double, metadata map<string,string>"
PATTERNS = "user_id string, agent_id string, pattern_type string, observation_count long, confidence double, description string, created_at timestamp, updated_at timestamp"
INTERACTIONS = "fact_id long, interaction_type string, ts timestamp"
SUMMARIES = "id long, user_id string, agent_id string, session_id string, topic string, content string, entities array<string>, projects array<string>, content_hash string, source_messages int, created_at timestamp, updated_at timestamp, last_accessed_at timestamp"
EMBEDDINGS = "content_hash string, embedding array<float>, created_at timestamp, accessed_at timestamp"
RESULTS = "result_id string, content_hash string, session_id string, tool_use_id string, tool_name string, full_result string, token_count long, created_at timestamp, accessed_at timestamp, expires_at timestamp"
CHUNKS = "chunk_id string, result_id string, chunk_idx int, chunk_text string, token_count long, embedding array<float>, start_offset int, end_offset int"

INTERACTION_TYPES = ("extracted", "retrieved", "reinforced", "corrected", "deleted")
