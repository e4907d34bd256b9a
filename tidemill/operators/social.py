"""Conversation threads."""

from __future__ import annotations

from tidemill.operators.base import operator


@operator("social_entities")
def keep_first(d):
    """WIN-04: the first occurrence of each platform id, never by text."""
    return f"""SELECT natural_key, conversation_id, kind, text_sha FROM (SELECT natural_key, conversation_id, kind, {d.sha("text")} AS text_sha, row_number() OVER (PARTITION BY natural_key ORDER BY conversation_id, kind, text) AS r FROM @social_entities) x WHERE r = 1"""


@operator("social_entities")
def thread_completeness(d):
    """AGG-42: per conversation: entities loaded, and replies whose parent is missing."""
    return """SELECT e.conversation_id, count(*) AS loaded, count_if(e.reply_to_id IS NOT NULL AND p.natural_key IS NULL) AS unresolved, count_if(e.reply_to_id IS NOT NULL AND p.natural_key IS NULL) = 0 AS complete
    FROM @social_entities e LEFT JOIN (SELECT DISTINCT natural_key FROM @social_entities) p ON e.reply_to_id = p.natural_key GROUP BY e.conversation_id"""


@operator("social_entities")
def collect_incremental(d):
    """SET-03: the union of all pages, deduped by id; duplicates are counted, not lost."""
    return "SELECT conversation_id, count(*) AS seen, count(DISTINCT natural_key) AS resolved, count(*) - count(DISTINCT natural_key) AS duplicates FROM @social_entities GROUP BY conversation_id"


@operator("social_entities")
def resume_collection(d):
    """STR-08, batch form: where to go on in each conversation."""
    return "SELECT conversation_id, max_by(natural_key, length(natural_key) * 1000 + CAST(split_part(natural_key, '-', 2) AS INT)) AS latest_id, count(*) AS entities FROM @social_entities GROUP BY conversation_id"
