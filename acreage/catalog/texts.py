"""Messages and articles."""

from __future__ import annotations

from acreage.operators import texts as tx
from acreage.plans.views import table, view, with_views

_MESSAGE = r"regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g')"
_INTENT = (f"CASE WHEN {_MESSAGE} = '' THEN 'empty' "
           + " ".join(f"WHEN contains({_MESSAGE}, '{w}') THEN '{w}'" for w in tx.INTENTS) + " ELSE 'default' END")
_BLOCKS = r""", b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS raw FROM articles),
t AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS block FROM b),
k AS (SELECT doc_id, CASE WHEN regexp_matches(block, '^[A-Z][A-Z\s\d:]+$') AND length(block) < 80 THEN 'heading'
    WHEN regexp_matches(block, '^\d+\.\s+[A-Z]') THEN 'numbered'
    WHEN contains(block, chr(10) || '-') OR starts_with(block, '-') THEN 'bullets'
    WHEN regexp_matches(block, '^[A-Z][a-zA-Z\s]+:') AND length(block) < 100 AND NOT contains(block, '.') THEN 'subheading'
    ELSE 'paragraph' END AS kind FROM t WHERE block <> '')
"""

ENTRIES = {
    "message_intent": (
        lambda s, d: tx.intent(table(s, d, "conversations")).select("conv_id", "turn", "intent"),
        f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations"),
    "intent_counts": (
        lambda s, d: tx.intent_counts(table(s, d, "conversations")),
        f"SELECT {_INTENT} AS intent, count(*) AS n FROM conversations GROUP BY 1"),
    "block_counts": (
        lambda s, d: tx.block_counts(view(s, d, "articles")),
        with_views(_BLOCKS + "SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind", "articles")),
    "block_kinds": (
        lambda s, d: tx.blocks(table(s, d, "documents")).groupBy("kind").count().withColumnRenamed("count", "n"),
        with_views(_BLOCKS.replace("FROM articles", "FROM documents") + "SELECT kind, count(*) AS n FROM k GROUP BY kind", "articles")),
}
